"""Counts of greedy word pieces by a linear longest-match automaton.

A trie of the vocabulary has, for each node, a failure link to the node where matching goes on when no edge
fits, and the number of pieces that are popped on the way. A word is read once, letter by letter; the
pieces are counted, never built.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomery.llm.shared import map_text

#: Stands before the first letter of a word in the vocabulary.
START = "▁"
#: Words that the memo holds before it starts anew.
MEMO = 300_000


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that stand for text; those that begin a word begin with START."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    """count(word): pieces of greedy longest match, from the left; unknown words count as one piece.

    Node 0 is where a word begins, node 1 where any later piece begins. With `alone`, START may be a piece of its own, if it is
    one of the vocabulary: node 0 is then the state after it, and a word is cut as START and the word are, all pieces fitting anywhere.
    """

    def __init__(self, pieces: list[str], alone: bool = True) -> None:
        self.edges: list[dict[str, int]] = [{}, {}]
        if alone:
            self.edges[1][START] = 0
        whole = [alone and START in pieces, False]
        for piece in pieces:
            node, rest = (0, piece[len(START) :]) if piece.startswith(START) else (1, piece)
            for letter in rest:
                nxt = self.edges[node].get(letter)
                if nxt is None:
                    nxt = len(self.edges)
                    self.edges[node][letter] = nxt
                    self.edges.append({})
                    whole.append(False)
                node = nxt
            if rest:
                whole[node] = True
        self.fail: list[int] = [-1] * len(self.edges)  # -1: no pieces fit
        self.popped = [0] * len(self.edges)
        if whole[0]:
            self.fail[0], self.popped[0] = 1, 1
        queue = deque([1] if alone else [0, 1])
        while queue:
            node = queue.popleft()
            for letter, nxt in self.edges[node].items():
                if nxt == 0:
                    pass  # known
                elif whole[nxt]:
                    self.fail[nxt], self.popped[nxt] = 1, 1
                else:
                    at, n = self.fail[node], self.popped[node]
                    while at >= 0 and letter not in self.edges[at]:
                        at, n = self.fail[at], n + self.popped[at]
                    if at >= 0:
                        self.fail[nxt], self.popped[nxt] = self.edges[at][letter], n
                queue.append(nxt)

    def count(self, word: str) -> int:
        """0 for a word that has no cut into pieces."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node, n = 0, 0
        for letter in word:
            while letter not in edges[node]:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = edges[node][letter]
        while node != 1:  # what is left is a prefix of pieces: pop it
            if node == 0 and not word:
                return 0
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


def count_pieces(docs: DataFrame, pieces: list[str], text: str = "text", keep: list[str] | None = None, memo: int = MEMO, alone: bool = True) -> DataFrame:
    """docs with n_words, n_unknown and n_tokens: the pieces of all words, unknown words as one each.

    Words are what white space divides. A null or empty text has none. Rows repeat as they are; columns of docs with
    these names are replaced; an empty table stays empty. alone: START may be a word's first piece by itself, as in the vocabulary's own cut.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def make():
        automaton = Automaton(shared.value, alone)
        known: dict[str, int] = {}

        def work(texts):
            out = [[], [], []]
            for text in texts:
                words = (text or "").split()
                try:
                    counts = [known[w] for w in words]
                except KeyError:
                    if len(known) > memo:
                        known.clear()
                    known.update((w, automaton.count(w)) for w in set(words) if w not in known)
                    counts = [known[w] for w in words]
                missing = counts.count(0)
                for column, value in zip(out, (len(words), missing, sum(counts) + missing), strict=True):
                    column.append(value)
            return out

        return work

    return map_text(docs, [("n_words", T.LongType()), ("n_unknown", T.LongType()), ("n_tokens", T.LongType())], make, text, keep)

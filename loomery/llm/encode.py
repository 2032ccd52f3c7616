"""Token ids of whole texts by the tokenizers library, with memos of words and chunks.

Both vocabularies cut a text by a pattern before they merge, so the ids of a text are those of its
chunks one after another, as long as a chunk's ends are cuts of that pattern too. Words are what single spaces (or, where the
vocabulary drops white space, any white space) divide; the chunks of a word are runs of letters and digits (with apostrophes
between them), runs of other signs, and white space within it.
Texts in which that could fail (added tokens, control separators, white space at a word's edge, text not in NFC, a letter that
lower-casing takes apart) are encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

#: White space as the vocabularies' patterns see it.
_S = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACED = re.compile(rf"(?: ?[^\W_]+|'[^\W_]+)(?:'[^\W_]+)*| ?(?:[^{_S}\w]|_)+|[{_S}]+(?![^{_S}])|[{_S}]")
_BARE = re.compile(rf"(?:[^\W_]+|'[^\W_]+)(?:'[^\W_]+)*|(?:[^{_S}\w]|_)+")
def _unassigned() -> str:
    """The ranges, for a pattern's class, of code points that this Python's Unicode tables lack; the tokenizers' may have letters there."""
    out, start = [], None
    for c in range(0x80, 0x20000):
        gone = c < 0x1F000 and unicodedata.category(chr(c)) == "Cn"
        if gone and start is None:
            start = c
        elif not gone and start is not None:
            out.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out) + f"{chr(0x20000)}-{chr(sys.maxunicode)}"


_NEW = re.compile(f"[{_unassigned()}]")
#: Letters of the Latin blocks, whose small forms are one letter each.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: The byte-level alphabet: bytes that print stand for themselves, the others for the letters from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = [chr(b) if b in _PRINTED else chr(256 + sum(x not in _PRINTED for x in range(b))) for b in range(256)]
#: Signs that end a word's letters for certain.
_TAIL = ",.;:!?%&*$#|)"
#: Words that each of the memo's two generations holds, letters of the longest one, and other chunks that are kept.
MEMO, WORD, SIGNS = 200_000, 40, 30_000
#: Letters of the longest words with other signs that are kept whole among the chunks.
SHORT = 3
#: Marks of words that were seen once, less one.
DOOR = (1 << 20) - 1


class Encoder:
    """ids(texts): the ids of each text as bytes, unsigned 32-bit little-endian."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # its own memo of the first 10,000 words costs more than it spares behind these
        self.tokenize = model.tokenize
        self.bare = self.tokenizer.normalizer is not None
        self.pattern = _BARE if self.bare else _SPACED
        # two generations: what is used stays, what isn't is forgotten when the newer one is full
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.seen = bytearray(DOOR + 1)
        self.most = memo

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bool:
        if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return False
        return not self.bare or text.isascii() or ("\u0130" not in text and unicodedata.is_normalized("NFC", text))

    def _merged(self, chunk: str) -> bytes:
        """The ids of a chunk: one of letters alone, which the pattern doesn't cut further, goes straight to the merges."""
        spaced = chunk[0] == " "
        letters = chunk[1:] if spaced else chunk
        if letters.isascii() and letters.isalpha():
            x = letters.lower() if self.bare else f"\u0120{letters}" if spaced else letters
        elif _LATIN.fullmatch(letters):
            x = "".join([_BYTES[b] for b in (letters.lower() if self.bare else chunk).encode()])
        else:
            return self._whole(chunk)
        return array("I", [t.id for t in self.tokenize(x)]).tobytes()

    def _sign(self, chunk: str) -> bytes:
        found = self.signs.get(chunk)
        if found is None:
            found = self._merged(chunk)
            if len(self.signs) > SIGNS:
                self.signs.clear()
            self.signs[chunk] = found
        return found

    def _chunks(self, word: str) -> bytes:
        """The ids of a word, chunk by chunk; of one with letters that the pattern may not know, by the library."""
        if not word.isascii() and _NEW.search(word):
            return self._whole(word)
        return b"".join(map(self._sign, self.pattern.findall(word)))

    def _kept(self, word: str) -> bytes:
        """The ids of a word of letters alone that stands after a single space."""
        found = self.words.get(word)
        if found is not None:
            return found
        found = self.old.get(word)
        if found is None:
            if word.isascii():
                found = array("I", [t.id for t in self.tokenize(word.lower() if self.bare else "\u0120" + word)]).tobytes()
            else:
                found = self._merged(word if self.bare else f" {word}")
            door = hash(word) & DOOR  # a word is kept from the second time on: most occur once
            if not self.seen[door]:
                self.seen[door] = 1
                return found
        if len(word) <= WORD:
            if len(self.words) >= self.most:
                self.old, self.words = self.words, {}
                self.seen[:] = bytes(DOOR + 1)
            self.words[word] = found
        return found

    def _word(self, word: str) -> bytes:
        """The ids of a word that stands after a single space and has other signs than letters."""
        core = word.rstrip(_TAIL)
        if core.isalpha():
            tail = word[len(core) :]
            return self._kept(core) + (self.signs.get(tail) or self._sign(tail))
        chunk = word if self.bare else f" {word}"
        found = self.signs.get(chunk)
        if found is None:
            found = self._chunks(chunk)
            if len(word) <= SHORT and len(self.signs) <= SIGNS:
                self.signs[chunk] = found
        return found

    def _text(self, text: str) -> bytes:
        if not self._plain(text):
            return self._whole(text)
        words = text.split() if self.bare else text.split(" ")
        first = b""
        if not self.bare:
            first = self._chunks(words[0])
            if words[0][-1:].isspace() and len(words) > 1:
                return self._whole(text)
            words = words[1:]
        out = list(map(self.words.get, words))
        at, find, bare, kept, ids = -1, out.index, self.bare, self._kept, self._word
        try:
            while True:
                at = find(None, at + 1)
                word = words[at]
                if word.isalpha():
                    out[at] = kept(word)
                    continue
                if not bare and (not word or word[0].isspace() or word[-1].isspace()):
                    return self._whole(text)
                out[at] = ids(word)
        except ValueError:  # no word is left
            return first + b"".join(out)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        return [self._text(x) if x else b"" for x in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this process: a Python worker keeps its memos from task to task."""
    return Encoder(path)

"""Packing, word-piece counts and token files."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomery.llm import encode, packing, tokenfile, wordpieces

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = (public_tokenizers.path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))
KNOWN: dict = {}


def plain(path, text):
    from tokenizers import Tokenizer

    if path not in KNOWN:
        KNOWN[path] = Tokenizer.from_file(path)
    return KNOWN[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abXé ß'st.,%_1²\n\t\x85 İſ́\x1c<|北🙂", max_size=40), max_size=4))
def test_encoder_gives_the_library_s_ids(path, texts):
    own = encode.encoder(path).ids(texts)
    assert [list(array("I", x)) for x in own] == [plain(path, x) for x in texts]


def test_encoder_with_a_tiny_memo(texts):
    tiny = encode.Encoder(BYTE, memo=3)
    for _, x in texts[:20] * 2:
        assert list(array("I", tiny.ids([x])[0])) == plain(BYTE, x)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 30)))
def test_plan_places_all_without_overlap(counts):
    used, n = {}, {x: 0 for x in counts}
    for length, rank, take, first, offset in packing.plan(counts, 16):
        assert rank == n[length]
        n[length] += take
        for k in range(take):
            used.setdefault(first + k, []).append((offset, length))
    assert n == counts
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 16
    # best fit decreasing, a piece at a time
    bins = []
    for length in sorted((x for x in counts for _ in range(counts[x])), reverse=True):
        fit = min((b for b in bins if 16 - sum(b) >= length), key=lambda b: 16 - sum(b), default=None)
        if fit is None:
            bins.append([length])
        else:
            fit.append(length)
    # which of equally full sequences takes a piece is free: after each length the sequences are as full as those
    for length in counts:
        full = lambda held: sorted(n for n in (sum(x for x in b if x >= length) for b in held) if n)  # noqa: B023, E731
        assert full([[x for _, x in pieces] for pieces in used.values()]) == full(bins)


def test_pack(shared, docs, texts, empty):
    rows = packing.pack(docs, BYTE).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, x in texts:
        ids = [*plain(BYTE, x), packing.END_ID]
        total += len(ids)
        own = [r for r in by_doc[i] if r.piece >= 0]
        starts = sorted({(r.start, r.length, r.ids_crc32) for r in own})
        assert sum(n for _, n, _ in starts) == len(ids) and (len(ids) > 1024 or len(starts) == 1)
        assert all(zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()) == c for s, n, c in starts)
        assert all(n == 1024 for _, n, _ in starts[1:])
    assert len(by_doc[5]) == 2  # a repeated row is packed again
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_sequence) <= -(-total // 1024) + 2
    assert packing.pack(empty, BYTE).count() == 0


def test_token_files(shared, docs, texts, empty, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfile.write_ids(docs, path, WORD, parts=3, row_group_bytes=1 << 16, page_bytes=1 << 12)
    order = sorted(texts, key=lambda x: (x[0], x[1] or ""))
    want, start = [], 0
    for i, x in order:
        ids = [*plain(WORD, x), tokenfile.END_ID]
        want.append((i, start, len(ids), ids))
        start += len(ids)
    assert sorted(tuple(r) for r in tokenfile.read_ids(shared, path).collect()) == sorted(want)
    assert sorted(tuple(r) for r in tokenfile.read_digest(shared, path).collect()) == sorted((i, s, n, zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, s, n, x in want)
    assert {r.doc_id for r in tokenfile.read_some(shared, path, [3, 108]).collect()} == {3, 108}
    meta = [pq.ParquetFile(p).metadata for p in sorted((tmp_path / "tokens").glob("*.parquet"))]
    column = {m.row_group(0).column(k).path_in_schema: m.row_group(0).column(k) for m in meta if m.num_row_groups for k in range(m.num_columns)}
    assert "RLE_DICTIONARY" in column["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in column["n_tokens"].encodings
    assert column["doc_id"].has_column_index and column["doc_id"].has_offset_index
    assert sum(m.num_row_groups for m in meta) >= 3
    none = str(tmp_path / "none")
    tokenfile.write_ids(empty, none, WORD)
    assert tokenfile.read_digest(shared, none).count() == 0


PIECES = ["▁", "▁a", "▁ab", "▁abc", "a", "b", "bc", "bcd", "c", "d", "▁x", "yz"]


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        for size in range(len(word) - at, 0, -1):
            if (("▁" if at == 0 else "") + word[at : at + size]) in pieces:
                break
        else:
            return 0
        at, n = at + size, n + 1
    return n


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcdxyz", min_size=1, max_size=12))
def test_automaton(word):
    assert wordpieces.Automaton(PIECES, alone=False).count(word) == greedy(word, set(PIECES))


def test_piece_counts(shared, docs, texts, empty):
    pieces = wordpieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    held, known = set(pieces), {}
    count = lambda w: known.setdefault(w, greedy_from_start(w, held))
    found = wordpieces.count_pieces(docs, pieces)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "n_words", "n_unknown", "n_tokens"]
    for r in found.collect():
        if len(r.text or "") < 4000:
            n = [count(w) for w in (r.text or "").split()]
            assert (r.n_words, r.n_unknown, r.n_tokens) == (len(n), n.count(0), sum(n) + n.count(0))
    assert wordpieces.count_pieces(empty, pieces).count() == 0
    assert wordpieces.count_pieces(docs, pieces, memo=2).agg({"n_tokens": "sum"}).first()[0] == found.agg({"n_tokens": "sum"}).first()[0]


def greedy_from_start(word, pieces):
    """Greedy pieces of START and the word."""
    word, n = wordpieces.START + word, 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not size:
            return 0
        word, n = word[size:], n + 1
    return n


@pytest.mark.parametrize("pieces", [PIECES, PIECES[1:], [*PIECES, "▁▁", "a▁b", "▁bcx"]])
@settings(max_examples=400, deadline=None)
@given(word=st.text(alphabet="abcdxyz▁", min_size=1, max_size=12))
def test_automaton_with_start_alone(pieces, word):
    assert wordpieces.Automaton(pieces, alone=True).count(word) == greedy_from_start(word, set(pieces))


def test_words_of_rare_first_letters(shared, monkeypatch):
    """The query knows words whose first letter has no piece with START."""
    from loomery.llm import queries

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = wordpieces.vocabulary(path)
    held = set(pieces)
    words = [f"{c}{rest}" for c in sorted({x for x in pieces if len(x) == 1} - {wordpieces.START}) if c.strip() and "▁" + c not in held for rest in ("", "e", "andra")][:300]
    assert words and "▁" in held
    monkeypatch.setattr(queries, "table", lambda *_: shared.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_unknown, r.n_tokens) for r in queries.op6_token_counts(shared, "").collect()}
    assert got == {i: (1, 0, greedy_from_start(w, held)) for i, w in enumerate(words)}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_short_signs_are_merged_once(name, monkeypatch):
    import public_tokenizers
    from loomery.llm.encode import Encoder

    e, cut = Encoder(public_tokenizers.path(name)), []
    monkeypatch.setattr(e, "_chunks", lambda word, f=e._chunks: cut.append(word) or f(word))
    text = "word | word, | word. +1 | Été! +1 été | |"
    assert e.ids([text, text]) == [e._whole(text)] * 2
    assert sum(w.strip() == "|" for w in cut) == 1 and sum(w.strip() == "+1" for w in cut) == 1

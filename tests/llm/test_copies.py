"""Line dedup, SimHash components and SpotSigs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomery.llm import line_dedup as ld
from loomery.llm import simhash as sh
from loomery.llm import spotsigs as ss


def brute_lines(rows, size=3):
    """The distinct (doc_id, text) in order; windows seen before mark their lines."""
    seen, out = set(), {}
    for i, text in rows:
        lines = [x for x in (text or "").split("\n") if x.strip()]
        bare = [" ".join(x.split()) for x in lines]
        gone = set()
        for k in range(len(lines) - size + 1):
            w = tuple(bare[k : k + size])
            if w in seen:
                gone.update(range(k, k + size))
            seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_lines(shared):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice(["one", "two ", " three", "four", "five  x"]) for _ in range(r.randint(0, 12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "one\ntwo"), (63, rows[7][1])]
    df = shared.createDataFrame([(i, x, 0, "a") for i, x in rows], "doc_id long, text string, n_lines int, lang string").repartition(4)
    found = ld.dedup_lines(df)
    assert found.columns == ["doc_id", "text", "lang", "n_lines", "n_removed"]
    got = {x.doc_id: x for x in found.collect()}
    want = brute_lines(rows)
    assert all((got[i].text or "") == want[i] for i, _ in rows) and got[60].text is None
    assert all(got[i].n_lines == len([y for y in (x or "").split("\n") if y.strip()]) for i, x in rows)
    assert sum(x.n_removed for x in got.values()) > 0


def test_lines_of_odd_rows(shared, docs, empty):
    found = ld.dedup_lines(docs)
    assert found.count() == docs.count()
    twice = found.where("doc_id = 5").collect()
    assert len(twice) == 2 and twice[0].text == twice[1].text and twice[0].n_removed == 0  # equal rows are one document
    copies = found.where("doc_id in (100, 101)").collect()
    assert len(copies) == 2 and all(r.n_lines > 2 and r.n_removed == r.n_lines for r in copies)
    assert ld.dedup_lines(empty).count() == 0
    assert ld.without("a\n\nb\nc\n\nd", [0]) == ("d", 4, 3)  # a blank line goes with the line before it


def test_lines_by_ids_of_text(shared):
    """Ids that are no numbers are ordered as they are; a null id comes last and loses to any."""
    x = "a line\nanother one\na third\n"
    df = shared.createDataFrame([("b", x + "b"), ("a", x + "a"), (None, x + "none"), (None, x + "none"), ("10", "short")], "doc_id string, text string")
    got = sorted(((r.doc_id or "~", r.text, r.n_removed) for r in ld.dedup_lines(df).collect()))
    assert got == [("10", "short", 0), ("a", x + "a", 0), ("b", "b", 3), ("~", "none", 3), ("~", "none", 3)]


def test_one_row_stays_with_maps(shared):
    df = shared.createDataFrame([(1, "same text here", {"b": 1}), (1, "same text here", {"a": 1}), (2, "same text here", {})], "doc_id long, text string, m map<string,int>")
    assert [(r.doc_id, r.m) for r in sh.keep_first(df).collect()] == [(1, {"a": 1})]


def test_one_window_in_a_third_of_all(shared):
    rows = [(i, f"own {i}\nx\ny\nz\nend {i}" if i % 3 == 0 else f"a {i}\nb {i}\nc {i}") for i in range(600)]
    got = ld.dedup_lines(shared.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_removed = 3").count() == 199 and got.where("doc_id = 0 and n_removed = 0").count() == 1


def brute_fp(text):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abC \t\n\x0bé \x1c", max_size=60))
def test_fingerprint(text):
    assert sh.fingerprint(text) & (1 << 64) - 1 == brute_fp(text)


def linked(fps, radius=2):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in fps}


@pytest.mark.parametrize("bucket", [sh.BUCKET, 3])
def test_links_join_all(shared, bucket):
    """Chains, crowded segments and strangers: the same components as all pairs give, with any bucket size."""
    r = random.Random(2)
    base = [r.getrandbits(63) for _ in range(12)]
    fps = set(base)
    for x in base[:4]:
        y = x
        for _ in range(25):  # chains
            y ^= 1 << r.randrange(63)
            fps.add(y)
        fps.update(x ^ (r.getrandbits(31) << 32) for _ in range(20))  # the same low segment
        fps.update(x ^ r.getrandbits(32) for _ in range(20))  # the same high segment
    df = shared.createDataFrame([(x,) for x in fps], "fp long")
    edges = sh.links(df, bucket=bucket)
    assert all(((x.a ^ x.b) & (1 << 64) - 1).bit_count() <= 2 for x in edges.collect())
    got = {x.node: x.root for x in sh.components(edges).collect()}
    want = linked(sorted(fps))
    assert all(got.get(x, x) == want[x] for x in fps)


def test_negative_fingerprints(shared):
    fps = [-1, -2, -4, 0, 1, 1 << 62, -(1 << 63), (-(1 << 63)) + 3]
    got = {x.node: x.root for x in sh.components(sh.links(shared.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    assert all((got.get(a, a) == got.get(b, b)) for a in fps for b in fps if near(a, b))
    assert got.get(-1, -1) != got.get(0, 0)


def test_components_of_a_path_and_a_star(shared):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {x.node: x.root for x in sh.components(shared.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 300))


def test_near_duplicates(shared, docs, texts, empty):
    found = sh.near_duplicates(docs).collect()
    assert len(found) == len(texts)
    fps = {i: brute_fp(x) for i, x in texts}
    root = linked(sorted(set(fps.values())))
    first = {}
    for i, x in texts:
        first[root[fps[i]]] = min(first.get(root[fps[i]], i), i)
    assert all(r.fp & (1 << 64) - 1 == fps[r.doc_id] and r.component_id == first[root[fps[r.doc_id]]] for r in found)
    kept = sh.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(first.values()))
    assert kept.where("doc_id = 3").first().score == "kept"
    assert sh.near_duplicates(empty).count() == 0 and sh.keep_first(empty).count() == 0


def test_each_component_keeps_a_row(shared):
    """Unrelated documents without an id, and one id with different texts, are components of their own."""
    prose = lambda seed, n: " ".join(random.Random(seed).choices("river stone lamp cloud paper table green walk seven night bread glass".split(), k=n))
    rows = [(None, prose(200, 60)), (None, prose(201, 60)), (None, prose(202, 60)), (None, prose(200, 60)), ("7", prose(203, 60)), ("7", prose(204, 60)), ("8", prose(204, 60)), ("9", prose(205, 60)), (None, prose(205, 60)), ("none", prose(206, 60)), (None, prose(206, 60))]
    got = sh.keep_first(shared.createDataFrame(rows, "doc_id string, text string")).collect()
    want = [rows[i] for i in (0, 1, 2, 4, 5, 7, 9)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_spots():
    spots = ss.Spots()
    a = "the river stone lamp of cloud paper table and green walk night"
    assert len(spots.of(a)) == 3 and np.array_equal(spots.of(a), spots.of(a.upper() + "!"))
    assert len(spots.of("")) == 0 and len(spots.of(None)) == 0 and len(spots.of("word")) == 1
    assert len(spots.of("北京 上海 广州 深圳 天津")) > 1  # no anchor: each word is one
    assert ss.likeness(spots.of("北京上海广州深圳天津重庆"), spots.of("北京上海广州深圳天津成都")) > 0.4  # without spaces each sign is a word
    assert ss.likeness(spots.of(""), spots.of("")) == 1.0 and ss.likeness(spots.of(a), spots.of("")) == 0.0
    assert ss.likeness(np.array([1, 2, 3]), np.array([2, 3, 4])) == 0.5 and ss.likeness(np.array([1]), np.arange(1, 9), 0.5) == 0.0


def test_compare_next(shared, docs, texts, empty):
    got = ss.compare_next(docs).collect()
    order = sorted(texts, key=lambda x: (x[0], x[1] or ""))
    assert len(got) == len(order)
    spots = ss.Spots()
    want = []
    for k, (i, x) in enumerate(order):
        x, y = x or "", order[(k + 1) % len(order)][1] or ""
        half = len(x) // 2
        changed = x[: len(x) - half] + y[:half]
        a, b, c = spots.of(x), spots.of(changed), spots.of(y)
        jaccard = lambda p, q: 1.0 if not len(p) and not len(q) else len(set(p) & set(q)) / len(set(p) | set(q))
        want.append((i, len(x), hashlib.sha256(changed.encode()).hexdigest(), ss.digest(a), ss.digest(b), jaccard(a, b), jaccard(a, c)))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == sorted(want)
    assert ss.compare_next(empty).count() == 0
    one = ss.compare_next(docs.where("doc_id = 107")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0  # the only row follows itself


def test_similar_pairs(shared, docs, texts, empty):
    members, pairs = ss.similar_pairs(docs, 0.5)
    spots = ss.Spots()
    sets = {i: frozenset(spots.of(x).tolist()) for i, x in texts}
    names = {}
    for i in sorted(sets):
        names.setdefault(sets[i], i)
    assert sorted(tuple(r) for r in members.collect()) == sorted((i, names[sets[i]]) for i, _ in texts)
    every = [(s, n) for s, n in names.items() if s]
    want = {(min(n, m), max(n, m)) for s, n in every for t, m in every if n < m and len(s & t) / len(s | t) >= 0.5}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert ss.similar_pairs(empty)[1].count() == 0

"""Benchmark decontamination and toxicity."""

from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomery.llm import decontaminate as dc
from loomery.llm import toxicity as tx

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, benchmark, window=10):
    w, hit, items = words(text), set(), set()
    for item, t in benchmark:
        b = words(t)
        m = min(window, len(b))
        for k in range(len(b) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == b[k : k + m]:
                    hit.update(range(i, i + m))
                    if item is not None:
                        items.add(item)
    return len(w), len(hit), sorted(items)


ALPHABET = st.lists(st.sampled_from(["a", "B", "cé", "d1", "-", "É"]), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(ALPHABET, st.lists(ALPHABET, max_size=4), st.integers(1, 4))
def test_wu_manber_finds_what_is_there(text, items, window):
    bench = [(str(i), x) for i, x in enumerate(items)]
    spans, found = [], set()
    w = dc.words(text)
    for one in dc.tables(bench, window):
        one.search(w, spans, found)
    flat = dc.merged(spans)
    assert (len(w), sum(flat[1::2]) - sum(flat[::2]), sorted(found)) == brute(text, bench, window)


@pytest.mark.parametrize("pass_bytes", [dc.PASS_BYTES, 40])
def test_leaks(shared, docs, texts, pass_bytes):
    bench = [(1, " ".join(texts[9][1].split()[3:30]).upper()), (2, "word"), (3, None), (4, "..."), (None, " ".join(texts[20][1].split()[:12])), (12, texts[9][1]), (12, texts[9][1])]
    table = shared.createDataFrame(bench, "item_id long, text string")
    found = dc.find_leaks(docs, table, pass_bytes=pass_bytes)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "n_words", "hit_spans", "hit_items"]
    rows = found.select("doc_id", "text", "n_words", dc.n_hit().alias("n_hit"), "hit_items").collect()
    assert len(rows) == len(texts)
    named = [(str(i) if i is not None else None, x) for i, x in bench]
    for r in rows:
        if len(r.text or "") < 20_000:
            assert (r.n_words, r.n_hit, sorted(r.hit_items)) == brute(r.text, named)
    spans = [(r.hit_spans[::2], r.hit_spans[1::2]) for r in found.collect()]
    assert all(len(a) == len(b) and all(x < y for x, y in zip(a, b, strict=True)) and all(y < x for y, x in zip(b, a[1:], strict=False)) for a, b in spans)
    kept = dc.drop_contaminated(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.n_hit}
    assert dc.find_leaks(docs.limit(0), table).count() == 0
    assert dc.find_leaks(docs, table.limit(0)).where(dc.n_hit() > 0).count() == 0


def test_factorization_machine_learns_a_pair():
    """Neither term alone is toxic; only the two together."""
    r = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(4000):
        insult, group = r.random() < 0.4, r.random() < 0.4
        own = list(r.integers(1000, 60_000, 40)) + [7] * insult + [9 + int(r.integers(3))] * group
        rows.append(np.unique(np.array(own)))
        labels.append(int(insult and group))
    model = tx.FactorizationMachine()
    model.learn(rows[:3000], labels[:3000])
    right = np.mean([(model.score(x) >= 0.5) == y for x, y in zip(rows[3000:], labels[3000:], strict=True)])
    assert right > 0.98
    packed = tx.Scorer(model.packed())
    assert all(abs(packed.score(x[model.used[x]]) - model.score(x)) < 1e-3 for x in rows[3000:3050])


def test_factorization_machine_learns_a_pair_of_balanced_terms():
    """Each term alone says nothing: a text is toxic with both or with neither."""
    r = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(4000):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(np.unique(np.array(list(r.integers(1000, 60_000, 40)) + [7] * a + [9] * b)))
        labels.append(int(a == b))
    model = tx.FactorizationMachine()
    model.learn(rows[:3000], labels[:3000])
    right = np.mean([(model.score(x) >= 0.5) == y for x, y in zip(rows[3000:], labels[3000:], strict=True)])
    assert right > 0.95 and set(np.flatnonzero(model.paired)) == {7, 9}
    packed = tx.Scorer(model.packed())
    assert all(abs(packed.score(x[model.used[x]]) - model.score(x)) < 1e-3 for x in rows[3000:3050])


def test_toxicity_on_held_out_labels(shared):
    spark = shared
    names = ["idiot", "clown", "moron"]
    rows = [(i, f"{'the river walks ' * (i % 9 + 1)} {names[i % 3] if i % 4 == 0 else 'lamp'} stone {i % 50}") for i in range(1200)]
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (0, rows[0][1])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    scored = tx.score(docs, model).withColumn("out", tx.held_out(F.col("doc_id"))).collect()
    assert len(scored) == 1203 and all(0 <= r.score <= 1 for r in scored)
    out = [r for r in scored if r.out and r.doc_id < 1200]
    assert out and all((r.score >= tx.THRESHOLD) == (r.doc_id % 4 == 0) for r in out)
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == ["doc_id", "text"] and {r.doc_id % 4 for r in kept.collect() if r.doc_id < 1200} == {1, 2, 3} and kept.where("text is null").count() == 1
    # labels of the held-out fold change nothing
    turned = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert all(np.array_equal(a, b) for a, b in zip(model, tx.train(docs, turned), strict=True))
    none = tx.train(docs, labels.limit(0))
    assert tx.score(docs, none).where("score >= 0.7").count() == 0 and tx.score(docs.limit(0), model).count() == 0


def test_sample_is_bounded(shared):
    docs = shared.createDataFrame([(i, "idiot" if i % 2 else "lamp") for i in range(300)], "doc_id long, text string")
    labels = shared.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    assert tx.train(docs, labels, sample=10) is not None

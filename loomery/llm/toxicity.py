"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.shared import map_text

#: Labelled documents that the model learns from, at most; those whose ids' hashes are least.
SAMPLE = 8_000
BUCKETS = 1 << 18
FACTORS = 4
THRESHOLD = 0.7
#: Most frequent terms whose pairs are looked at for an effect of their own, rows that each combination must have, and its size in standard errors.
SCREENED, CELL, EFFECT = 256, 20, 8.0
#: Lengths of the beginnings of words that are terms beside the words.
STEMS = (3, 4, 5)
#: Parts of a text's words from which on a word or beginning that occurs more than once is a further term.
LEVELS = (1 / 128, 1 / 64)
MEMO = 200_000

_WORD = re.compile(r"[^\W\d_]+")


class Terms:
    """of(text): the sorted distinct buckets of the text's words and their beginnings, and of those that make up a part of it (LEVELS)."""

    def __init__(self, buckets: int = BUCKETS, memo: int = MEMO) -> None:
        self.buckets, self.most = buckets, memo
        self.memo: dict[str, tuple] = {}

    def _ids(self, word: str) -> tuple:
        return tuple({zlib.crc32(x.encode("utf-8", "surrogatepass")) % self.buckets for x in (word, *[f"{word[:n]}-" for n in STEMS if len(word) >= n])})

    def of(self, text: str | None) -> np.ndarray:
        words = Counter(_WORD.findall((text or "").lower()))
        if not words:
            return np.zeros(0, dtype=np.int64)
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = self._ids(w)
        found = [memo[w] for w in words]
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int64)
        times = np.repeat(np.fromiter(words.values(), dtype=np.int64, count=len(words)), [len(x) for x in found])
        terms, at = np.unique(ids, return_inverse=True)
        count = np.bincount(at, weights=times)
        dense = [(terms[(count > 1) & (count >= level * words.total())] * 2654435761 + k) % self.buckets for k, level in enumerate(LEVELS, 1)]
        return np.unique(np.concatenate([terms, *dense]))


class FactorizationMachine:
    """p = sigmoid(bias + sum of weights + sum over pairs of the products of their factors), over the terms that occur.

    Terms in fewer than `least` documents are left out. Weights follow the FTRL rule with an L1 term, which keeps those of
    chance terms at zero. Factors follow AdaGrad and count for terms whose weights aren't zero, and for those of the most frequent terms
    of which a pair says more than its two terms (paired): the number of pairs grows with
    the square of a text's terms, and chance pairs of a long text would drown the others.
    """

    def __init__(self, buckets: int = BUCKETS, factors: int = FACTORS, alpha: float = 1.0, l1: float = 5.0, l2: float = 0.1, rate: float = 0.05, decay: float = 0.002, least: int = 3, seed: int = 7) -> None:
        self.alpha, self.l1, self.l2, self.rate, self.decay, self.least = alpha, l1, l2, rate, decay, least
        self.bias = 0.0
        self.w = np.zeros(buckets)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (buckets, factors))
        self.z, self.n, self.g = np.zeros(buckets), np.zeros(buckets), np.full((buckets, factors), 1e-2)
        self.used = np.zeros(buckets, dtype=bool)
        self.paired = np.zeros(buckets, dtype=bool)

    def margin(self, ids: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        w = self.w[ids]
        live = ids[(w != 0) | self.paired[ids]]
        v = self.v[live]
        total = v.sum(axis=0)
        return self.bias + float(w.sum()) + 0.5 * float((total * total - (v * v).sum(axis=0)).sum()), live, total

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(ids[self.used[ids]])[0], -30, 30))))

    def learn(self, rows: list[np.ndarray], labels: list[int], epochs: int = 15) -> None:
        share = sum(labels) / len(labels) if labels else 0.0
        if share in (0.0, 1.0):
            self.bias = 30.0 if share else -30.0
            return
        count = np.zeros(len(self.w), dtype=np.int64)
        for ids in rows:
            count[ids] += 1
        self.used = count >= self.least
        self._screen(rows, np.array(labels, dtype=float), count)
        rows = [ids[self.used[ids]] for ids in rows]
        self.bias = float(np.log(share / (1 - share)))
        order = np.random.default_rng(11)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                ids, y = rows[k], labels[k]
                m, live, total = self.margin(ids)
                g = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - y
                self.bias -= 0.01 * g
                if abs(g) < 1e-2:
                    continue
                v = self.v[live]
                grad = g * (total - v) + self.decay * v
                self.g[live] += grad * grad
                self.v[live] = v - self.rate * grad / np.sqrt(self.g[live])
                n, w = self.n[ids], self.w[ids]
                new = n + g * g
                z = self.z[ids] + g - (np.sqrt(new) - np.sqrt(n)) / self.alpha * w
                self.z[ids], self.n[ids] = z, new
                self.w[ids] = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((1 + np.sqrt(new)) / self.alpha + self.l2))

    def _screen(self, rows: list[np.ndarray], y: np.ndarray, count: np.ndarray) -> None:
        """Marks the terms of pairs with an effect: the label's share with both and with neither against that with one of them."""
        often = np.argsort(-np.minimum(count, len(rows) - count), kind="stable")[:SCREENED]
        place = np.full(len(count), -1)
        place[often] = np.arange(len(often))
        x = np.zeros((len(rows), len(often)))
        for k, ids in enumerate(rows):
            at = place[ids]
            x[k, at[at >= 0]] = 1
        cells = []  # the rows and the labels of each combination
        for a in (x, 1 - x):
            for b in (x, 1 - x):
                cells.append((a.T @ b, (a * y[:, None]).T @ b))
        few = np.minimum.reduce([n for n, _ in cells]) < CELL
        with np.errstate(divide="ignore", invalid="ignore"):
            share = [(t + 0.5) / (n + 1) for n, t in cells]
            error = np.sqrt(sum(p * (1 - p) / n for p, (n, _) in zip(share, cells, strict=True)))
            strong = ~few & (np.abs(share[0] - share[1] - share[2] + share[3]) > EFFECT * error)
        np.fill_diagonal(strong, False)
        self.paired[often[strong.any(axis=1)]] = True

    def packed(self) -> tuple:
        live = np.flatnonzero((self.w != 0) | self.paired)
        return self.bias, live, self.w[live].astype(np.float32), self.v[live].astype(np.float32)


class Scorer:
    """The model's live terms, as they are sent to the executors: no more than the buckets."""

    def __init__(self, packed: tuple, buckets: int = BUCKETS) -> None:
        self.bias, live, w, v = packed
        self.place = np.full(buckets, -1, dtype=np.int32)
        self.place[live] = np.arange(len(live))
        self.w, self.v = w.astype(np.float64), v.astype(np.float64)

    def score(self, ids: np.ndarray) -> float:
        at = self.place[ids]
        at = at[at >= 0]
        v = self.v[at]
        total = v.sum(axis=0)
        m = self.bias + self.w[at].sum() + 0.5 * (total * total - (v * v).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(m, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple:
    """The packed model, from labels outside the held-out fold.

    At most `sample` labelled documents are used, those whose ids' hashes are least. Labels of null count for nothing; of several labels of
    a document the greatest holds; of several texts of a document the one of the least hash is learnt from. Without labels all scores are 0, as with one class only.
    """
    rows = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    chosen = rows.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    spark = docs.sparkSession
    few = spark.createDataFrame([(r.id, r.y) for r in chosen], T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("y", T.IntegerType())]))
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(few), "id")
    own = own.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # a row for each of few, however often its id occurs

    def make():
        terms = Terms()
        return lambda texts: [[terms.of(x).astype(np.int32).tobytes() for x in texts]]

    got = sorted((r.id, bytes(r.ids), r.y) for r in map_text(own, [("ids", T.BinaryType())], make, "text", ["id", "y"]).select("id", "y", "ids").collect())
    model = FactorizationMachine()
    model.learn([np.frombuffer(x, dtype=np.int32) for _, x, _ in got], [int(y > 0) for _, _, y in got])
    return model.packed()


def score(docs: DataFrame, model: tuple, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns in keep) with score, from 0 to 1. A null or empty text has the model's bias alone. Rows repeat as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        terms, scorer = Terms(), Scorer(shared.value)
        return lambda texts: [[scorer.score(terms.of(x)) for x in texts]]

    return map_text(docs, [("score", T.DoubleType())], make, text, keep)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score under the threshold, with their columns as they are.

    Rows of one text go or stay together; a null or empty text has the model's bias as its score. Without labels none goes. An empty table stays empty.
    """
    model = train(docs, labels)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = score(plain, model, f"c{docs.columns.index('text')}").where(F.col("score") < threshold)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])

"""SpotSigs: fingerprints from chains of content words that follow common words."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.shared import map_text, written

#: Common words of English, German, French and Spanish that are anchors and never part of a chain.
ANCHORS = frozenset(
    """a an and are as at be by for from have he in is it of on or that the this to was were which with you
    am auf aus bei das dem den der des die ein eine einen einer es für ich im ist mit nicht sich sie und von zu
    au aux avec ce dans de du elle en est et il la le les ne pas pour que qui sur un une
    al con del el ella los las lo más no para por se su sus una y ya""".split()
)
#: Content words in a chain, one after another.
CHAIN = 3
SIMILAR = 0.8
MEMO = 300_000

#: Words; of scripts without spaces each sign is one.
_WORD = re.compile("[\u3040-\u30ff\u3400-\u9fff]|[^\\W_\u3040-\u30ff\u3400-\u9fff]+")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


class Spots:
    """of(text): the sorted 64-bit hashes of the text's spot signatures.

    Texts without an anchor that a whole chain follows take each word as an anchor; if that gives none either, all words
    are one signature. A text without words has none.
    """

    def __init__(self, chain: int = CHAIN, memo: int = MEMO) -> None:
        self.chain, self.most = chain, memo
        self.memo: dict[str, int] = {}

    def _words(self, text: str) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words = _WORD.findall(text.lower())
        memo = self.memo
        try:
            return np.array([memo[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(memo) > self.most:
                memo.clear()
            # the lowest bit says whether it is an anchor
            memo.update((w, xxh3_64_intdigest(w) & ~1 | (w in ANCHORS)) for w in set(words) if w not in memo)
            return np.array([memo[w] for w in words], dtype=np.uint64)

    def _chains(self, heads: np.ndarray, first: np.ndarray, content: np.ndarray) -> np.ndarray:
        """Signatures of the heads whose chains begin at the places first of content."""
        whole = first + self.chain <= len(content)
        heads, first = heads[whole], first[whole]
        value = heads * np.uint64(_MIX[0])
        for k in range(self.chain):
            value = (value ^ (value >> np.uint64(29)) ^ content[first + k]) * np.uint64(_MIX[1 + k % 3])
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = self._words(text or "")
        if not len(words):
            return words
        anchor = (words & np.uint64(1)).astype(bool)
        content = words[~anchor]
        found = self._chains(words[anchor], (np.cumsum(~anchor) - ~anchor)[anchor], content)
        if not len(found):
            found = self._chains(words[: len(words) - self.chain], np.arange(1, len(words) - self.chain + 1), words) if len(words) > self.chain else found
        if not len(found):
            found = np.array([int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little")], dtype=np.uint64)
        return np.unique(found)


def digest(spots: np.ndarray) -> str:
    """The fingerprint of a signature set, as 32 hex digits."""
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(spots.tobytes())


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted signature sets; 0 as soon as their sizes rule out `least`. Two empty sets are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The text with its last half (of code points, rounded down) replaced by as many of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chain: int = CHAIN) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_spots of each row.

    The next row is that of the next doc_id, ascending; rows of one doc_id are in the order of their texts, a null doc_id
    comes first, and the first row follows the last. A null text is empty. Other columns of docs aren't kept, whatever their names. The rows are range-sorted by doc_id; a task keeps its first
    row, and its last waits in a written table for the first row of the next task.
    """
    kind = docs.schema[doc_id].dataType
    result = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()), ("n_spots", T.LongType())]
    arrow = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("body", T.StringType()), *[T.StructField(n, t) for n, t in result]])

    def row(spots, x, own, y, other) -> tuple:
        changed = edited(x, y)
        new = own if changed == x else spots.of(changed)
        return len(x), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest(own), digest(new), likeness(own, new), likeness(own, other), len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots, part, last = Spots(chain), TaskContext.get().partitionId(), None
        ids_type = None

        def batch_of(kinds, ids, bodies, rows):
            made = [pa.array([r[i] if r else None for r in rows], t) for i, t in enumerate(arrow)]
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([part] * len(kinds), pa.int32()), pa.array(ids, ids_type), pa.array(bodies, pa.string()), *made], schema.names)

        for batch in batches:
            ids_type = batch.schema.field(0).type
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                kinds, ids, bodies, rows = [], [], [], []
                for i, x in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    own = spots.of(x)
                    if last is None:
                        kinds, ids, bodies, rows = ["head"], [i], [x], [None]
                    else:
                        kinds.append("row")
                        ids.append(last[0])
                        bodies.append(None)
                        rows.append(row(spots, last[1], last[2], x, own))
                    last = i, x, own
                yield batch_of(kinds, ids, bodies, rows)
        if last:
            yield batch_of(["tail"], [last[0]], [last[1]], [None])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    done = written(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema), "spots")
    names = [n for n, _ in result]
    parts = [r.part for r in done.where("kind = 'head'").select("part").orderBy("part").collect()]  # as many as tasks
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    tails = done.where("kind = 'tail'").select("part", "doc_id", "body").join(F.broadcast(follows), "part")
    ends = tails.join(done.where("kind = 'head'").select(F.col("part").alias("next"), F.col("body").alias("other")), "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = Spots(chain)
        for batch in batches:
            made = [row(spots, x, spots.of(x), y, spots.of(y)) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([m[i] for m in made], t) for i, t in enumerate(arrow)]], ["doc_id", *names])

    closed = ends.select("doc_id", "body", "other").mapInArrow(close, T.StructType([schema["doc_id"], *[schema[c] for c in names]]))
    return done.where("kind = 'row'").select("doc_id", *names).unionByName(closed)


def signatures(docs: DataFrame, text: str = "text", keep: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """docs (the columns in keep) with spots: the sorted signatures, as longs, of each text; none for a null text or one without words. A column spots of docs is replaced."""

    def make():
        spots = Spots(chain)
        return lambda texts: [[spots.of(x).view(np.int64).tolist() for x in texts]]

    return map_text(docs, [("spots", T.ArrayType(T.LongType()))], make, text, keep)


def similar_pairs(docs: DataFrame, least: float = SIMILAR, doc_id: str = "doc_id", text: str = "text", chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id, class_id of each row; a, b, similarity of class ids with a Jaccard of at least `least`.

    A class is all rows of equal signature sets, named by its least doc_id. Sets are partitioned by their length so that partners lie in the
    same or the next partition; in each, a set is looked up by its rarest signatures only, as many as a partner must share one of,
    and the Jaccard is verified on the whole sets. Texts without words are one class and pair with none.
    """
    sets = written(signatures(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), keep=["doc_id"], chain=chain).withColumn("k", F.sha2(F.array_join("spots", ","), 256)), "spots")
    named = sets.groupBy("k").agg(F.min("doc_id").alias("class_id"), F.first("spots").alias("spots"))
    named = written(named, "classes")
    members = sets.select("doc_id", "k").join(named.select("k", "class_id"), "k").select("doc_id", "class_id")
    long = named.where(F.size("spots") > 0).select("class_id", F.size("spots").alias("n"), F.explode("spots").alias("s"))
    rarity = long.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    ordered = long.join(rarity, "s").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("by"))
    # signatures that no other set has (df 1) come first in the order and match nothing
    prefix = F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1 - (F.col("n") - F.size("by"))
    level = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / least) + 1e-9)
    index = ordered.where(prefix > 0).select("class_id", "n", level.alias("p"), F.explode(F.slice("by", 1, prefix)).alias("x")).select("class_id", "n", "p", "x.s")
    probe = index.select(F.col("class_id").alias("other"), F.col("n").alias("m"), "s", F.explode(F.array("p", F.col("p") + 1)).alias("p"))
    near = index.join(probe, ["p", "s"]).where((F.col("class_id") != F.col("other")) & (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")))
    candidates = near.select(F.least("class_id", "other").alias("a"), F.greatest("class_id", "other").alias("b")).distinct()
    sides = [named.select(F.col("class_id").alias(c), F.col("spots").alias(f"s{c}")) for c in "ab"]
    shared = F.size(F.array_intersect("sa", "sb"))
    pairs = candidates.join(sides[0], "a").join(sides[1], "b").withColumn("similarity", shared / (F.size("sa") + F.size("sb") - shared))
    return members, pairs.where(F.col("similarity") >= least).select("a", "b", "similarity")

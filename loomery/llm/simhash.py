"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.shared import forget, map_text, written

SEED = 42
BITS = 64
RADIUS = 2
SEGMENTS = 2
#: Fingerprints of one segment value whose pairs are tried one by one; beyond it they meet in the points of their balls.
BUCKET = 64

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = 3) -> int:
    """The majority bits of the shingles' hashes, as a signed 64-bit number; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not w:
        return 0
    if len(w) < words:
        hashes = [xxh64_intdigest(b" ".join(w), SEED)]
    else:
        hashes = [xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False))]
    bits = np.zeros(BITS, dtype=np.int64)
    packed = np.array(hashes, dtype=">u8")
    for low in range(0, len(packed), 1 << 14):  # a long text's bits a slice at a time
        bits += np.unpackbits(packed[low : low + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = 3) -> DataFrame:
    """docs (the columns in keep) with the column fp, of long. A null text is empty; the fingerprint of a text without words is 0. Repeated rows stay; a column fp of docs is replaced; an empty table stays empty."""
    return map_text(docs, [("fp", T.LongType())], lambda: lambda texts: [[fingerprint(x, words) for x in texts]], text, keep)


def _balls(width: int, radius: int) -> list[int]:
    """Masks of all changes of up to radius of width bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _segments() -> list[tuple[int, int]]:
    """(shift, width) of each."""
    width = BITS // SEGMENTS
    return [(i * width, width if i < SEGMENTS - 1 else BITS - i * width) for i in range(SEGMENTS)]


def _near(segment: int, value: Column):
    return lambda mask: F.struct(F.lit(segment).alias("s"), value.bitwiseXOR(mask).alias("v"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that join the same distinct fingerprints (column fp of longs) as all links of up to radius bits do.

    Two fingerprints of up to `radius` different bits have a segment in which they differ in no more than
    the segment's share; with radius = q * SEGMENTS + r, that share is q in the first r + 1 segments and q - 1 in the others.
    So a fingerprint looks for the values of that ball in each segment's table, and the complete
    distance is verified. The segment values that more than `bucket` fingerprints have would make pairs
    by the square: those fingerprints are linked to the points of their own ball of half the radius instead, which is exact
    for an even radius, as two fingerprints share such a point if and only if they are that near. Points that
    are no fingerprint, and have one neighbour only, don't matter and go.
    """
    if radius % 2:
        raise ValueError("an even radius is needed for buckets of any size")
    q, r = divmod(radius, SEGMENTS)
    tables, probes = [], []
    for i, (shift, width) in enumerate(_segments()):
        share = q if i <= r else q - 1
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        tables.append(F.struct(F.lit(i).alias("s"), value.alias("v")))
        if share >= 0:
            masks = F.array(*[F.lit(m).cast("long") for m in _balls(width, share)])
            probes.append(F.transform(masks, _near(i, value)))
    table = fps.select("fp", F.explode(F.array(*tables)).alias("k")).select("fp", "k.s", "k.v")
    crowded = table.groupBy("s", "v").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("s", "v")
    crowded = written(crowded, "crowded")
    probe = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("k")).select("a", "k.s", "k.v")
    some = crowded.limit(1).count() > 0
    quiet = table.join(crowded, ["s", "v"], "left_anti") if some else table
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("fp")))
    # both ends of a link may find it: a link of which only one end finds the other is kept from either
    near = probe.alias("p").join(quiet.alias("t"), (F.col("p.s") == F.col("t.s")) & (F.col("p.v") == F.col("t.v")) & (far <= radius) & (F.col("a") != F.col("fp")))
    found = near.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    if some:
        # whoever looks into a crowded value meets its members in the points; a member looks into its own value
        reach = probe.join(crowded, ["s", "v"], "left_semi").select(F.col("a").alias("fp")).distinct()
        masks = F.array(*[F.lit(_signed(m)).cast("long") for m in _balls(BITS, radius // 2)])
        points = reach.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
        center = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
        met = points.join(center, "point").where("a != fp").select("a", F.col("fp").alias("b"))
        found = found.union(met)
    return found.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: for each node of the edges (a, b) of longs the least node that it is joined with.

    Large-star and small-star rounds: each aggregates the least neighbour of each node and joins it back; every
    round is written to the shared folder. No node's neighbours are gathered in one row.
    """
    now = written(edges.where("a != b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()  # larger neighbours to the least
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m").toDF("a", "b"))
        old, now = now, written(small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        forget(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """fp, root, component_id: the least fingerprint and the least doc_id that the fingerprint's links reach. docs: the columns doc_id and fp.

    Only root is a component's own: components may share a least doc_id, or have none.
    """
    ids = written(docs.groupBy(F.col(f"`{fp}`").alias("fp")).agg(F.min(F.col(f"`{doc_id}`")).alias("first")), "classes")
    edges = links(ids.select("fp"), radius)
    root = components(edges)
    named = ids.join(root, ids["fp"] == root["node"], "left").select(ids["fp"], "first", F.coalesce("root", ids["fp"]).alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = 3) -> DataFrame:
    """doc_id, fp, component_id for each row: links hold between fingerprints of up to radius different bits.

    Null texts are empty; texts without words have fingerprint 0, which links like any other. Repeated rows
    are members as often as they occur. A null doc_id is never a component's id unless all its members have none. An empty table gives none.
    """
    own = written(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), keep=["doc_id"], words=words), "fingerprints")
    return own.join(classes(own, radius), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = 3) -> DataFrame:
    """The documents without those of which an earlier one (by doc_id) is in the same component; their columns as they are.

    Of rows with the component's least doc_id, those of the least fingerprint stay, and of these the least row by text, then by the others' JSON.
    A document whose doc_id is null stays only if no other member has one. Each component keeps one row, also where components
    share their least doc_id or have none.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, body = (f"c{docs.columns.index(c)}" for c in (doc_id, text))
    marked = written(fingerprints(plain, body), "marked")
    ids = marked.select(F.col(own).alias("doc_id"), "fp")
    labelled = ids.join(classes(ids, radius), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = labelled.groupBy("root", "component_id").agg(F.min("fp").alias("fp"))
    key = lambda c: F.concat_ws("|", F.col(c).isNull().cast("string"), F.col(c).cast("string"), "fp")
    kept = marked.withColumn("k", key(own)).join(first.select(key("component_id").alias("k")), "k", "left_semi")
    rest = [c for c in plain.columns if c != body]
    order = F.struct(body, F.to_json(F.struct(*rest)))  # columns of any type, maps too
    one = kept.groupBy("k").agg(F.min_by(F.struct(body, *rest), order).alias("row"))
    return one.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])

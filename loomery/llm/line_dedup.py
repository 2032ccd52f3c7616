"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.shared import written

WINDOW = 3


def hashed_windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """128 bits for each run of `size` lines that aren't blank; white space at a line's ends and runs of it don't count."""
    from xxhash import xxh3_128_digest

    lines = [xxh3_128_digest(" ".join(x).encode("utf-8", "surrogatepass")) for x in map(str.split, (text or "").split("\n")) if x]
    return [xxh3_128_digest(b"".join(lines[i : i + size])) for i in range(len(lines) - size + 1)]


def without(text: str | None, starts: list[int] | None, size: int = WINDOW) -> tuple[str | None, int, int]:
    """The text without the lines that windows beginning at the starts cover, its lines that aren't blank, and how many of them went.

    A blank line goes with the line before it.
    """
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    gone = {s + k for s in starts or () for k in range(size)}
    kept, place, drop = [], 0, False
    for line in lines:
        if line.strip():
            drop = place in gone
            place += 1
        if not drop:
            kept.append(line)
    return (text if not gone else "\n".join(kept)), place, len(gone)


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """d, t, at, h: a row for each window of docs (d, t, text)."""
    schema = T.StructType([docs.schema["d"], docs.schema["t"], T.StructField("at", T.IntegerType()), T.StructField("h", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                some = batch.slice(low, 2000)
                found = [hashed_windows(x, size) for x in some.column(2).to_pylist()]
                rows = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0).take(rows), some.column(1).take(rows), pa.array([k for x in found for k in range(len(x))], pa.int32()), pa.array([h for x in found for h in x], pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """docs (the columns in keep) with its text without the lines of repeated windows, and with n_lines and n_removed.

    A window is `size` consecutive lines that aren't blank. Its first occurrence, by (doc_id, hash of the
    text, place), stays; lines that any later occurrence covers go. Texts of fewer lines
    stay as they are, null texts stay null (n_lines 0). Ids are ordered by their own type; a null doc_id comes last. Rows of the same doc_id and text
    are one document and all get its result. An empty table gives an empty one. Columns n_lines and n_removed of docs are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_lines", "n_removed", text.lower())]
    order = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_lines", "n_removed")]
    d, t = F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`"))
    found = written(_windows(docs.select(d.alias("d"), t.alias("t"), F.col(f"`{text}`").alias("text")), size), "windows")
    place = F.struct(F.col("d").isNull().alias("none"), "d", "t", "at")
    repeated = found.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    later = found.join(repeated, "h").where(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy("d", "t").agg(F.collect_set("at").alias("starts"))
    fields = [docs.schema[c] for c in kept] + [T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(kept)
            made = [without(x, s, size) for x, s in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], *[pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))]], names)

    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("x"), d.alias("d"), t.alias("t"))
    starts = starts.toDF("sd", "st", "starts")
    joined = plain.join(starts, F.col("d").eqNullSafe(F.col("sd")) & (F.col("t") == F.col("st")), "left").select(*[f"c{i}" for i in range(len(kept))], "x", "starts")
    return joined.mapInArrow(run, T.StructType(fields)).select(*[F.col(f"`{c}`") for c in (order if text in order else [*order, text])], "n_lines", "n_removed")

"""Token-id files: Parquet with list columns.

Rows are in ascending order of the document's id over files in the order of their part. The ids are a list column with a
dictionary (a page's ids are bit-packed), document ids, counts and starts are delta-packed; row groups and
pages have set sizes, and page indexes let a reader fetch some documents' ids, or the counts alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.encode import encoder

END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes part, doc_id, local_start, n_tokens, ids for each document, sorted by doc_id.

    A null text is empty and has the end id only. A null doc_id comes first; rows of the same doc_id are in the order
    of their texts, repeated rows included. An empty table gives files without rows. Other columns of docs aren't written, whatever their names. parts: by default the session's shuffle partitions.
    """
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode, part, start = encoder(tokenizer).ids, TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                ids = [x + end for x in encode(some.column(1).to_pylist())]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, dtype=np.int32)), some.column(0), pa.array(start + ends - sizes), pa.array(sizes), lists], schema.names)
                start += int(ends[-1])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    writer = rows.mapInArrow(run, schema).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).option("parquet.writer.version", "v2").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    for column in ("part", "doc_id", "local_start", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, local_start, n_tokens: the ids themselves aren't read."""
    return spark.read.parquet(path).select("part", "doc_id", "local_start", "n_tokens")


def bases(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part: a row for each file, from the counts alone."""
    total, out = 0, {}
    for r in read_counts(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        out[r.part] = total
        total += r.n
    return out


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; no rows for files without any. Rows are as they were written: repeats, null doc_ids and end ids included."""
    first = spark.sparkContext.broadcast(bases(spark, path))
    rows = spark.read.parquet(path)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("start", T.LongType()), *[rows.schema[c] for c in ("n_tokens", "ids")]])

    def run(batches):
        for batch in batches:
            base = np.array([first.value[p] for p in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(base + batch.column(2).to_numpy(zero_copy_only=False)), batch.column(3), batch.column(4)], schema.names)

    return rows.select("part", "doc_id", "local_start", "n_tokens", "ids").mapInArrow(run, schema)


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit), all from the files, a row for each that was written."""
    first = spark.sparkContext.broadcast(bases(spark, path))
    rows = spark.read.parquet(path)
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])

    def run(batches):
        for batch in batches:
            base = np.array([first.value[p] for p in batch.column(0).to_pylist()], dtype=np.int64)
            lists = batch.column(3)
            at, ids = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(base + batch.column(2).to_numpy(zero_copy_only=False)), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], schema.names)

    return rows.select("part", "doc_id", "local_start", "ids").mapInArrow(run, schema)


def read_some(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """The rows of a few documents; statistics of row groups and pages leave out the others."""
    return spark.read.parquet(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")

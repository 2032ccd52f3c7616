"""Best-fit packing of token pieces into sequences, in bulk-synchronous supersteps.

Lengths are whole numbers up to the capacity, so the documents sorted by length, and the gaps sorted by
size, fall into at most `capacity` classes each; a document is (length, rank in its class) and a
sequence is (gap, place in the queue of its class). The distributed parts are the tokenizing, the ranks in
the classes and the placing of each piece; one superstep between them treats a whole class: its pieces,
longest class first, sweep the sorted gaps for their successor (the least gap that holds them), pieces
that want the same gaps get them by rank, as many to a gap as it holds, the gaps are updated, and those left over sweep again. New
sequences open only when no gap holds a piece. The sequences are those of best fit decreasing. What is matched in a superstep is a range of ranks,
so the plan is a table of ranges whose size depends on the capacity and not on the documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.encode import encoder
from loomery.llm.shared import written

CAPACITY = 1024
END_ID = 2


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): where the ranges of ranks of each length go."""
    queues: dict[int, deque] = {}  # of each gap: ranges [first sequence, number]
    gaps: list[int] = []  # those with a queue, ascending
    opened, out = 0, []

    def add(gap: int, first: int, n: int) -> None:
        if gap == 0:
            return
        if gap not in queues:
            queues[gap] = deque()
            insort(gaps, gap)
        if queues[gap] and sum(queues[gap][-1]) == first:
            queues[gap][-1][1] += n
        else:
            queues[gap].append([first, n])

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                new = -(-left // (capacity // length))
                add(capacity, opened, new)
                opened += new
                continue
            gap = gaps[k]
            each = gap // length  # a sequence is the best fit until it holds no more
            moved = []
            queue = queues[gap]
            while queue and left:
                first, n = queue[0]
                full = min(n, left // each)
                sequences, pieces = (full, each) if full else (1, left)
                for place in range(pieces):
                    out.append((length, rank + place * sequences, sequences, first, capacity - gap + place * length))
                moved.append((gap - pieces * length, first, sequences))
                rank, left = rank + pieces * sequences, left - pieces * sequences
                if sequences == n:
                    queue.popleft()
                else:
                    queue[0] = [first + sequences, n - sequences]
            if not queue:
                del queues[gap]
                gaps.pop(k)
            for smaller, first, n in moved:
                add(smaller, first, n)
    return out


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first is what whole pieces leave over."""
    rest = n % capacity
    return ([(0, rest)] if rest else []) + [(s, capacity) for s in range(rest, n, capacity)]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the piece's part (its task) and lr (rank among the part's pieces of that length).

    A null text has the end id only; repeated rows and null doc_ids have pieces of their own; an empty table has none. Other columns of docs aren't kept, whatever
    their names.
    """
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("lr", T.LongType()))])
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode, seen, part = encoder(tokenizer).ids, Counter(), TaskContext.get().partitionId()
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            rows, columns = [], [[] for _ in range(6)]
            for row, ids in enumerate(encode(batch.column(1).to_pylist())):
                view = memoryview(ids + end)
                for piece, (start, length) in enumerate(cut(len(view) // 4, capacity)):
                    rows.append(row)
                    for column, value in zip(columns, (piece, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), part, seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]], schema.names)

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: its one piece is the end id. Repeated rows are packed as often as they occur; a null doc_id stays
    null. An empty table gives no rows. Other columns of docs aren't kept. Only documents of more ids than the capacity are cut.
    """
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer, capacity, end_id, doc_id, text), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # a row for each task and length at most: the ranks of a length's pieces begin where those of earlier tasks end
    from pyspark.sql import Window

    first = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    ranges = sorted(plan(totals, capacity))
    shared = spark.sparkContext.broadcast(tuple(np.array(x, dtype=np.int64) for x in zip(*ranges, strict=True)) if ranges else None)
    ranked = pieces.join(first.select("length", "part", "base"), ["length", "part"])
    schema = T.StructType([*[pieces.schema[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        length, rank, _, sequence, offset = shared.value
        key = (length << 44) | rank
        for batch in batches:
            own, r = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (own << 44) | r, side="right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])], schema.names)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("lr")).alias("rank")).mapInArrow(place, schema)

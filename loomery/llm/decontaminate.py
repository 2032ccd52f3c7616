"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.llm.shared import free_name, map_text, written

#: Words in a window.
WINDOW = 10
#: Bytes of item texts that one pass over the documents searches for, and so the bound of what is broadcast.
PASS_BYTES = 8 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text after A-Z became a-z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Windows of one length m: for each block of two words the least distance of its end from a window's end,
    and for each last block the windows that end in it."""

    def __init__(self, windows: dict[tuple, list], m: int) -> None:
        self.m, self.b = m, min(2, m)
        self.most = m - self.b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for window, items in windows.items():
            for end in range(self.b, m + 1):
                block = window[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.most), m - end)
            self.buckets.setdefault(window[m - self.b :], []).append((window, items))

    def search(self, text: list[bytes], spans: list[tuple[int, int]], items: set) -> None:
        m, most, shift, buckets, n = self.m, self.most, self.shift.get, self.buckets, len(text)
        at = m - 1
        if self.b == 2:
            while at < n:
                block = (text[at - 1], text[at])
                skip = shift(block, most)
                if skip:
                    at += skip
                    continue
                self._confirm(text, at, buckets.get(block, ()), spans, items)
                at += 1
        else:
            for at in range(n):
                self._confirm(text, at, buckets.get((text[at],), ()), spans, items)

    def _confirm(self, text: list[bytes], at: int, bucket: list, spans: list, items: set) -> None:
        start = at - self.m + 1
        first = text[start]
        for window, own in bucket:
            if window[0] == first and window == tuple(text[start : at + 1]):
                spans.append((start, at + 1))
                items.update(own)


def tables(benchmark: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One search structure for each window length; items of fewer words are one window of their own."""
    by_length: dict[int, dict[tuple, list]] = {}
    for item, text in benchmark:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            own = by_length.setdefault(m, {}).setdefault(tuple(w[i : i + m]), [])
            if item is not None and item not in own:
                own.append(item)
    return [WuManber(x, m) for m, x in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Starts and ends, one after another, of the union of the spans."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


ADDED = [("n_words", T.LongType()), ("hit_spans", T.ArrayType(T.IntegerType())), ("hit_items", T.ArrayType(T.StringType()))]


def _one_pass(docs: DataFrame, rows: list[tuple[str | None, str]], text: str, window: int, keep: list[str]) -> DataFrame:
    """docs (the columns in keep) with ADDED, for the items in rows."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def make():
        found = tables(shared.value, window)

        def work(texts):
            out = [[], [], []]
            for x in texts:
                w, spans, own = words(x), [], set()
                for one in found:
                    one.search(w, spans, own)
                for column, value in zip(out, (len(w), merged(spans), sorted(own)), strict=True):
                    column.append(value)
            return out

        return work

    return map_text(docs, ADDED, make, text, keep)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES, keep: list[str] | None = None) -> DataFrame:
    """docs (the columns in keep) with n_words, hit_spans (starts and ends of hit word ranges, flat) and hit_items.

    A text of null or without words has no words and no hits. Benchmark rows without words have no
    windows; those whose id is null hit words but name no item. Rows repeat as they are in docs. Columns of docs
    with the names of the added ones are replaced. The benchmark is searched for in as many passes as its
    bytes need, each over all documents and written before the next one begins, so that no more than pass_bytes of item texts
    (and one item) are broadcast or held by a worker at a time; what the passes found is joined by the text's hash.
    """
    items = benchmark.select(benchmark[item].cast("string").alias("i"), benchmark[item_text].alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = -(-total // pass_bytes) or 1
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n for n, _ in ADDED}]
    if passes == 1:
        return _one_pass(docs, [(r.i, r.t) for r in items.collect()], text, window, kept)
    key = lambda c: F.struct(F.xxhash64(c), F.xxhash64(F.lit(1), c))
    texts = docs.select(F.col(f"`{text}`").alias("t")).where("t is not null").withColumn("k", key("t"))
    every = None
    for k in range(passes):
        rows = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == k).collect()]
        hits = written(_one_pass(texts, rows, "t", window, ["k"]).where(F.size("hit_spans") > 0).drop("n_words").dropDuplicates(["k"]), f"hits{k}")
        every = hits if every is None else every.unionByName(hits)
    by_text = every.groupBy("k").agg(F.flatten(F.collect_list("hit_spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))
    spans = F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(2)), lambda i: F.struct(F.get("s", i).alias("a"), F.get("s", i + 1).alias("b")))

    def take(out, x):
        """The union of the ranges so far and one that begins later."""
        last = F.element_at(out, -1)
        return F.when((F.size(out) == 0) | (x["a"] > last), F.concat(out, F.array(x["a"], x["b"]))).otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(last, x["b"]))))

    union = F.aggregate(F.array_sort(spans), F.array().cast("array<int>"), take)
    by_text = by_text.select("k", union.alias("hit_spans"), "hit_items")
    hidden = free_name(docs, "_key")
    counted = map_text(docs.withColumn(hidden, key(F.col(f"`{text}`"))), [("n_words", T.LongType())], lambda: lambda xs: [[len(words(x)) for x in xs]], text, [*kept, hidden])
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return counted.join(by_text, counted[hidden] == by_text["k"], "left").select(*[counted[c] for c in kept], "n_words", none("hit_spans", "array<int>"), none("hit_items", "array<string>"))


def n_hit(spans: str = "hit_spans"):
    """Words in the hit ranges."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit word, with their columns as they are."""
    clash = {c: free_name(docs, f"_kept_{c}") for c in docs.columns if c.lower() in ("n_words", "hit_spans", "hit_items")}
    found = find_leaks(docs.withColumnsRenamed(clash), benchmark).where(F.size("hit_spans") == 0)
    return found.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])

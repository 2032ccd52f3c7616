"""Book maps: physical page ranges of outline entries, folio calibration, section and range selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as t

LEVELS = 8


def toc_ranges(entries: DataFrame, n_pages: Column | int, delta: Column | int = 0, levels: int = LEVELS, draft: bool = False) -> DataFrame:
    """idx, level, title, slug, printed_page, physical_start, physical_end, pages, of each entry (book, idx, level, title, page).

    An entry ends before the next one of its level or above; starts and ends are kept within the book. With draft, pages are printed
    ones, moved by delta, and a column `number` may come before the title. One window pass finds the ends of each of `levels` levels.
    """
    c = F.col
    n, d = (x if isinstance(x, Column) else F.lit(x) for x in (n_pages, delta))
    after = Window.partitionBy("book").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    following = F.coalesce(*[F.when(c("level") == k, F.first(F.when(c("level") <= k, c("page")), ignorenulls=True).over(after)) for k in range(1, levels + 1)])
    start = F.greatest(F.lit(1), F.least(c("page") + d, n)).cast("long")
    title, slug = c("title"), t.slug_book(c("title"))
    if draft and "number" in entries.columns:
        title = F.when(F.coalesce(c("number"), F.lit("")) != "", t.strip(F.concat("number", F.lit(" "), "title"))).otherwise(c("title"))
        slug = t.slug_book(F.concat(F.coalesce("number", F.lit("")), F.lit(" "), "title"))
    rows = entries.withColumn("next_page", following)
    end = F.greatest(start, F.least(F.coalesce(c("next_page") + d - 1, n), n)).cast("long")
    printed = c("page") if draft else F.lit(None)
    return rows.select("book", "idx", "level", title.alias("title"), slug.alias("slug"), printed.cast("long").alias("printed_page"), start.alias("physical_start"), end.alias("physical_end"), (end - start + 1).alias("pages"))


def folio_samples(pages: DataFrame) -> DataFrame:
    """book, physical, folio, delta of sampled inner pages (book, page_num from 1, text): every so many from 15 % on, about 20 of them."""
    size = pages.groupBy("book").agg(F.max("page_num").alias("n"))
    start = F.greatest(F.floor(F.col("n") * 0.15), F.lit(5))
    end = F.greatest(F.col("n") - 2, start + 1)
    step = F.greatest(F.floor((end - start) / 20), F.lit(1))
    at = F.col("page_num") - 1
    taken = pages.join(size.select("book", start.alias("lo"), end.alias("hi"), step.alias("step")), "book").where((at >= F.col("lo")) & (at < F.col("hi")) & ((at - F.col("lo")) % F.col("step") == 0))
    return taken.select("book", F.col("page_num").alias("physical"), t.read_folio(F.col("text")).alias("folio")).where("folio is not null").withColumn("delta", F.col("physical") - F.col("folio"))


def calibrate_delta(pages: DataFrame) -> DataFrame:
    """book, delta, confidence, samples: the most frequent offset of the samples, of a tie the one seen first; null under three samples."""
    counts = folio_samples(pages).groupBy("book", "delta").agg(F.count("*").alias("n"), F.min("physical").alias("first"))
    best = counts.groupBy("book").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "delta")).alias("b"), F.sum("n").alias("samples"))
    few = F.col("samples") < 3
    return best.select("book", F.when(~few, F.col("b.delta")).alias("delta"), F.when(few, 0.0).otherwise(F.round(F.col("b.n") / F.col("samples"), 2)).alias("confidence"), "samples")


def toc_region(pages: DataFrame, probe_pages: int = 30) -> DataFrame:
    """book, lo, hi (from 0, end exclusive): 14 pages from the first whose head says contents, else the first probe_pages."""
    size = pages.groupBy("book").agg(F.max("page_num").alias("n"))
    head = F.lower(F.array_join(F.slice(F.split("text", "\n"), 1, 3), "\n"))
    hit = pages.where((F.col("page_num") <= max(probe_pages, 30)) & head.rlike(r"\bcontents\b")).groupBy("book").agg((F.min("page_num") - 1).alias("at"))
    return size.join(hit, "book", "left").select("book", F.coalesce("at", F.lit(0)).alias("lo"), F.when(F.col("at").isNotNull(), F.least(F.col("at") + 14, "n")).otherwise(F.least(F.lit(probe_pages), "n")).alias("hi"))


def dump_pages(pages: DataFrame, region: DataFrame) -> DataFrame:
    """book, text: the region's pages, each under a line with its number."""
    inside = pages.join(region, "book").where((F.col("page_num") > F.col("lo")) & (F.col("page_num") <= F.col("hi")))
    part = F.concat(F.lit("===== PHYSICAL PAGE "), "page_num", F.lit(" =====\n"), "text")
    return inside.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("text"))


def resolve_sections(ranges: DataFrame, selections: DataFrame) -> DataFrame:
    """The entry that each selection (book, sel) means: its index, else its slug, else the first title that holds it."""
    s = F.lower("sel")
    rank = F.when(F.col("sel").rlike(r"^\d+$") & (F.col("idx").cast("string") == F.col("sel")), 1).when(F.col("slug") == s, 2).when(F.lower("title").contains(s), 3)
    found = selections.join(ranges, "book").withColumn("rank", rank).where("rank is not null")
    fields = ["rank", "idx", "level", "title", "slug", "physical_start", "physical_end"]
    return found.groupBy("book", "sel").agg(F.min(F.struct(*fields)).alias("e")).select("book", "sel", *[f"e.{f}" for f in fields])


def parse_range(spec: Column) -> Column:
    """(first, last) of 'A-B' or 'A'."""
    p = F.split(spec, "-")
    a = F.get(p, F.lit(0)).cast("int")
    return F.struct(a.alias("first"), F.coalesce(F.nullif(F.get(p, F.lit(1)), F.lit("")).cast("int"), a).alias("last"))


def choose_range(pages: Column, printed: Column, delta: Column, section: Column) -> Column:
    """The range that counts: physical pages, else printed ones moved by delta, else the section's. Each is a struct (first, last)."""
    moved = F.when(printed.isNotNull(), F.struct((printed["first"] + delta).alias("first"), (printed["last"] + delta).alias("last")))
    return F.coalesce(pages, moved, section)


def slice_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """The pages within (book, first, last), both ends included and kept within the book: a range join by book."""
    return pages.join(ranges, "book").where((F.col("page_num") >= F.greatest(F.lit(1), "first")) & (F.col("page_num") <= F.col("last")))


def section_record(chosen: DataFrame) -> DataFrame:
    """book, sel, record: section.json of selections (book, sel, label, physical_start, physical_end, mode, extract_rc, source_pdf)."""
    fields = F.struct("source_pdf", F.col("book").alias("book_slug"), F.col("sel").alias("selection"), "label", "physical_start", "physical_end", (F.col("physical_end") - F.col("physical_start") + 1).alias("pages"), "mode", "extract_rc")
    return chosen.select("book", "sel", F.to_json(fields).alias("record"))


def book_map(ranges: DataFrame, books: DataFrame, draft: bool = False) -> DataFrame:
    """book, record: book_map.json from toc_ranges and books (book, source_pdf, page_count, delta, title, author). An outline is as long as a person made it."""
    shown = ["level", "title", "slug", *(["printed_page"] if draft else []), "physical_start", "physical_end", "pages"]
    entries = ranges.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(*shown).alias("e")))), lambda x: x["e"]).alias("entries"))
    source = F.lit("printed" if draft else "outline")
    metadata = F.when(F.col("title").isNotNull() | F.col("author").isNotNull(), F.struct("title", "author"))
    fields = F.struct("source_pdf", F.col("book").alias("book_slug"), "page_count", source.alias("toc_source"), (F.col("delta") if draft else F.lit(0)).alias("delta"), metadata.alias("metadata"), F.coalesce("entries", F.from_json(F.lit("[]"), entries.schema["entries"].dataType)).alias("entries"))
    return books.join(entries, "book", "left").select("book", F.to_json(fields).alias("record"))


def probe_record(books: DataFrame, region: DataFrame, deltas: DataFrame) -> DataFrame:
    """book, record: probe.json of books (book, source_pdf, page_count), toc_region and calibrate_delta."""
    joined = books.join(region, "book").join(deltas, "book", "left")
    fields = F.struct("source_pdf", F.col("book").alias("book_slug"), "page_count", F.array(F.col("lo") + 1, F.col("hi")).alias("toc_region_physical"), F.when(F.col("delta").isNotNull(), F.struct(F.col("delta"), F.col("confidence"))).alias("delta_suggestion"))
    return joined.select("book", F.to_json(fields).alias("record"))


def delta_evidence(pages: DataFrame, n: int = 20) -> DataFrame:
    """book, rank, physical, folio, delta: the first n samples of each book, which the probe shows."""
    rank = F.row_number().over(Window.partitionBy("book").orderBy("physical"))
    return folio_samples(pages).withColumn("rank", rank).where(F.col("rank") <= n).select("book", "rank", "physical", "folio", "delta")

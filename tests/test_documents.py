from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomery.operators import book, media, pdf


def test_toc(spark):
    toc = spark.createDataFrame([("b", i, lv, f"T {i}", p) for i, (lv, p) in enumerate([(1, 1), (2, 1), (2, 36), (1, 60), (2, 70)])], "book string, idx long, level int, title string, page long")
    found = book.toc_ranges(toc, 100).orderBy("idx").collect()
    assert [r.physical_end for r in found] == [59, 35, 59, 100, 100]
    one = spark.createDataFrame([("b", 0, 1, "X", 750, "13"), ("b", 1, 1, "Y", 789, None)], "book string, idx long, level int, title string, page long, number string")
    row = book.toc_ranges(one, 900, 13, draft=True).orderBy("idx").first()
    assert (row.title, row.slug, row.physical_start, row.physical_end, row.pages) == ("13 X", "13-x", 763, 801, 39)
    outside = spark.createDataFrame([("b", 0, 1, "X", 500)], "book string, idx long, level int, title string, page long")
    assert book.toc_ranges(outside, 100).first().physical_start == 100


def test_delta_tie_is_first_seen(spark):
    deltas = [3, 3, 1, 1]
    pages = spark.createDataFrame([("b", i + 1, f"x\n{i + 1 - deltas[(i - 5) % 4]}" if i >= 5 else "x") for i in range(12)], "book string, page_num long, text string")
    row = book.calibrate_delta(pages).first()
    assert (row.delta, row.confidence) == (3, 0.6) and row.samples == 5
    few = book.calibrate_delta(pages.where("page_num < 8")).first()
    assert few is None or few.delta is None


def test_selection(spark, value):
    ranges = spark.createDataFrame([("b", 0, 1, "Intro two", "intro-two", 1, 4), ("b", 1, 1, "Two", "two", 5, 9)], "book string, idx long, level int, title string, slug string, physical_start long, physical_end long")
    chosen = book.resolve_sections(ranges, spark.createDataFrame([("b", s) for s in ("1", "TWO", "tro", "zzz")], "book string, sel string"))
    assert {r.sel: r.idx for r in chosen.collect()} == {"1": 1, "TWO": 1, "tro": 0}
    assert tuple(value(book.parse_range(F.lit("3-7")))) == (3, 7) and tuple(value(book.parse_range(F.lit("4")))) == (4, 4)
    pair = lambda a, b: F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"))
    none = F.lit(None).cast("struct<first:int,last:int>")
    assert tuple(value(book.choose_range(none, pair(10, 12), F.lit(3), pair(1, 2)))) == (13, 15)
    pages = spark.createDataFrame([("b", i, f"t{i}") for i in range(1, 6)], "book string, page_num long, text string")
    assert book.slice_pages(pages, spark.createDataFrame([("b", 0, 2)], "book string, first int, last int")).count() == 2
    region = book.toc_region(pages.withColumn("text", F.when(F.col("page_num") == 2, "Table of Contents").otherwise("x")))
    assert tuple(region.first()) == ("b", 1, 5)
    assert book.dump_pages(pages, region).first().text.startswith("===== PHYSICAL PAGE 2 =====\nt2\n\n")


@pytest.mark.parametrize(("kind", "math", "want"), [("scanned", True, "nougat"), ("scanned", False, "ocr"), ("hybrid", True, "marker"), ("native", True, "marker"), ("native", False, "pymupdf")])
def test_strategy(value, kind, math, want):
    assert value(pdf.pick_strategy(F.lit(kind), F.lit(math))) == want
    assert value(pdf.pick_strategy(F.lit(kind), F.lit(math), "ocr")) == "ocr"


def test_ladder_keeps_the_last_attempt(spark):
    docs = spark.createDataFrame([("d", "native", False, 1, 1000)], "doc_group string, overall_type string, has_math boolean, pages long, native_chars long")
    tried = spark.createDataFrame([("d", "pymupdf", "x" * 600), ("d", "marker", "y" * 100)], "doc_group string, strategy string, text string")
    last = pdf.run_ladder(docs, tried).first()
    assert (last.strategy, last.text, last.score, last.unreliable) == ("nougat", "", 0.0, True)  # a missing candidate empties the text
    assert last.strategies_used == {"pymupdf": 1, "marker": 1, "nougat": 1}
    assert pdf.run_ladder(docs, tried, mode="best").first().strategy == "pymupdf"
    assert pdf.run_ladder(docs, tried, threshold=0.5).first().strategies_used == {"pymupdf": 1}


def test_profiles(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 300, 0), ("a", 2, "", 1), ("b", 1, "", 2)], "doc_group string, page_num long, text string, images int")
    profiles = pdf.profile_pages(pages)
    assert [r.type for r in profiles.orderBy("doc_group", "page_num").collect()] == ["native", "scanned", "scanned"]
    assert {r.doc_group: r.overall_type for r in pdf.profile_docs(profiles).collect()} == {"a": "hybrid", "b": "scanned"}
    assert {r.doc_group: r.pages for r in pdf.needs_vision(profiles).collect()} == {"a": [2], "b": [1]}
    bad = pdf.latex_warnings(spark.createDataFrame([(1, "$$ {a $$ and $b}$ and $c$ \\$")], "doc_id long, text string"))
    assert sorted(r.snippet for r in bad.collect()) == ["$$ {a $$", "$b}$"]


def test_vtt(spark):
    text = "WEBVTT\n\n1\n00:01.000 --> 00:02.500 align:start\n<c>Hello</c>\nyou\n\nNOTE x\n\n00:00:03.000 --> 00:00:04.000\n\n\n00:05.000 --> 00:06.000\n<b></b>\n"
    rows = media.parse_vtt(spark.createDataFrame([("v", text)], "video_id string, text string")).collect()
    assert [(r.start, r.end, r.text) for r in rows] == [(1.0, 2.5, "Hello you")]
    chosen = media.choose_source(spark.createDataFrame([("v", "faster-whisper"), ("v", "yt-dlp-subs"), ("w", "other")], "video_id string, source string"))
    assert [tuple(r) for r in chosen.collect()] == [("v", "yt-dlp-subs")]


def test_video_content(spark):
    video = spark.createDataFrame([("v", "T", None, "u", 65, "yt-dlp-subs", [(3.0, "One"), (None, "Two")], "[0:00] a\n")], "video_id string, title string, channel string, url string, duration int, transcript_source string, chapters array<struct<start_time:double,title:string>>, text string")
    assert media.video_content(video).first().content == '---\ntitle: "T"\nchannel: ""\nurl: u\nduration: 1:05\ntranscript_source: yt-dlp-subs\n---\n\n# T\n\n## Chapters\n\n- [0:03] One\n- Two\n\n## Transcript\n\n````text\n[0:00] a\n````\n'
    assert '"url":"u"' in media.video_profile(video).first().profile

"""Transcripts: caption files to segments, and segments to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions import text as t

FENCE = "````"
STAMP = r"^([\d:]+\.\d+)\s*-->\s*([\d:]+\.\d+)"


def parse_vtt(files: DataFrame, key: str = "video_id", text: str = "text") -> DataFrame:
    """key, ord, start, end, text: blocks between blank lines, their first line with an arrow, what follows without tags; empty ones go."""
    blocks = files.select(key, F.posexplode(F.split(text, r"\n\n+")).alias("ord", "block")).withColumn("lines", F.split(t.strip(F.col("block")), "\n"))
    at = F.array_position(F.transform("lines", lambda x: x.contains("-->")), F.lit(True))
    stamp = F.get("lines", (at - 1).cast("int"))
    rest = F.array_join(F.slice(F.col("lines"), (at + 1).cast("int"), F.size("lines")), " ")
    made = blocks.where(at > 0).select(key, "ord", F.regexp_extract(stamp, STAMP, 1).alias("a"), F.regexp_extract(stamp, STAMP, 2).alias("b"), t.strip(F.regexp_replace(rest, "<[^>]+>", "")).alias("text"))
    return made.where("a != '' and text != ''").select(key, "ord", t.vtt_time(F.col("a")).alias("start"), t.vtt_time(F.col("b")).alias("end"), "text")


def choose_source(candidates: DataFrame, order: tuple[str, ...] = ("youtube-transcript-api", "yt-dlp-subs", "faster-whisper")) -> DataFrame:
    """video_id, transcript_source: the first source in order that has segments (video_id, source, ...)."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("source"))
    return candidates.where(place > 0).groupBy("video_id").agg(F.min(F.struct(place.alias("p"), "source")).alias("m")).select("video_id", F.col("m.source").alias("transcript_source"))


def transcript_text(segments: DataFrame) -> DataFrame:
    """video_id, n_segments, text: a line '[time] text' for each segment, in order."""
    line = F.concat(F.lit("["), t.format_time(F.col("start")), F.lit("] "), F.coalesce("text", F.lit("")), F.lit("\n"))
    return segments.groupBy("video_id").agg(F.count("*").alias("n_segments"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "").alias("text"))


def video_content(videos: DataFrame) -> DataFrame:
    """video_id, content of (video_id, title, channel, url, duration, transcript_source, chapters, text): frontmatter, chapters, transcript in a fence."""
    c = F.col
    or_blank = lambda x: F.coalesce(c(x), F.lit(""))
    chapter = F.transform("chapters", lambda x: F.concat(F.lit("- "), F.when(x["start_time"].isNotNull(), F.concat(F.lit("["), t.format_time(x["start_time"]), F.lit("] "))).otherwise(""), F.coalesce(x["title"], F.lit(""))))
    title = F.coalesce("title", c("video_id").cast("string"))
    duration = F.when(F.coalesce("duration", F.lit(0)) > 0, t.format_time(c("duration"))).otherwise("")
    head = F.concat(F.lit("---\ntitle: "), t.json_text(title), F.lit("\nchannel: "), t.json_text(or_blank("channel")), F.lit("\nurl: "), or_blank("url"), F.lit("\nduration: "), duration, F.lit("\ntranscript_source: "), or_blank("transcript_source"), F.lit("\n---\n\n# "), title, F.lit("\n\n"))
    listed = F.when(F.coalesce(F.size("chapters"), F.lit(0)) > 0, F.concat(F.lit("## Chapters\n\n"), F.array_join(chapter, "\n"), F.lit("\n\n"))).otherwise("")
    return videos.select("video_id", F.concat(head, listed, F.lit(f"## Transcript\n\n{FENCE}text\n"), F.regexp_replace(or_blank("text"), r"\s+\z", ""), F.lit(f"\n{FENCE}\n")).alias("content"))


def video_profile(videos: DataFrame) -> DataFrame:
    return videos.select("video_id", F.to_json(F.struct(F.lit("video-transcript").alias("source"), "transcript_source", "url"), {"ignoreNullFields": "false"}).alias("profile"))

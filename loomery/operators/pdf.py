"""Page profiles and the extraction ladder over candidate texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import text as t

# What follows each strategy.
ESCALATION = {"pymupdf": "marker", "marker": "nougat", "ocr": "nougat"}
THRESHOLD = 0.7


def profile_pages(pages: DataFrame) -> DataFrame:
    """doc_group, page_num, chars, images, has_math, type."""
    chars = F.length(t.strip(F.coalesce("text", F.lit(""))))
    return pages.select("doc_group", "page_num", chars.cast("long").alias("chars"), "images", t.math_signal(F.col("text")).alias("has_math"), t.page_type(chars, F.col("images")).alias("type"))


def profile_docs(profiles: DataFrame) -> DataFrame:
    """doc_group, overall_type, has_math, pages, native_chars."""
    n = F.count("*")
    kind = F.when(F.count_if(F.col("type") == "native") == n, "native").when(F.count_if(F.col("type") == "scanned") == n, "scanned").otherwise("hybrid")
    return profiles.groupBy("doc_group").agg(kind.alias("overall_type"), F.bool_or("has_math").alias("has_math"), n.alias("pages"), F.coalesce(F.sum(F.when(F.col("type") == "native", F.col("chars"))), F.lit(0)).alias("native_chars"))


def pick_strategy(overall_type: Column, has_math: Column, force: str = "auto") -> Column:
    if force != "auto":
        return F.lit(force)
    return F.when(overall_type == "scanned", F.when(has_math, "nougat").otherwise("ocr")).when(overall_type == "hybrid", "marker").otherwise(F.when(has_math, "marker").otherwise("pymupdf"))


def ladder(overall_type: Column, has_math: Column, force: str = "auto") -> Column:
    """The strategies in the order of the attempts."""
    first = pick_strategy(overall_type, has_math, force)
    chains = F.create_map(*[x for s in ("pymupdf", "marker", "ocr", "nougat") for x in (F.lit(s), F.array(*[F.lit(y) for y in _chain(s)]))])
    return F.try_element_at(chains, first)


def _chain(s: str) -> list[str]:
    out = [s]
    while out[-1] in ESCALATION:
        out.append(ESCALATION[out[-1]])
    return out


def run_ladder(docs: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD, mode: str = "compat", force: str = "auto") -> DataFrame:
    """doc_group, strategy, text, score, unreliable, strategies_used, exit_code of profiles (profile_docs) and candidate texts (doc_group, strategy, text).

    Attempts go on until a score reaches the threshold. compat takes the last attempt, even if it is worse or empty; best the best one.
    A missing candidate is a failed attempt with the empty text. exit_code: 0, 4 for an unreliable text, 3 where there is none.
    """
    steps = docs.select("doc_group", "pages", "native_chars", F.posexplode(ladder(F.col("overall_type"), F.col("has_math"), force)).alias("step", "strategy"))
    tried = steps.join(candidates.select("doc_group", "strategy", "text"), ["doc_group", "strategy"], "left")
    clean = tried.withColumn("text", t.cleanup(F.coalesce("text", F.lit("")))).withColumn("score", t.quality_score(F.col("text"), F.col("native_chars"), F.col("pages")))
    all_ = clean.groupBy("doc_group").agg(F.array_sort(F.collect_list(F.struct("step", "strategy", "score", "text"))).alias("a"))
    good = F.filter("a", lambda x: x["score"] >= threshold)
    last = F.when(F.size(good) > 0, F.get(good, F.lit(0))).otherwise(F.element_at("a", -1))
    made = F.filter("a", lambda x: x["step"] <= last["step"])
    best = F.element_at(F.array_sort(F.transform(made, lambda x: F.struct(x["score"].alias("score"), (-x["step"]).alias("o"), x["strategy"].alias("strategy"), x["text"].alias("text")))), -1)
    chosen = best if mode == "best" else last
    used = F.map_from_entries(F.transform(made, lambda x: F.struct(x["strategy"], F.lit(1))))
    return all_.select("doc_group", chosen["strategy"].alias("strategy"), chosen["text"].alias("text"), chosen["score"].alias("score"), (chosen["score"] < threshold).alias("unreliable"), used.alias("strategies_used"), F.when(chosen["text"] == "", 3).when(chosen["score"] < threshold, 4).otherwise(0).alias("exit_code"))


def outputs(results: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_group, content, metadata (JSON), exit_code of run_ladder and profile_docs: what an extraction leaves. Where there is no text nothing is written."""
    own = results.where("exit_code != 3").join(docs.select("doc_group", "pages"), "doc_group")
    metadata = F.struct(F.col("doc_group").alias("source_pdf"), F.col("pages").alias("page_count"), "strategies_used", F.round("score", 3).alias("final_quality"))
    return own.select("doc_group", F.col("text").alias("content"), F.to_json(metadata).alias("metadata"), "exit_code")


def needs_vision(profiles: DataFrame) -> DataFrame:
    """doc_group, pages: those that aren't native, or all if none is."""
    some = F.array_sort(F.collect_list(F.when(F.col("type") != "native", F.col("page_num"))))
    return profiles.groupBy("doc_group").agg(F.when(F.size(some) > 0, some).otherwise(F.array_sort(F.collect_list("page_num"))).alias("pages"))


def latex_warnings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, snippet of maths whose braces don't balance: a weaker check than a LaTeX parser's."""
    display = F.regexp_extract_all(text, F.lit(r"(?s)\$\$.+?\$\$"), F.lit(0))
    inline = F.regexp_extract_all(text, F.lit(r"(?<!\$)\$(?!\$)[^$\n]+\$(?!\$)"), F.lit(0))
    found = docs.select(key, F.explode(F.concat(display, inline)).alias("m"))
    bare = F.regexp_replace("m", r"\\.", "")
    depth = F.aggregate(F.split(F.regexp_replace(bare, r"[^{}]", ""), ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, x: F.struct((a["d"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("d"), F.least(a["low"], a["d"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("low")))
    return found.where((depth["d"] != 0) | (depth["low"] < 0)).select(key, F.substring("m", 1, 80).alias("snippet"))


def render_worklist(results: DataFrame, profiles: DataFrame) -> DataFrame:
    """doc_group, page_num: the pages of unreliable results (run_ladder) that someone has to look at: those that aren't native, or all if all are."""
    unsure = profiles.join(results.where("unreliable and exit_code != 3").select("doc_group"), "doc_group", "left_semi")
    mixed = unsure.where("type != 'native'").select("doc_group").distinct().withColumn("mixed", F.lit(True))
    return unsure.join(mixed, "doc_group", "left").where("mixed is null or type != 'native'").select("doc_group", "page_num")

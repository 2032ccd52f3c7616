"""Concept audit: how well the sources of a corpus develop each concept, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.predicates import is_paper_like

# Predicate classes.
DEFINING = ("defines", "introduces")
ANCHORS = ("is-a", "part-of", "alternative-to")


def _in_order(value: str, when: Column) -> Column:
    """The values for which the condition holds, in the order of the edges."""
    kept = F.array_sort(F.collect_list(F.when(when, F.struct("e_seq", value))))
    return F.transform(kept, lambda x: x[value])


def audit_concepts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """slug, title, papers_count, defined_by, discussed_by, anchor_count, related_only_count, total_in, seq of each concept.

    Sources are paper-like by the nodes' types; edges from unknown slugs count as edges of concepts. Concepts without edges are kept.
    """
    paper = nodes.where(is_paper_like(F.col("type"))).select(F.col("slug").alias("from"), F.lit(True).alias("paper")).distinct()
    concept = nodes.where("type = 'concept'").select("slug", "title", "seq")
    into = edges.select(F.col("from"), F.col("to").alias("slug"), "predicate", F.col("seq").alias("e_seq")).join(paper, "from", "left")
    is_paper = F.col("paper").isNotNull()
    p = F.col("predicate")
    return (
        concept.join(into, "slug", "left").groupBy("slug", "title", "seq").agg(
            F.count_distinct(F.when(is_paper, F.col("from"))).alias("papers_count"),
            _in_order("from", is_paper & p.isin(*DEFINING)).alias("defined_by"), _in_order("from", is_paper & (p == "discusses")).alias("discussed_by"),
            F.count_if(~is_paper & p.isin(*ANCHORS)).alias("anchor_count"), F.count_if(~is_paper & (p == "related-to")).alias("related_only_count"), F.count("e_seq").alias("total_in"),
        ).select("slug", "title", "papers_count", "defined_by", "discussed_by", "anchor_count", "related_only_count", "total_in", "seq")
    )


def audit_bucket(audit: DataFrame, bucket: str) -> DataFrame:
    """A: mentioned but never defined; B: no incoming edges; C: one source, defined; D: only related-to. In report order."""
    defined = F.size("defined_by") > 0
    rule, order = {
        "A": (~defined & (F.col("total_in") > 0), [F.desc("total_in"), "seq"]),
        "B": (F.col("total_in") == 0, ["slug"]),
        "C": ((F.col("papers_count") == 1) & defined, ["slug"]),
        "D": ((F.col("anchor_count") == 0) & (F.col("related_only_count") > 0) & defined, [F.desc("related_only_count"), "seq"]),
    }[bucket]
    return audit.where(rule).orderBy(*order)


# The headings of the report.
HEADINGS = {
    "A": "A. Mentioned but never DEFINED — ingest the foundational paper", "B": "B. Orphan concepts — no incoming edges (stale?)",
    "C": "C. Single-paper concepts — sibling paper would deepen them", "D": "D. Weakly anchored — only related-to edges, no is-a / part-of",
}


def _padded(x: Column, width: int, left: bool = False) -> Column:
    gap = F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(x), F.lit(0)))
    return F.concat(gap, x) if left else F.concat(x, gap)


def report_lines(audit: DataFrame) -> DataFrame:
    """bucket, rank, line: the report, to be read by bucket and rank. Rank 0 is the bucket's heading; an empty bucket says (none)."""
    slug, count = _padded(F.col("slug"), 38), lambda c: _padded(c.cast("string"), 2, True)
    line = {
        "A": F.concat(F.lit("  "), slug, F.lit(" "), count(F.size("discussed_by")), F.lit(" discusser(s), "), count(F.col("related_only_count")), F.lit(" related-to-from-concepts")),
        "B": F.concat(F.lit("  "), "slug"),
        "C": F.concat(F.lit("  "), slug, F.lit(" defined by "), F.array_join("defined_by", ", ")),
        "D": F.concat(F.lit("  "), slug, F.lit(" related-to×"), F.col("related_only_count").cast("string")),
    }
    spark = audit.sparkSession
    heads = spark.createDataFrame([(b, 0, f"=== {x} ===") for b, x in HEADINGS.items()], "bucket string, rank bigint, line string")
    key = {"A": (-F.col("total_in"), "seq"), "B": (F.lit(0), "slug"), "C": (F.lit(0), "slug"), "D": (-F.col("related_only_count"), "seq")}
    parts = None
    for b in HEADINGS:
        one = audit_bucket(audit, b).select(F.lit(b).alias("bucket"), key[b][0].cast("long").alias("k"), F.col(key[b][1]).cast("string").alias("s"), F.col("seq").alias("n"), line[b].alias("line"))
        parts = one if parts is None else parts.unionByName(one)
    by_number = F.when(F.col("bucket").isin("A", "D"), F.col("n")).otherwise(0)
    ranked = parts.select("bucket", F.row_number().over(Window.partitionBy("bucket").orderBy("k", by_number, "s")).cast("long").alias("rank"), "line")
    empty = heads.select("bucket").join(parts, "bucket", "left_anti").select("bucket", F.lit(1).cast("long").alias("rank"), F.lit("  (none)").alias("line"))
    return heads.unionByName(ranked).unionByName(empty)

"""Merging two corpora, and changes to one: keyed unions with policies for clashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as t

POLICIES = ("skip", "replace", "rename")


class SchemaConflict(ValueError):
    """Two corpora define a predicate in different ways."""


def predicate_conflicts(source: DataFrame, target: DataFrame) -> DataFrame:
    """name, source_json, target_json of the predicates that differ."""
    return source.select("name", F.col("raw_json").alias("source_json")).join(target.select("name", F.col("raw_json").alias("target_json")), "name").where("source_json != target_json")


def merge_predicates(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target's predicates and the source's others; raises SchemaConflict before anything is merged."""
    different = [r.name for r in predicate_conflicts(source, target).orderBy("name").limit(20).collect()]
    if different:
        raise SchemaConflict(f"defined in different ways: {', '.join(different)}")
    return target.unionByName(source.join(target.select("name"), "name", "left_anti").select(target.columns))


def page_actions(source: DataFrame, target: DataFrame, on_conflict: str = "skip") -> DataFrame:
    """slug, action, dest_slug for the source's pages (slug): copy, or what the policy says where the target has the slug.

    A renamed page gets the first free number from 2 on. Numbers are tried against the slugs of both sides, so that no
    two pages can meet in a new name; a page of the source keeps its own slug in any case.
    """
    if on_conflict not in POLICIES:
        raise ValueError(f"a policy is one of {POLICIES}")
    have = target.select("slug").distinct().withColumn("has", F.lit(True))
    marked = source.select("slug").join(have, "slug", "left")
    if on_conflict != "rename":
        return marked.select("slug", F.when(F.col("has"), on_conflict).otherwise("copy").alias("action"), F.col("slug").alias("dest_slug"))
    taken = target.select("slug").union(source.select("slug")).distinct()
    # the numbers that slugs of this stem have already: the first gap from 2 on is free
    used = taken.select(F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", 1).alias("stem"), F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", 2).alias("n"), "slug").where("n != ''").where(F.col("slug") == F.concat("stem", F.lit("-"), F.col("n").cast("int").cast("string")))
    clash = marked.where("has").select("slug")
    numbers = used.join(clash.withColumnRenamed("slug", "stem"), "stem", "left_semi").select("stem", F.col("n").cast("int").alias("n")).where("n >= 2")
    place = F.row_number().over(Window.partitionBy("stem").orderBy("n")) + 1
    dense = numbers.withColumn("expected", place).where("n = expected").groupBy("stem").agg((F.max("n") + 1).alias("free"))
    renamed = marked.join(dense, F.col("slug") == F.col("stem"), "left")
    new = F.concat("slug", F.lit("-"), F.coalesce("free", F.lit(2)).cast("string"))
    return renamed.select("slug", F.when(F.col("has"), "rename").otherwise("copy").alias("action"), F.when(F.col("has"), new).otherwise(F.col("slug")).alias("dest_slug"))


def _renames(actions: DataFrame) -> DataFrame:
    return actions.where("action = 'rename'").select(F.col("slug").alias("old"), F.col("dest_slug").alias("new"))


def merge_nodes(source: DataFrame, target: DataFrame, actions: DataFrame) -> DataFrame:
    """slug, title, type, seq: by slug, the source's node before the target's unless its page was skipped; the target's order first."""
    skipped = actions.where("action = 'skip'").select("slug")
    own = source.where(F.coalesce("slug", F.lit("")) != "").join(_renames(actions), F.col("slug") == F.col("old"), "left").withColumn("slug", F.coalesce("new", "slug")).join(skipped, "slug", "left_anti")
    both = target.where(F.coalesce("slug", F.lit("")) != "").select("slug", "title", "type", "seq", F.lit(0).alias("side")).unionByName(own.select("slug", "title", "type", "seq", F.lit(1).alias("side")))
    best = both.groupBy("slug").agg(F.max(F.struct("side", "seq", "title", "type")).alias("b"), F.min(F.struct("side", "seq")).alias("f"))
    return best.select("slug", "b.title", "b.type", F.col("f.side").alias("side"), F.col("f.seq").alias("seq"))


def merge_edges(source: DataFrame, target: DataFrame, actions: DataFrame) -> DataFrame:
    """from, to, predicate, context, side, seq: distinct by (from, to, predicate), the target's and the first context kept.

    Endpoints follow the renames; edges that touch a skipped slug go.
    """
    skipped = actions.where("action = 'skip'").select("slug")
    names = _renames(actions)
    own = source
    for end in ("from", "to"):
        own = own.join(names, F.col(end) == F.col("old"), "left").withColumn(end, F.coalesce("new", end)).drop("old", "new")
        own = own.join(skipped.withColumnRenamed("slug", end), end, "left_anti")
    columns = ["from", "to", "predicate", "context", "seq"]
    both = target.select(*columns, F.lit(0).alias("side")).unionByName(own.select(*columns, F.lit(1).alias("side")))
    return dedupe_edges(both)


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (from, to, predicate), by side (if there is one) and seq."""
    order = [c for c in ("side", "seq") if c in edges.columns]
    first = edges.groupBy("from", "to", "predicate").agg(F.min(F.struct(*order, "context")).alias("f"))
    return first.select("from", "to", "predicate", "f.context", *[f"f.{c}" for c in order])


def renamed_pages(pages: DataFrame, actions: DataFrame) -> DataFrame:
    """slug, text of the pages that are written: those not skipped, under their new slug; links in bodies stay."""
    from loomery.functions.text import rename_slug

    moved = pages.join(actions.where("action != 'skip'"), "slug")
    return moved.select(F.col("dest_slug").alias("slug"), F.when(F.col("action") == "rename", rename_slug(F.col("text"), F.col("slug"), F.col("dest_slug"))).otherwise(F.col("text")).alias("text"))


def replace_outgoing(edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """The edges with those of each source that new_edges names replaced by the new ones."""
    return edges.join(new_edges.select("from").distinct(), "from", "left_anti").select(edges.columns).unionByName(new_edges.select(edges.columns))


def known_sources(bundles: DataFrame, pages: DataFrame) -> DataFrame:
    """The bundles whose source a page names already: a re-ingest."""
    return bundles.join(pages.select(F.col("fm")["source"].alias("source")).where("source is not null").distinct(), "source", "left_semi")


def promote(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after each pair of synonyms (a, b) became one: the slug of more edges stays, of a tie the lesser.

    A slug is in one pair at most.
    """
    degree = edges.select(F.explode(F.array("from", "to")).alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))
    ranked = pairs.join(degree.toDF("a", "na"), "a", "left").join(degree.toDF("b", "nb"), "b", "left").fillna(0, ["na", "nb"])
    keep_a = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") <= F.col("b")))
    names = ranked.select(F.when(keep_a, F.col("b")).otherwise(F.col("a")).alias("old"), F.when(keep_a, F.col("a")).otherwise(F.col("b")).alias("new"))
    moved = edges
    for end in ("from", "to"):
        moved = moved.join(names, F.col(end) == F.col("old"), "left").withColumn(end, F.coalesce("new", end)).drop("old", "new")
    return nodes.join(names.select(F.col("old").alias("slug")), "slug", "left_anti").select(nodes.columns), dedupe_edges(moved.where(F.col("from") != F.col("to")))


def papers_out_of_sync(pages: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """slug, missing, extra: concept pages whose papers list differs from the sources of their edges."""
    source = nodes.where(F.col("type").isin("paper", "video", "pdf")).select(F.col("slug").alias("from"))
    real = edges.join(source, "from", "left_semi").groupBy(F.col("to").alias("slug")).agg(F.collect_set("from").alias("real"))
    empty = F.array().cast("array<string>")
    listed = pages.where(F.col("fm")["type"] == "concept").select("slug", F.coalesce(F.col("fm_lists")["papers"], empty).alias("listed")).join(real, "slug", "left").withColumn("real", F.coalesce("real", empty))
    out = listed.select("slug", F.array_sort(F.array_except("real", "listed")).alias("missing"), F.array_sort(F.array_except("listed", "real")).alias("extra"))
    return out.where((F.size("missing") > 0) | (F.size("extra") > 0))


def strongest_predicate(edges: DataFrame, strength: list[str]) -> DataFrame:
    """from, to, predicate: of several edges between two nodes the predicate that stands first in strength; others last, by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in strength]), F.col("predicate"))
    return edges.groupBy("from", "to").agg(F.min(F.struct(F.when(place == 0, len(strength) + 1).otherwise(place).alias("p"), "predicate")).alias("m")).select("from", "to", "m.predicate")


def page_slugs(pages: DataFrame) -> DataFrame:
    """seq, slug of pages (seq, title): the slug of the title's first eight words; of equal ones the first keeps it, the others get numbers that no slug has."""
    own = pages.select("seq", t.slug_title(F.col("title")).alias("slug"))
    stem = lambda k: F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", k)
    used = own.select(stem(1).alias("stem"), stem(2).alias("n")).where("n != ''").groupBy("stem").agg(F.max(F.col("n").cast("long")).alias("most"))
    place = F.row_number().over(Window.partitionBy("slug").orderBy("seq"))
    numbered = own.withColumn("r", place).join(used, F.col("slug") == F.col("stem"), "left")
    number = F.greatest(F.coalesce("most", F.lit(1)), F.lit(1)) + F.col("r") - 1
    return numbered.select("seq", F.when(F.col("r") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), number.cast("string"))).alias("slug"))

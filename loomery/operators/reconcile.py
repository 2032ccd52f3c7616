"""Concepts across corpora: bridges, the root graph, and the connections report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings of the report, and the signs of its matrix.
TITLE, BRIDGES, SYNONYMS, COVERAGE, PATHS = "# Cross-Corpus Connections", "## Bridge Concepts", "## Candidate Synonyms", "## Thematic Coverage Map", "## Cross-Corpus Reading Paths"
COVERED, NOT_COVERED = "●", "○"


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each corpus and slug: the last one's fields at the first one's place."""
    one = nodes.groupBy("corpus", "slug").agg(F.max(F.struct("seq", "title", "type")).alias("l"), F.min("seq").alias("seq"))
    return one.select("corpus", "slug", "l.title", "l.type", "seq")


def confirmed_bridges(nodes: DataFrame) -> DataFrame:
    """slug, corpora: concepts of more than one corpus; corpora in order of their names."""
    return nodes.where("type = 'concept'").groupBy("slug").agg(F.array_sort(F.collect_set("corpus")).alias("corpora")).where(F.size("corpora") > 1)


def same_as_edges(bridges: DataFrame) -> DataFrame:
    """from, to, predicate for each pair of corpora of a bridge. A slug has as many corpora as there are vaults at most."""
    left = bridges.select("slug", "corpora", F.posexplode("corpora").alias("i", "a"))
    pairs = left.select("slug", "a", F.explode(F.slice(F.col("corpora"), F.col("i") + 2, F.size("corpora"))).alias("b"))
    name = lambda c: F.concat(c, F.lit("/"), "slug")
    return pairs.select(name("a").alias("from"), name("b").alias("to"), F.lit("same-as").alias("predicate"))


def root_nodes(nodes: DataFrame, bridges: DataFrame) -> DataFrame:
    """slug (namespaced), corpus, local_slug, title, type of the bridges' nodes."""
    found = nodes.where("type = 'concept'").join(bridges.select("slug"), "slug", "left_semi")
    return found.select(F.concat("corpus", F.lit("/"), "slug").alias("slug"), "corpus", F.col("slug").alias("local_slug"), F.coalesce("title", "slug").alias("title"), F.lit("concept").alias("type"))


def carry_over(new_nodes: DataFrame, new_edges: DataFrame, old_nodes: DataFrame, old_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The root graph with what earlier runs added: edges other than same-as, and nodes that aren't confirmed."""
    kept_edges = old_edges.where(F.coalesce("predicate", F.lit("")) != "same-as")
    kept_nodes = old_nodes.join(new_nodes.select("slug"), "slug", "left_anti")
    return new_nodes.unionByName(kept_nodes, allowMissingColumns=True), new_edges.unionByName(kept_edges, allowMissingColumns=True)


def top_outgoing(edges: DataFrame, n: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(by,) from, rank, label of the first n edges of each node: 'to (predicate): context', the context up to 100 characters. Edges of one seq are in the order of their ends."""
    rank = F.row_number().over(Window.partitionBy(*by, "from").orderBy("seq", "to", "predicate"))
    label = F.concat("to", F.lit(" ("), "predicate", F.lit("): "), F.substring(F.coalesce("context", F.lit("")), 1, 100))
    return edges.withColumn("rank", rank).where(F.col("rank") <= n).select(*by, "from", "rank", label.alias("label"))


def concept_inventory(nodes: DataFrame, edges: DataFrame, n: int = 3) -> DataFrame:
    """corpus, slug, title, top_edges."""
    top = top_outgoing(edges, n, ("corpus",)).groupBy("corpus", F.col("from").alias("slug")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("top_edges"))
    return nodes.where("type = 'concept'").join(top, ["corpus", "slug"], "left").select("corpus", "slug", F.coalesce("title", "slug").alias("title"), F.coalesce("top_edges", F.array().cast("array<string>")).alias("top_edges"))


def bridge_groups(root_nodes: DataFrame, root_edges: DataFrame) -> DataFrame:
    """slug, corpora: the corpora of each bridge in the order in which the same-as edges (seq) name them."""
    node = root_nodes.select(F.col("slug").alias("ns"), "local_slug", "corpus")
    same = root_edges.where("predicate = 'same-as'")
    first = same.join(node, F.col("from") == F.col("ns")).select("seq", "local_slug", F.lit(0).alias("end"), "corpus", "to")
    second = first.select("seq", "local_slug", "to").join(node.select("ns", "corpus"), F.col("to") == F.col("ns")).select("seq", "local_slug", F.lit(1).alias("end"), "corpus")
    seen = first.drop("to").unionByName(second).groupBy("local_slug", "corpus").agg(F.min(F.struct("seq", "end")).alias("at"))
    return seen.groupBy(F.col("local_slug").alias("slug")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "corpus"))), lambda x: x["corpus"]).alias("corpora"))


def theme_matrix(root_nodes: DataFrame, root_edges: DataFrame, corpora: list[str]) -> DataFrame:
    """theme, title and a column for each corpus: ● where the theme covers a node of it, else ○."""
    themes = root_nodes.where("type = 'theme'").select(F.col("slug").alias("theme"), "title")
    node = root_nodes.select(F.col("slug").alias("to"), "corpus")
    covered = root_edges.where("predicate = 'covers'").join(node, "to").select(F.col("from").alias("theme"), "corpus")
    flags = themes.join(covered, "theme", "left").groupBy("theme", "title").agg(*[F.max(F.col("corpus") == c).alias(c) for c in corpora])
    return flags.select("theme", "title", *[F.when(F.coalesce(F.col(f"`{c}`"), F.lit(False)), COVERED).otherwise(NOT_COVERED).alias(c) for c in corpora])


def synonym_lines(root_nodes: DataFrame, root_edges: DataFrame) -> DataFrame:
    """line, rank: a line of the report for each candidate (same-as?) edge, whose ends may be missing; in the order of seq, else of the ends."""
    node = root_nodes.select("slug", "title", "corpus")
    found = root_edges.where("predicate = 'same-as?'")
    context = F.col("context") if "context" in found.columns else F.lit(None).cast("string")
    order = ["seq"] if "seq" in found.columns else ["from", "to"]
    named = found.withColumn("context", context).join(node.toDF("from", "ft", "fc"), "from", "left").join(node.toDF("to", "tt", "tc"), "to", "left")
    end = lambda title, slug, corpus: F.concat(F.lit("**"), F.coalesce(title, slug), F.lit("** ("), F.coalesce(corpus, F.lit("?")), F.lit(")"))
    line = F.concat(F.lit("- "), end("ft", "from", "fc"), F.lit(" ↔ "), end("tt", "to", "tc"), F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("  — "), "context")).otherwise(""))
    rank = F.col("seq") if order == ["seq"] else F.row_number().over(Window.orderBy(*order))
    return named.select(line.alias("line"), rank.alias("rank"))


def connections_report(nodes: DataFrame, edges: DataFrame, root: tuple[DataFrame, DataFrame], order: list[str], previous: str = "", today: str = "") -> str:
    """The text of the connections report. Only corpora of the given order are listed; the reading paths of the previous report stay."""
    root_nodes_, root_edges_ = root
    corpora = [r.corpus for r in nodes.select("corpus").distinct().collect()]
    listed = [c for c in order if c in corpora]
    lines = [f"> Generated {today} from `graph.json`.", "", TITLE, "", BRIDGES, ""]
    groups = bridge_groups(root_nodes_, root_edges_)
    sample = F.coalesce(F.get(F.filter(F.array(*[F.lit(c) for c in order]), lambda c: F.array_contains("corpora", c)), F.lit(0)), F.get("corpora", F.lit(0)))
    titled = groups.withColumn("corpus", sample).join(nodes.select("corpus", "slug", "title"), ["corpus", "slug"], "left")
    hints = top_outgoing(edges, 2, ("corpus",)).groupBy("corpus", F.col("from").alias("slug")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: F.trim(F.substring_index(x["label"], "(", 1))), ", ").alias("hint"))
    each = groups.select("slug", F.explode("corpora").alias("corpus")).join(hints, ["corpus", "slug"], "left").groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct("corpus", F.coalesce("hint", F.lit(""))))).alias("hints"))
    for r in titled.join(each, "slug").orderBy(F.desc(F.size("corpora")), "slug").toLocalIterator():
        lines += [f"### {r.title or r.slug}", ""]
        for c in (c for c in listed if c in r.hints):
            lines += [f"**[{c}]({c}/README.md)** —" + (f" Connects to: {r.hints[c]}." if r.hints[c] else ""), ""]
    rows = [r.line for r in synonym_lines(root_nodes_, root_edges_).orderBy("rank").toLocalIterator()]
    if rows:
        lines += ["---", "", SYNONYMS, "", *rows, ""]
    matrix = theme_matrix(root_nodes_, root_edges_, listed).orderBy("theme").collect()
    if matrix:
        lines += ["---", "", COVERAGE, "", "| Theme | " + " | ".join(listed) + " |", "|---|" + "|".join(["---"] * len(listed)) + "|"]
        lines += [f"| {r.title} | " + " | ".join(r[c] for c in listed) + " |" for r in matrix] + [""]
    if PATHS in previous:
        lines += ["---", "", previous[previous.index(PATHS) :]]
    return "\n".join(lines)


def _deletions(x: Column, depth: int) -> Column:
    """The text and all texts with up to `depth` letters left out."""
    out = F.array(x)
    for _ in range(depth):
        one = F.flatten(F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
        out = F.array_distinct(F.concat(out, one))
    return out


def synonym_candidates(nodes: DataFrame, edges: DataFrame, distance: int = 2, overlap: float = 0.5) -> DataFrame:
    """a, b, reason: concepts of different slugs and corpora with titles of up to `distance` (1 or 2) edits, or with shared edge targets.

    Distinct titles that are so near share a text with up to `distance` letters left out: they meet by such texts, and the edit
    distance is verified where they meet. Targets meet by shared neighbours. Both are equi-joins, merged: an estimate of what is
    exploded is far too low, and a broadcast of it more than a driver holds.
    """
    concept = nodes.where("type = 'concept'").select("corpus", "slug", F.lower(F.coalesce("title", "slug")).alias("title"))
    titles = concept.select("title").distinct()
    keys = titles.select("title", F.explode(_deletions(F.col("title"), distance)).alias("k")).select("title", F.xxhash64("k").alias("k"))
    met = keys.toDF("ta", "k").hint("merge").join(keys.toDF("tb", "k"), "k").where((F.col("ta") < F.col("tb")) & (F.levenshtein("ta", "tb", distance) >= 0)).select("ta", "tb").distinct()
    both_ways = F.explode(F.array(F.struct(F.col("ta"), F.col("tb")), F.struct(F.col("tb").alias("ta"), F.col("ta").alias("tb"))))
    alike_titles = met.select(both_ways.alias("x")).select("x.*").unionByName(titles.select(F.col("title").alias("ta"), F.col("title").alias("tb")))
    name = F.concat("corpus", F.lit("/"), "slug")
    side = lambda s: concept.select(name.alias(s), F.col("corpus").alias(f"c{s}"), F.col("slug").alias(f"s{s}"), F.col("title").alias(f"t{s}"))
    near = alike_titles.hint("merge").join(side("a"), "ta").hint("merge").join(side("b"), "tb").where((F.col("ca") < F.col("cb")) & (F.col("sa") != F.col("sb")))
    out = edges.groupBy("corpus", F.col("from").alias("slug")).agg(F.collect_set("to").alias("targets")).hint("merge").join(concept, ["corpus", "slug"], "left_semi").withColumn("n", F.size("targets"))
    long = out.select("corpus", "slug", "n", F.explode("targets").alias("t"))
    # sets that share so much share one of each other's rarest targets: a popular target brings nodes together only if they have no rarer one
    rarity = long.groupBy("t").agg(F.count("*").alias("df"))
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("df", "t"))), F.lit(1), F.first("n") - F.ceil(F.first("n") * overlap).cast("int") + 1)
    index = long.hint("merge").join(rarity, "t").groupBy("corpus", "slug").agg(F.first("n").alias("n"), rarest.alias("r")).select("corpus", "slug", "n", F.explode("r.t").alias("t"))
    met = index.toDF("ca", "sa", "na", "t").hint("merge").join(index.toDF("cb", "sb", "nb", "t"), "t").where((F.col("ca") < F.col("cb")) & (F.col("sa") != F.col("sb")) & (F.least("na", "nb") >= F.lit(overlap) * F.greatest("na", "nb"))).select("ca", "sa", "cb", "sb").distinct()
    sets = out.select("corpus", "slug", "targets")
    shared = met.hint("merge").join(sets.toDF("ca", "sa", "ta"), ["ca", "sa"]).hint("merge").join(sets.toDF("cb", "sb", "tb"), ["cb", "sb"]).withColumn("k", F.size(F.array_intersect("ta", "tb")))
    alike = shared.where(F.col("k") / (F.size("ta") + F.size("tb") - F.col("k")) >= overlap)
    both = near.select("a", "b", F.lit("title").alias("reason")).unionByName(alike.select(F.concat("ca", F.lit("/"), "sa").alias("a"), F.concat("cb", F.lit("/"), "sb").alias("b"), F.lit("targets").alias("reason")))
    return both.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("reason"))


def themes_by_label(items: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(theme nodes, covers edges) from items (slug, corpus, label): a theme for each label of at least `least` corpora."""
    wide = items.groupBy("label").agg(F.count_distinct("corpus").alias("n")).where(F.col("n") >= least).select("label")
    theme = F.concat(F.lit("theme/"), F.col("label").cast("string"))
    nodes = wide.select(theme.alias("slug"), F.lit(None).cast("string").alias("corpus"), F.lit(None).cast("string").alias("local_slug"), F.col("label").cast("string").alias("title"), F.lit("theme").alias("type"))
    return nodes, items.join(wide, "label").select(theme.alias("from"), F.col("slug").alias("to"), F.lit("covers").alias("predicate"))

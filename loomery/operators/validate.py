"""Integrity rules over pages, source documents, nodes, edges and predicates, each a lazy DataFrame of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions import text as t
from loomery.operators.predicates import REQUIRED, is_paper_like

ISSUE = ("severity", "rule", "slug", "edge_seq", "message")


def read_pages(files: DataFrame) -> DataFrame:
    """slug, path, subdir, fm, fm_lists, has_frontmatter, body of files (path, text); of equal stems the last path in order holds."""
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    last = files.where(F.col("path").endswith(".md")).groupBy(stem.alias("slug")).agg(F.max(F.struct("path", "text")).alias("p"))
    text = F.col("p.text")
    return last.select("slug", F.col("p.path").alias("path"), F.regexp_extract("p.path", r"([^/]*)/[^/]+$", 1).alias("subdir"), t.frontmatter(text).alias("fm"), t.frontmatter_lists(text).alias("fm_lists"), t.has_frontmatter(text).alias("has_frontmatter"), t.body_of(text).alias("body"))


def _issue(df: DataFrame, severity: str, rule: str, slug, message, seq=None) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), slug.cast("string").alias("slug"), (F.lit(None) if seq is None else seq).cast("long").alias("edge_seq"), message.alias("message"))


def _say(*parts):
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) if not isinstance(p, str) else F.lit(p) for p in parts])


def page_issues(pages: DataFrame, source_docs: DataFrame) -> DataFrame:
    """V02 and V04 to V12. Pages without frontmatter have no other issue here, those of unknown type none after it.

    One pass over the pages gives all issues, those that depend on other files (V02, V09, V10) with the name to look up; one
    join with the names that exist decides these.
    """
    c = F.col
    kind = t.strip(F.coalesce(c("fm")["type"], F.lit("")))
    paper, concept = is_paper_like(c("kind")), c("kind") == "concept"
    typed = paper | concept
    required = F.when(paper, F.array(*[F.lit(x) for x in REQUIRED["paper"]])).otherwise(F.array(*[F.lit(x) for x in REQUIRED["concept"]]))
    empty = lambda f: F.coalesce(c("fm")[f] == "", F.lit(True)) | F.coalesce(F.size(c("fm_lists")[f]) == 0, F.lit(False))
    place = F.when(paper, "papers").otherwise("concepts")
    none = F.array().cast("array<struct<rule:string,severity:string,name:string,message:string>>")

    def issue(rule: str, message, severity: str = "error", name=None):
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.lit(None) if name is None else name).cast("string").alias("name"), message.cast("string").alias("message"))

    def each(condition, values, make):
        return F.when(condition, F.transform(values, make)).otherwise(none)

    def one(condition, made):
        return F.when(condition, F.array(made)).otherwise(none)

    found = F.concat(
        F.array(issue("V02", _say("source document has the name of page ", c("slug")), name=c("slug"))),
        one(~c("has_frontmatter"), issue("V04", _say("no frontmatter"))),
        one(c("has_frontmatter") & ~typed, issue("V05", _say("unknown type ", c("kind")))),
        each(c("has_frontmatter") & typed, F.filter(required, empty), lambda f: issue("V06", _say("frontmatter lacks ", f))),
        one(c("has_frontmatter") & typed & (c("fm")["slug"] != "") & (c("fm")["slug"] != c("slug")), issue("V07", _say("frontmatter slug is ", c("fm")["slug"]))),
        one(c("has_frontmatter") & typed & (c("subdir") != place), issue("V08", _say("lies under ", c("subdir"), ", not ", place))),
        each(c("has_frontmatter") & typed, t.wiki_links(c("body")), lambda x: issue("V09", _say("link to missing ", x), name=x)),
        one(c("has_frontmatter") & typed & (c("doc") != ""), issue("V10", _say("source document ", c("doc"), " is missing"), name=c("doc"))),
        one(c("has_frontmatter") & paper & (c("doc") == ""), issue("V11", _say("no source document"), "warn")),
        each(c("has_frontmatter") & paper, t.image_embeds(c("body")), lambda x: issue("V12", _say("image on a source page: ", x))),
    )
    rows = pages.withColumns({"kind": kind, "doc": t.strip(F.coalesce(c("fm")["source_doc"], F.lit("")))}).select("slug", F.explode(found).alias("i")).select("slug", "i.*")
    names = pages.select(c("slug").alias("name"), F.lit(True).alias("page")).unionByName(source_docs.select(c("stem").alias("name"), F.lit(False).alias("page")))
    exist = names.groupBy("name").agg(F.bool_or("page").alias("is_page"), F.bool_or(~c("page")).alias("is_doc"))
    is_doc, any_ = F.coalesce(c("is_doc"), F.lit(False)), c("is_page").isNotNull()
    holds = F.when(c("rule") == "V02", is_doc).when(c("rule") == "V09", ~any_).when(c("rule") == "V10", ~is_doc).otherwise(True)
    return rows.join(exist, "name", "left").where(holds).select("severity", "rule", "slug", F.lit(None).cast("long").alias("edge_seq"), "message")


def node_issues(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """V13 to V15."""
    c = F.col
    named = nodes.where(F.coalesce(c("slug"), F.lit("")) != "")
    return _issue(nodes.where(F.coalesce(c("slug"), F.lit("")) == ""), "error", "V13", c("slug"), _say("node without slug")).unionByName(
        _issue(named.join(pages.select("slug"), "slug", "left_anti"), "error", "V14", c("slug"), _say("node without page"))
    ).unionByName(_issue(pages.join(named.select("slug").distinct(), "slug", "left_anti"), "warn", "V15", c("slug"), _say("page without node")))


def edge_issues(pages: DataFrame, edges: DataFrame, predicates: DataFrame) -> DataFrame:
    """V16 to V21. A missing predicate has no further issue, endpoints without page are not typed."""
    c = F.col
    kinds = pages.select("slug", F.coalesce(c("fm")["type"], F.lit("none")).alias("kind"))
    ends = edges.select("seq", "predicate", F.stack(F.lit(2), F.lit("from"), c("from"), F.lit("to"), c("to")).alias("end", "slug")).withColumn("slug", F.coalesce("slug", F.lit("")))
    joined = ends.join(kinds, "slug", "left").join(predicates.select(c("name").alias("predicate"), "from_type", "to_type", F.lit(True).alias("known")), "predicate", "left")
    blank = F.coalesce(c("predicate"), F.lit("")) == ""
    want = F.when(c("end") == "from", c("from_type")).otherwise(c("to_type"))
    wrong = c("known") & c("kind").isNotNull() & (F.coalesce(want, F.lit("*")) != "*") & (want != "") & ~((want == "paper") & is_paper_like(c("kind"))) & (c("kind") != want)
    rule = F.array_compact(F.array(
        F.when(c("slug") == "", "V16"), F.when((c("slug") != "") & c("kind").isNull(), "V17"),
        F.when((c("end") == "from") & blank, "V18"), F.when((c("end") == "from") & ~blank & c("known").isNull(), "V19"),
        F.when(~blank & wrong, F.when(c("end") == "from", "V20").otherwise("V21")),
    ))
    found = joined.select("seq", "slug", "end", "predicate", F.explode(rule).alias("rule"))
    about = F.when(c("rule").isin("V18", "V19"), c("predicate")).otherwise(c("slug"))
    return found.select(F.lit("error").alias("severity"), "rule", about.alias("slug"), c("seq").alias("edge_seq"), _say("edge ", c("seq"), " ", F.when(c("rule").isin("V18", "V19"), "predicate").otherwise(c("end")), ": ", about).alias("message"))


def in_degree(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """slug, incoming, paper_edges of each page: duplicates and loops count, whatever the edge's source is."""
    by = F.col("predicate").isin("defines", "discusses", "introduces")
    counts = edges.groupBy(F.col("to").alias("slug")).agg(F.count("*").alias("incoming"), F.count_if(by).alias("paper_edges"))
    return pages.select("slug", F.col("fm")["type"].alias("kind")).join(counts, "slug", "left").select("slug", "kind", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.when(F.col("kind") == "concept", F.coalesce("paper_edges", F.lit(0))).otherwise(0).alias("paper_edges"))


def orphan_issues(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """V22 and V23."""
    degrees = in_degree(pages, edges)
    rules = F.array_compact(F.array(F.when(F.col("incoming") == 0, "V22"), F.when((F.col("kind") == "concept") & (F.col("paper_edges") == 0), "V23")))
    found = degrees.select("slug", F.explode(rules).alias("rule"))
    return found.select(F.lit("warn").alias("severity"), "rule", "slug", F.lit(None).cast("long").alias("edge_seq"), F.when(F.col("rule") == "V22", "no incoming edges").otherwise("no source defines, discusses or introduces it").alias("message"))


def validate(pages: DataFrame, source_docs: DataFrame, nodes: DataFrame, edges: DataFrame, predicates: DataFrame, cache: bool = False) -> DataFrame:
    """severity, rule, slug, edge_seq, message: all issues. With cache the parsed pages are persisted for the rules that share them; the caller unpersists.

    V01 (missing inputs) is an error of the readers; V03 can't occur, as pages are keyed by stem."""
    pages = pages.persist() if cache else pages
    return page_issues(pages, source_docs).unionByName(node_issues(pages, nodes)).unionByName(edge_issues(pages, edges, predicates)).unionByName(orphan_issues(pages, edges))


def summary(issues: DataFrame) -> DataFrame:
    """severity, n, failed: issue counts, and whether a run with them fails."""
    return issues.groupBy("severity").agg(F.count("*").alias("n")).withColumn("failed", F.col("severity") == "error")


def index_listing(pages: DataFrame) -> DataFrame:
    """type, heading, rank, slug, title, date: the index by type (papers, videos, pdfs, concepts, others A to Z), newest first."""
    from pyspark.sql import Window

    fm = lambda k, other: F.coalesce(F.col("fm")[k], other)
    rows = pages.select(fm("type", F.lit("unknown")).alias("type"), "slug", fm("title", F.col("slug")).alias("title"), fm("date", fm("ingested", F.lit(""))).alias("date"))
    place = F.array_position(F.array(*[F.lit(x) for x in ("paper", "video", "pdf", "concept")]), F.col("type"))
    heading = F.concat(F.upper(F.substring("type", 1, 1)), F.lower(F.substring(F.col("type"), F.lit(2), F.length("type"))), F.when(F.col("type").endswith("s"), "").otherwise("s"))
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("date"), F.desc("slug"), F.desc("title")))
    return rows.select("type", heading.alias("heading"), F.when(place == 0, 5).otherwise(place).cast("int").alias("group"), rank.alias("rank"), "slug", "title", "date")


def index_text(pages: DataFrame, n_edges: int) -> DataFrame:
    """One row with the text of the index."""
    lines = index_listing(pages).groupBy("group", "type", "heading").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- [["), "slug", F.lit("|"), "title", F.lit("]]")).alias("line")))).alias("lines"))
    part = F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    whole = lines.agg(F.array_sort(F.collect_list(F.struct("group", "type", part.alias("part"), F.size("lines").alias("n")))).alias("parts"))
    total = F.aggregate("parts", F.lit(0), lambda a, x: a + x["n"])
    return whole.select(F.concat(F.lit("# Wiki\n\n_"), total, F.lit(f" pages, {n_edges} edges._\n\n"), F.array_join(F.transform("parts", lambda x: x["part"]), "\n")).alias("text"))


def index_totals(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with pages and edges, the totals that the index names."""
    counts = pages.select(F.lit(1).alias("p"), F.lit(0).alias("e")).unionByName(edges.select(F.lit(0).alias("p"), F.lit(1).alias("e")))
    return counts.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pages"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))

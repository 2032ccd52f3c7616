"""A knowledge graph, a vault and books derived from the star-schema tables, for the queries over them.

Each rule is deterministic in the keys, and faults for the validator are put in by key. seq gives the order that files
would have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators.predicates import default_predicates

BASE = 10**12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, title, type, seq: a concept for each part, a source for each supplier."""
    concept = table(spark, sf_dir, "part").select(F.concat(F.lit("concept-"), "p_partkey").alias("slug"), F.col("p_name").alias("title"), F.lit("concept").alias("type"), F.col("p_partkey").alias("seq"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "paper").when(F.col("s_suppkey") % 3 == 1, "video").otherwise("pdf")
    source = table(spark, sf_dir, "supplier").select(F.concat(F.lit("source-"), "s_suppkey").alias("slug"), F.col("s_name").alias("title"), kind.alias("type"), (F.lit(BASE) + F.col("s_suppkey")).alias("seq"))
    return concept.unionByName(source)


def _target(part: str) -> Column:
    """Every fifth concept is never reached."""
    return F.col(part) - F.when(F.col(part) % 5 == 0, 1).otherwise(0)


def source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each line item, from its supplier (for some parts the first one) to its part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", _target("l_partkey").alias("t"))
    kind = F.when(F.col("l_quantity") <= 2, "defines").when(F.col("l_quantity") <= 3, "introduces").otherwise("discusses")
    source = F.when(F.col("t") % 7 == 3, 1).otherwise(F.col("l_suppkey"))
    return lines.select(F.concat(F.lit("source-"), source).alias("from"), F.concat(F.lit("concept-"), "t").alias("to"), kind.alias("predicate"), F.col("l_orderkey").cast("string").alias("context"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from the part of each line item to that of the order's next one."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", _target("l_partkey").alias("t"))
    nxt = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("t").alias("b"), F.col("l_returnflag").alias("r"), F.col("l_quantity").alias("q"))
    kind = F.when((F.col("r") == "A") & (F.col("q") <= 2), "is-a").when((F.col("r") == "R") & (F.col("q") <= 2), "part-of").otherwise("related-to")
    return lines.select("l_orderkey", "l_linenumber", F.col("t").alias("a")).join(nxt, ["l_orderkey", "l_linenumber"]).select(
        F.concat(F.lit("concept-"), "a").alias("from"), F.concat(F.lit("concept-"), "b").alias("to"), kind.alias("predicate"), F.col("l_orderkey").cast("string").alias("context"), (F.lit(BASE) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from, to, predicate, context, seq."""
    return source_edges(spark, sf_dir).unionByName(concept_edges(spark, sf_dir))


def faulty_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("not (type = 'concept' and seq % 50 = 17)")


def faulty_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("context").cast("long") % 97
    first = F.col("from").startswith("source-")
    kind = F.when(k == 3, "").when(k == 4, "mentions").when((k == 5) & first, "cites").when((k == 6) & ~first, "defines").otherwise(F.col("predicate"))
    return edges(spark, sf_dir).withColumns({"to": F.when(k == 1, "").when(k == 2, "nowhere").otherwise(F.col("to")), "predicate": kind})


def vault_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: a Markdown file for each page of the vault."""
    k = F.col("p_partkey") % 50
    slug = F.concat(F.lit("concept-"), "p_partkey")
    head = F.concat(
        F.lit("---\nslug: "), slug, F.when(k == 9, "-x").otherwise(""), F.lit('\ntitle: "'), F.col("p_name"), F.lit('"\ntype: '), F.when(k == 5, "note").otherwise("concept"),
        F.lit('\naliases: ["'), F.col("p_brand"), F.lit('", '), F.col("p_type"), F.lit("]"), F.when(k == 7, "").otherwise(F.concat(F.lit("\ningested: 2024-01-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"))), F.lit("\n---\n"),
    )
    link = F.when(k == 13, F.concat(F.lit("See [[missing-"), "p_partkey", F.lit("]].\n"))).otherwise(F.concat(F.lit("See [["), slug, F.lit("#top|itself]].\n")))
    concept = table(spark, sf_dir, "part").where("p_partkey % 50 != 15").select(F.concat(F.lit("pages/"), F.when(k == 11, "papers").otherwise("concepts"), F.lit("/"), slug, F.lit(".md")).alias("path"), F.concat(F.when(k == 3, "").otherwise(head), link).alias("text"))
    s = F.col("s_suppkey") % 10
    name = F.concat(F.lit("source-"), "s_suppkey")
    doc = F.when(s == 1, F.concat(F.lit("\nsource_doc: nowhere-"), "s_suppkey")).when(s == 2, "").otherwise(F.concat(F.lit("\nsource_doc: "), name, F.lit("-source")))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "paper").when(F.col("s_suppkey") % 3 == 1, "video").otherwise("pdf")
    source = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("pages/papers/"), name, F.lit(".md")).alias("path"),
        F.concat(F.lit("---\nslug: "), name, F.lit("\ntitle: "), F.col("s_name"), F.lit("\nsource: http://example.org/"), F.col("s_suppkey"), F.lit("\ntype: "), kind, doc, F.lit("\ndate: 2023-"), F.lpad((F.col("s_suppkey") % 12 + 1).cast("string"), 2, "0"), F.lit("\ningested: 2024-02-01\n---\nText.\n"), F.when(s == 3, "![plot](plot.png)\n").otherwise("")).alias("text"),
    )
    return concept.unionByName(source)


def source_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem: the staged source of each supplier, and some that take the name of a page."""
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("source-"), "s_suppkey", F.lit("-source")).alias("stem"))
    clash = table(spark, sf_dir, "part").where("p_partkey % 50 = 19").select(F.concat(F.lit("concept-"), "p_partkey").alias("stem"))
    return own.unionByName(clash)


def predicates(spark: SparkSession) -> DataFrame:
    return default_predicates(spark)


def corpus_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, corpus: a source belongs to the region of its supplier."""
    return table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("source-"), "s_suppkey").alias("slug"), F.col("r_name").alias("corpus"))


def corpus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus, from, to, predicate, context, seq: source edges in the source's corpus."""
    return source_edges(spark, sf_dir).join(corpus_of_sources(spark, sf_dir), F.col("from") == F.col("slug")).select("corpus", "from", "to", "predicate", "context", "seq")


def corpus_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus, slug, title, type, seq: the sources of each corpus and the concepts that they reach."""
    every = nodes(spark, sf_dir)
    source = every.join(corpus_of_sources(spark, sf_dir), "slug").select("corpus", "slug", "title", "type", "seq")
    reached = corpus_edges(spark, sf_dir).select("corpus", F.col("to").alias("slug")).distinct().join(every, "slug").select("corpus", "slug", "title", "type", "seq")
    return source.unionByName(reached)


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, idx, level, title, page: one book, a chapter for each region and a section for each nation."""
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 1000).alias("idx"), F.lit(1).alias("level"), F.col("r_name").alias("title"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("idx"), F.lit(2).alias("level"), F.col("n_name").alias("title"))
    return region.unionByName(nation).select(F.lit("world").alias("book"), F.col("idx").cast("long").alias("idx"), "level", "title", (1 + F.floor(F.col("idx") / 40)).cast("long").alias("page"))


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_group, page_num, text, images: each document is a page of its source's book."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_group"), F.col("doc_id").alias("page_num"), "text", (F.col("doc_id") % 3).cast("int").alias("images"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, ord, start, end, text: each conversation is a video, each turn a segment of 30 seconds."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("ord"), (F.col("turn") * 30.0).alias("start"), (F.col("turn") * 30.0 + 30).alias("end"), "text")

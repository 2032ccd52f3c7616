from __future__ import annotations

import pytest

from loomery.operators import audit, merge, reconcile, validate
from loomery.operators.predicates import default_predicates

NODE = "slug string, title string, type string, seq long"
EDGE = "`from` string, `to` string, predicate string, context string, seq long"


def nodes(spark, *rows):
    return spark.createDataFrame([(s, s.upper(), k, i) for i, (s, k) in enumerate(rows)], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(*r, f"c{i}", i) for i, r in enumerate(rows)], EDGE)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_audit_counts_duplicates_and_unknown_sources(spark):
    n = nodes(spark, ("c", "concept"), ("d", "concept"), ("p", "paper"))
    e = edges(spark, ("p", "c", "defines"), ("p", "c", "introduces"), ("ghost", "c", "related-to"), ("p", "ghost", "defines"))
    row = audit.audit_concepts(n, e).where("slug = 'c'").first()
    assert (row.papers_count, row.defined_by, row.related_only_count, row.total_in) == (1, ["p", "p"], 1, 3)
    buckets = {b: [r.slug for r in audit.audit_bucket(audit.audit_concepts(n, e), b).collect()] for b in "ABCD"}
    assert buckets == {"A": [], "B": ["d"], "C": ["c"], "D": ["c"]}


def test_validate_clean_graph(spark):
    page = lambda slug, kind, more="": f"---\nslug: {slug}\ntitle: T\ntype: {kind}\ningested: x\n{more}---\n[[c]]\n"
    files = spark.createDataFrame([("pages/concepts/c.md", page("c", "concept")), ("pages/papers/p.md", page("p", "paper", "source: u\nsource_doc: p-source\n"))], "path string, text string")
    docs = spark.createDataFrame([("p-source",)], "stem string")
    n, e = nodes(spark, ("c", "concept"), ("p", "paper")), edges(spark, ("p", "c", "defines"))
    found = validate.validate(validate.read_pages(files), docs, n, e, default_predicates(spark))
    assert got(found, "severity", "rule", "slug") == [("warn", "V22", "p")]
    assert validate.summary(found).where("failed").count() == 0


def test_validate_quirks(spark):
    files = spark.createDataFrame([("pages/concepts/a.md", "no block"), ("pages/papers/a.md", "---\nslug: a\ntype: concept\ntitle: T\ningested: \n---\n![[gone]]\n")], "path string, text string")
    pages = validate.read_pages(files)
    assert pages.count() == 1  # stems are keys: the last path holds
    none = spark.createDataFrame([], "stem string")
    n = spark.createDataFrame([("", "x", "concept", 0)], NODE)
    e = edges(spark, ("a", "a", None), (None, "a", "cites"))
    found = got(validate.validate(pages, none, n, e, default_predicates(spark)), "rule", "slug", "edge_seq")
    assert ("V06", "a", None) in found and ("V08", "a", None) in found and ("V09", "a", None) in found and ("V13", "", None) in found
    assert [x for x in found if x[2] == 0] == [("V18", None, 0)]
    assert sorted(x[0] for x in found if x[2] == 1) == ["V16", "V21"]
    empty = validate.validate(pages.limit(0), none, n.limit(0), e.limit(0), default_predicates(spark))
    assert empty.count() == 0


def test_index(spark):
    rows = [("b", "concept", "2024-02"), ("a", "concept", "2024-02"), ("p", "paper", "2020")]
    files = spark.createDataFrame([(f"pages/x/{s}.md", f"---\ntype: {k}\ntitle: {s.upper()}\ndate: {d}\n---\n") for s, k, d in rows], "path string, text string")
    text = validate.index_text(validate.read_pages(files), 4).first().text
    assert text == "# Wiki\n\n_3 pages, 4 edges._\n\n## Papers\n\n- [[p|P]]\n\n## Concepts\n\n- [[b|B]]\n- [[a|A]]\n"


def test_merge_with_itself_changes_nothing(spark):
    n = nodes(spark, ("c", "concept"), ("p", "paper"))
    e = edges(spark, ("p", "c", "defines"), ("p", "c", "defines"))
    for policy in ("skip", "replace"):
        actions = merge.page_actions(n, n, policy)
        assert got(merge.merge_nodes(n, n, actions), "slug") == [("c",), ("p",)]
        assert got(merge.merge_edges(e, e, actions), "from", "to", "predicate", "context") == [("p", "c", "defines", "c0")]


def test_rename_takes_the_first_free_number(spark):
    source, target = nodes(spark, ("a", "concept"), ("b", "concept"), ("a-4", "concept")), nodes(spark, ("a", "concept"), ("a-2", "concept"), ("a-3", "concept"), ("a-07", "concept"))
    actions = merge.page_actions(source, target, "rename")
    assert got(actions, "slug", "action", "dest_slug") == [("a", "rename", "a-5"), ("a-4", "copy", "a-4"), ("b", "copy", "b")]
    moved = merge.merge_edges(edges(spark, ("b", "a", "is-a")), edges(spark, ("a", "a-2", "is-a")), actions)
    assert got(moved, "from", "to") == [("a", "a-2"), ("b", "a-5")]
    pages = spark.createDataFrame([("a", "slug: a\n[[a]]")], "slug string, text string")
    assert merge.renamed_pages(pages, actions).first().text == "slug: a-5\n[[a]]"
    with pytest.raises(ValueError):
        merge.page_actions(source, target, "other")


def test_skip_drops_edges_and_pageless_nodes_overwrite(spark):
    pages, have = nodes(spark, ("c", "concept")), nodes(spark, ("c", "concept"))
    actions = merge.page_actions(pages, have, "skip")
    assert merge.merge_edges(edges(spark, ("x", "c", "is-a"), ("x", "y", "is-a")), edges(spark), actions).count() == 1
    graph = nodes(spark, ("z", "paper"))  # no page in the source
    assert got(merge.merge_nodes(graph, nodes(spark, ("z", "concept")), actions), "slug", "type") == [("z", "paper")]


def test_schema_conflict(spark):
    own = default_predicates(spark)
    other = own.limit(1).selectExpr("name", "is_typed", "from_type", "to_type", "'{}' as raw_json")
    with pytest.raises(merge.SchemaConflict):
        merge.merge_predicates(other, own)


def test_promote_and_sync(spark):
    n = nodes(spark, ("a", "concept"), ("b", "concept"), ("p", "paper"))
    e = edges(spark, ("p", "b", "defines"), ("p", "a", "defines"), ("a", "b", "is-a"), ("p", "b", "discusses"))
    kept, moved = merge.promote(n, e, spark.createDataFrame([("a", "b")], "a string, b string"))
    assert got(kept, "slug") == [("b",), ("p",)] and got(moved, "from", "to", "predicate") == [("p", "b", "defines"), ("p", "b", "discusses")]
    pages = validate.read_pages(spark.createDataFrame([("pages/concepts/a.md", "---\ntype: concept\npapers: [q]\n---\n")], "path string, text string"))
    assert got(merge.papers_out_of_sync(pages, e, n), "slug", "missing", "extra") == [("a", ["p"], ["q"])]
    assert got(merge.known_sources(spark.createDataFrame([("u",), ("v",)], "source string"), validate.read_pages(spark.createDataFrame([("a.md", "---\nsource: u\n---\n")], "path string, text string"))), "source") == [("u",)]


def test_reconcile(spark):
    n = spark.createDataFrame([("x", "c", "C1", "concept", 0), ("x", "c", "C2", "concept", 1), ("y", "c", "Cy", "concept", 0), ("y", "only", "O", "concept", 1)], "corpus string, slug string, title string, type string, seq long")
    latest = reconcile.latest_nodes(n)
    assert got(latest.where("corpus = 'x'"), "title", "seq") == [("C2", 0)]  # the last fields at the first place
    bridges = reconcile.confirmed_bridges(latest)
    assert got(bridges, "slug", "corpora") == [("c", ["x", "y"])]
    same = reconcile.same_as_edges(bridges)
    root = reconcile.root_nodes(latest, bridges)
    theme = spark.createDataFrame([("theme/t", None, None, "T", "theme")], root.schema)
    old_edges = spark.createDataFrame([("theme/t", "x/c", "covers"), ("x/c", "y/c", "same-as")], "`from` string, `to` string, predicate string")
    nodes_, edges_ = reconcile.carry_over(root, same, theme, old_edges)
    assert edges_.count() == 2
    from pyspark.sql import functions as F

    edges_ = edges_.withColumn("seq", F.monotonically_increasing_id()).withColumn("context", F.lit(None).cast("string"))
    out = spark.createDataFrame([("x", "c", "d", "is-a", "why", 0)], "corpus string, `from` string, `to` string, predicate string, context string, seq long")
    report = reconcile.connections_report(latest, out, (nodes_, edges_), ["x", "y"], "old\n## Cross-Corpus Reading Paths\nkeep", "today")
    assert "**[x](x/README.md)** — Connects to: d." in report and "| T | ● | ○ |" in report and report.endswith("## Cross-Corpus Reading Paths\nkeep")
    assert "### C2" in report


def test_synonyms_broadcast_nothing_that_grows(spark, tmp_path):
    made = spark.createDataFrame([(c, f"{c}{i}", t, "concept") for c in "xy" for i, t in enumerate(["", "a", "abc", "abcd", "acbd", "bacde", "abcd"])], "corpus string, slug string, title string, type string")
    made.write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    edges = nodes.selectExpr("corpus", "slug as `from`", "slug as `to`")
    found = reconcile.synonym_candidates(nodes, edges)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [(r.corpus, r.slug, r.title) for r in nodes.collect()]

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    assert sorted((r.a, r.b) for r in found.collect()) == sorted((f"{c}/{s}", f"{d}/{u}") for c, s, t in rows for d, u, v in rows if c < d and distance(t, v) <= 2)

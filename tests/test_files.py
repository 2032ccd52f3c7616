from __future__ import annotations

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from loomery.operators import validate
from loomery.operators.predicates import default_predicates
from loomery.sinks import vaults as sink
from loomery.sources import vaults as source
from loomery.streaming import ingest


def test_vault_round_trip(spark, tmp_path):
    root = str(tmp_path / "v")
    assert sink.init_vault(spark, root) and not sink.init_vault(spark, root)  # a second run does nothing
    assert len(json.loads((tmp_path / "v/_schema.json").read_text())["predicates"]) == 16
    sink.write_files(spark.createDataFrame([("pages/concepts/c.md", "---\nslug: c\n---\n"), ("sources/s.md", "x")], "path string, text string"), root)
    nodes = spark.createDataFrame([("c", "C", "concept", 1), ("b", None, "concept", 0)], "slug string, title string, type string, seq long")
    edges = spark.createDataFrame([("c", "b", "is-a", "why", 0)], "`from` string, `to` string, predicate string, context string, seq long")
    sink.write_text(sink.graph_json(nodes, edges), f"{root}/graph.json")
    vault = source.read_vault(spark, root)
    assert [r.slug for r in vault["nodes"].orderBy("seq").collect()] == ["b", "c"] and vault["edges"].first().context == "why"
    assert vault["predicates"].where("is_typed").count() == 16 and vault["source_docs"].first().stem == "s"
    assert validate.read_pages(vault["files"]).first().fm == {"slug": "c"}
    found_nodes, found_edges = source.read_graphs(spark, str(tmp_path))
    assert {r.corpus for r in found_nodes.collect()} == {"v"} and found_edges.count() == 1
    with pytest.raises(source.MissingInput):
        source.read_vault(spark, str(tmp_path / "none"))


def test_bare_predicates(spark):
    text = json.dumps({"predicates": {"cites": {"from_type": "paper", "to_type": "*"}, "old": "a description"}})
    from loomery.operators.predicates import parse_predicates

    rows = {r.name: (r.is_typed, r.from_type, r.to_type) for r in parse_predicates(spark.createDataFrame([(text,)], "text string")).collect()}
    assert rows == {"cites": (True, "paper", "*"), "old": (False, None, None)}


def test_archives(spark):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w") as archive:
        for name in ("a.tex", "s/b.tex", "../evil.tex"):
            info = tarfile.TarInfo(name)
            info.size = 1
            archive.addfile(info, io.BytesIO(b"x"))
    blobs = spark.createDataFrame([("t", gzip.compress(held.getvalue())), ("g", gzip.compress(b"one")), ("p", b"two"), ("n", None)], "bundle_id string, content binary")
    assert sorted((r.bundle_id, r.file, r.text) for r in source.unpack_sources(blobs).collect()) == [("g", "main.tex", "one"), ("p", "main.tex", "two"), ("t", "a.tex", "x"), ("t", "s/b.tex", "x")]


def test_atom(spark):
    xml = "<feed><entry><id>http://arxiv.org/abs/1234.5678v2</id><title>A\n  b</title><summary> S </summary><author><name>X</name></author><author><name>Y</name></author><category term='c1'/></entry></feed>"
    row = source.atom_metadata(spark.createDataFrame([("1234.5678", xml)], "arxiv_id string, xml string")).first()
    assert (row.title, row.authors, row.abstract, row.categories, row.version) == ("A b", ["X", "Y"], "S", ["c1"], "2")


def test_idempotent(spark):
    one = spark.createDataFrame([(1,), (2,)], "bundle_id long")
    assert source.not_ingested(one, one.where("bundle_id = 1")).count() == 1
    with pytest.raises(NotImplementedError):
        source.unavailable("run a page's scripts")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 5:02d}:{i % 60:02d}:00", i % 3, "ab"[i % 2], float(i)) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id int, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed_counts(ingest.read_events(spark, str(tmp_path / "in"), events), late="0 seconds")
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in ingest.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    got = {tuple(r) for r in spark.table("closed").collect()}
    assert got and got <= batch  # windows that the watermark has closed
    assert ingest.sessions(events.withColumn("ts", F.col("ts").cast("timestamp"))).count() > 0


def test_upsert_batches(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    edges = spark.createDataFrame([("p", "x"), ("q", "y")], "`from` string, `to` string")
    edges.write.parquet(b)
    run = ingest.upsert_edges(a, b)
    for _ in range(2):  # again, as after a failure
        run(spark.createDataFrame([("p", "z")], edges.schema), 0)
    assert {tuple(r) for r in spark.read.parquet(a).collect()} == {("p", "z"), ("q", "y")}
    assert default_predicates(spark).count() == 16


def test_archives_of_a_small_table_are_many_tasks(spark, tmp_path):
    import loomery.bundle_queries  # noqa: F401
    from loomery.queries import QUERIES

    spark.sql("select id as p_partkey, concat('n', id) as p_name, 'b' as p_brand, 1 as p_size from range(30)").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = QUERIES["source_archives"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.bundle_id, r.file, r.text) for r in made.collect()) == sorted([(k, "main.tex", f"text of n{k}") for k in range(30)] + [(k, "img/a.txt", "a") for k in range(2, 30, 3)])

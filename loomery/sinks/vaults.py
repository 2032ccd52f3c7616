"""Writers of vaults and graphs: a file tree for people, from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.predicates import default_predicates


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the text of graph.json, in the order of seq. A vault is a person's size: its graph is one file by format."""
    n = nodes.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct("slug", "title", "type").alias("x")))), lambda x: x["x"]).alias("nodes"))
    e = edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct("from", "to", "predicate", "context").alias("x")))), lambda x: x["x"]).alias("edges"))
    return n.join(e, F.lit(True)).select(F.to_json(F.struct("nodes", "edges")).alias("text"))


def schema_json(predicates: DataFrame) -> DataFrame:
    """One row with the text of _schema.json."""
    entry = F.concat(F.to_json(F.struct(F.col("name").alias("n"))), F.lit("\u0000"), F.coalesce("raw_json", F.lit('""')))
    key = F.regexp_extract(entry, r'^\{"n":(.*)\}\x00', 1)
    body = F.array_join(F.array_sort(F.collect_list(F.concat(key, F.lit(": "), F.when(F.col("is_typed"), F.col("raw_json")).otherwise(F.regexp_extract(F.to_json(F.struct(F.col("raw_json").alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))))), ",\n  ")
    return predicates.agg(F.concat(F.lit('{"predicates": {\n  '), body, F.lit("\n}}\n")).alias("text"))


def write_text(one: DataFrame, path: str) -> None:
    """The single row's text as the file of that name, through the Hadoop file system of the path."""
    text = one.first()[0]
    spark = one.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_files(files: DataFrame, root: str) -> None:
    """Each row's text (or content, where it is binary) at root/path, in the file system that root names (file, hdfs, s3, gs).

    Of rows of equal paths the greatest text is written. A null text is an empty file.
    """
    base = root.rstrip("/")
    body = "content" if "content" in files.columns else "text"

    def run(rows):
        from pyarrow.fs import FileSystem

        store, top = FileSystem.from_uri(base)
        for r in rows:
            full = f"{top}/{r.path}"
            store.create_dir(full.rpartition("/")[0], recursive=True)
            with store.open_output_stream(full) as out:
                out.write(r.body.encode() if isinstance(r.body, str) else bytes(r.body or b""))

    files.groupBy("path").agg(F.max(body).alias("body")).foreachPartition(run)


def init_vault(spark, root: str) -> bool:
    """Makes an empty vault where there is none; False, and nothing done, where there is one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = root.rstrip("/")
    path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{base}/{p}")
    fs = path("").getFileSystem(conf)
    made = False
    for folder in ("pages/papers", "pages/concepts", "sources", "assets"):
        made |= not fs.exists(path(folder)) and fs.mkdirs(path(folder))
    for name, one in (("graph.json", lambda: spark.createDataFrame([('{"nodes": [], "edges": []}\n',)], "text string")), ("_schema.json", lambda: schema_json(default_predicates(spark))), ("index.md", lambda: spark.createDataFrame([("# Wiki\n",)], "text string"))):
        if not fs.exists(path(name)):
            write_text(one(), f"{base}/{name}")
            made = True
    return made


def overwrite(df: DataFrame, path: str) -> None:
    """A table replaced as a whole."""
    df.write.mode("overwrite").parquet(path)


def create_if_missing(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").parquet(path)


def write_vault(files: DataFrame, nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """The pages (path, text) and the graph of a merged vault; other files stay."""
    write_files(files, root)
    write_text(graph_json(nodes, edges), f"{root.rstrip('/')}/graph.json")


def write_root(nodes: DataFrame, edges: DataFrame, report: DataFrame | None, root: str) -> None:
    """The root graph of several vaults and, as one row's text, the report on it."""
    write_text(graph_json(nodes, edges), f"{root.rstrip('/')}/graph.json")
    if report is not None:
        write_text(report, f"{root.rstrip('/')}/CONNECTIONS.md")


def copy_once(spark, source: str, folder: str) -> str:
    """The path of the file's copy in the folder, which is made if it isn't there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    origin = jvm.org.apache.hadoop.fs.Path(source)
    target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{origin.getName()}")
    store = target.getFileSystem(conf)
    if not store.exists(target):
        store.mkdirs(target.getParent())
        jvm.org.apache.hadoop.fs.FileUtil.copy(origin.getFileSystem(conf), origin, store, target, False, conf)
    return target.toString()


def ingest(df: DataFrame, path: str, ingest_id: str) -> bool:
    """One ingest is one partition of the table at path, written as a whole or not at all. False, and nothing done, where it is there or has no rows."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = f"{path.rstrip('/')}/ingest={ingest_id}"
    done = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if done.getFileSystem(conf).exists(done) or df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(target)
    return True

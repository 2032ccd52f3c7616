"""Readers of vaults, bundles and archives from files, and of what only a network could give."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions import text as t
from loomery.operators.predicates import parse_predicates

GRAPH = "nodes array<struct<slug:string,title:string,type:string>>, edges array<struct<`from`:string,`to`:string,predicate:string,context:string>>"
ATOM = "entry struct<title:string,summary:string,id:string,author:array<struct<name:string>>,category:array<struct<_term:string>>,primary_category:struct<_term:string>>"


#: Bytes of unpacked files after which a batch of rows goes out.
BATCH = 1 << 24


class MissingInput(FileNotFoundError):
    """A vault lacks its pages, graph or schema."""


def _texts(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """path, text of whole files, through Spark's reader only."""
    reader = spark.read.format("text").option("wholetext", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # the metadata has the URI
    return reader.load(path).select(plain.alias("path"), F.col("value").alias("text"))


def _hidden(spark: SparkSession, path: str) -> str:
    """The text of one small file whose name Spark's readers pass over, by the Hadoop file system of its path."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_graphs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all corpora under root, a corpus for each folder with a graph.json whose name doesn't begin with a dot; seq is the place in the file."""
    files = _texts(spark, f"{root.rstrip('/')}/*/graph.json").select(F.regexp_extract("path", r"([^/]+)/graph\.json$", 1).alias("corpus"), F.from_json("text", GRAPH).alias("g")).where(~F.col("corpus").startswith("."))
    nodes = files.select("corpus", F.posexplode("g.nodes").alias("seq", "n")).select("corpus", F.col("seq").cast("long").alias("seq"), "n.*")
    edges = files.select("corpus", F.posexplode("g.edges").alias("seq", "e")).select("corpus", F.col("seq").cast("long").alias("seq"), "e.*")
    return nodes, edges


def read_vault(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """files, source_docs, nodes, edges and predicates of one vault; MissingInput where pages, graph or schema are missing."""
    base = path.rstrip("/")
    try:
        files = _texts(spark, f"{base}/pages", recursiveFileLookup="true", pathGlobFilter="*.md")
        graph = _texts(spark, f"{base}/graph.json").select(F.from_json("text", GRAPH).alias("g"))
        schema = spark.createDataFrame([(_hidden(spark, f"{base}/_schema.json"),)], "text string")
    except Exception as e:
        raise MissingInput(f"{base} has no pages, graph.json or _schema.json") from e
    try:
        docs = _texts(spark, f"{base}/sources", pathGlobFilter="*.md").select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"))
    except Exception:
        docs = spark.createDataFrame([], "stem string")
    nodes = graph.select(F.posexplode("g.nodes").alias("seq", "n")).select(F.col("seq").cast("long").alias("seq"), "n.*")
    edges = graph.select(F.posexplode("g.edges").alias("seq", "e")).select(F.col("seq").cast("long").alias("seq"), "e.*")
    return {"files": files, "source_docs": docs, "nodes": nodes, "edges": edges, "predicates": parse_predicates(schema)}


def atom_metadata(feeds: DataFrame) -> DataFrame:
    """arxiv_id, title, authors, abstract, primary_class, categories, version, abs_url of stored Atom answers (arxiv_id, xml)."""
    e = feeds.select("arxiv_id", F.from_xml("xml", ATOM).alias("x")).select("arxiv_id", "x.entry.*")
    line = lambda c: F.regexp_replace(t.strip(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")
    url = t.strip(F.coalesce("id", F.lit("")))
    return e.select("arxiv_id", line("title").alias("title"), F.transform("author", lambda a: t.strip(a["name"])).alias("authors"), line("summary").alias("abstract"), F.col("primary_category._term").alias("primary_class"), F.transform("category", lambda c: c["_term"]).alias("categories"), F.nullif(F.regexp_extract(url, r"v([^v/]*)$", 1), F.lit("")).alias("version"), url.alias("abs_url"))


def read_outlines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, entries) of the JSON that a PDF reader leaves for each book (book, text): title, author, page_count, outline [[level, title, page], ...]."""
    parsed = files.select("book", F.from_json("text", "metadata struct<title:string,author:string,subject:string>, page_count int, outline array<array<string>>").alias("j"))
    books = parsed.select("book", *[F.nullif(F.col(f"j.metadata.{c}"), F.lit("")).alias(c) for c in ("title", "author", "subject")], F.col("j.page_count").alias("page_count"))
    entries = parsed.select("book", F.posexplode("j.outline").alias("idx", "e"))
    return books, entries.select("book", F.col("idx").cast("long").alias("idx"), F.get("e", F.lit(0)).cast("int").alias("level"), F.get("e", F.lit(1)).alias("title"), F.get("e", F.lit(2)).cast("long").alias("page"))


def unpack_sources(blobs: DataFrame) -> DataFrame:
    """bundle_id, file, text, content of source archives (bundle_id, content): tar.gz, one gzipped file, or one bare file."""

    def files(blob: bytes) -> Iterator[tuple[str, bytes]]:
        if blob[:2] != b"\x1f\x8b":
            yield "main.tex", blob
            return
        raw = gzip.decompress(blob)
        try:
            with tarfile.open(fileobj=io.BytesIO(raw)) as archive:
                for member in archive:
                    if member.isfile() and not member.name.startswith("/") and ".." not in member.name.split("/"):
                        yield member.name.removeprefix("./"), archive.extractfile(member).read()
        except tarfile.TarError:
            yield "main.tex", raw

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("bundle_id", blobs.schema["bundle_id"].dataType), *T._parse_datatype_string("file string, text string, content binary").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        rows, size = [], 0
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, data in files(blob.as_py()):
                    rows.append((key, name, data.decode("utf-8", "replace"), data))
                    size += len(data) + 100
                    if size > BATCH:
                        yield out(rows)
                        rows, size = [], 0
        if rows:
            yield out(rows)

    return blobs.select("bundle_id", "content").where("content is not null").mapInArrow(run, schema)


def not_ingested(bundles: DataFrame, done: DataFrame, key: str = "bundle_id") -> DataFrame:
    """The bundles that aren't there yet: an idempotent run skips the others."""
    return bundles.join(done.select(key), key, "left_anti")


#: What needs a network, a renderer or a model: callers put its results in a table of the named columns.
CAPABILITIES = {
    "run a page's scripts": "pages(page_id, url, html)",
    "extract PDF text": "candidates(doc_group, strategy, text)", "render TeX or PDF": "pictures(bundle_id, seq, text)", "captions and speech": "segments(video_id, source, ord, start, end, text)",
    "write synthesis pages": "files(path, text)", "commit to version control": "none: writes replace whole tables",
}


def unavailable(name: str):
    raise NotImplementedError(f"{name} is outside this engine; its results come as {CAPABILITIES[name]}")

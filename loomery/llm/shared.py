"""Tables, shared storage and batch helpers that the operators of this subpackage use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    made = tempfile.mkdtemp(prefix="loomery-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_tables: dict[int, tuple[DataFrame, str]] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: its rows stay the same when executors are lost. forget() deletes it, the end of the process at the latest."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[id(out)] = out, path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what written() made, once nothing that is still to be computed reads it. Other tables stay."""
    for df in tables:
        found = _tables.pop(id(df), None)
        if found:
            _delete(found[0].sparkSession._jvm, found[1])


def _delete(jvm, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


@atexit.register
def _forget_all() -> None:
    """Tables that results were read from until the end. A session that is gone, or a store that needs its settings, leaves them to the deployment."""
    try:
        forget(*[df for df, _ in _tables.values()])
    except Exception:  # the process ends; the folder is the deployment's
        return


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def map_text(df: DataFrame, added: list[tuple[str, T.DataType]], make: Callable[[], Callable[[list], list[list]]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of df in keep (all) and the added ones, which make()(texts) gives, a list for each column.

    make runs once in each task; added columns replace columns of df with their names.
    """
    names = {n.lower() for n, _ in added}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    fields = [df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in added]
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(t) for _, t in added]
    names_out = [f.name for f in fields]
    at = kept.index(text) if text in kept else len(kept)
    sent = [df[c] for c in kept] + ([] if text in kept else [df[text].alias(free_name(df, "_text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(batch.column(at).to_pylist())
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(x, t) for x, t in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names_out)

    return df.select(*sent).mapInArrow(run, schema)

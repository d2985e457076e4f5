"""What the corpus operators share: shipping the package, scratch tables, seeds and safe names."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiremill.session import ensure_checkpoint_dir

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the Python workers once per application, so that executors need no shared source folder."""
    sc = spark.sparkContext
    if getattr(sc, "_hiremill_shipped", False):
        return
    if PACKAGE.startswith("/") and os.path.isdir(PACKAGE):
        base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "hiremill_package")
        archive = shutil.make_archive(base, "zip", os.path.dirname(PACKAGE), os.path.basename(PACKAGE))
        sc.addPyFile(archive)
    sc._hiremill_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder that the cluster shares."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table below the shared checkpoint folder and reads it back: lineage ends, columns can still be pruned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def dropped(df: DataFrame) -> None:
    """Removes the scratch table that `written` gave, once nothing reads it any more."""
    root = df.sparkSession.sparkContext.getCheckpointDir()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if root and root.rstrip("/").split(":")[-1] in folder:
            delete_path(df.sparkSession, folder)


def freed() -> None:
    """At the end of a task: gives memory that was let go back to the system, since workers are reused by the steps that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While steps run that read texts, a task and its worker hold at most that many of them at once; the session's setting comes back."""
    given = spark.conf.get(ARROW_ROWS, None)
    own = int(given) if given and int(given) > 0 else rows + 1
    spark.conf.set(ARROW_ROWS, str(min(rows, own)))
    try:
        yield
    finally:
        spark.conf.unset(ARROW_ROWS) if given is None else spark.conf.set(ARROW_ROWS, given)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def string_or_empty(column: str):
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with more columns at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def schema_with(df: DataFrame, **more: str) -> str:
    """DDL of the table's columns and more."""
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*own, *(f"`{k}` {v}" for k, v in more.items())])

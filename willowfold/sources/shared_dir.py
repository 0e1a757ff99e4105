"""New folders below the one that driver and executors share, and tables kept in them."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_dir(spark: SparkSession, label: str) -> str:
    """A path that does not exist yet, below spark.checkpoint.dir; a local session without it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-willowfold-")
        base = _own[context.applicationId]
    path = f"{base.rstrip('/')}/{label}-{uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def kept(df: DataFrame, label: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """df written to the shared folder and read back, so that later steps survive lost executors."""
    spark = df.sparkSession
    path = path or new_dir(spark, label)
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._kept_at = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more: all that is made of them is written."""
    for table in tables:
        _delete(table.sparkSession, table._kept_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was kept inside; the results must be written to a path from outside by then."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        for path in made:
            _delete(spark, path)

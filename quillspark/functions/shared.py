"""Tables in the folder that driver and executors share: lineage is cut there, not in executors."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process
    (tests, a laptop) a temporary folder is made and set. On a cluster an unset folder is an
    error, as every executor would write to its own disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(spark, "_quill_shared", None)
        if not where:
            where = "file://" + tempfile.mkdtemp(prefix="quill-")
            spark._quill_shared = where
            spark.sparkContext.setCheckpointDir(where)
    return where


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quill-{uuid.uuid4().hex}/{name}"
    fs, top = _file_system(spark, path.rsplit("/", 1)[0])
    fs.deleteOnExit(top)
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables made inside when the block ends; what is to stay gets its path before."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            remove(spark, path)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder (or to ``path`` there) and read it back."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

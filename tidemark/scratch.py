"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder of this session.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset on one machine, as in tests, a temporary
    folder is made and removed when the interpreter ends; elsewhere executors wouldn't share it, and it is an error.
    """
    named = spark.conf.get(_DIR, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_DIR} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set(_DIR, named)
    return named.rstrip("/")


class Tables(list):
    """The tables stored within a scope, as functions that delete them."""

    def clear(self) -> None:
        while self:
            with contextlib.suppress(Exception):  # the session may be gone, or the table
                self.pop()[1]()


_OF_SESSION = Tables()
_HERE = threading.local()
atexit.register(_OF_SESSION.clear)


def _deletion(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def delete() -> None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)

    return delete


def place(spark: SparkSession, name: str = "") -> str:
    """A path of its own in the shared folder, deleted with the scope it was asked for in."""
    path = f"{folder(spark)}/tidemark/{name}{uuid.uuid4().hex}"
    getattr(_HERE, "tables", _OF_SESSION).append((path, _deletion(spark, path)))
    return path


@contextlib.contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Delete what is stored within when it ends, but for the stored tables put on the list it gives.

    Those belong to the scope around it; the outermost ends with the interpreter, or when ``clear`` is called.
    """
    around, mine, kept = getattr(_HERE, "tables", _OF_SESSION), Tables(), []
    _HERE.tables = mine
    try:
        yield kept
    finally:
        _HERE.tables = around
        paths = {df._stored_at for df in kept}
        around.extend(x for x in mine if x[0] in paths)
        mine[:] = [x for x in mine if x[0] not in paths]
        mine.clear()


def clear() -> None:
    """Delete all tables that this process has stored; results that read them must have been taken."""
    _OF_SESSION.clear()


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffles of each table written within as soon as it is written.

    Nothing reads them again; else they take disk until the driver happens to collect its garbage.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; losing an executor loses nothing."""
    spark = df.sparkSession
    path = place(spark)
    writer = df.write.option("compression", "zstd")
    with freed(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    schema = df.schema
    if partition_by:  # partition columns come last when read
        kept = [f for f in schema if f.name not in partition_by]
        schema = type(schema)(kept + [f for f in schema if f.name in partition_by])
    made = spark.read.schema(schema).parquet(path)
    made._stored_at = path
    return made

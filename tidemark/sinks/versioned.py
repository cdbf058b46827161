"""Tables that readers see whole: a new version is written beside the old one, then a pointer is moved."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.keyed import append_absent

_POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def pointed(spark: SparkSession, table: str) -> str | None:
    """What the pointer of ``table`` says; None before the first."""
    files, pointer = _fs(spark, f"{table}/{_POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current(spark: SparkSession, table: str) -> str | None:
    """The folder of the current version; None before the first."""
    name = pointed(spark, table)
    return f"{table}/{name}" if name else None


def point(spark: SparkSession, table: str, text: str) -> None:
    """Replace what the pointer of ``table`` says; readers see the old text or the new one, whole."""
    files, fresh = _fs(spark, f"{table}/{_POINTER}-{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{_POINTER}"), options)


def publish(df: DataFrame, table: str) -> str:
    """Write ``df`` as the new version of ``table``; readers see the old one until all of it is there.

    The frame may read the current version.  Old versions stay until ``tidy`` removes them.
    """
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{name}")
    point(spark, table, name)
    return f"{table}/{name}"


def read(spark: SparkSession, table: str) -> DataFrame | None:
    """The current version; None before the first."""
    where = current(spark, table)
    return spark.read.parquet(where) if where else None


def tidy(spark: SparkSession, table: str) -> int:
    """Remove all versions but the current one; the number removed."""
    kept, (files, root) = current(spark, table), _fs(spark, table)
    old = [s.getPath() for s in files.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("v-") and not (kept or "").endswith(s.getPath().getName())]
    for path in old:
        files.delete(path, True)
    return len(old)


def append_new(df: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Append the rows of ``df`` whose keys ``folder`` doesn't have yet, one per key; what was appended is returned."""
    spark = df.sparkSession
    files, target = _fs(spark, folder)
    fresh = append_absent(spark.read.parquet(folder), df, keys) if files.exists(target) else df.dropDuplicates(keys)
    from tidemark.scratch import stored

    fresh = stored(fresh)
    fresh.write.mode("append").parquet(folder)
    return fresh

"""Readers of feeds and stored documents."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

SOURCE = T.StructType([T.StructField("name", T.StringType()), T.StructField("url", T.StringType())])
ARTICLE = T.StructType([*(T.StructField(n, T.StringType()) for n in ("title", "url", "published", "description")), T.StructField("rss_source", SOURCE)])
_RSS = "title string, link string, pubDate string, description string, source struct<_url: string, _VALUE: string>"


@arrow_udf(T.StringType())
def unescaped(values: pa.Array) -> pa.Array:
    """Entities decoded; null stays null."""
    return pa.array([v if v is None or "&" not in v else html.unescape(v) for v in values.to_pylist()], pa.string())


def _articles(items: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    source = F.struct(unescaped(text("source._VALUE")).alias("name"), text("source._url").alias("url"))
    return items.select(unescaped(text("title")).alias("title"), text("link").alias("url"), text("pubDate").alias("published"), unescaped(text("description")).alias("description"), source.alias("rss_source"))


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """All items of one or many RSS files; missing fields are empty texts."""
    return _articles(spark.read.format("xml").schema(_RSS).option("rowTag", "item").load(path))


def stream_rss(spark: SparkSession, folder: str) -> DataFrame:
    """The items of RSS files as they arrive in a folder."""
    return _articles(spark.readStream.format("xml").schema(_RSS).option("rowTag", "item").load(folder))


def read_documents(spark: SparkSession, path: str, schema: T.StructType = ARTICLE, strict: bool = False) -> DataFrame:
    """A JSON document holding a list of records; an empty table where ``path`` doesn't exist.

    Malformed input gives nulls, or with ``strict`` an error, as ledgers need.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def inbox(previous: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Both feeds with one row per key: the latest values, in the place where the key came first (``pos``)."""
    from tidemark.operators.keyed import keep_last_at_first

    numbered = previous.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    ordered = numbered.withColumn("_at", F.struct(F.col("_turn"), F.monotonically_increasing_id().alias("n")))
    return keep_last_at_first(ordered, [key], ["_at"], "pos").drop("_turn", "_at")

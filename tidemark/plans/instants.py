"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.timestamps import with_instant


def published(spark: SparkSession, sf: str) -> DataFrame:
    """(origin, record_key, pos_no, published, feed) of both tables that hold articles."""
    articles = spark.read.parquet(f"{sf}/articles.parquet").select(
        F.lit("articles").alias("origin"), F.col("article_id").cast("string").alias("record_key"), F.lit(0).alias("pos_no"), "published", F.col("rss_source.name").alias("feed")
    )
    groups = spark.read.parquet(f"{sf}/news_groups.parquet").select("group_key", F.posexplode("articles").alias("pos_no", "a"))
    return articles.unionByName(groups.select(F.lit("news_groups").alias("origin"), F.col("group_key").alias("record_key"), "pos_no", "a.published", F.col("a.rss_source.name").alias("feed")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    named = with_instant(published(spark, sf), "published", F.col("feed"), spark.read.parquet(f"{sf}/feeds.parquet"))
    return named.where("utc_us is not null").select("origin", "record_key", "pos_no", "utc_us")

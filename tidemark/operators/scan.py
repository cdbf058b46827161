"""Running aggregates and time bands that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_max(df: DataFrame, keys: list[str], order: str, value: str, before: str, upto: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Add ``before`` and ``upto``: the greatest ``value`` of the same key in front of a row in ``order``, and that with the row.

    ``order`` is a whole number, unique within a key.  It is cut into buckets of about ``rows_per_bucket`` rows; the
    greatest values of the buckets are carried forward, and only within a bucket rows are walked in order.  Null
    keys are one key; null values count for nothing.
    """
    bounds = df.agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).first()
    n_buckets = max(1, -(-bounds["n"] // rows_per_bucket))
    width = max(1, -(-((bounds["high"] or 0) - (bounds["low"] or 0) + 1) // n_buckets))
    cut = df.withColumn("_bucket", F.floor((F.col(order) - (bounds["low"] or 0)) / width))
    tops = cut.groupBy(*keys, "_bucket").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*(F.col(k).alias("_k_" + k) for k in keys), F.col("_bucket").alias("_b"), F.max("_top").over(earlier).alias("_carried"))
    same = F.col("_bucket") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_k_" + k))
    within = Window.partitionBy(*keys, "_bucket").orderBy(order)
    local = F.max(value).over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = cut.withColumn("_local", local).join(carried, same)
    made = rows.withColumn(before, F.greatest("_local", "_carried"))
    return made.withColumn(upto, F.greatest(before, value)).select(*df.columns, before, upto)


def earlier_in_band(df: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Add ``n_earlier``: rows of the same key at most ``seconds`` before, or at the same time; the row itself not counted.

    Time is cut into stretches as long as the band; each is counted together with the one before it, so that a
    key is spread over its stretches, and no pair is ever made.  Rows without time have null.
    """
    band = seconds * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    timed = df.withColumn("_t", micros).withColumn("_own", F.floor(F.col("_t") / band))
    spread = timed.withColumn("_stretch", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    window = Window.partitionBy(*keys, "_stretch").orderBy("_t").rangeBetween(-band, 0)
    counted = spread.where("_t is not null").withColumn("n_earlier", F.count("*").over(window) - 1).where("_stretch = _own")
    rest = timed.where("_t is null").withColumn("n_earlier", F.lit(None).cast("long"))
    return counted.select(*df.columns, "n_earlier").unionByName(rest.select(*df.columns, "n_earlier"))

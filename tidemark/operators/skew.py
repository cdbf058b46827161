"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in HOT of the whole.  There can be at most HOT such keys.
HOT = 256


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``groups`` (one row per ``key``, ``size`` = rows of the key).

    The rows of hot keys are joined by broadcast, as at most ``HOT`` keys can be hot whatever the
    amount of data; only the rest is shuffled by key, where no key holds more than 1/HOT of the
    rows.  ``rows`` is read twice and should be a stored table.  Null keys match nothing; with
    ``how='left'`` they are kept.
    """
    limit = max(1, total // HOT)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    near = rows.join(hot, key)
    far = rows.join(F.broadcast(groups.where(F.col(size) > limit).select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far)


def lookup(rows: DataFrame, column: str, mapping: DataFrame, into: str, hot: dict) -> DataFrame:
    """Add ``into``, what ``mapping`` (key, value) has for ``column``; null where it has nothing.

    ``hot`` holds the values of hot keys (at most ``HOT``), which are written into the plan; their rows take part in the
    join under keys that match nothing and are spread evenly.
    """
    own = F.col(column).cast("string")
    if not hot:
        found = mapping.select(F.col("key").cast("string").alias("_k"), F.col("value").alias(into))
        return rows.withColumn("_c", own).join(found, F.col("_c") == F.col("_k"), "left").drop("_c", "_k")
    is_hot = F.col(column).isin(list(hot))
    spread = F.concat(F.lit("\0"), F.xxhash64(*rows.columns).cast("string"))
    known = F.create_map(*(F.lit(x) for pair in hot.items() for x in pair))
    found = mapping.select(F.col("key").cast("string").alias("_k"), F.col("value").alias("_v"))
    joined = rows.withColumn("_c", F.when(is_hot, spread).otherwise(own)).join(found, F.col("_c") == F.col("_k"), "left")
    return joined.withColumn(into, F.coalesce(F.try_element_at(known, F.col(column)), F.col("_v"))).drop("_c", "_k", "_v")

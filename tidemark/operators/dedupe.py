"""Greedy representatives of time bands, linked blocks, and clusters in which every pair is proved."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import stored


def representatives(df: DataFrame, keys: list[str], at: str, ident: str, seconds: int) -> DataFrame:
    """(<ident>, representative): greedily, in order of time, a row belongs to the latest representative of its key
    if that is at most ``seconds`` earlier, else it is one itself.

    Only the start of each band matters, so rows of a key are first cut where a gap of more than ``seconds`` starts
    anew anyway; the stretches between such gaps are spread over all tasks and walked as they stream by, sorted.  Null keys
    are one key; rows without time are left out.
    """
    order = Window.partitionBy(*keys).orderBy(at, ident)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    named = df.where(F.col(at).isNotNull()).select(*keys, at, ident, F.when(gap <= seconds * 1_000_000, 0).otherwise(1).alias("_new"))
    stretches = named.withColumn("_stretch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, head, since = None, None, None
        for rows in batches:
            out = []
            for *here, t, i in rows.itertuples(index=False):
                if here != place or (t - since).total_seconds() > seconds:
                    head, since = i, t
                place = here
                out.append(head)
            yield pd.DataFrame({ident: rows[ident], "representative": out})

    kind = df.schema[ident].dataType.simpleString()
    columns = [*keys, "_stretch", at, ident]
    sorted_rows = stretches.select(*columns).repartition(*keys, "_stretch").sortWithinPartitions(*columns)
    return sorted_rows.mapInPandas(walk, f"{ident} {kind}, representative {kind}")


def linked_blocks(edges: DataFrame) -> DataFrame:
    """(v, block): blocks of directly or indirectly linked vertices, named by their smallest.

    Alternating stars: each vertex's larger neighbours are linked to its smallest one, then its smaller ones, until
    nothing changes; the rounds grow with the logarithm of the longest chain.
    """
    links = stored(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        small = stored(small)
        if links.exceptAll(small).isEmpty() and small.exceptAll(links).isEmpty():
            break
        links = small
    ends = links.groupBy("u").agg(F.min("v").alias("block")).select(F.col("u").alias("v"), "block")
    roots = links.select(F.col("v").alias("v")).distinct().join(ends.select("v"), "v", "left_anti").select("v", F.col("v").alias("block"))
    return ends.unionByName(roots)


def complete_linkage(edges: DataFrame, order: str) -> DataFrame:
    """(v, cluster): accepted pairs (a, b) are taken in ``order``; two clusters join only if every pair across is accepted.

    Pairs only matter within their linked block, so blocks are walked independently.  ``cluster`` is the smallest member.
    """
    blocks = linked_blocks(edges)
    inside = edges.join(blocks.withColumnRenamed("v", "a"), "a").select("a", "b", order, "block")
    kind = edges.schema["a"].dataType.simpleString()

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        accepted = defaultdict(set)
        for a, b in zip(rows["a"], rows["b"], strict=True):
            accepted[a].add(b)
            accepted[b].add(a)
        cluster = {v: {v} for v in accepted}
        for a, b in rows.sort_values(order)[["a", "b"]].itertuples(index=False):
            x, y = cluster[a], cluster[b]
            if x is not y and all(y <= accepted[v] for v in x):
                x |= y
                for v in y:
                    cluster[v] = x
        return pd.DataFrame([(v, min(c)) for v, c in cluster.items()], columns=["v", "cluster"])

    return inside.groupBy("block").applyInPandas(walk, f"v {kind}, cluster {kind}")

"""Keyed keep-first and keep-last, append-if-absent, logs with history, admission and fair order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``.  Null keys are one key.  Aggregates before shuffling, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_m"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_m.{c}") for c in df.columns))


def keep_last_at_first(df: DataFrame, keys: list[str], order: list[str], position: str = "first_position") -> DataFrame:
    """The last row of each key with the position of its first, as a dict keeps them when values are overwritten."""
    rest = [c for c in df.columns if c not in keys]
    values = F.struct(*order, *[c for c in rest if c not in order])
    best = df.groupBy(*keys).agg(F.max(values).alias("_m"), F.min(order[0]).alias(position))
    return best.select(*(F.col(c) if c in keys else F.col(f"_m.{c}") for c in df.columns), position)


def append_absent(archive: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` to append: one per key, none that the archive has.  Null keys match null keys."""
    same = None
    known = archive.select(*(F.col(k).alias("_k_" + k) for k in keys)).distinct()
    for k in keys:
        one = F.col(k).eqNullSafe(F.col("_k_" + k))
        same = one if same is None else same & one
    return new.dropDuplicates(keys).join(known, same, "left_anti")


def review_log(events: DataFrame, key: str, at: str, payload: str) -> DataFrame:
    """(key, observation_count, first_seen_at, last_seen_at, last_payload) of an append-only log; rows without key are left out."""
    rows = events.where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.count("*").alias("observation_count"), F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.max(F.struct(at, payload))[payload].alias("last_payload"))


def latest_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The ``n`` latest rows of each key; the cut comes before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def admitted(df: DataFrame, needs: Column, order: list[str], capacity: int) -> DataFrame:
    """Add ``is_admitted``: rows that need nothing, and the first ``capacity`` of the others in ``order``.

    The last admitted place is a top-k of the order columns, one row, with which all rows are compared; no total order
    is built.  Null places come first.
    """
    first = df.where(needs).select(*order).orderBy(*order).limit(capacity)
    last = first.orderBy(*(F.desc_nulls_last(c) for c in order)).limit(1).collect()
    if not last:
        return df.withColumn("is_admitted", ~needs)
    within, same = F.lit(False), F.lit(True)
    for c in order:
        limit = F.lit(last[0][c]).cast(df.schema[c].dataType)
        before = F.col(c).isNull() & limit.isNotNull() | F.coalesce(F.col(c) < limit, F.lit(False))
        within = within | same & before
        same = same & F.col(c).eqNullSafe(limit)
    return df.withColumn("is_admitted", ~needs | within | same)


def fair_order(df: DataFrame, rank: list[str], age: list[str], first: int) -> DataFrame:
    """(slot, ...) for the ``first`` slots: every fourth goes to the oldest row left, the others to the best ranked.

    Each slot takes one row from the front of one of two orders, so only the first rows of both can ever be chosen;
    these are found by two top-k, and the choice itself is made over at most twice ``first`` rows.
    """
    front = df.orderBy(*rank).limit(first).union(df.orderBy(*age).limit(first)).distinct()

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        by_rank, by_age = (rows.sort_values(c, kind="stable").index.tolist() for c in (rank, age))
        taken: list = []
        used: set = set()
        at = {"r": 0, "a": 0}
        while len(taken) < min(first, len(rows)):
            which, order = ("a", by_age) if len(taken) % 4 == 3 else ("r", by_rank)
            while order[at[which]] in used:
                at[which] += 1
            used.add(order[at[which]])
            taken.append(order[at[which]])
        return rows.loc[taken].assign(slot=range(len(taken)))[["slot", *rows.columns]]

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return front.groupBy(F.lit("all").alias("_all")).applyInPandas(choose, f"slot int, {types}")

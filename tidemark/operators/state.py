"""Keyed state with history, in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HISTORY = "array<struct<mark: string, last_seen_at: timestamp>>"


def fresh(arrivals: DataFrame, key: str, mark: str, at: str) -> DataFrame:
    """(key, mark, first_seen_at, last_seen_at, history) of arrivals alone: the latest mark of each key; null keys are left out."""
    rows = arrivals.where(F.col(key).isNotNull())
    last = rows.groupBy(key).agg(F.max(F.struct(F.col(at).alias("t"), F.col(mark).alias("m"))).alias("_l"), F.min(at).alias("first_seen_at"))
    return last.select(key, F.col("_l.m").alias("mark"), "first_seen_at", F.col("_l.t").alias("last_seen_at"), F.array().cast(_HISTORY).alias("history"))


def upsert(state: DataFrame, arrivals: DataFrame, key: str) -> DataFrame:
    """The state after ``arrivals`` (both as ``fresh`` gives them), with ``is_changed``.

    A key whose mark changed starts anew: its first time is reset and its old mark goes into the history.  An
    unchanged key keeps its first time.  Keys that didn't arrive stay as they are.
    """
    old, new = (df.select(F.col(key), F.struct("mark", "first_seen_at", "last_seen_at", "history").alias(x)) for df, x in ((state, "_o"), (arrivals, "_n")))
    both = old.join(new, key, "full")
    changed = F.col("_o").isNotNull() & F.col("_n").isNotNull() & ~F.col("_o.mark").eqNullSafe(F.col("_n.mark"))
    grown = F.concat(F.col("_o.history"), F.array(F.struct(F.col("_o.mark").alias("mark"), F.col("_o.last_seen_at").alias("last_seen_at"))))
    return both.select(
        key,
        F.when(F.col("_n").isNotNull(), F.col("_n.mark")).otherwise(F.col("_o.mark")).alias("mark"),
        F.when(changed | F.col("_o").isNull(), F.col("_n.first_seen_at")).otherwise(F.col("_o.first_seen_at")).alias("first_seen_at"),
        F.greatest("_o.last_seen_at", "_n.last_seen_at").alias("last_seen_at"),
        F.when(changed, grown).otherwise(F.coalesce("_o.history", "_n.history")).alias("history"),
        changed.alias("is_changed"),
    )

"""Structured Streaming variants of the keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "first_seen_at timestamp, last_seen_at timestamp, fingerprint string, revisions int"
SEEN = f"url string, {STATE}, is_change boolean"


def observe(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One url's arrivals of a micro-batch: its times widen, a new fingerprint counts as a revision.

    Rows are taken in order of time; late ones widen the past and never replace the latest fingerprint.
    """
    first, last, mark, revisions = state.get if state.exists else (None, None, None, 0)
    changed = False
    for rows in [pd.concat(list(batches)).sort_values("seen_at", kind="stable")]:
        for at, fingerprint in zip(rows["seen_at"], rows["fingerprint"], strict=True):
            if last is None or at >= last:
                if fingerprint != mark:
                    changed, revisions = revisions > 0 or changed, revisions + 1
                mark, last = fingerprint, at
            first = at if first is None or at < first else first
    state.update((first, last, mark, revisions))
    yield pd.DataFrame({"url": [key[0]], "first_seen_at": [first], "last_seen_at": [last], "fingerprint": [mark], "revisions": [revisions], "is_change": [changed]})


def observed(arrivals: DataFrame) -> DataFrame:
    """Keyed upsert of (url, seen_at, fingerprint): a row per url and micro-batch with its state; late rows are kept.

    Rows without url or time are ignored.  State never expires, as nothing seen is forgotten.
    """
    rows = arrivals.where("url is not null and seen_at is not null").select("url", "seen_at", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    return rows.groupBy("url").applyInPandasWithState(observe, SEEN, STATE, "update", GroupStateTimeout.NoTimeout)


def counts_by_window(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, <kind>, n) of closed windows; rows later than ``late`` behind the latest time are left out."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), kind, "n")


def first_arrivals(arrivals: DataFrame, key: str, at: str, late: str = "24 hours") -> DataFrame:
    """The first row of each key within ``late``: a pre-filter of exact repeats in front of the banded duplicate rule."""
    return arrivals.withWatermark(at, late).dropDuplicatesWithinWatermark([key])

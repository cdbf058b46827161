"""Reprints: equal headlines close in time, of which an original or the earliest is kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shorter headlines prove nothing.
LEAST_HEADLINE = 28


def reprints(articles: DataFrame, seconds: int = 86_400) -> DataFrame:
    """(id, representative, reason): a row per article; reason null where it is kept.

    ``articles``: id, url, headline, feed, at (microseconds), body ('' if none), rank (0 for originals).  In order of (rank, id) an
    article falls to the first kept one of the same url (``same_url``), else of the same headline of LEAST_HEADLINE or more
    characters at most ``seconds`` apart whose body agrees, if that is of the same feed (``same_feed``) or ranks
    before it (``original_available``).  Null urls and times match nothing; null ids are left out.

    Articles are spread by headline and stream by in order; only the kept ones of one headline are held.
    """
    rows = articles.where("id is not null")
    # null urls are spread, each in a window of its own
    apart = F.when(F.col("url").isNull(), F.col("id"))
    first = F.first("id").over(Window.partitionBy("url", apart).orderBy("rank", "id"))
    rows = rows.withColumn("_first", F.when(F.col("url").isNotNull(), first)).withColumn("_same", F.col("_first") != F.col("id"))
    same = rows.where("_same").select("id", F.col("_first").alias("representative"), F.lit("same_url").alias("reason"))
    rest = rows.where("coalesce(not _same, true)").select("headline", "rank", "id", "at", "feed", "body")
    alone = rest.where(f"at is null or length(headline) < {LEAST_HEADLINE} or headline is null")
    kept_alone = alone.select("id", F.col("id").alias("representative"), F.lit(None).cast("string").alias("reason"))
    blocks = rest.where(f"at is not null and length(headline) >= {LEAST_HEADLINE}")
    band = seconds * 1_000_000

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, kept = None, []
        for part in batches:
            out = []
            for headline, rank, ident, at, feed, body in part.itertuples(index=False):
                if headline != block:
                    block, kept = headline, []
                match = next(((k, "same_feed" if f == feed else "original_available") for k, r, t, f, b in kept if abs(at - t) <= band and b == body and (f == feed or r < rank)), None)
                if match is None:
                    kept.append((ident, rank, at, feed, body))
                out.append((ident, *(match or (ident, None))))
            yield pd.DataFrame(out, columns=["id", "representative", "reason"])

    ordered = blocks.repartition("headline").sortWithinPartitions("headline", "rank", "id")
    kind = articles.schema["id"].dataType.simpleString()
    return ordered.mapInPandas(walk, f"id {kind}, representative {kind}, reason string").unionByName(kept_alone).unionByName(same)

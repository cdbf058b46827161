"""Problem 9: records of several sources mixed towards target shares of the total size.

Each source's texts, in a row, are cut into blocks of a fixed number of tokens.  For each output shard the number
of blocks per source is drawn from a multinomial distribution of the target shares; a source's slots are mapped
through pseudorandom permutations of its block numbers, one for each round through its blocks, and the blocks are
joined by number.  A source gives each block at most as many times as a record may be used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tidemark.scratch import stored

BLOCK = 256
#: Slots of a shard, at least; there are at most MOST_SHARDS, so that what the driver draws is bounded.
SHARD, MOST_SHARDS = 1_024, 4_096
#: Rows over which a running total is computed in one task, on average.
BUCKET = 20_000
#: Slots that are numbered at once.
SPAN = 4_096


_ROUNDS = [np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64)) for r in range(4)]


def permuted(j: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A permutation of 0..n-1 for each (n, seed): four Feistel rounds, walked on until the value is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, out = j.astype(np.uint64), np.zeros(len(j), dtype=np.uint64)
    open_ = np.ones(len(j), dtype=bool)
    while open_.any():
        a, b = x >> half, x & mask
        for r in range(4):
            f = (b + seed.astype(np.uint64) + _ROUNDS[r]) * np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(29)
            a, b = b, a ^ ((f * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)) & mask)
        x = np.where(open_, (a << half) | b, x)
        done = open_ & (x < n.astype(np.uint64))
        out[done] = x[done]
        open_ &= ~done
    return out.astype(np.int64)


@arrow_udf(T.LongType())
def _permuted(j: pa.Array, n: pa.Array, seed: pa.Array) -> pa.Array:
    return pa.array(permuted(*(x.to_numpy(zero_copy_only=False) for x in (j, n, seed))))


def _placed(rows: DataFrame, total: int) -> DataFrame:
    """Add ``start``, the tokens of the same source before a row; the running totals are local to buckets of rows."""
    buckets = max(1, -(-total // BUCKET))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("n").alias("s"))
    before = F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")
    local = F.sum("n").over(Window.partitionBy("source", "bucket").orderBy("doc_id", "n").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", "bucket", before.alias("before"))
    return dealt.withColumn("local", F.coalesce(local, F.lit(0))).join(offsets, ["source", "bucket"]).select("source", "doc_id", "n", (F.col("before") + F.col("local")).alias("start"))


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(shard, source, block_no, repeat_no, doc_id, first_token, n_tokens): the chosen pieces of documents.

    ``sizes``: (doc_id, source, n_tokens); ``targets``: (doc_source, target_share, max_repeats).  ``total_tokens`` is the size of
    the mix, by default that of all documents of the sources named.  ``repeat_no`` counts from 1 and never passes
    max_repeats; where a source has too little, it gives all it may, and the others keep their numbers.  Sources
    without documents, with a null or non-positive share or number of repeats give nothing; documents of
    other or no source, without tokens, or with a null id aren't used.
    """
    spark = sizes.sparkSession
    wanted = targets.where("doc_source is not null and target_share > 0 and max_repeats > 0").groupBy(F.col("doc_source").alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    rows = sizes.where("doc_id is not null and n_tokens > 0").join(wanted.select("source"), "source").select("source", F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n"))
    placed = stored(_placed(stored(rows), rows.count()))
    have = {r["source"]: r for r in placed.groupBy("source").agg(F.sum("n").alias("n")).join(wanted, "source").collect()}  # a row per target
    names = sorted(have)
    total = total_tokens or sum(have[s]["n"] for s in names)
    slots = -(-total // block)
    n_shards = int(min(MOST_SHARDS, max(1, slots // SHARD)))
    per_shard = np.diff(np.linspace(0, slots, n_shards + 1).astype(np.int64))
    # shares of sources that can't give are not handed to others: what is missing is drawn, too, and left empty
    shares = np.array([have[s]["share"] for s in names], dtype=float)
    whole = max(1.0, float(wanted.agg(F.sum("share")).first()[0] or 0.0))
    draws = np.random.default_rng(seed).multinomial(per_shard, np.r_[shares / whole, max(0.0, 1 - shares.sum() / whole)])
    ranges = []
    for i, s in enumerate(names):
        blocks = -(-have[s]["n"] // block)
        ends = np.minimum(np.cumsum(draws[:, i]), blocks * have[s]["most"])
        starts = np.r_[0, ends[:-1]]
        ranges += [(k, s, int(a), int(b), int(blocks)) for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if b > a]
    drawn = spark.createDataFrame(ranges, "shard int, source string, from_slot long, to_slot long, blocks long")
    # ranges are cut into spans first, so that no row ever holds the slots of a whole shard
    spans = drawn.select("*", F.explode(F.sequence(F.floor(F.col("from_slot") / SPAN), F.floor((F.col("to_slot") - 1) / SPAN))).alias("span")).repartition("shard", "source", "span")
    within = F.sequence(F.greatest("from_slot", F.col("span") * SPAN), F.least("to_slot", (F.col("span") + 1) * SPAN) - 1)
    each = spans.select("shard", "source", "blocks", F.explode(within).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    mapped = each.withColumn("repeat_no", (turn + 1).cast("int")).withColumn("block_no", _permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64("source", turn, F.lit(seed))))
    numbers = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n") - 1) / block))
    pieces = placed.select("source", "doc_id", "start", "n", F.explode(numbers).alias("block_no"))
    begin, end = F.greatest("start", F.col("block_no") * block), F.least(F.col("start") + F.col("n"), (F.col("block_no") + 1) * block)
    pieces = pieces.select("source", "block_no", "doc_id", (begin - F.col("start")).alias("first_token"), (end - begin).alias("n_tokens"))
    # the ranges look small to the optimiser, the slots they stand for grow with the data: never broadcast them
    return mapped.hint("merge").join(pieces, ["source", "block_no"]).select("shard", "source", "block_no", "repeat_no", "doc_id", "first_token", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_tokens, actual_share, most_repeats): what each source named really got."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.max("repeat_no").alias("most_repeats"))
    total = F.sum("n_tokens").over(Window.partitionBy())  # a row per target
    named = targets.where("doc_source is not null").groupBy(F.col("doc_source").alias("source")).agg(F.max("target_share").alias("target_share"))
    filled = named.join(got, "source", "left").fillna(0, ["n_tokens", "most_repeats"])
    return filled.select("source", "target_share", "n_tokens", F.when(total > 0, F.col("n_tokens") / total).otherwise(F.lit(0.0)).alias("actual_share"), "most_repeats")

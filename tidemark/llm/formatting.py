"""Problem 2: records that are the same but for white space, letter case, punctuation or order of fields.

Each record gets a canonical key.  Partition-wise Bloom filters of keys seen at least once and of keys
seen repeatedly are merged bit by bit; only records whose key may repeat are shuffled for exact grouping,
all others are single and stay where they are read.  False positives of the filter cost a little shuffling, never a wrong result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingles import distinct
from tidemark.operators.skew import attach
from tidemark.scratch import stored

#: ASCII symbols and their wide forms count as punctuation; emoji and other symbols don't.
PUNCTUATION = r"[\p{P}\p{Z}\p{Cc}\s\x{FEFF}\x{200B}$+<=>^`|~＄＋＜＝＞＾｀｜～]+"
SEPARATOR = "\x01"
#: Bits set per key, bits per key, and the most bits of a filter (256 MB: what is broadcast never exceeds it).
HASHES, BITS_PER_KEY, MOST_BITS = 3, 10, 1 << 31
SEGMENT = 1 << 20


def bare(text: Column) -> Column:
    """Text without white space and punctuation, in one case; null becomes empty."""
    return F.regexp_replace(F.lower(F.upper(F.coalesce(text, F.lit("")))), PUNCTUATION, "")


def canonical_url(url: Column) -> Column:
    """A url without case, white space, punctuation and order of parameters."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"(?s)^[^?]*\?(.*)$", 1)
    pairs = F.transform(F.split(query, "[&;]"), lambda p: F.concat_ws("=", *[bare(F.get(F.split(p, "=", 2), F.lit(i))) for i in (0, 1)]))
    kept = F.filter(pairs, lambda p: p != "=")
    return F.concat_ws(SEPARATOR, bare(F.regexp_extract(text, r"(?s)^([^?]*)", 1)), F.array_sort(kept))


def record_key(title: Column, url: Column) -> Column:
    """16 bytes that agree for records that agree; null if the record has neither title nor url."""
    named = F.length(F.concat(F.coalesce(title, F.lit("")), F.coalesce(url, F.lit("")))) > 0
    return F.when(named, F.unhex(F.md5(F.concat_ws(SEPARATOR * 2, bare(title), canonical_url(url)).cast("binary"))))


def payload_fields(payload: Column, *names: str) -> list[Column]:
    """Text fields of a JSON object; all null where the payload isn't JSON."""
    parsed = F.try_parse_json(payload)
    return [F.try_variant_get(parsed, f"$.{n}", "string").alias(n) for n in names]


def _positions(keys: pa.Array, bits: int) -> np.ndarray:
    """Row by row the bits of each 16-byte key."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), dtype="<u8").reshape(-1, 2)
    steps = np.arange(HASHES, dtype=np.uint64)
    return (raw[:, :1] + steps * (raw[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def _packed(at: np.ndarray) -> bytes:
    field = np.zeros(SEGMENT, dtype=bool)
    field[at] = True
    return zlib.compress(np.packbits(field).tobytes(), 1)


def _segments(once: np.ndarray, again: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    segment, again_segment = once // SEGMENT, again // SEGMENT
    for n in distinct(segment):
        yield int(n), _packed((once[segment == n] % SEGMENT).astype(np.int64)), _packed((again[again_segment == n] % SEGMENT).astype(np.int64))


def _merge(parts: pd.DataFrame) -> pd.DataFrame:
    """A bit is repeated if it was in any part or if two parts have it."""
    once = again = np.zeros(SEGMENT // 8, dtype=np.uint8)
    for a, b in zip(parts["once"], parts["again"], strict=True):
        a, b = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (a, b))
        once, again = once | a, again | b | (once & a)
    return pd.DataFrame({"segment": parts["segment"].iloc[:1], "once": [zlib.compress(once.tobytes(), 1)], "again": [zlib.compress(again.tobytes(), 1)]})


def filter_bits(rows: int) -> tuple[int, int]:
    """(bits, ranges): bits for so many keys, a power of two; more keys than MOST_BITS are for are taken in several ranges, a filter each."""
    bits = max(SEGMENT, 1 << (rows * BITS_PER_KEY).bit_length())
    return min(MOST_BITS, bits), max(1, bits // MOST_BITS)


def repeat_filter(keys: DataFrame, bits: int) -> dict[int, bytes]:
    """The filter of keys seen more than once, as compressed segments; its size is bounded by MOST_BITS."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b.column(0) for b in batches if b.num_rows]
        if not seen:
            return
        keys = pa.chunked_array(seen).combine_chunks()
        at = _positions(keys, bits)
        _, first, counts = np.unique(at[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ at[:, 1], return_index=True, return_counts=True)
        parts = list(_segments(distinct(at[first].ravel()), distinct(at[first[counts > 1]].ravel())))
        names = ("segment", "once", "again", "part")
        part = int(at[0, 0] % 16)
        for p in parts:
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([x] for x in (*p, part)), strict=True)), pa.schema([("segment", pa.int64()), ("once", pa.binary()), ("again", pa.binary()), ("part", pa.int32())]))

    filled = keys.mapInArrow(fill, "segment long, once binary, again binary, part int")
    # in two steps, so that no task merges the parts of all partitions
    shape = "segment long, once binary, again binary"
    merged = filled.groupBy("segment", "part").applyInPandas(_merge, shape).groupBy("segment").applyInPandas(_merge, shape)
    return {r["segment"]: bytes(r["again"]) for r in merged.select("segment", "again").toLocalIterator()}


def possible_repeats(keyed: DataFrame, key: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``keyed`` whose key may occur more than once, all that do and few others; and the rest, told apart where they are read."""
    bits, ranges = filter_bits(rows)
    again = single = None
    for i in range(ranges):
        part = keyed.where(F.pmod(F.xxhash64(key), F.lit(ranges)) == i) if ranges > 1 else keyed
        shared = keyed.sparkSession.sparkContext.broadcast(repeat_filter(part.select(key), bits))
        hit, miss = (part.mapInArrow(_passing(shared, bits, keyed.columns.index(key), wanted), keyed.schema) for wanted in (True, False))
        again, single = (hit, miss) if again is None else (again.unionByName(hit), single.unionByName(miss))
    return again, single


def _passing(shared, bits: int, at: int, wanted: bool):
    """Rows whose key the filter of compressed segments holds, or those whose key it doesn't hold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits // 8, dtype=np.uint8)
        for n, part in shared.value.items():
            field[n * (SEGMENT // 8) : (n + 1) * (SEGMENT // 8)] = np.frombuffer(zlib.decompress(part), dtype=np.uint8)
        for b in batches:
            if b.num_rows:
                p = _positions(b.column(at), bits).astype(np.int64)
                hit = (field[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1
                yield b.filter(pa.array(hit.all(axis=1) == wanted))

    return keep


def keyed_records(df: DataFrame, record: str, payload: str) -> DataFrame:
    """(record, key) of all records, as a stored table; the key is null for those that belong to no group."""
    title, url = payload_fields(F.col(payload), "title", "url")
    return stored(df.select(F.col(record), title, url).select(record, record_key(F.col("title"), F.col("url")).alias("key")))


def repeats(df: DataFrame, record: str = "item_id", payload: str = "payload") -> DataFrame:
    """(first_<record>, <record>): each record of a group but the first, which has the smallest id.

    Records whose payload isn't JSON, or has neither title nor url, belong to no group.  Null ids are
    ignored.  An empty table gives no rows.
    """
    keyed = keyed_records(df.where(F.col(record).isNotNull()), record, payload).where("key is not null")
    total = keyed.count()
    again = stored(possible_repeats(keyed, "key", total)[0])
    groups = again.groupBy("key").agg(F.min(record).alias("first_" + record), F.count("*").alias("_n")).where("_n > 1")
    return attach(again, groups, "key", "_n", total).where(F.col(record) != F.col("first_" + record)).select("first_" + record, record)


def collapse(df: DataFrame, record: str = "item_id", payload: str = "payload") -> DataFrame:
    """(<record>, n_copies): one row per group, with its smallest id and number of copies.

    A record that belongs to no group (its payload isn't JSON, or has neither title nor url) comes out with 1.
    """
    every = keyed_records(df.where(F.col(record).isNotNull()), record, payload)
    keyed = every.where("key is not null")
    again, single = possible_repeats(keyed, "key", keyed.count())
    grouped = again.groupBy("key").agg(F.min(record).alias(record), F.count("*").alias("n_copies")).select(record, "n_copies")
    # singletons are never shuffled
    alone = single.unionByName(every.where("key is null")).select(record, F.lit(1).cast("long").alias("n_copies"))
    return grouped.unionByName(alone)

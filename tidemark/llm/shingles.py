"""Runs of three characters of whole texts, hashed and counted batch by batch in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tidemark.scratch import stored

WIDTH = 40
MASK = np.uint64((1 << WIDTH) - 1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
SEGMENT = 1 << 16
#: Most buckets of a table of counts, and most places of a presence table.
MOST, MOST_PLACES = 1 << 22, 1 << 24
#: Parts of tables of counts, and keys, up to which the driver merges them itself (32 MB, 1 MB); beyond, the executors do.
FEW_PARTS, FEW_KEYS = 128, 1 << 17
#: Texts worked on at once; at most 2^12, as their numbers share a word with a rank and a hash.
PIECE = 2_000
#: Bits of a text's parities.
BITS = 256


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[3]
    x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    return x ^ (x >> np.uint64(32))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting, which beats hashing by far here."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def first_of_each(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of one of equal (group, key) each, in order of both; group: ascending numbers from 0."""
    if not len(group):
        return np.empty(0, dtype=np.int64)
    bits = np.uint64(int(group[-1]).bit_length())
    # one word sorts much faster than two columns; where it doesn't tell two keys apart, both are compared
    word = (key >> bits) | (group.astype(np.uint64) << (np.uint64(64) - bits)) if bits else key
    order = np.argsort(word)
    same, k = word[order][1:] == word[order][:-1], key[order]
    if (same & (k[1:] != k[:-1])).any():
        order = np.lexsort((key, group))
        g, k = group[order], key[order]
        same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    return order[np.r_[True, ~same]]


def mixed_int(x: int) -> int:
    """``mixed`` of one number."""
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 29)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 32)


def content_key(text: str) -> int | None:
    """Signed 64-bit key of a text; None for a text without content."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) if text else None


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the number of the text each belongs to."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return codes, np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) for t in texts])


def grams(texts: list[str]) -> np.ndarray:
    """Sorted distinct (text number << WIDTH | hash) of the runs of three characters; a shorter text is one run."""
    codes, of = codes_of([t if len(t) > 2 else t.ljust(3, "\0") if t else t for t in texts])
    if len(codes) < 3:
        return np.empty(0, dtype=np.uint64)
    hashes = mixed(codes[:-2] * _MIX[0] + codes[1:-1] * _MIX[1] + codes[2:] * _MIX[2])
    inside = of[:-2] == of[2:]
    return distinct((of[:-2][inside] << np.uint64(WIDTH)) | (hashes[inside] & MASK))


def similarity(left: list[str], right: list[str]) -> np.ndarray:
    """Runs in both divided by runs in either, pair by pair; 0 where both are empty."""
    a, b = grams(left), grams(right)
    of = lambda x: np.bincount((x >> np.uint64(WIDTH)).astype(np.int64), minlength=len(left))
    merged = np.sort(np.concatenate([a, b]))
    both = of(merged[1:][merged[1:] == merged[:-1]])
    return both / np.maximum(1, of(a) + of(b) - both)


def parities(found: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts BITS bits, as signed 64-bit words: whether an odd number of its runs fall on a bit; found: sorted (text, hash).

    Two texts differ in at least as many runs as bits.
    """
    at = (found >> np.uint64(WIDTH)) * np.uint64(BITS) + mixed(found & MASK) % np.uint64(BITS)
    odd = np.bincount(at.astype(np.int64), minlength=n * BITS) & 1
    return np.packbits(odd.astype(bool)).view("<i8").reshape(n, BITS // 64)


def folded(parities: list[np.ndarray]) -> list[np.ndarray]:
    """The parities on half as many bits; two texts differ in at least as many runs as bits of these, too."""
    half = len(parities) // 2
    return [x ^ y for x, y in zip(parities[:half], parities[half:], strict=True)]


def ranks(counts: np.ndarray) -> np.ndarray:
    """For each bucket of a table of counts its place among at most 2^12, rare ones first: whole numbers up to 2^11, then by the logarithm."""
    steep = 2048 + 64 * np.log2(np.maximum(counts, 2048) / 2048)
    return np.where(counts < 2048, counts, np.minimum(steep, 4095)).astype(np.uint16)


def packed(counts: np.ndarray) -> list[tuple[int, bytes]]:
    """Non-empty segments of a table of counts."""
    return [(i, zlib.compress(counts[i * SEGMENT : (i + 1) * SEGMENT].astype("<u4").tobytes(), 1)) for i in range(len(counts) // SEGMENT) if counts[i * SEGMENT : (i + 1) * SEGMENT].any()]


def _add(parts: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SEGMENT, dtype=np.uint64)
    for x in parts["counts"]:
        total += np.frombuffer(zlib.decompress(x), dtype="<u4")
    return pd.DataFrame({"segment": parts["segment"].iloc[:1], "counts": [zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)]})


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The table of ``size`` counts from a stored (segment, part, counts); merged in two steps, its size doesn't grow with the data."""
    if parts.count() <= FEW_PARTS:  # at most 32 MB, not worth two shuffles
        few = parts.select("segment", "counts").toArrow()
        counts = np.zeros(size, dtype="<u4")
        for i, c in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
            counts[i * SEGMENT : (i + 1) * SEGMENT] += np.frombuffer(zlib.decompress(c), dtype="<u4")
        return counts
    shape = "segment int, counts binary"
    return unpacked(stored(parts.groupBy("segment", "part").applyInPandas(_add, shape).groupBy("segment").applyInPandas(_add, shape)), size)


def unpacked(merged: DataFrame, size: int) -> np.ndarray:
    """The table of ``size`` counts of (segment, counts), each segment once."""
    counts = np.zeros(size, dtype="<u4")
    for r in merged.toLocalIterator():
        counts[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype="<u4")
    return counts


def squeezed(table: np.ndarray) -> tuple[str, int, bytes]:
    """A table of numbers to be broadcast: compressed, as every executor and the driver keep a broadcast on disk."""
    planes = np.ascontiguousarray(table).view(np.uint8).reshape(-1, table.itemsize).T.tobytes()
    return table.dtype.str, len(table), pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unsqueezed(kind: str, n: int, data: bytes) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, n * width), dtype=np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def table_size(rows: int) -> int:
    """Buckets of a table of counts: a power of two near four per row, from 2^16 to 2^22 (16 MB)."""
    return min(MOST, max(SEGMENT, 1 << (4 * rows).bit_length()))


_COUNTS = pa.schema([("segment", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def places_of(values: np.ndarray, size: int) -> np.ndarray:
    """Places of a presence table that whole numbers fall on, whether these are hashes or not."""
    return (mixed(values.astype(np.uint64)) % np.uint64(size)).astype(np.int64)


def presence(keys: DataFrame, rows: int) -> np.ndarray:
    """Which of a bounded number of places some key of the one column falls on; a place may hold many keys."""
    size = min(MOST_PLACES, max(SEGMENT, 1 << (8 * rows).bit_length()))
    if rows <= FEW_KEYS:
        field = np.zeros(size, dtype=bool)
        field[places_of(keys.toArrow().column(0).to_numpy(), size)] = True
        return field

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        field, part = np.zeros(size, dtype=np.uint8), 0
        for b in batches:
            at = places_of(b.column(0).to_numpy(), size)
            part = int(at[0] % 16) if len(at) else part
            field[at] = 1
        for i, c in packed(field):
            yield batch(_COUNTS, {"segment": [i], "part": [part], "counts": [c]})

    return summed(stored(keys.mapInArrow(fill, "segment int, part int, counts binary")), size) > 0


def only_present(df: DataFrame, key: str, places: np.ndarray, wanted: bool = True) -> DataFrame:
    """The rows of ``df`` whose key, a number, may be among those of ``places``, or with ``wanted=False`` all others.

    Only the keys are sent to Python.
    """
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(places))  # at most 2 MB
    size = len(places)

    @arrow_udf(T.BooleanType())
    def has(keys: pa.Array) -> pa.Array:
        at = places_of(keys.to_numpy(), size)
        return pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1) == wanted)

    return df.where(has(F.col(key)))


def batch(schema: pa.Schema, columns: dict[str, Iterable]) -> pa.RecordBatch:
    """A batch of ``schema``; columns that aren't given are null."""
    rows = max(len(list(c)) for c in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

"""Whole numbers shuffled in packs: a task sends to each bucket one compressed block of all its rows.

Rows of hashes and ids hardly compress one by one; in blocks, by byte of the number and as differences, they take a third to a sixth.  No number is changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a task holds before it sends them, and rows of whole buckets that are unpacked at once, if one bucket doesn't have more.
HELD = 1 << 20
#: Least number of buckets of an exchange; a task that receives works on one after the other.
BUCKETS = 512

DDL = "bucket int, n int, data binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def partitions(df: DataFrame, expected: int = 0) -> int:
    """Partitions of an exchange of about ``expected`` rows: as the session has it, or as many as keep each at 4 million."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-expected >> 22))


def buckets(parts: int) -> int:
    """Buckets of an exchange: a multiple of its partitions, two for each at least."""
    return parts * max(2, -(-BUCKETS // parts))


def pack(bucket: np.ndarray, columns: list[np.ndarray], steps: tuple[bool, ...]) -> pa.RecordBatch:
    """Blocks of the rows of each bucket, in the order given; ``steps``: whether a column is sent as differences."""
    small = bucket.astype(np.uint16)  # sorted by radix
    order = np.argsort(small if (small == bucket).all() else bucket.astype(np.int32), kind="stable")
    bucket = bucket[order].astype(np.int32)
    columns = [c[order].astype(np.int64) for c in columns]
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, dtype=np.int64)
    end = np.append(begin[1:], len(bucket))[: len(begin)]
    for c, step in zip(columns, steps, strict=True):
        if step:
            d = np.r_[c[:1], c[1:] - c[:-1]]
            d[begin] = c[begin]
            c[:] = d
    codec = pa.Codec("zstd", 1)
    bytes_of = [c.view(np.uint8).reshape(-1, 8) for c in columns]
    data = [codec.compress(np.concatenate([x[i:j].T.ravel() for x in bytes_of]).tobytes(), asbytes=True) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin], pa.int32()), pa.array((end - begin).astype(np.int32), pa.int32()), pa.array(data, pa.binary())], schema=_SCHEMA)


def _unpack(n: int, data: bytes, steps: tuple[bool, ...]) -> list[np.ndarray]:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, n * 8 * len(steps)), dtype=np.uint8).reshape(len(steps), 8, n)
    made = [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]
    return [np.cumsum(c) if step else c for c, step in zip(made, steps, strict=True)]


def blocks(bucket: np.ndarray, columns: list[np.ndarray], steps: tuple[bool, ...], count: int) -> list[bytes | None]:
    """The blocks of ``pack`` by bucket, one of ``count``; each says how many rows it has, for ``unblocked``."""
    made, out = pack(bucket, columns, steps), [None] * count
    for at, n, data in zip(*(made.column(i).to_pylist() for i in range(3)), strict=True):
        out[at] = n.to_bytes(4, "little") + data
    return out


def unblocked(block: bytes, steps: tuple[bool, ...]) -> list[np.ndarray]:
    return _unpack(int.from_bytes(block[:4], "little"), memoryview(block)[4:], steps)


def sent(df: DataFrame, parts: int) -> DataFrame:
    """The blocks of ``pack`` with whole buckets in one of ``parts`` partitions each, bucket after bucket."""
    width = buckets(parts) // parts
    return df.repartitionById(parts, F.expr(f"cast(bucket div {width} as int)")).sortWithinPartitions("bucket")


def received(batches: Iterator[pa.RecordBatch], steps: tuple[bool, ...]) -> Iterator[list[np.ndarray]]:
    """The buckets' numbers and the columns of whole buckets, some buckets at once."""
    held, rows, last = [], 0, None
    for b in batches:
        for bucket, n, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != last and rows >= HELD:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, rows = [], 0
            held.append([np.full(n, bucket, dtype=np.int64), *_unpack(n, data, steps)])
            rows, last = rows + n, bucket
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


class Sums:
    """Numbers added up by pairs of ids, and sent in packs; ``most``: a sum that counts as enough, beyond which it isn't told apart."""

    STEPS = (True, False, False)

    def __init__(self, parts: int, most: int) -> None:
        self.width, self.most, self.held, self.rows = buckets(parts), most, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((a, b, n))
        self.rows += len(a)
        if self.rows >= 4 * HELD:
            self.held = [summed(*(np.concatenate(c) for c in zip(*self.held, strict=True)), self.most)]
            self.rows = len(self.held[0][0])
            if self.rows >= HELD:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            a, b, n = summed(*(np.concatenate(c) for c in zip(*self.held, strict=True)), self.most)
            self.held, self.rows = [], 0
            yield pack(bucket_of(a, b, self.width), [a, b, n], self.STEPS)


def bucket_of(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """The bucket of a pair, one of ``width``; the same either way round."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(width)).astype(np.int64)


def summed(a: np.ndarray, b: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum of n, at most ``most``), each pair once, in order."""
    if not len(a):
        return a, b, n
    code = _codes(a, b)
    order = np.argsort(code)
    code = code[order]
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    total = np.minimum(np.add.reduceat(n[order].astype(np.int64), begin), most)
    return a[order[begin]], b[order[begin]], total


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, in the order of the pairs: the bits that the ids use, or else their places among all ids."""
    used = int(np.bitwise_or.reduce(a) | np.bitwise_or.reduce(b))
    if used < 0 or 2 * used.bit_count() > 63:
        ids = np.unique(np.concatenate([a, b]))
        return np.searchsorted(ids, a) * len(ids) + np.searchsorted(ids, b)

    def packed(x: np.ndarray) -> np.ndarray:
        made, rest, width = np.zeros(len(x), dtype=np.int64), used, 0
        while rest:  # from one run of used bits to the next
            low = (rest & -rest).bit_length() - 1
            bits = (~(rest >> low) & ((rest >> low) + 1)).bit_length() - 1
            made |= ((x >> low) & ((1 << bits) - 1)) << width
            rest, width = rest >> (low + bits) << (low + bits), width + bits
        return made

    return packed(a) << used.bit_count() | packed(b)


def totals(sums: DataFrame, parts: int, most: int, either: bool = False) -> DataFrame:
    """(a, b) of the pairs whose numbers of all tasks add up to ``most``; with ``either``, once and a < b if (a, b) or (b, a) does."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, b, n in received(batches, Sums.STEPS):
            a, b, n = summed(a, b, n, most)
            a, b = a[n >= most], b[n >= most]
            if either:  # both are in one bucket
                a, b, _ = summed(np.minimum(a, b), np.maximum(a, b), np.ones(len(a), dtype=np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return sent(sums, parts).mapInArrow(add, "a long, b long")

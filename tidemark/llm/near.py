"""Problem 3: near-duplicate texts, found without comparing all pairs.

A size-aware heavy-light join of the sets of three-character runs; it loses no pair.  All runs have one order, rare ones first, from
counts over all texts.  Two sets that share enough have a run in common among the first few of either in that order, and two such
runs if each takes one more.  Small sets therefore enumerate their subsets of two such runs; large sets scan the inverted lists of
single ones, which hold the sets they may be like, and go on with those met in SHARED of them.  The size that divides them is where both cost the same (``boundary``); it changes
no result.  Where the common runs stand tells how much two sets can still share at most, and most pairs end there, inside the join.  The others
are compared exactly.  Equal texts are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import packs
from tidemark.llm import shingles as S
from tidemark.llm.components import components
from tidemark.llm.plain import plain
from tidemark.operators.skew import attach
from tidemark.scratch import scope, stored

#: An inverted list of more entries is cut into blocks of so many, which meet two by two.
BLOCK = 1 << 15
#: Large sets must share so many single runs, each of which takes part with SHARED - 1 runs more, before their texts are looked at.
SHARED = 3
#: What making a key costs, in looks at an entry of a list.
KEY_COST = 50
#: Pairs of a list that are looked at together.
AT_ONCE = 1 << 21
WORDS = [f"w{i}" for i in range(S.BITS // 64)]

_TEXTS = pa.schema(
    [("id", pa.int64()), ("node", pa.int64()), ("num", pa.int64()), ("text", pa.string()), ("runs", pa.int32()), *((w, pa.int64()) for w in WORDS), ("segment", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("kind", pa.int32())]
)
_TEXTS_DDL = f"id long, node long, num long, text string, runs int, {', '.join(w + ' long' for w in WORDS)}, segment int, part int, counts binary, kind int"
#: Columns of the keys that are shuffled: key, number of the text, meta.
_STEPS = (False, True, False)
#: A text's number: that of the partition that read it, and its place there.
PLACE_BITS = 26


def joined_plain(parts: list[pa.Array]) -> list[str]:
    """The plain forms of some columns in one text, null as empty."""
    columns = [p.to_pylist() for p in parts]
    return [" ".join(filter(None, map(plain, row))) for row in zip(*columns, strict=True)]


def read_texts(df: DataFrame, record: str, columns: tuple[str, ...], size: int, counted: Callable | None = None) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(id, node) of every row with a text; (node, num, text, runs, parities) once per text; and ``size`` counts of the runs of all texts, or of what ``counted`` makes of texts.

    A text that several partitions read counts in each.  ``num`` is another, smaller name of the text, which compresses well.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, part, first = np.zeros(size, dtype=np.int64), set(), None, TaskContext.get().partitionId() << PLACE_BITS
        for b in batches:
            texts = joined_plain([b.column(i) for i in range(1, b.num_columns)])
            nodes = [S.content_key(t) for t in texts]
            yield S.batch(_TEXTS, {"id": b.column(0).cast(pa.int64()), "node": nodes, "kind": [0] * len(texts)})
            fresh = [(n, t) for n, t in zip(nodes, texts, strict=True) if n is not None and not (n in seen or seen.add(n))]
            for i in range(0, len(fresh), S.PIECE):
                some = fresh[i : i + S.PIECE]
                part = some[0][0] % 16 if part is None else part
                found = S.grams([t for _, t in some])
                runs = np.bincount((found >> np.uint64(S.WIDTH)).astype(np.int64), minlength=len(some))
                made = counted([t for _, t in some]) if counted else found & S.MASK
                counts += np.bincount((made % np.uint64(size)).astype(np.int64), minlength=size)
                parities = S.parities(found, len(some))
                nums = np.arange(first, first + len(some))
                first += len(some)
                yield S.batch(_TEXTS, {"node": [n for n, _ in some], "num": nums, "text": [t for _, t in some], "runs": runs, **{w: parities[:, i] for i, w in enumerate(WORDS)}, "kind": [2] * len(some)})
        if packed := S.packed(counts):
            yield S.batch(_TEXTS, {"segment": [i for i, _ in packed], "part": [part or 0] * len(packed), "counts": [c for _, c in packed], "kind": [1] * len(packed)})

    rows = df.where(F.col(record).isNotNull()).select(F.col(record).cast("long"), *columns)
    both = stored(rows.mapInArrow(read, _TEXTS_DDL), "kind")
    ids = both.where("kind = 0 and node is not null").select("id", "node")
    return ids, _distinct(both.where("kind = 2").select("node", "num", "text", "runs", *WORDS)), S.summed(both.where("kind = 1").select("segment", "part", "counts"), size)


def _distinct(texts: DataFrame) -> DataFrame:
    """``texts`` once per node; only the few that more than one partition read are shuffled."""
    again = stored(texts.groupBy("node").count().where("count > 1").select("node"))
    places = S.presence(again, again.count())
    # whoever reads the texts gets the same one of equal texts, and so the same number
    least = F.min(F.struct("num", *(c for c in texts.columns if c not in ("node", "num")))).alias("t")
    return S.only_present(texts, "node", places, False).unionByName(S.only_present(texts, "node", places).groupBy("node").agg(least).select("node", "t.*"))


def needed(x: Column, y: Column, least: float) -> Column:
    """The runs that sets of ``x`` and ``y`` runs must share to be similar enough."""
    return F.ceil(F.lit(least / (1 + least)) * (x + y) - F.lit(1e-9))


def boundary(counts: np.ndarray, least: float) -> int:
    """The most runs of a small set: up to there, all subsets of two cost no more than scanning the lists of single runs.

    A set of n runs takes part with its first (1 - least) n.  These are about the rarest of all occurrences, whose lists have the
    mean length L, so that scanning costs (1 - least) n L and subsets ((1 - least) n)^2 / 2 keys.
    """
    loads = np.sort(counts[counts > 0]).astype(np.int64)
    if not len(loads):
        return 2
    upto = np.cumsum(loads)
    rare = loads[: np.searchsorted(upto, (1 - least) * upto[-1]) + 1].astype(np.float64)
    # an occurrence takes part in about every second text that has it
    mean = float((rare**2).sum() / rare.sum()) / 2
    return max(2, int(2 * mean / KEY_COST / (1 - least)))


def keys_of_texts(texts: list[str], nodes: np.ndarray, rank: np.ndarray, counts: np.ndarray, least: float, small: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, meta): subsets of two runs of small sets, and single runs of large ones and those that may be like them.

    ``meta`` holds the size of the set, the runs from the (second) one of the key on, whether it is a subset, and for keys of long lists which half of two
    blocks the text is in (``together`` reads it).
    """
    found = S.grams(texts)
    at = ((found & S.MASK) % np.uint64(len(counts))).astype(np.int64)
    # text number, rank and hash in one word
    order = np.sort(((found >> np.uint64(S.WIDTH)) << np.uint64(52)) | (rank[at].astype(np.uint64) << np.uint64(40)) | (found & S.MASK))
    text, run = (order >> np.uint64(52)).astype(np.int64), order & S.MASK
    n = np.bincount(text, minlength=len(texts))
    start = np.searchsorted(text, np.arange(len(texts)))
    place = np.arange(len(text)) - start[text]
    first = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
    single = np.flatnonzero((place < first[text] + SHARED - 1) & ((n[text] > small) | (n[text] >= math.floor(least * small)) | (n[text] <= 1 / least)))
    parts = [(run[single], run[single], text[single], n[text[single]] - place[single], np.zeros(len(single), dtype=np.int64))]
    few = np.flatnonzero((n > 1) & (n <= small))
    for i in range(int(first[few].max()) if len(few) else 0):
        for j in range(i + 1, int(first[few].max()) + 1):
            some = few[(first[few] >= j) & (n[few] > j)]
            a, b = run[start[some] + i], run[start[some] + j]
            parts.append((S.mixed(a * np.uint64(31) + b + np.uint64(7)), a, some, n[some] - j + 1, np.ones(len(some), dtype=np.int64)))
    key, by, of, rest, subset = (np.concatenate(x) for x in zip(*parts, strict=True))
    load = counts[(by % np.uint64(len(counts))).astype(np.int64)].astype(np.int64)
    kept = load > 1  # a run of one text meets nothing
    key, of, rest, subset, load = key[kept], of[kept], rest[kept], subset[kept], load[kept]
    key, of, half, copy = in_blocks(key, of, nodes, load, block)
    return key, of, (n[of] << 32) | (rest[copy] << 4) | (subset[copy] << 2) | half


def in_blocks(key: np.ndarray, of: np.ndarray, nodes: np.ndarray, load: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, half, place in what was given): entries of lists longer than ``block`` are repeated, so that every two blocks of a list meet under a key of their own."""
    blocks = -(-load // block)
    copy = np.repeat(np.arange(len(key)), blocks)
    other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mine = (S.mixed(nodes[of].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)[copy]
    low, high = np.minimum(mine, other), np.maximum(mine, other)
    salt = (low * (1 << 20) + high).astype(np.uint64)
    cut = (blocks > 1)[copy]
    made = np.where(cut, S.mixed(key[copy] + salt * np.uint64(0x9E3779B97F4A7C15)), key[copy])
    return made, of[copy], np.where(mine == other, 0, np.where(mine < other, 1, 2)), copy


def keys_of(texts: DataFrame, counts: np.ndarray, least: float, small: int, parts: int, bits: int = 64) -> DataFrame:
    """The keys of (num, text), cut to ``bits`` bits, in packs for ``together``; keys that become equal make more pairs meet, never fewer."""
    shared = texts.sparkSession.sparkContext.broadcast((counts, S.ranks(counts)))  # at most 24 MB

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        counts, rank = shared.value
        for b in batches:
            nums, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for i in range(0, len(texts), S.PIECE):
                some = nums[i : i + S.PIECE]
                key, of, meta = keys_of_texts(texts[i : i + S.PIECE], some, rank, counts, least, small)
                yield key & np.uint64((1 << bits) - 1), some[of], meta

    return in_packs(texts.select("num", "text"), make, parts)


def in_packs(df: DataFrame, make: Callable, parts: int, steps: tuple[bool, ...] = _STEPS) -> DataFrame:
    """What ``make`` makes of the batches of ``df``, (key, number, meta) or more, in packs by key."""
    width = packs.buckets(parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for made in make(batches):
            held.append(made)
            rows += len(made[0])
            if rows >= packs.HELD:
                yield packed(held)
                held, rows = [], 0
        if held:
            yield packed(held)

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, *others = (np.concatenate(c) for c in zip(*held, strict=True))
        return packs.pack(key % np.uint64(width), [key // np.uint64(width), *others], steps)

    return df.mapInArrow(send, packs.DDL)


def _met(key: np.ndarray, node: np.ndarray, meta: np.ndarray, least: float, small: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n) of the texts in whole lists that may be similar by their sizes and by where the key stands in both."""
    order = np.lexsort((meta >> 32, key))
    key, node, meta = key[order], node[order], meta[order]
    size, rest, subset, half = meta >> 32, (meta >> 4) & ((1 << 28) - 1), (meta >> 2) & 1, meta & 3
    # what stands before the last of SHARED common runs may be common, too
    rest = rest + np.where(subset, 0, SHARED - 1)
    # the texts of a list by size: those that one may be like as the smaller are in a row behind it
    within = np.cumsum(np.r_[0, key[1:] != key[:-1]]) << 28
    most = np.minimum(size / least, (rest + 1e-9) * (1 + least) / least - size) + 1e-6
    end = np.searchsorted(within | size, within | np.clip(most.astype(np.int64), 0, (1 << 28) - 1), side="right")
    after = np.maximum(0, end - np.arange(len(key)) - 1)
    upto = np.cumsum(after)
    cuts = np.searchsorted(upto, np.arange(AT_ONCE, int(upto[-1]) + AT_ONCE, AT_ONCE)) if len(upto) else []
    begin = 0
    for stop in [min(int(c) + 1, len(key)) for c in cuts]:
        count = after[begin:stop]
        x = np.repeat(np.arange(begin, stop), count)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
        begin = stop
        low, high = size[x], size[y]
        shared = np.ceil(least / (1 + least) * (low + high) - 1e-9)
        halves = half[x] + half[y]
        # small sets meet by subsets, if they must share two runs
        by = (subset[x] == 1) | (high > small) | (shared < 2)
        kept = np.flatnonzero((low >= least * high - 1e-9) & (np.minimum(rest[x], rest[y]) >= shared) & by & ((halves == 0) | (halves == 3)) & (node[x] != node[y]))
        if len(kept):
            x, y = x[kept], y[kept]
            n = np.where((subset[x] == 0) & (shared[kept] >= SHARED), 1, SHARED)
            yield np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), n


def together(keys: DataFrame, least: float, small: int) -> DataFrame:
    """(a, b), a < b: the texts of (key, node, meta) that meet under enough keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            yield b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()

    parts = packs.partitions(keys)
    return together_packed(in_packs(keys.select("key", "node", "meta"), make, parts), least, small, parts)


def together_packed(keys: DataFrame, least: float, small: int, parts: int) -> DataFrame:
    """``together`` of keys in packs for ``parts`` partitions.

    One shuffle brings the lists together, one task walks them in order; no list is longer than two blocks.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = packs.Sums(parts, SHARED)
        for bucket, key, node, meta in packs.received(batches, _STEPS):
            width = packs.buckets(parts)
            for met in _met(key.view(np.uint64) * np.uint64(width) + bucket.view(np.uint64), node, meta, least, small):
                yield from sums.add(*met)
        yield from sums.rest()

    return packs.totals(packs.sent(keys, parts).mapInArrow(walk, packs.DDL), parts, SHARED)


def among(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``texts`` whose number is in ``pairs``, and a few others: most are in none, and are dropped where they are read, before any shuffle."""
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("num")).distinct())
    return S.only_present(texts, "num", S.presence(ends, ends.count()))


def may_share(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` that may be similar by the parities of their texts."""
    bits = texts.select("num", "runs", *WORDS)
    sides = [bits.select(F.col("num").alias(s), *(F.col(c).alias(s + c) for c in ("runs", *WORDS))) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    differ = sum((F.bit_count(F.col("a" + w).bitwiseXOR(F.col("b" + w))) for w in WORDS[1:]), F.bit_count(F.col("a" + WORDS[0]).bitwiseXOR(F.col("b" + WORDS[0]))))
    total = F.col("aruns") + F.col("bruns")
    return both.where(total - differ >= 2 * needed(F.col("aruns"), F.col("bruns"), least)).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: the nodes of the pairs of numbers whose texts differ and share at least ``least`` of their runs."""
    known = among(pairs, texts.select("num", "node", "text"))
    left, right = (known.select(F.col("num").alias(x), F.col("node").alias("n" + x), F.col("text").alias("t" + x)) for x in "ab")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = S.similarity(b.column(2).to_pylist(), b.column(3).to_pylist()) >= least
                yield b.select([0, 1]).filter(pa.array(same))

    met = pairs.join(left, "a").join(right, "b").where("na != nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "ta", "tb")
    return met.mapInArrow(compare, "a long, b long")


def class_links(df: DataFrame, record: str, columns: tuple[str, ...], least: float = 0.7, small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row with a text, and (a, b) of every two different texts that are near-duplicates.

    ``small``: the most runs of a small set, by default where the costs meet.
    """
    with scope() as kept:
        rows = df.count()
        ids, texts, counts = read_texts(df, record, columns, S.table_size(4 * rows))
        small = boundary(counts, least) if small is None else small
        ids = stored(ids)
        # a set of n runs has keys for little more than (1 - least) n, a small one ((1 - least) n)^2 / 2
        expected = int(int(counts.sum(dtype=np.int64)) * max(1 - least, (1 - least) ** 2 * small / 2))
        parts = packs.partitions(texts, expected)
        keys = keys_of(texts, counts, least, small, parts, min(64, max(32, expected.bit_length() + 8)))
        pairs = stored(together_packed(keys, least, small, parts))
        some = among(pairs, texts)
        links = stored(confirmed(stored(may_share(pairs, some, least)), some, least))
        kept += [ids, links]
    return ids, links


def near_pairs(df: DataFrame, record: str, *columns: str, least: float = 0.7) -> DataFrame:
    """(<record>_a, <record>_b): all pairs of rows, smaller id first, whose texts are near-duplicates or equal.

    The text is the plain form of ``columns``, null as empty; rows without text are near nothing.
    As it lists all pairs, the result grows with the square of a group; ``near_groups`` doesn't.
    """
    ids, links = class_links(df, record, columns, least)
    # the rows of a text that very many share are dealt to blocks, each of which meets all links of the text
    sizes = ids.groupBy("node").agg(F.ceil(F.count("*") / (BLOCK // 8)).cast("int").alias("blocks"), F.count("*").alias("n"))
    sizes = stored(sizes.where("n > 1"))
    dealt = attach(ids, sizes.select("node", "blocks", "n"), "node", "n", ids.count(), "left")
    members = stored(dealt.select("id", "node", F.coalesce(F.pmod(F.xxhash64("id"), "blocks"), F.lit(0)).alias("block")))
    both = links.unionByName(sizes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    for side in "ab":
        cut = sizes.where("blocks > 1").select(F.col("node").alias(side), "blocks")
        spread = both.join(cut, side, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        rows = members.select(F.col("id").alias("i" + side), F.col("node").alias(side), "block")
        both = spread.join(rows, [side, "block"]).drop("block")
    distinct = both.where((F.col("a") != F.col("b")) | (F.col("ia") < F.col("ib")))
    return distinct.select(F.least("ia", "ib").alias(record + "_a"), F.greatest("ia", "ib").alias(record + "_b"))


def near_groups(df: DataFrame, record: str, *columns: str, least: float = 0.7) -> DataFrame:
    """(<record>, group_id, n_copies, n_links): one row per record with a text.

    ``group_id`` is the smallest id of all records linked to it directly or indirectly, ``n_copies``
    the number of records with an equal text (itself included), ``n_links`` the number of different texts
    that are near-duplicates of its own.
    """
    ids, links = class_links(df, record, columns, least)
    nodes = ids.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n_copies"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node"))
    degree = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    group = components(links, "a", "b").select(F.col("vertex").alias("node"), "component")
    labelled = nodes.join(group, "node", "left").join(degree, "node", "left").withColumn("g", F.coalesce("component", "node"))
    named = labelled.groupBy("g").agg(F.min("first").alias("group_id"))
    labelled = stored(labelled.join(named, "g").select("node", "group_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    return attach(ids, labelled, "node", "n_copies", ids.count()).select(F.col("id").alias(record), "group_id", "n_copies", "n_links")

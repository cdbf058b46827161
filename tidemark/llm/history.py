"""Problem 7: checking each new batch against all that is already accepted.

Content-defined chunking: a rolling hash over the characters of a text's plain form sets chunk boundaries, so that an edit changes
only the chunks around it.  A table from chunk to record is kept (``store.History``).  Of a new text the rarest chunks that any other text has are
looked up, so many that less than REST of the bytes of such chunks are left: a record that covers so much is always met, and of
those that cover less nearly all.  The bytes that a record shares are added up; a pair counts only if it is of fitting size and its texts may be
alike by the parities of their runs, which bound what two texts share and come with the chunks.  Those that cover enough are compared exactly.  Rows whose urls agree repeat each other, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import near, packs
from tidemark.llm import shingles as S
from tidemark.scratch import stored

#: One in SPREAD positions is a boundary; the window of the rolling hash is three characters.
SPREAD = 4
#: The rarest chunks are looked up until less than REST of the bytes are left, and at least LEAST of them.
REST, LEAST = 0.5, 6
#: The least share of a text's bytes that the chunks looked up must cover in a record.
COVERAGE = 0.03

#: Shares of a text's bytes are added up in units of 1 / UNITS, rounded up, so that no pair falls below COVERAGE by rounding.
UNITS = 1 << 12

#: A table of chunks has a row for some texts each: a block of their numbers, runs and parities, and one of (key, place of the text) for every bucket of keys.
BUCKETS = 16
_PACKED = pa.schema([("texts", pa.binary()), *((f"k{i}", pa.binary()) for i in range(BUCKETS))])
PACKED_DDL = ", ".join(f"{f.name} binary" for f in _PACKED)
_TEXT_STEPS, _KEY_STEPS = (True, False, *(False for _ in near.WORDS)), (False, True)
_SIGNS = [f"s{i}" for i in range(len(near.WORDS) // 2)]
_PROBES = pa.schema([("key", pa.int64()), ("num", pa.int64()), ("meta", pa.int64()), *((s, pa.int64()) for s in _SIGNS)])
_PROBES_DDL = ", ".join(f"{f.name} long" for f in _PROBES)
#: Columns of chunks that are shuffled: key, number of the text, its runs with the units that the chunk covers (0 for an entry of the table), folded parities.
_STEPS = (False, True, False, *(False for _ in _SIGNS))


def bare_url(url: Column) -> Column:
    """A url without letter case, white space and end punctuation."""
    return F.regexp_replace(F.lower(F.upper(url)), r"(?U)\s+|[\p{P}\p{S}\s]+$", "")


def same_url(bare: Column) -> Column:
    """A key of a ``bare_url`` without order of parameters; null if nothing is left."""
    query = F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1)
    base = F.regexp_replace(F.regexp_extract(bare, r"(?s)^([^?]*)", 1), r"[\p{P}\p{S}]+$", "")
    sorted_query = F.array_sort(F.filter(F.split(query, "&"), lambda p: p != ""))
    return F.when(F.length(bare) > 0, F.xxhash64(F.concat_ws("\x01", base, sorted_query)))


def chunks(texts: list[str], spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, bytes) of all chunks of all texts, in order."""
    codes, of = S.codes_of(texts)
    if not len(codes):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    rolling = codes * S._MIX[0]
    for back in (1, 2):  # of the same text only
        rolling[back:] += np.where(of[back:] == of[:-back], codes[:-back], np.uint64(0)) * S._MIX[back]
    rolling = S.mixed(rolling)
    begins = np.r_[True, of[1:] != of[:-1]]
    cut = begins | np.r_[False, rolling[:-1] % np.uint64(spread) == 0]
    first = np.flatnonzero(cut)
    place = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
    letters = S.mixed(codes + (place.astype(np.uint64) << np.uint64(32)))
    width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    return of[first].astype(np.int64), S.mixed(np.add.reduceat(letters, first)), np.add.reduceat(width, first)


def chunk_keys(texts: list[str]) -> np.ndarray:
    """The distinct chunks of each text, for counting."""
    text, key, _ = chunks(texts)
    return key[S.first_of_each(text, key)]


def chunk_packs(texts: DataFrame) -> DataFrame:
    """The distinct chunks of every text of (num, text, runs, parities), as a table of chunks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, columns = b.column(0).to_pylist(), [b.column(i).to_numpy() for i in range(1, b.num_columns)]
            for i in range(0, len(texts), S.PIECE):
                text, key, _ = chunks(texts[i : i + S.PIECE])
                first = S.first_of_each(text, key)
                text, key = text[first], key[first].astype(np.int64)
                some = [c[i : i + S.PIECE] for c in columns]
                row = packs.blocks(np.zeros(len(some[0]), dtype=np.int64), some, _TEXT_STEPS, 1) + packs.blocks(key % BUCKETS, [key, text], _KEY_STEPS, BUCKETS)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], schema=_PACKED)

    return texts.select("text", "num", "runs", *near.WORDS).mapInArrow(make, PACKED_DDL)


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(keys, place of each key's text, columns of the texts) of each row of a table of chunks, of which some buckets were read."""
    for i in range(b.num_rows):  # one large row after the other
        block, *keys = (c[i].as_py() for c in b.columns)
        found = [packs.unblocked(k, _KEY_STEPS) for k in keys if k is not None]
        if found:
            key, place = (np.concatenate(c) for c in zip(*found, strict=True))
            yield key.view(np.uint64), place, packs.unblocked(block, _TEXT_STEPS)


def rarest(texts: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, share of the text's bytes, count) of the chunks of each text to look up, by REST and LEAST; none that it alone has."""
    text, key, size = chunks(texts)
    first = S.first_of_each(text, key)
    text, key, size = text[first], key[first], size[first]
    total = np.bincount(text, weights=size, minlength=len(texts))
    load = counts[(key % np.uint64(len(counts))).astype(np.int64)].astype(np.int64)
    some = np.flatnonzero(load > 1)
    # rows are in order of text and key; one word sorts faster than three columns
    one = len(key) < 1 << 20 and len(texts) <= 1 << 11
    order = some[np.argsort((text[some] << 52) | (load[some] << 20) | some) if one else np.lexsort((key[some], load[some], text[some]))]
    text, key, size, load = text[order], key[order], size[order], load[order]
    start = np.searchsorted(text, text)
    upto = np.cumsum(size)
    before = upto - size - (upto - size)[start]
    known = np.bincount(text, weights=size, minlength=len(texts))
    kept = (before <= (1 - REST) * known[text]) | (np.arange(len(text)) - start < LEAST)
    return text[kept], key[kept], (size / total[text])[kept], load[kept]


def probes(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, num, meta, folded parities): the chunks of (num, text, runs, parities) to look up; ``meta`` as in _STEPS."""
    shared = texts.sparkSession.sparkContext.broadcast(S.squeezed(counts))  # at most 16 MB

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = S.unsqueezed(*shared.value)
        for b in batches:
            texts, (nums, runs, *words) = b.column(0).to_pylist(), (b.column(i).to_numpy() for i in range(1, b.num_columns))
            signs = S.folded(words)
            for i in range(0, len(texts), S.PIECE):
                text, key, share, _ = rarest(texts[i : i + S.PIECE], counts)
                at = text + i
                meta = (runs[at].astype(np.int64) << 16) | np.maximum(1, np.ceil(share * UNITS - 1e-9)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key.astype(np.int64), nums[at], meta, *(s[at] for s in signs))], schema=_PROBES)

    return texts.select("text", "num", "runs", *near.WORDS).mapInArrow(make, _PROBES_DDL)


def _block_key(key: np.ndarray, block: np.ndarray) -> np.ndarray:
    return S.mixed(key + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def meeting(looked_up: DataFrame, tables: list[DataFrame], counts: np.ndarray, wanted: np.ndarray, least: float, expected: int, block: int = near.BLOCK) -> DataFrame:
    """(a, b), a < b: numbers of texts of ``probes`` and of other texts of a chunk table that cover COVERAGE of their bytes and may be alike by size and parities.

    ``wanted``: the places of the chunks looked up, about ``expected``.  Long lists of the table are dealt to blocks, each of which a probe meets.  Keys are
    cut to as many bits as keep chance meetings rare; these only add pairs, which are compared as all others.
    """
    shared = looked_up.sparkSession.sparkContext.broadcast((S.squeezed(counts), S.squeezed(np.packbits(wanted))))  # at most 18 MB
    places, parts, bits = len(wanted), packs.partitions(looked_up, 4 * expected), min(64, max(32, int(counts.sum(dtype=np.int64)).bit_length() + 8))
    width = packs.buckets(parts)

    def blocks_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-counts[(keys % np.uint64(len(counts))).astype(np.int64)].astype(np.int64) // block))

    def cut(key: np.ndarray) -> np.ndarray:
        return key & np.uint64((1 << bits) - 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        counts = S.unsqueezed(*shared.value[0])
        for b in batches:
            keys, *others = (c.to_numpy() for c in b.columns)
            blocks = blocks_of(keys.view(np.uint64), counts)
            copy = np.repeat(np.arange(len(keys)), blocks)
            turn = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            yield cut(_block_key(keys.view(np.uint64)[copy], turn)), *(c[copy] for c in others)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        counts, has = S.unsqueezed(*shared.value[0]), np.unpackbits(S.unsqueezed(*shared.value[1])).astype(bool)
        for b in batches:
            for keys, place, (nums, runs, *words) in _unpacked(b):
                kept = np.flatnonzero(has[S.places_of(keys, places)])
                keys, at = keys[kept], place[kept]
                turn = S.mixed(nums[at].view(np.uint64)) % blocks_of(keys, counts).astype(np.uint64)
                yield cut(_block_key(keys, turn)), nums[at], runs[at] << 16, *(s[at] for s in S.folded(words))

    most = int(COVERAGE * UNITS - 1e-6)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = packs.Sums(parts, most)
        for bucket, key, num, meta, *signs in packs.received(batches, _STEPS):
            for met in _met(key.view(np.uint64) * np.uint64(width) + bucket.view(np.uint64), num, meta >> 16, meta & 0xFFFF, signs, least):
                yield from sums.add(*met)
        yield from sums.rest()

    both = near.in_packs(looked_up, ask, parts, _STEPS)
    for part in tables:
        both = both.unionByName(near.in_packs(part, hold, parts, _STEPS))
    return packs.totals(packs.sent(both, parts).mapInArrow(walk, packs.DDL), parts, most, either=True)


def _met(key: np.ndarray, num: np.ndarray, runs: np.ndarray, units: np.ndarray, signs: list[np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text looked up, other text, units) of every chunk that both have, if they may be alike by size and parities; entries of the table have no units."""
    asked, order = np.flatnonzero(units > 0), np.flatnonzero(units == 0)
    asked = asked[np.argsort(key[asked])]
    bits = int(runs.max()).bit_length() if len(runs) else 0
    one = not len(key) or int(key.max()) >> (64 - bits) == 0  # one word sorts faster than two columns
    order = order[np.argsort((key[order] << np.uint64(bits)) | runs[order].astype(np.uint64)) if one else np.lexsort((runs[order], key[order]))]
    ordered = key[order]
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, dtype=np.int64)
    listed = ordered[start]
    at = np.searchsorted(listed, key[asked])
    found = np.flatnonzero(at < len(listed))
    found = found[listed[at[found]] == key[asked[found]]]
    asked, at = asked[found], at[found]
    # the entries of a list by size
    within = np.repeat(np.arange(len(listed)), np.diff(np.r_[start, len(order)])) << 32 | runs[order]
    low, high = np.ceil(least * runs[asked] - 1e-6).astype(np.int64), (runs[asked] / least + 1e-6).astype(np.int64)
    begin, end = np.searchsorted(within, at << 32 | low), np.searchsorted(within, at << 32 | high, side="right")
    count = np.maximum(0, end - begin)
    upto = np.cumsum(count)
    first = 0
    for stop in [min(int(c) + 1, len(asked)) for c in np.searchsorted(upto, np.arange(near.AT_ONCE, int(upto[-1]) + near.AT_ONCE, near.AT_ONCE))] if len(upto) else []:
        n = count[first:stop]
        x = np.repeat(asked[first:stop], n)
        y = order[np.repeat(begin[first:stop], n) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)]
        first = stop
        total = runs[x] + runs[y]
        differ = sum(np.bitwise_count((s[x] ^ s[y]).view(np.uint64)).astype(np.int64) for s in signs)  # of signed numbers, the absolute value's bits
        kept = np.flatnonzero((total - differ >= 2 * np.ceil(least / (1 + least) * total - 1e-9)) & (num[x] != num[y]))
        x, y = x[kept], y[kept]
        kept = np.minimum(runs[x], runs[y]) >= least * np.maximum(runs[x], runs[y]) - 1e-9
        yield num[x][kept], num[y][kept], units[x][kept]


def settled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(accepted_id, id) of the rows that repeat an accepted one.

    ``rows``: (id, node, site, old): incoming rows, ``old`` the smallest id of the history they repeat; ``links`` (a, b): different texts that
    are alike.  A row of the history settles a row at once; of the others, a row waits while a smaller row that it
    repeats waits.  Each round works on groups (equal text, equal url), never on pairs within a group; null texts and urls are in none.
    """
    own = [rows.where(F.col(c).isNotNull()).select("id", F.lit(i).alias("kind"), F.col(c).alias("g")) for i, c in enumerate(("node", "site"))]
    member = stored(own[0].unionByName(own[1]))
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = own[0].join(ways, F.col("g") == F.col("a")).select("id", "kind", F.col("b").alias("g"))
    seen = stored(member.unionByName(linked))
    decided = stored(rows.select("id", "old", F.when(F.col("old").isNotNull(), F.lit("case")).otherwise(F.lit("open")).alias("state")))

    def smallest(*states: str) -> DataFrame:
        """(id, <state>...): the smallest row of each state among those that a row's groups hold."""
        live = decided.where("state != 'case'")
        groups = member.join(live, "id").groupBy("kind", "g").agg(*(F.min(F.when(F.col("state") == s, F.col("id"))).alias(s) for s in states))
        return seen.join(groups, ["kind", "g"]).groupBy("id").agg(*(F.min(s).alias(s) for s in states))

    while not decided.where("state = 'open'").isEmpty():
        view = smallest("accepted", "open")
        first, wait = F.col("accepted") < F.col("id"), F.col("open") < F.col("id")
        state = F.when(F.col("state") != "open", F.col("state")).when(first, "case").when(wait, "open").otherwise("accepted")
        decided = stored(decided.join(view, "id", "left").select("id", "old", state.alias("state")))
    # the smallest accepted row counts, also for rows that repeat the history
    ended = decided.where("state = 'case'").join(smallest("accepted"), "id", "left")
    return ended.select(F.least("old", F.when(F.col("accepted") < F.col("id"), F.col("accepted"))).alias("accepted_id"), "id")

"""Problem 8: items of varying size in containers of fixed capacity, with little space left.

Best-two-fit: a container is filled greedily, largest item first; then its smallest item is replaced by the
two unpacked items that together fit its expanded gap more tightly.  Items are dealt by hash into cells that
are packed on their own, so that no task holds more than a bounded number of items; what a cell loses is less
than a container.  Only items above the capacity are cut: into full containers and a rest that is packed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a cell, on average; kinds of containers at once, more are refused.
CELL, MOST_KINDS = 8_192, 1_000


class Stock:
    """How many unpacked items there are of each size up to the capacity."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.count = np.bincount(sizes, minlength=capacity + 1)
        self.some = np.flatnonzero(self.count)

    def largest(self, most: int) -> int:
        """The largest size of at most ``most``; 0 if there is none."""
        i = int(np.searchsorted(self.some, most, "right"))
        return int(self.some[i - 1]) if i else 0

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.some = np.delete(self.some, np.searchsorted(self.some, size))

    def put(self, size: int) -> None:
        if not self.count[size]:
            self.some = np.insert(self.some, np.searchsorted(self.some, size), size)
        self.count[size] += 1

    def best_two(self, room: int, above: int) -> tuple[int, int] | None:
        """Two items that together take more than ``above`` and at most ``room``, as much as possible."""
        first = self.some[: np.searchsorted(self.some, room)]
        if not len(first):
            return None
        at = np.searchsorted(self.some, np.minimum(first, room - first), "right") - 1
        fits = at >= 0
        second = np.where(fits, self.some[np.maximum(at, 0)], 0)
        # an item can't be used twice: where only one is left of a size, take the next smaller one
        twice = fits & (second == first) & (self.count[first] < 2)
        second = np.where(twice, np.where(at > 0, self.some[np.maximum(at - 1, 0)], 0), second)
        total = np.where(second > 0, first + second, 0)
        best = int(np.argmax(total))
        return (int(first[best]), int(second[best])) if total[best] > above else None


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Sizes (1 to capacity) by container."""
    stock, containers = Stock(sizes, capacity), []
    while len(stock.some):
        packed, room = [], capacity
        while room and (size := stock.largest(room)):
            stock.take(size)
            packed.append(size)
            room -= size
        if room and len(packed) and len(stock.some):
            least = packed[-1]
            if pair := stock.best_two(room + least, least):
                packed.pop()
                for size in pair:
                    stock.take(size)
                    packed.append(size)
                stock.put(least)
        containers.append(packed)
    return containers


_OUT = "container_kind string, container_id string, item long, piece_no int, first_token long, n_tokens long"


def _pack(kind: str, cell: int, capacity: int, items: np.ndarray, tokens: np.ndarray) -> Iterator[tuple]:
    order = np.lexsort((items, tokens))
    items, tokens = items[order], tokens[order]
    for n in np.flatnonzero(tokens > capacity):
        for k in range(int(tokens[n]) // capacity):
            yield kind, f"{kind}-{cell}-{items[n]}-{k}", int(items[n]), k, k * capacity, capacity
    rest = np.where(tokens > capacity, tokens % capacity, tokens)
    waiting: dict[int, list[int]] = {}
    for n in np.flatnonzero(rest > 0)[::-1]:
        waiting.setdefault(int(rest[n]), []).append(int(n))
    for i, packed in enumerate(best_two_fit(rest[rest > 0], capacity)):
        for size in packed:
            n = waiting[size].pop()
            full = int(tokens[n]) // capacity if tokens[n] > capacity else 0
            yield kind, f"{kind}-{cell}-{i}", int(items[n]), full, full * capacity, size


def packed(sizes: DataFrame, item: str, tokens: str, containers: DataFrame, cell: int = CELL) -> DataFrame:
    """(container_kind, container_id, <item>, piece_no, first_token, n_tokens): a row for each piece of each item.

    ``sizes`` has a row per item, ``containers`` (container_kind, capacity_tokens) a row per kind; each kind holds all
    items once.  Items of size null or 0 need no space and come out with container null.  Rows with a null item id,
    and kinds with a null or non-positive capacity, are ignored.
    """
    wanted = containers.where("capacity_tokens > 0 and container_kind is not null").select("container_kind", "capacity_tokens").distinct()
    kinds = [(r["container_kind"], int(r["capacity_tokens"])) for r in wanted.limit(MOST_KINDS + 1).collect()]
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    rows = sizes.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long")).alias("tokens"))
    n_cells = max(1, -(-rows.count() // cell))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).alias("capacity")) for k, c in kinds))) if kinds else None
    if each is None:
        return rows.sparkSession.createDataFrame([], _OUT).withColumnRenamed("item", item)
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("item"), F.lit(n_cells)).cast("int"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        made = list(_pack(part["kind"].iloc[0], int(part["cell"].iloc[0]), int(part["capacity"].iloc[0]), part["item"].to_numpy(), part["tokens"].to_numpy()))
        return pd.DataFrame(made, columns=["container_kind", "container_id", "item", "piece_no", "first_token", "n_tokens"])

    full = dealt.where("tokens > 0").select("item", "tokens", "cell", each.alias("k")).select("item", "tokens", "cell", "k.kind", "k.capacity")
    made = full.groupBy("kind", "cell").applyInPandas(pack, _OUT)
    none = dealt.where("tokens <= 0").select("item", each.alias("k"))
    empty = none.select(F.col("k.kind").alias("container_kind"), F.lit(None).cast("string").alias("container_id"), "item", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens"))
    return made.unionByName(empty).withColumnRenamed("item", item)


def fill_rates(assignment: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, n_containers, n_tokens, fill_rate): how full the containers of each kind are."""
    used = assignment.where("container_id is not null").groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n"))
    total = used.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    return total.join(containers.select("container_kind", "capacity_tokens"), "container_kind").select("container_kind", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill_rate"))

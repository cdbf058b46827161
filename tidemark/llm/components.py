"""Problem 5: one identifier for all records that pairwise matches link, directly or indirectly.

Randomised contraction: in each round every vertex hooks to the vertex of its closed neighbourhood that
comes first in a fresh hash order; edges are relabelled and made distinct, until none is left.  The
expected number of vertices with edges falls by a constant factor in each round whatever the shape of the
graph, so long chains take no more rounds than stars.  The rounds' mappings are then expanded backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import HOT, lookup
from tidemark.scratch import stored


def _hooks(edges: DataFrame, seed: int) -> DataFrame:
    """(v, r, n): each vertex, the first of its closed neighbourhood in the order of this seed, its edges."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    order = F.struct(F.xxhash64(F.lit(seed), F.col("w")), F.col("w").alias("w"))
    best = both.groupBy("v").agg(F.min(order).alias("m"), F.count("*").alias("n"))
    own = F.struct(F.xxhash64(F.lit(seed), F.col("v")), F.col("v").alias("w"))
    return best.select("v", F.least(own, F.col("m"))["w"].alias("r"), "n")


def components(pairs: DataFrame, left: str, right: str, seed: int = 1) -> DataFrame:
    """(component, vertex): every vertex of at least one pair of two different vertices.

    ``component`` is the smallest vertex of its group.  Pairs with a null and pairs of a vertex with
    itself link nothing; repeated pairs, in either order, count once.
    """
    a, b = F.col(left), F.col(right)
    edges = stored(pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    rounds: list[DataFrame] = []
    while total := edges.count():
        hooks = stored(_hooks(edges, seed + len(rounds)))
        rounds.append(hooks)
        mapping = hooks.select(F.col("v").alias("key"), F.col("r").alias("value"))
        hot = {x["v"]: x["r"] for x in hooks.where(F.col("n") > max(1, 2 * total // HOT)).collect()}  # at most HOT vertices
        moved = lookup(lookup(edges, "a", mapping, "ra", hot), "b", mapping, "rb", hot)
        ra, rb = F.col("ra"), F.col("rb")
        edges = stored(moved.where(ra != rb).select(F.least(ra, rb).alias("a"), F.greatest(ra, rb).alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("component"), F.col("b").alias("vertex"))
    found = rounds[-1].select("v", "r")
    for hooks in reversed(rounds[:-1]):
        moved = lookup(hooks.select("v", "r"), "r", found.select(F.col("v").alias("key"), F.col("r").alias("value")), "to", _hot_values(hooks, found))
        found = stored(moved.select("v", F.coalesce("to", "r").alias("r")))
    names = stored(found.groupBy("r").agg(F.min("v").alias("component"), F.count("*").alias("n")))
    hot = {x["r"]: x["component"] for x in names.where(F.col("n") > max(1, found.count() // HOT)).collect()}
    named = lookup(found, "r", names.select(F.col("r").alias("key"), F.col("component").alias("value")), "component", hot)
    return named.select("component", F.col("v").alias("vertex"))


def _hot_values(hooks: DataFrame, found: DataFrame) -> dict:
    """What ``found`` has for the vertices that many others hook to; at most HOT."""
    sizes = hooks.groupBy("r").agg(F.count("*").alias("n"))
    hot = [x["r"] for x in sizes.where(F.col("n") > max(1, hooks.count() // HOT)).collect()]
    return {x["v"]: x["r"] for x in found.where(F.col("v").isin(hot)).collect()} if hot else {}

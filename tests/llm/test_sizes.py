import itertools
import random

import numpy as np
import pytest

from tests.conftest import DATA
from tidemark.llm import mixing, packing, queries, tokens


@pytest.mark.parametrize("seed", range(8))
def test_best_two_fit(seed):
    rng = np.random.default_rng(seed)
    sizes, capacity = rng.integers(1, 101, 400), 100
    packed = packing.best_two_fit(sizes, capacity)
    assert sorted(itertools.chain(*packed)) == sorted(sizes) and all(0 < sum(p) <= capacity for p in packed)
    assert len(packed) <= 1.05 * sizes.sum() / capacity + 2
    assert packing.best_two_fit(np.array([], dtype=int), 10) == []


def test_packing(spark):
    sizes = spark.createDataFrame([(i, random.Random(i).randrange(0, 900)) for i in range(500)] + [(900, 5000), (901, None), (None, 7), (902, 1000)], "doc_id long, n_tokens long").selectExpr("*", "1 as cell", "'x' as kind")
    kinds = spark.createDataFrame([("a", 1000), ("b", 300), ("c", 0), (None, None)], "container_kind string, capacity_tokens int")
    out = packing.packed(sizes, "doc_id", "n_tokens", kinds, cell=100).toPandas()
    total = sizes.where("doc_id is not null").toPandas().n_tokens.sum()
    for kind, capacity in (("a", 1000), ("b", 300)):
        mine = out[out.container_kind == kind]
        assert mine.n_tokens.sum() == total and mine.doc_id.nunique() == 503
        assert (mine.dropna().groupby("container_id").n_tokens.sum() <= capacity).all()
        pieces = mine.groupby("doc_id").n_tokens.agg(["count", "sum"])
        assert (pieces["count"] == np.maximum(1, -(-pieces["sum"] // capacity))).all()  # cut only where it must be
    assert set(out.container_kind) == {"a", "b"}
    assert packing.packed(sizes.limit(0), "doc_id", "n_tokens", kinds).count() == 0


def test_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        j = np.arange(n)
        assert sorted(mixing.permuted(j, np.full(n, n), np.full(n, 5))) == list(j)
    j = np.arange(1000)
    assert (mixing.permuted(j, np.full(1000, 1000), np.full(1000, 1)) != mixing.permuted(j, np.full(1000, 1000), np.full(1000, 2))).any()


def test_mixing(spark):
    rows = [(i, "big", 300) for i in range(400)] + [(1000 + i, "small", 100) for i in range(10)] + [(2000, "other", 50), (2001, None, 9), (2002, "big", 0), (None, "big", 9)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").selectExpr("*", "1 as share", "2 as block_no")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 2), (None, 0.3, 1)], "doc_source string, target_share double, max_repeats int")
    mixed = mixing.mix(sizes, targets, total_tokens=60_000)
    df = mixed.toPandas()
    assert df.groupby("source").repeat_no.max().to_dict() == {"big": 1, "small": 3}
    assert not df.duplicated(["doc_id", "first_token", "repeat_no"]).any()
    assert df[df.source == "small"].n_tokens.sum() == 3000  # all it may give
    assert 0.4 * 60_000 < df[df.source == "big"].n_tokens.sum() < 0.6 * 60_000
    report = {r["source"]: r for r in mixing.shares(mixed, targets).collect()}
    assert report["gone"]["n_tokens"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    assert mixing.mix(sizes, targets, total_tokens=60_000).exceptAll(mixed).count() == 0  # the same again
    assert mixing.mix(sizes.limit(0), targets).count() == 0 and mixing.mix(sizes, targets.limit(0)).count() == 0


def test_token_count(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("水道局 " * 5000,)], "text string")
    got = [r[0] for r in df.select(tokens.token_count(df["text"])).collect()]
    encoding = tokens.encoding(tokens.PATH)
    assert got[0] == len(encoding.encode_ordinary("hello world")) and got[1:3] == [0, 0] and got[3] > 5000
    assert encoding.decode(encoding.encode_ordinary("Über 水道 🚒")) == "Über 水道 🚒"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions.answers import answer_object
from tidemark.functions.unicode import headline, normalized
from tidemark.operators import state
from tidemark.operators.reprints import reprints


def test_upsert(spark):
    day = datetime(2026, 1, 1)
    schema = "k string, m string, at timestamp"
    first = state.fresh(spark.createDataFrame([("a", "1", day), ("b", "1", day), (None, "1", day), ("a", "0", day - timedelta(1))], schema), "k", "m", "at")
    second = state.fresh(spark.createDataFrame([("a", "2", day + timedelta(2)), ("b", "1", day + timedelta(3)), ("c", None, day)], schema), "k", "m", "at")
    got = {r["k"]: r for r in state.upsert(first, second, "k").collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["is_changed"] and got["a"]["first_seen_at"] == day + timedelta(2) and [h["mark"] for h in got["a"]["history"]] == ["1"]
    assert not got["b"]["is_changed"] and got["b"]["first_seen_at"] == day and got["b"]["last_seen_at"] == day + timedelta(3)
    again = state.upsert(first, second, "k").drop("is_changed")
    assert {r["k"]: r["is_changed"] for r in state.upsert(again, second, "k").collect()} == {"a": False, "b": False, "c": False}
    assert state.upsert(first.limit(0), first.limit(0), "k").count() == 0


def brute_reprints(rows):
    kept, out, urls = [], {}, {}
    for i, url, head, feed, at, body, rank in sorted(rows, key=lambda r: (r[6], r[0])):
        if url is not None and url in urls:
            out[i] = (urls[url], "same_url")
            continue
        if url is not None:
            urls[url] = i
        found = None
        if head is not None and len(head) >= 28 and at is not None:
            for k, h, f, t, b, r in kept:
                if h == head and abs(at - t) <= 86_400_000_000 and b == body and (f == feed or r < rank):
                    found = (k, "same_feed" if f == feed else "original_available")
                    break
            if found is None:
                kept.append((i, head, feed, at, body, rank))
        out[i] = found or (i, None)
    return out


def test_reprints(spark):
    rng = random.Random(4)
    heads = ["見出し" * 12, "題" * 28, "短い", None]
    rows = [(i, rng.choice([None, *(f"u{k}" for k in range(120))]), rng.choice(heads), rng.choice("abc"), rng.choice([None, rng.randrange(10**12)]), rng.choice(["", "", "本文"]), rng.randrange(2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, url string, headline string, feed string, at long, body string, rank int")
    assert {r["id"]: (r["representative"], r["reason"]) for r in reprints(df).collect()} == brute_reprints(rows)
    assert reprints(df.limit(0)).count() == 0


def test_text(spark):
    df = spark.createDataFrame([("ＡＢ Straße - Ｎews", "News"), (None, None), ("x", "")], "t string, f string")
    assert [r[0] for r in df.select(headline(F.col("t"), F.col("f"))).collect()] == ["abstrasse", "", "x"]
    assert [r[0] for r in df.select(normalized("t")).collect()] == ["ab strasse - news", None, "x"]
    texts = ['```json\n{"a": 1}\n```', '{"a": 1}', "[1]", "5", "{", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(answer_object(F.col("t")).isNotNull())
    assert [r[0] for r in got.collect()] == [True, True, False, False, False, False, False]

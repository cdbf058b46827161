import itertools
import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import dates, dedupe, keyed, pairs, scan
from tidemark.operators.skew import attach


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_attach_splits_hot_keys(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)] + [(1000, None)], "id int, k string")
    groups = facts.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    joined = attach(facts, groups, "k", "n", 901)
    assert joined.count() == 900 and joined.where("k = 'hot'").select("first").distinct().collect()[0][0] == 1
    assert attach(facts, groups, "k", "n", 901, "left").count() == 901


def test_keywords_and_urls(spark):
    df = spark.createDataFrame([("札幌 AB事故ニュースカタカナ事故", "https://u@A.test:8/x"), (None, None), ("", "ftp://a"), ("ー", "http:///x")], "t string, u string")
    got = df.select(X.keywords(F.col("t")), X.safe_url(F.col("u")), X.host(F.col("u"))).collect()
    assert list(got[0]) == [["AB", "事故", "ニュースカタカナ"], True, "a.test"] or list(got[0]) == [["AB", "事故", "ニュ", "スカタカナ"], True, "a.test"]
    assert [list(r) for r in got[1:]] == [[[], False, ""]] * 3


def brute_pairs(titles, words):
    return {(a, b): len(words[a] & words[b]) for a, b in itertools.combinations(sorted(titles), 2) if words[a] & words[b]}


def test_shared_keywords(spark, table):
    articles = table("incoming_articles")
    words = {r[0]: set(r[1]) for r in articles.select("article_id", X.keywords(F.col("title"))).collect()}
    got = {(r["a"], r["b"]): r["n_words"] for r in pairs.shared_keywords(articles, "article_id", "title").collect()}
    assert got == brute_pairs(words, words)
    assert pairs.shared_keywords(articles.limit(0), "article_id", "title").count() == 0


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 4), (3, None, 3), (4, None, 2), (1, "a", 5)], "id int, k string, v int")
    assert rows(keyed.keep_first(df, ["k"], ["id"]).select("id", F.coalesce("k", F.lit("-")), "v")) == [(1, "a", 5), (3, "-", 3)]
    assert rows(keyed.keep_last_at_first(df, ["k"], ["id"]).select("id", F.coalesce("k", F.lit("-")), "v", "first_position")) == [(2, "a", 4, 1), (4, "-", 2, 3)]
    assert keyed.keep_first(df.limit(0), ["k"], ["id"]).count() == 0


def test_append_absent(spark):
    old = spark.createDataFrame([("a", None), ("b", "x")], "k string, m string")
    new = spark.createDataFrame([("a", None), ("b", None), ("b", None), ("b", "x"), ("c", "y")], "k string, m string")
    assert sorted(map(str, rows(keyed.append_absent(old, new, ["k", "m"]).select(F.coalesce("k", F.lit("")), F.coalesce("m", F.lit("")))))) == ["('b', '')", "('c', 'y')"]


def test_admission(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(20)], "pos int, needs boolean")
    got = keyed.admitted(df, F.col("needs"), ["pos"], 3)
    assert rows(got.where("not is_admitted").select("pos")) == [(i,) for i in range(6, 20, 2)]
    assert keyed.admitted(df.where("not needs"), F.col("needs"), ["pos"], 3).where("is_admitted").count() == 10


def test_fair_order(spark):
    random.seed(3)
    items = [(i, random.random(), random.random()) for i in range(200)]
    left, want = sorted(items, key=lambda r: r[1]), []
    while len(want) < 50:
        pick = min(left, key=lambda r: r[2]) if len(want) % 4 == 3 else left[0]
        left.remove(pick)
        want.append(pick[0])
    got = keyed.fair_order(spark.createDataFrame(items, "id int, cost double, age double"), ["cost"], ["age"], 50)
    assert [r["id"] for r in got.orderBy("slot").collect()] == want


def test_bands_and_representatives(spark):
    random.seed(5)
    start = datetime(2026, 1, 1)
    items = [(i, random.choice("ab"), start + timedelta(minutes=random.randrange(3000))) for i in range(300)] + [(999, None, start)]
    df = spark.createDataFrame(items, "id int, k string, at timestamp")
    earlier = {r["id"]: r["n_earlier"] for r in scan.earlier_in_band(df, ["k"], "at", 3600).collect()}
    for i, k, t in items[:60]:
        assert earlier[i] == sum(k == k2 and timedelta(0) <= t - t2 <= timedelta(hours=1) for _, k2, t2 in items) - 1
    head, want = {}, {}
    for i, k, t in sorted(items, key=lambda r: (str(r[1]), r[2], r[0])):
        if k not in head or (t - head[k][1]) > timedelta(hours=1):
            head[k] = (i, t)
        want[i] = head[k][0]
    assert dict(rows(dedupe.representatives(df, ["k"], "at", "id", 3600))) == want


def test_running_max(spark):
    rng = random.Random(8)
    items = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, rng.randrange(1000)])) for i in range(500)]
    best, want = {}, {}
    for i, k, v in items:
        before = best.get(k)
        best[k] = max((x for x in (before, v) if x is not None), default=None)
        want[i] = (before, best[k])
    df = spark.createDataFrame(items, "id int, k string, v int")
    assert {r["id"]: (r["b"], r["u"]) for r in scan.running_max(df, ["k"], "id", "v", "b", "u", rows_per_bucket=40).collect()} == want
    assert scan.running_max(df.limit(0), ["k"], "id", "v", "b", "u").count() == 0


def brute_blocks(edges):
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {v: top(v) for v in list(up)}


def test_linked_blocks(spark):
    random.seed(7)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (5, None)]
    assert dict(rows(dedupe.linked_blocks(spark.createDataFrame(edges, "a int, b int")))) == brute_blocks(edges)


def test_complete_linkage(spark):
    # a-b and b-c alone must not join a and c; a full triangle joins
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("x", "y", 3), ("y", "z", 4), ("x", "z", 5)], "a string, b string, n int")
    got = defaultdict(set)
    for v, c in rows(dedupe.complete_linkage(edges, "n")):
        got[c].add(v)
    assert dict(got) == {"a": {"a", "b"}, "c": {"c"}, "x": {"x", "y", "z"}}


def test_schedule_bounds(spark):
    cases = {
        "2026年10月8日": (date(2026, 10, 8), date(2026, 10, 8), "day"), "2026年11月": (date(2026, 11, 1), date(2026, 11, 30), "month"), "２０２７年": (date(2027, 1, 1), date(2027, 12, 31), "year"),
        "2031年度": (date(2031, 4, 1), date(2032, 3, 31), "fiscal_year"), "2026年13月": (None, None, "unknown"), "2026年春": (None, None, "unknown"), "11月": (None, None, "unknown"), None: (None, None, "unknown"), "2026年11月上旬": (date(2026, 11, 1), date(2026, 11, 30), "month"), "来年度、2026年4月1日": (None, None, "unknown"), "2026年上旬": (None, None, "unknown"), "11月、2027年": (None, None, "unknown"), "2026年2月30日": (None, None, "unknown"), "2026-02-30": (None, None, "unknown"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", dates.schedule_bounds(F.col("t")).alias("b"))
    assert {r["t"]: tuple(r["b"]) for r in df.collect()} == cases


def brute_best(words, per_document=3, at_most=150):
    weight = lambda w: 3 if len(w) >= 5 else 2 if len(w) == 4 else 1
    scored = {(a, b): sum(map(weight, words[a] & words[b])) for a, b in itertools.combinations(sorted(words), 2) if words[a] & words[b]}
    order = sorted(scored, key=lambda p: (-scored[p], p))
    seen, kept = dict.fromkeys(words, 0), []
    for a, b in order:
        if min(seen[a], seen[b]) < per_document:
            kept.append((a, b, scored[a, b]))
        seen[a] += 1
        seen[b] += 1
    return kept[:at_most]


@pytest.mark.parametrize(("n", "vocabulary", "most"), [(600, 90, 9), (500, 8, 4), (300, 5000, 12), (400, 3, 1), (7, 4, 3)])
def test_best_shared_and_partner_counts(spark, n, vocabulary, most):
    rng = random.Random(n)
    pool = ["abcdefg"[: 2 + i % 6] + str(i) for i in range(vocabulary)]
    picked = [sorted({pool[int(vocabulary * rng.random() ** 2)] for _ in range(rng.randint(0, most))}) for _ in range(n)]
    picked[n // 2 :] = [picked[rng.randrange(n // 2)] if rng.random() < 0.3 else p for p in picked[n // 2 :]]
    ids = rng.sample(range(-n, 9 * n), n)
    df = spark.createDataFrame([*((i, " ".join(p)) for i, p in zip(ids, picked, strict=True)), (None, "abc abcd"), (10 * n, None)], "id long, title string")
    words = {i: set(p) for i, p in zip(ids, picked, strict=True)}
    assert [tuple(r) for r in pairs.best_shared(df, "id", "title").collect()] == brute_best(words)
    partners = {i: sum(len(w & v) >= 2 for j, v in words.items() if j != i) for i, w in words.items()}
    assert dict(rows(pairs.partner_counts(df, "id", "title"))) == {i: c for i, c in partners.items() if c}


def test_partner_counts_with_fewer_bits(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MASKS", 40)
    titles = {i: {f"w{i % 7}", f"v{i % 5}", f"u{i % 30}", f"t{i // 2}"} for i in range(400)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in titles.items()], "id long, title string")
    partners = {i: sum(len(w & v) >= 2 for j, v in titles.items() if j != i) for i, w in titles.items()}
    assert dict(rows(pairs.partner_counts(df, "id", "title"))) == {i: c for i, c in partners.items() if c}


def test_words_in_all_titles_list_no_pairs(spark):
    df = spark.range(40_000).select("id", F.concat(F.lit("alpha beta x"), "id").alias("title"))  # 800 million pairs
    assert pairs.partner_counts(df, "id", "title").agg(F.count("*"), F.min("n_partners"), F.max("n_partners")).collect()[0][:] == (40_000, 39_999, 39_999)

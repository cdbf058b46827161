import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tests.test_operators import brute_blocks
from tidemark.llm import components, formatting, near, plain, store, survivor
from tidemark.llm import shingles as S

WORDS = [a + b for a in "水道再開発路線議会公園補修" for b in "市区町村駅橋港館局会"]


def sentence(rng, n=40):
    return "".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(WORDS) + text[i + rng.randrange(3) :]
    return text


def runs(text):
    text = plain.plain(text or "") or ""
    return {text[i : i + 3] for i in range(len(text) - 2)} or ({text} if text else set())


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [sentence(rng) for _ in range(n)]
    texts = base + [edited(rng, rng.choice(base), rng.randrange(1, 5)) for _ in range(n)] + [rng.choice(base) for _ in range(20)]
    return texts + ["", None, "短い", "短い", "三文字", "x" * 60_000, "x" * 60_000 + "y"]


def test_near_pairs(spark):
    texts = corpus(11)
    hot = sentence(random.Random(1))
    texts += [hot] * 40 + [edited(random.Random(k), hot, 1) for k in range(40)]  # a third of all rows
    sets = [runs(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if similar(sets[i], sets[j]) >= 0.7}
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "id long, t string, node string")
    got = {tuple(r) for r in near.near_pairs(df, "id", "t").collect()}
    assert got == want
    groups = {r["id"]: r for r in near.near_groups(df, "id", "t").collect()}
    blocks = brute_blocks(want)
    assert {i: r["group_id"] for i, r in groups.items()} == {i: blocks.get(i, i) for i in range(len(texts)) if sets[i]}
    assert groups[texts.index("短い")]["n_copies"] == 2
    assert near.near_pairs(df.limit(0), "id", "t").count() == 0


def test_similarity():
    left, right = corpus(3)[:40], corpus(4)[:40]
    left = [t or "" for t in left]
    right = [(t or "")[:30] + left[i][10:] for i, t in enumerate(right)]
    assert all(abs(x - similar(runs(a), runs(b))) < 1e-9 for x, a, b in zip(S.similarity(left, right), left, right, strict=True))


def test_components(spark):
    rng = random.Random(5)
    edges = [(str(rng.randrange(400)), str(rng.randrange(400))) for _ in range(330)]
    edges += [(f"c{i:04}", f"c{i + 1:04}") for i in range(300)] + [("hub", f"h{i}") for i in range(400)] + [("q", "q"), (None, "w"), ("w", None), ("1", "2"), ("2", "1")]
    df = spark.createDataFrame(edges, "a string, b string")
    assert {r["vertex"]: r["component"] for r in components.components(df, "a", "b").collect()} == brute_blocks(edges)
    assert components.components(df.limit(0), "a", "b").count() == 0


def test_formatting(spark, monkeypatch):
    make = lambda t, u: '{"title": "%s", "x": {"title": "no"}, "url": "%s"}' % (t, u)
    rows = [
        (1, make("A b、C", "https://X.test/p?a=1&b=2")), (2, make("a B C!", "https://x.test/p/?b=2&a=1#")), (3, make("abc", "https://x.test/p?a=12&b=")), (4, make("ab", "https://x.test/p?a=1&b=2")),
        (5, '{"title": "A b'), (6, "5"), (7, None), (8, "{}"), (9, '{"url": "https://x.test/p?b=2&a=1", "title": "ABC"}'), (10, "{}"), (None, make("A b、C", "u")), (11, make("", "u")), (12, make("", "U ")),
    ] + [(100 + i, make("hot", "h")) for i in range(60)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "item_id long, payload string, key string")
    got = {tuple(r) for r in formatting.repeats(df).collect()}
    assert got == {(1, 2), (1, 9), (11, 12)} | {(100, 100 + i) for i in range(1, 60)}
    copies = {r["item_id"]: r["n_copies"] for r in formatting.collapse(df).collect()}
    assert sum(copies.values()) == len(rows) - 1 and copies[1] == 3 and copies[100] == 60 and copies[5] == 1
    assert formatting.repeats(df.limit(0)).count() == 0
    monkeypatch.setattr(formatting, "MOST_BITS", formatting.SEGMENT)
    monkeypatch.setattr(formatting, "BITS_PER_KEY", 1 << 16)  # many more keys than one filter is for
    assert formatting.filter_bits(len(rows))[1] > 1
    assert {tuple(r) for r in formatting.repeats(df).collect()} == got
    assert {r["item_id"]: r["n_copies"] for r in formatting.collapse(df).collect()} == copies


def brute_history(accepted, incoming, url_of, text_of):
    seen, out = list(accepted), set()
    for r in sorted(incoming):
        same = [s[0] for s in seen if (url_of(r) is not None and url_of(r) == url_of(s)) or similar(text_of(r), text_of(s)) >= 0.7]
        if same:
            out.add((min(same), r[0]))
        else:
            seen.append(r)
    return out


def test_history(spark):
    rng = random.Random(9)
    texts = corpus(21)
    rows = [(i, rng.choice([None, f"https://a.test/{rng.randrange(150)}?x=1&y=2", f"HTTPS://a.test/{rng.randrange(150)}?y=2&x=1."]), t, None) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    old, new = rows[:60], rows[60:]
    sets = {r[0]: runs(r[2]) for r in rows}
    url = lambda r: None if r[1] is None else r[1].lower().rstrip(".").split("?")[0]
    schema = "id long, url string, t string, node string"
    got = {tuple(r) for r in store.repeated(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "id", "url", ("t",)).collect()}
    assert got == brute_history(old, new, url, lambda r: sets[r[0]])
    none = spark.createDataFrame([], schema)
    assert store.repeated(none, none, "id", "url", ("t",)).count() == 0
    assert store.repeated(spark.createDataFrame(old, schema), none, "id", "url", ("t",)).count() == 0


def copies(seed, base, n, most):
    """``n`` texts with up to ``most`` different edits each of ``base``."""
    rng, letters = random.Random(seed), [chr(x) for x in range(0x4E00, 0x5E00)]
    out = []
    for _ in range(n):
        text = base
        for _ in range(rng.randrange(1, most + 1)):
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice([rng.choice(letters), rng.choice(letters) + text[i], ""]) + text[i + 1 :]
        out.append(text)
    return out


def test_history_hot_group(spark):
    letters = [chr(x) for x in range(0x4E00, 0x5E00)]
    sentences = ["".join(random.Random(k).choices(letters, k=n)) for k, n in ((1, 40), (2, 110), (3, 230))]
    texts = corpus(41, 80) + [t for k, s in enumerate(sentences) for t in copies(k, s, 40, len(s) // 14)]  # over a third of all rows
    rows = [(i, None, t) for i, t in enumerate(texts)]
    random.Random(6).shuffle(rows)
    sets = {r[0]: runs(r[2]) for r in rows}
    old, new = rows[:90], rows[90:]
    schema = "id long, url string, t string"
    got = {tuple(r) for r in store.repeated(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "id", "url", ("t",)).collect()}
    assert got == brute_history(old, new, lambda r: r[1], lambda r: sets[r[0]])


def test_near_hot_group(spark):
    letters = [chr(x) for x in range(0x4E00, 0x5E00)]
    hot = "".join(random.Random(5).choices(letters, k=300))
    texts = ["".join(random.Random(k).choices(letters, k=40)) for k in range(300)] + copies(8, hot, 160, 22)  # a third of all rows
    sets = [runs(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(300, len(texts)), 2) if similar(sets[i], sets[j]) >= 0.7}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    assert {tuple(r) for r in near.near_pairs(df, "id", "t").collect()} == want
    groups = {r["id"]: r["group_id"] for r in near.near_groups(df, "id", "t").collect()}
    blocks = brute_blocks(want)
    assert groups == {i: blocks.get(i, i) for i in range(len(texts))}


def test_near_any_boundary(spark, monkeypatch):
    """Neither the size that divides small sets from large ones, nor blocks of lists, nor the counts change a pair."""
    rng = random.Random(17)
    texts = [t for t in corpus(19, 40) if t and len(t) < 1_000] + ["ab", "abc", "abcd", "aaaa", "aaaaa", "abab", "ababa", "x"]
    texts += copies(8, sentence(rng, 12), 60, 5) + copies(9, sentence(rng, 90), 60, 10)
    texts = sorted(set(texts))
    sets = [runs(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for least, small, block, size in ((0.7, 2, 8, 1 << 16), (0.7, 60, 1 << 15, 1 << 16), (0.7, 400, 8, 1 << 16), (0.5, 40, 16, 1 << 16), (0.8, 25, 1 << 15, 1)):
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "AT_ONCE", 97 if block == 8 else 1 << 21)
        counts = np.zeros(size, dtype="<u4")
        for t in texts:
            at, n = np.unique((S.grams([t]) & S.MASK) % np.uint64(size), return_counts=True)
            counts[at.astype(int)] += n.astype("<u4")
        nodes = np.array([S.content_key(t) for t in texts])
        key, of, meta = near.keys_of_texts(texts, nodes, S.ranks(counts), counts, least, small, block)
        keys = spark.createDataFrame([(int(k), int(o), int(m)) for k, o, m in zip(key.astype(np.int64), of, meta, strict=True)], "key long, node long, meta long")
        got = {tuple(sorted(r)) for r in near.together(keys, least, small).collect()}
        want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if similar(sets[i], sets[j]) >= least}
        assert want <= got, (least, small, block)
        assert near.class_links(df, "id", ("t",), least, small)[1].count() == len(want)


def brute_links(texts, queries, least=0.7):
    """(i, j) of the texts i of ``queries`` and all other different texts that share enough, by inverted lists of all runs."""
    lists, sizes = {}, np.array([len(runs(t)) for t in texts])
    sets = [runs(t) for t in texts]
    for i, s in enumerate(sets):
        for g in s:
            lists.setdefault(g, []).append(i)
    lists = {g: np.array(x) for g, x in lists.items()}
    out = set()
    for i in queries:
        both = np.bincount(np.concatenate([lists[g] for g in sets[i]]), minlength=len(texts))
        near_by = np.flatnonzero(both / np.maximum(1, sizes + sizes[i] - both) >= least)
        out |= {(min(i, j), max(i, j)) for j in near_by.tolist() if j != i}
    return out


def test_large_clusters(spark):
    """Clusters of copies with 3 to 10 edits each among others: every pair of a text whose number is divisible by 20."""
    rng, letters = random.Random(23), [chr(x) for x in range(0x4E00, 0x5E00)]
    texts = [sentence(rng, rng.randrange(20, 60)) for _ in range(2_000)]
    for n in (50, 400, 1_000):
        base = "".join(rng.choices(letters, k=250))
        for _ in range(n):
            text = base
            for _ in range(rng.randrange(3, 11)):
                i = rng.randrange(len(text))
                text = text[:i] + rng.choice([rng.choice(letters), rng.choice(letters) + text[i], ""]) + text[i + 1 :]
            texts.append(text)
    rng.shuffle(texts)
    want = brute_links(texts, range(0, len(texts), 20))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(8)
    pairs = near.near_pairs(df, "id", "t")
    got = {tuple(r) for r in pairs.where("id_a % 20 = 0 or id_b % 20 = 0").collect()}
    assert got == want and len(want) > 20_000
    old, new = df.where("id < 3000"), df.where("id >= 3000")
    repeats = {r["id"]: r["accepted_id"] for r in store.repeated(old.withColumn("u", F.lit(None).cast("string")), new.withColumn("u", F.lit(None).cast("string")), "id", "u", ("t",)).collect()}
    first = {}
    for i, j in sorted(brute_links(texts, range(3_000, len(texts)))):
        if i < 3_000 <= j:
            first.setdefault(j, i)
    assert {j: repeats.get(j) for j in first} == first


def test_store(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, rng.choice([None, f"https://a.test/{rng.randrange(120)}"]), t) for i, t in enumerate(rng.sample(corpus(31), 100))] + [(None, None, "x")]
    sets = {r[0]: runs(r[2]) for r in rows}
    kept = store.History(spark, str(tmp_path / "h"), "id", "url", ("t",))
    schema = "id long, url string, t string"
    got = set()
    for part in (rows[:40], rows[40:70], [], rows[70:]):
        got |= {tuple(r) for r in kept.accept(spark.createDataFrame(part, schema)).collect()}
    assert got == brute_history([], [r for r in rows if r[0] is not None], lambda r: r[1], lambda r: sets[r[0]])


def test_survivors(spark):
    from datetime import datetime, timedelta

    feeds = spark.createDataFrame([("a", 3), ("b", 9), (None, 20)], "feed_name string, trust int")
    at = datetime(2026, 1, 1)
    rows = [
        ("k", 1, at, "https://h.test", "Long title here", "a"), ("k", 2, at + timedelta(1), "https://", "Long title…", "b"), ("k", 3, at + timedelta(2), "ftp://h", "Other", None), ("k", 4, at + timedelta(3), "http://g/x", "Long title here..", "a"),
        ("m", 5, at, None, None, "a"), ("m", 6, at, "", "・・・", "b"), ("n", 7, at, "https://h.test", "One", "a"), (None, 8, at, "https://h.test", "One", "a"), ("s", 9, at, "https://x", "Ab", "b"), ("s", 10, at, "https://y", "Abc", "zz"),
    ]
    full = [(k, i, t, u, ti, "", "x" * 50_000, {"name": f, "url": "u"}, 1) for k, i, t, u, ti, f in rows]
    df = spark.createDataFrame(full, "article_key string, revision_id long, observed_at timestamp, url string, title string, published string, description string, rss_source struct<name: string, url: string>, _n int")
    got = {r["article_key"]: (r["url"] and r["url"]["record"], r["title"] and r["title"]["record"]) for r in survivor.golden(df, feeds, 2).collect()}
    assert got == {"k": (4, 4), "m": (None, None), "s": (9, 10)}
    assert survivor.golden(df.limit(0), feeds).count() == 0


def test_bundles_that_contradict(spark):
    """The best url and the best title come from feeds that don't go together: what is given up is decided by trust in all, as by trying everything."""
    from datetime import datetime, timedelta

    rng, at = random.Random(4), datetime(2026, 1, 1)
    hosts = {"a": "a.test", "b": "b.test", "c": None}
    trust = {"a": 3, "b": 5, "c": 4}
    rows = []
    for i in range(240):
        feed = rng.choice(["a", "b", "c", "zz", None])
        url = rng.choice([f"https://{rng.choice('abx')}.test/{i}", "bad", None])
        rows.append((f"k{i // 6}", i, at + timedelta(i * 37 % 240), url, rng.choice([f"Title {i} {'x' * i}", "", None]), {"name": feed, "url": "u"}))
    df = spark.createDataFrame([(*r[:5], "", "", r[5], "x") for r in rows], "article_key string, revision_id long, observed_at timestamp, url string, title string, published string, description string, rss_source struct<name: string, url: string>, site string")
    feeds = spark.createDataFrame([(f, trust[f], h) for f, h in hosts.items()], "feed_name string, trust int, host string")
    got = {r["article_key"]: tuple(r[b] and r[b]["record"] for b in ("url", "source", "title")) for r in survivor.bundled(df, feeds).collect()}
    contradicted = 0
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        usable = ([r for r in mine if (r[3] or "").startswith("http")], [r for r in mine if r[5]["name"]], [r for r in mine if r[4]])

        def fits(u, s, t):
            home = hosts.get(s[5]["name"]) if s else None
            return not (u and home and u[3].split("/")[2] != home) and not (s and t and t[5]["name"] and t[5]["name"] != s[5]["name"])

        def worth(choice):
            picked = [r for r in choice if r]
            return len(picked), sum(trust.get(r[5]["name"], -(1 << 31)) for r in picked), sum((r[2] - datetime(1970, 1, 1)).total_seconds() for r in picked)

        best = max((c for c in itertools.product(*([*u, None] for u in usable)) if fits(*c)), key=worth)
        assert worth([next((r for r in mine if r[1] == i), None) for i in got[key]]) == worth(best), key
        top = [max(u, key=lambda r: worth([r]), default=None) for u in usable]
        contradicted += not fits(*top)
    assert contradicted > 5
    assert survivor.bundled(df.limit(0), feeds).count() == 0


def test_golden_source_fits_url_and_title(spark):
    """Url and title are the best of their own, as by SQL; the source is the best of those that fit both, as by trying everything."""
    from datetime import datetime, timedelta

    rng, at = random.Random(6), datetime(2026, 1, 1)
    hosts, trust = {"a": "a.test", "b": "b.test", "c": None}, {"a": 3, "b": 5, "c": 5}
    rows = []
    for i in range(300):
        feed, url = rng.choice(["a", "b", "c", "zz", None]), rng.choice([f"https://{rng.choice('abx')}.test/{i}", "bad", None])
        rows.append((f"k{i // 6}", i, rng.choice([at + timedelta(i * 37 % 300), None]), url, rng.choice([f"Title {i} {'x' * i}", "", None]), "", "", {"name": feed, "url": "u"}))
    df = spark.createDataFrame(rows, "article_key string, revision_id long, observed_at timestamp, url string, title string, published string, description string, rss_source struct<name: string, url: string>")
    feeds = spark.createDataFrame([(f, trust[f], h) for f, h in hosts.items()], "feed_name string, trust int, host string")
    got = {r["article_key"]: tuple(r[b] and r[b]["record"] for b in ("url", "title", "source")) for r in survivor.golden(df, feeds).collect()}
    assert got == {r["article_key"]: tuple(r[b] and r[b]["record"] for b in ("url", "title", "source")) for r in survivor.golden(df, feeds, values=False).collect()}
    worth = lambda r: (trust.get(r[7]["name"], -(1 << 31)), r[2] or datetime(1970, 1, 1), r[1])
    contradicted = left_out = 0
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        url = max((r for r in mine if (r[3] or "").startswith("http")), key=worth, default=None)
        title = max((r for r in mine if r[4]), key=worth, default=None)
        named = [r for r in mine if r[7]["name"]]
        fits = [r for r in named if not (url and hosts.get(r[7]["name"]) not in (None, url[3].split("/")[2])) and not (title and title[7]["name"] not in (None, r[7]["name"]))]
        source = max(fits, key=worth, default=None)
        assert got[key] == tuple(r and r[1] for r in (url, title, source)), key
        contradicted += source != max(named, key=worth, default=None)
        left_out += bool(named) and source is None
    assert contradicted > left_out > 0


def test_branch_and_bound():
    rng = random.Random(2)
    for _ in range(60):
        lists = [sorted(({"trust": rng.randrange(4), "at": rng.randrange(9), "t": rng.randrange(3)} for _ in range(rng.randrange(4))), key=lambda c: (-c["trust"], -c["at"])) for _ in range(3)]

        def worth(choice, lists=lists):
            picked = [lists[i][j] for i, j in enumerate(choice) if j is not None]
            return (len(picked), sum(c["trust"] for c in picked), sum(c["at"] for c in picked)) if len({c["t"] for c in picked}) < 2 else (-1,)

        best = max(map(worth, itertools.product(*([*range(len(x)), None] for x in lists))))
        assert worth(survivor.choose(lists, [["t"]] * 3)) == best

import json
from datetime import datetime, timedelta

import pytest

from tidemark.sinks import versioned
from tidemark.sources import feeds
from tidemark.streaming import keyed

RSS = """<rss><channel><item><title>A &amp;amp; B</title><link>https://a.test/1</link><pubDate>Thu, 05 Mar 2026 12:04:05 GMT</pubDate>
<description>&lt;a href="x"&gt;t&lt;/a&gt;</description><source url="https://a.test">N</source></item><item><title>C</title></item></channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text(RSS)
    first, second = sorted(feeds.read_rss(spark, str(tmp_path / "f.xml")).collect(), key=lambda r: r["title"])
    assert (first["title"], first["url"], tuple(first["rss_source"])) == ("A & B", "https://a.test/1", ("N", "https://a.test"))
    assert (second["title"], second["url"], second["description"]) == ("C", "", "")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.xml").write_text(RSS)
    run = feeds.stream_rss(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("rss").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("rss").count() == 2


def test_documents_and_inbox(spark, tmp_path):
    assert feeds.read_documents(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "a.json").write_text(json.dumps([{"title": "t", "url": "u1"}, {"title": "s", "url": "u2"}]))
    (tmp_path / "bad.json").write_text('[{"title": ')
    old = feeds.read_documents(spark, str(tmp_path / "a.json"))
    new = old.limit(1).selectExpr("'new' as title", "url", "published", "description", "rss_source")
    merged = {r["url"]: r["title"] for r in feeds.inbox(old, new).collect()}
    assert sorted(merged.values()) in (["new", "s"], ["new", "t"])
    with pytest.raises(Exception):  # noqa: B017
        feeds.read_documents(spark, str(tmp_path / "bad.json"), strict=True).collect()


def test_versions(spark, tmp_path):
    table = str(tmp_path / "t")
    assert versioned.read(spark, table) is None
    versioned.publish(spark.range(3).coalesce(1), table)
    versioned.publish(versioned.read(spark, table).where("id > 0"), table)
    assert versioned.read(spark, table).count() == 2
    assert versioned.tidy(spark, table) == 1 and versioned.read(spark, table).count() == 2
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    assert versioned.append_new(rows, log, ["k"]).count() == 2
    assert versioned.append_new(rows, log, ["k"]).count() == 0


def test_streams(spark, tmp_path):
    schema = "url string, seen_at timestamp, fingerprint string"
    batches = [[("u", datetime(2026, 1, 2), "x"), ("v", datetime(2026, 1, 1), "y"), (None, datetime(2026, 1, 1), "z")], [("u", datetime(2026, 1, 1), "w")], [("u", datetime(2026, 1, 3), "y")]]
    seen = []
    run = keyed.observed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))).writeStream.outputMode("update")
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        run.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    last = [r for r in seen if r[0] == "u"][-1]
    assert last == ("u", datetime(2026, 1, 1), datetime(2026, 1, 3), "y", 2, True)


def test_windows(spark, tmp_path):
    day = datetime(2026, 1, 1)
    rows = [(f"u{i % 3}", day + timedelta(minutes=20 * i), "ab"[i % 2]) for i in range(12)]
    spark.createDataFrame(rows, "url string, at timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("url string, at timestamp, kind string").parquet(str(tmp_path / "in"))
    for name, df in (("win", keyed.counts_by_window(read(), "at", "kind", late="1 hour")), ("once", keyed.first_arrivals(read(), "url", "at"))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("once").count() == 3
    closed = {(r["window_start"], r["kind"]): r["n"] for r in spark.table("win").collect()}
    assert closed and all(closed[w, k] == sum(w <= at < w + timedelta(hours=1) and kind == k for _, at, kind in rows) for w, k in closed)

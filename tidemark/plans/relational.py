"""Joins, aggregates, windows and keyed views over the collection tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import dates, dedupe, keyed, pairs, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The point in time that reports over ``events`` and over the collection tables refer to.
EVENTS_NOW, COLLECTION_NOW = "2024-02-01 00:00:00", "2026-12-01 00:00:00"


def query(sql: str | None = None) -> Callable:
    """Register a function of the tables under its name."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_KEYWORDS = """
  list_filter(list_distinct(regexp_extract_all(coalesce({0}, ''), '[一-龯]{{2,}}|[ぁ-ん]{{2,}}|[ァ-ヶ]{{2,}}|[A-Za-z0-9]{{2,}}')),
    lambda x: NOT list_contains(['札幌','北海道','ニュース','発表','明らか','関係者','きょう','今日','昨日','今月','今年','市内','道内','男性','女性','問題','について','めぐり','など','こと'], x))
"""
_INDEX = f"idx AS (SELECT article_id AS id, unnest({_KEYWORDS.format('title')}) AS word FROM incoming_articles)"


@query(f"""
WITH {_INDEX},
p AS (SELECT l.id AS a, r.id AS b, sum(CASE WHEN length(l.word) >= 5 THEN 3 WHEN length(l.word) = 4 THEN 2 ELSE 1 END) AS score
      FROM idx l JOIN idx r ON l.word = r.word AND l.id < r.id GROUP BY 1, 2),
e AS (SELECT a, b, score, a AS e FROM p UNION ALL SELECT a, b, score, b AS e FROM p),
t AS (SELECT a, b, score FROM e QUALIFY row_number() OVER (PARTITION BY e ORDER BY score DESC, a, b) <= 3)
SELECT DISTINCT a, b, score::BIGINT AS score FROM t ORDER BY score DESC, a, b LIMIT 150""")
def q_candidate_pairs(t):
    return pairs.best_shared(t("incoming_articles"), "article_id", "title")


@query(f"""
WITH {_INDEX},
p AS (SELECT l.id AS a, r.id AS b FROM idx l JOIN idx r ON l.word = r.word AND l.id < r.id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT id AS article_id, count(*) AS n_partners FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY 1""")
def q_pairs_min_two(t):
    return pairs.partner_counts(t("incoming_articles"), "article_id", "title")


@query(f"""
WITH k AS (SELECT coalesce(list_extract({_KEYWORDS.format('title').replace('list_distinct', '')}, 1), '-') AS bucket, article_id FROM articles)
SELECT bucket, count(*) AS n_articles, min(article_id) AS first_id, max(article_id) AS last_id FROM k GROUP BY 1""")
def q_keyword_bucket(t):
    first = F.coalesce(F.get(X.keywords(F.col("title")), F.lit(0)), F.lit("-"))
    return t("articles").select(first.alias("bucket"), "article_id").groupBy("bucket").agg(F.count("*").alias("n_articles"), F.min("article_id").alias("first_id"), F.max("article_id").alias("last_id"))


@query("SELECT min(doc_id) AS doc_id, text, count(*) AS n_copies FROM documents GROUP BY text")
def q_keep_first_exact(t):
    return t("documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


@query("""
SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(ts, event_id) AS ts, arg_max(value, event_id) AS value, min(event_id) AS first_position
FROM events GROUP BY 1, 2""")
def q_keep_last_position(t):
    return keyed.keep_last_at_first(t("events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT min(doc_id) AS doc_id, source, arg_min(text, doc_id) AS text FROM documents GROUP BY source")
def q_keep_first_row(t):
    return keyed.keep_first(t("documents").select("doc_id", "source", "text"), ["source"], ["doc_id"])


@query("""
SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) - 1 AS n_earlier
FROM events""")
def q_band_duplicates(t):
    return scan.earlier_in_band(t("events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", 86_400).select("event_id", "user_id", "event_type", "n_earlier")


@query("""
WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_id, user_id, event_type, n, event_id AS head, ts AS since FROM o WHERE n = 1
  UNION ALL
  SELECT o.event_id, o.user_id, o.event_type, o.n, CASE WHEN o.ts - w.since > INTERVAL 6 HOUR THEN o.event_id ELSE w.head END, CASE WHEN o.ts - w.since > INTERVAL 6 HOUR THEN o.ts ELSE w.since END
  FROM w JOIN o ON o.user_id = w.user_id AND o.event_type = w.event_type AND o.n = w.n + 1)
SELECT event_id, head AS representative FROM w""")
def q_greedy_representatives(t):
    return dedupe.representatives(t("events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id", 6 * 3600)


@query("""
SELECT DISTINCT i.url, i.rss_source.name AS feed, i.title FROM incoming_articles i
WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.url IS NOT DISTINCT FROM i.url AND a.rss_source.name IS NOT DISTINCT FROM i.rss_source.name AND a.title IS NOT DISTINCT FROM i.title)""")
def q_exclusion_append(t):
    archive, new = (t(x).select("url", F.col("rss_source.name").alias("feed"), "title") for x in ("articles", "incoming_articles"))
    return keyed.append_absent(archive, new, ["url", "feed", "title"])


@query("""
SELECT coalesce(rss_source.name, '') AS feed, count(*) AS n_articles, count(*) FILTER (WHERE description IS NULL OR description = '') AS n_without_text,
  count(DISTINCT url) AS n_urls, count(*) - count(DISTINCT url) AS n_repeated,
  round(100.0 * count(*) FILTER (WHERE collection_role = 'primary') / count(*), 2)::DOUBLE AS primary_percent
FROM articles GROUP BY 1""")
def q_source_metrics(t):
    n, urls = F.count("*"), F.count_distinct("url")
    return t("articles").groupBy(F.coalesce("rss_source.name", F.lit("")).alias("feed")).agg(
        n.alias("n_articles"), F.count_if(F.col("description").isNull() | (F.col("description") == "")).alias("n_without_text"), urls.alias("n_urls"),
        (n - urls).alias("n_repeated"), F.round(100.0 * F.count_if(F.col("collection_role") == "primary") / n, 2).alias("primary_percent"),
    )


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1, 2")
def q_status_histogram(t):
    return t("orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"))


@query(f"""
SELECT event_type AS stage, count(*) AS n, count(DISTINCT user_id) AS n_users, min(ts) AS first_seen, round(max(epoch(TIMESTAMP '{EVENTS_NOW}') - epoch(ts)) / 3600.0, 2)::DOUBLE AS longest_wait_hours
FROM events GROUP BY 1""")
def q_stage_health(t):
    wait = (F.lit(EVENTS_NOW).cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 3600.0
    return t("events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.min("ts").alias("first_seen"), F.round(F.max(wait), 2).alias("longest_wait_hours"))


@query("""
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(n, 1) OVER w AS p1, lag(n, 2) OVER w AS p2, lag(n, 3) OVER w AS p3, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS rn FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, n, coalesce(n > p1 AND p1 > p2 AND p2 > p3, false) AS is_growing FROM l WHERE rn <= 24""")
def q_growth_alert(t):
    days = t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("day")
    p = [F.lag("n", k).over(w) for k in (1, 2, 3)]
    marked = days.withColumn("is_growing", F.coalesce((F.col("n") > p[0]) & (p[0] > p[1]) & (p[1] > p[2]), F.lit(False)))
    return keyed.latest_per_key(marked, "event_type", [F.desc("day")], 24)


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 0 WHEN o_orderstatus = 'P' THEN 3 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS rank_class,
  date_diff('day', o_orderdate, TIMESTAMP '1998-12-01') AS age_days FROM orders""")
def q_wait_rank(t):
    rank = F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"), 0).when(F.col("o_orderstatus") == "P", 3).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    return t("orders").select("o_orderkey", rank.alias("rank_class"), F.datediff(F.lit("1998-12-01").cast("date"), F.to_date("o_orderdate")).alias("age_days"))


@query()
def q_fair_queue(t):
    """The first 100 slots of the fair order of all orders: cheapest first, but every fourth slot to the oldest."""
    waiting = t("orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return keyed.fair_order(waiting, ["o_totalprice", "o_orderkey"], ["o_orderdate", "o_orderkey"], 100)


@query("""
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, o_orderstatus <> 'O' OR n <= 16 AS is_admitted FROM r""")
def q_admission_prefix(t):
    rows = keyed.admitted(t("orders"), F.col("o_orderstatus") == "O", ["o_orderdate", "o_orderkey"], 16)
    return rows.select("o_orderkey", "o_orderstatus", "is_admitted")


@query("""
WITH j AS (SELECT timezone('Asia/Tokyo', timezone('UTC', o_orderdate)) AS moment, CAST(ceil(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority FROM orders)
SELECT strftime(moment, '%Y-%m') AS month, count(*) AS calls, CAST(sum(cents) AS BIGINT) AS cents, count(DISTINCT CAST(moment AS DATE)) AS n_days, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_calls FROM j GROUP BY 1""")
def q_day_month_totals(t):
    at = F.from_utc_timestamp("o_orderdate", "Asia/Tokyo")
    rows = t("orders").select(F.date_format(at, "yyyy-MM").alias("month"), F.to_date(at).alias("day"), F.ceil(F.col("o_totalprice") * 100).alias("cents"), "o_orderpriority")
    return rows.groupBy("month").agg(F.count("*").alias("calls"), F.sum("cents").alias("cents"), F.count_distinct("day").alias("n_days"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent_calls"))


def fingerprint(*columns: str):
    """A hash of some text columns, null as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("")) for c in columns)), 256)


_PRINT = "sha256(coalesce({0}.url,'') || chr(31) || coalesce({0}.title,'') || chr(31) || coalesce({0}.description,'') || chr(31) || coalesce({0}.published,''))"


@query(f"""
WITH k AS (SELECT DISTINCT a.url, {_PRINT.format('a')} AS fp FROM articles a), u AS (SELECT DISTINCT url FROM k WHERE url IS NOT NULL)
SELECT i.article_id, {_PRINT.format('i')} AS fingerprint, u.url IS NOT NULL AS is_known_url, k.fp IS NOT NULL AS is_known_revision
FROM incoming_articles i LEFT JOIN u ON u.url = i.url LEFT JOIN k ON k.url = i.url AND k.fp = {_PRINT.format('i')}""")
def q_known_revision_join(t):
    revision = fingerprint("url", "title", "description", "published").alias("fingerprint")
    known = t("articles").where("url is not null").select("url", revision).distinct()
    urls = known.select("url").distinct().withColumn("is_known_url", F.lit(True))
    rows = t("incoming_articles").select("article_id", "url", revision)
    found = rows.join(urls, "url", "left").join(known.withColumn("is_known_revision", F.lit(True)), ["url", "fingerprint"], "left")
    return found.select("article_id", "fingerprint", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("is_known_url", "is_known_revision")))


_MARK = "sha256(coalesce({0}.url,'') || chr(31) || coalesce({0}.title,'') || chr(31) || coalesce({0}.published,''))"


@query(f"""
WITH s AS (SELECT DISTINCT {_MARK.format('a')} AS mark FROM articles a WHERE event_id IS NOT NULL),
x AS (SELECT group_key, category, tracking_value, unnest(articles) AS m FROM news_groups),
g AS (SELECT {_MARK.format('x.m')} AS mark, max(group_key) AS group_key, coalesce(arg_max(coalesce(category, '対象外') = '対象外' OR coalesce(tracking_value, '') = 'low', group_key), false) AS is_out FROM x GROUP BY 1),
i AS (SELECT article_id, batch_no, {_MARK.format('i')} AS mark, min(batch_no) OVER (PARTITION BY {_MARK.format('i')}) AS first_batch FROM incoming_articles i)
SELECT i.article_id, CASE WHEN s.mark IS NOT NULL THEN 'already_saved' WHEN g.is_out THEN 'out_of_scope' WHEN g.mark IS NOT NULL THEN 'classified_waiting' WHEN i.first_batch < i.batch_no THEN 'downstream_waiting' ELSE 'queued' END AS status,
  CASE WHEN s.mark IS NULL THEN g.group_key END AS reference FROM i LEFT JOIN s ON s.mark = i.mark LEFT JOIN g ON g.mark = i.mark""")
def q_triage_precedence(t):
    """What becomes of each arrival: the first of saved, classified (out of scope or waiting), waiting from an earlier batch, queued."""
    mark = fingerprint("url", "title", "published").alias("mark")
    saved = t("articles").where("event_id is not null").select(mark).distinct().withColumn("_s", F.lit(1))
    out = (F.coalesce("category", F.lit("対象外")) == "対象外") | (F.coalesce("tracking_value", F.lit("")) == "low")
    members = t("news_groups").select("group_key", out.alias("is_out"), F.explode("articles").alias("m")).select("group_key", "is_out", "m.url", "m.title", "m.published")
    last = members.select(mark, F.struct("group_key", "is_out").alias("g")).groupBy("mark").agg(F.max("g").alias("g")).select("mark", "g.group_key", "g.is_out")
    rows = t("incoming_articles").select("article_id", "batch_no", mark)
    first = rows.groupBy("mark").agg(F.min("batch_no").alias("first_batch"))
    found = rows.join(first, "mark").join(saved, "mark", "left").join(last, "mark", "left")
    status = (
        F.when(F.col("_s").isNotNull(), "already_saved")
        .when(F.col("is_out"), "out_of_scope")
        .when(F.col("group_key").isNotNull(), "classified_waiting")
        .when(F.col("first_batch") < F.col("batch_no"), "downstream_waiting")
        .otherwise("queued")
    )
    return found.select("article_id", status.alias("status"), F.when(F.col("_s").isNull(), F.col("group_key")).alias("reference"))


@query("SELECT l_orderkey, min(l_returnflag) AS label, count(*) AS n_lines, max(l_linenumber) AS last_line FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def q_single_label_groups(t):
    one = t("lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("label"), F.max("l_returnflag").alias("_most"), F.count("*").alias("n_lines"), F.max("l_linenumber").alias("last_line"))
    return one.where("label = _most").drop("_most")  # one label: no count of distinct values is needed


@query("""
WITH g AS (SELECT group_key, x.url AS url, x.title AS title FROM (SELECT group_key, unnest(articles) AS x FROM news_groups))
SELECT article_id FROM articles a WHERE EXISTS (SELECT 1 FROM g WHERE g.url = a.url) OR EXISTS (SELECT 1 FROM g WHERE g.title = a.title)""")
def q_registry_exclusion(t):
    held = t("news_groups").select(F.explode("articles").alias("x")).select("x.url", "x.title")
    rows = t("articles").select("article_id", "url", "title")
    by_url, by_title = (rows.join(held.select(c).where(F.col(c).isNotNull()).distinct(), c, "left_semi").select("article_id") for c in ("url", "title"))
    return by_url.union(by_title).distinct()


@query("SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS n_suppliers, list_sort(list(DISTINCT l_suppkey))::VARCHAR AS suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def q_shared_members_audit(t):
    """Parts delivered by more than one supplier; distinct pairs come first, so that lists hold no repeats while they grow."""
    distinct = t("lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey").distinct()
    lists = distinct.groupBy("part").agg(F.count("*").alias("n_suppliers"), F.array_sort(F.collect_list("l_suppkey")).alias("s")).where("n_suppliers > 1")
    return lists.select("part", "n_suppliers", F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x.cast("string")), ", "), F.lit("]")).alias("suppliers"))


@query("""
WITH a AS (SELECT regexp_replace(split_part(title, ' - ', 1), '[ 　]+', '', 'g') AS h, article_id FROM articles WHERE title IS NOT NULL),
i AS (SELECT regexp_replace(split_part(title, ' - ', 1), '[ 　]+', '', 'g') AS h, article_id FROM incoming_articles WHERE title IS NOT NULL),
c AS (SELECT h, count(DISTINCT article_id) AS n_candidates, min(article_id) AS first_candidate FROM a WHERE length(h) >= 28 GROUP BY 1)
SELECT i.article_id, c.n_candidates, c.first_candidate FROM i JOIN c ON c.h = i.h""")
def q_heading_candidates(t):
    heading = F.regexp_replace(F.split_part(F.col("title"), F.lit(" - "), F.lit(1)), "[ 　]+", "").alias("h")
    known = t("articles").where("title is not null").select(heading, "article_id").where("length(h) >= 28")
    grouped = known.groupBy("h").agg(F.count_distinct("article_id").alias("n_candidates"), F.min("article_id").alias("first_candidate"))
    return t("incoming_articles").select("article_id", heading).join(grouped, "h").select("article_id", "n_candidates", "first_candidate")


@query("""
WITH p AS (SELECT least(event_a_id, event_b_id) AS a, greatest(event_a_id, event_b_id) AS b, count(*) AS n_times, min(pair_no) AS first_pair FROM merge_preview
  WHERE event_a_id IS NOT NULL AND event_b_id IS NOT NULL AND event_a_id <> event_b_id GROUP BY 1, 2)
SELECT p.a, p.b, p.n_times, p.first_pair FROM p WHERE NOT EXISTS (SELECT 1 FROM tracked_events e WHERE e.event_id IN (p.a, p.b) AND e.publication_status = 'held')""")
def q_blocked_pairs(t):
    a, b = F.least("event_a_id", "event_b_id"), F.greatest("event_a_id", "event_b_id")
    named = t("merge_preview").where("event_a_id is not null and event_b_id is not null and event_a_id != event_b_id")
    distinct = named.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n_times"), F.min("pair_no").alias("first_pair"))
    held = t("tracked_events").where("publication_status = 'held'").select("event_id").distinct()
    return distinct.join(held.withColumnRenamed("event_id", "a"), "a", "left_anti").join(held.withColumnRenamed("event_id", "b"), "b", "left_anti").select("a", "b", "n_times", "first_pair")


@query("""
WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey))::VARCHAR AS k FROM lineitem GROUP BY 1)
SELECT max(l_orderkey) AS last_order, count(*) AS n_orders, sha256(k) AS set_key FROM s GROUP BY k""")
def q_set_equality_replace(t):
    sets = t("lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("s"))
    key = F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x.cast("string")), ", "), F.lit("]"))
    return sets.select("l_orderkey", F.sha2(key, 256).alias("set_key")).groupBy("set_key").agg(F.max("l_orderkey").alias("last_order"), F.count("*").alias("n_orders"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS majority_type, n AS n_votes FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def q_majority_type(t):
    votes = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    best = votes.groupBy("user_id").agg(F.max(F.struct(F.col("n"), (-F.col("f")).alias("f"), F.col("event_type"))).alias("m"))
    return best.select("user_id", F.col("m.event_type").alias("majority_type"), F.col("m.n").alias("n_votes"))


@query("""
SELECT article_id, coalesce(regexp_matches(url, '(?i)^https?://[^/?#\\s]+'), false) AS is_safe, lower(regexp_extract(coalesce(url, ''), '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM articles""")
def q_url_parts(t):
    return t("articles").select("article_id", X.safe_url(F.col("url")).alias("is_safe"), X.host(F.col("url")).alias("host"))


@query("""
WITH p AS (SELECT article_id, trim(regexp_replace(regexp_replace(coalesce(description, ''), '<[^>]*>', ' ', 'g'), '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}]+', ' ', 'g')) AS body FROM articles)
SELECT article_id, body, length(body) AS n_chars, length(body) >= 40 AS is_substantive FROM p""")
def q_description_text(t):
    body = t("articles").select("article_id", X.without_tags(F.col("description")).alias("body"))
    return body.select("article_id", "body", F.length("body").alias("n_chars"), (F.length("body") >= 40).alias("is_substantive"))


# Topics and the words that show them.
TOPICS = (("accident", "事故|火災|倒木"), ("weather", "大雪|洪水|土砂崩れ|浸水"), ("transport", "路線|運賃|便"), ("building", "再開発|新庁舎|補修"), ("money", "予算|補助金|給食費"))


@query(f"""
WITH l AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in TOPICS)}], lambda x: x IS NOT NULL) AS k FROM documents)
SELECT array_to_string(k, ',') AS topics, count(*) AS n_documents, min(doc_id) AS first_id FROM l GROUP BY 1""")
def q_topic_labels(t):
    labels = F.filter(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in TOPICS)), lambda x: x.isNotNull())
    return t("documents").select("doc_id", F.array_join(labels, ",").alias("topics")).groupBy("topics").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_id"))


@query("""
SELECT a.article_id, e.event_id, contains(a.title, e.event_name) AS title_has_name, contains(coalesce(a.description, ''), e.event_name) AS text_has_name
FROM articles a JOIN tracked_events e ON e.event_id = a.event_id WHERE a.title IS NOT NULL AND e.event_name IS NOT NULL""")
def q_quote_containment(t):
    names = t("tracked_events").where("event_name is not null").select("event_id", "event_name")
    rows = t("articles").where("title is not null and event_id is not null").select("article_id", "event_id", "title", F.coalesce("description", F.lit("")).alias("d")).join(names, "event_id")
    return rows.select("article_id", "event_id", F.contains("title", "event_name").alias("title_has_name"), F.contains("d", "event_name").alias("text_has_name"))


@query("""
SELECT event_id, event_name, category, lifecycle, len(schedules) AS n_schedules, updated_at FROM tracked_events
WHERE coalesce(publication_status, '') <> 'held' AND category IS NOT NULL AND coalesce(tracking_value, '') <> 'low'
  AND contains(concat_ws(' ', event_name, summary, latest), '案')""")
def q_serving_page(t):
    shown = t("tracked_events").where("coalesce(publication_status, '') != 'held' and category is not null and coalesce(tracking_value, '') != 'low'")
    found = shown.where(F.contains(F.concat_ws(" ", "event_name", "summary", "latest"), F.lit("案")))
    return found.select("event_id", "event_name", "category", "lifecycle", F.when(F.col("schedules").isNotNull(), F.size("schedules")).cast("long").alias("n_schedules"), "updated_at")


@query("""
WITH u AS (SELECT event_id, unnest(schedules) AS s, generate_subscripts(schedules, 1) - 1 AS pos_no FROM tracked_events),
t AS (SELECT event_id, pos_no, s.date_text AS date_text, translate(coalesce(s.date_text, ''), '０１２３４５６７８９', '0123456789') AS t FROM u),
g AS (SELECT *, regexp_extract(t, '(?:(\\d{4})年)?(\\d{1,2})月(?:(\\d{1,2})日)?', ['y', 'm', 'd']) AS g, regexp_extract(t, '(\\d{4})年度', 1) AS f, regexp_extract(t, '(\\d{4})年', 1) AS a FROM t),
b AS (SELECT *, CASE WHEN contains(t, '年度') THEN TRY_CAST(f || '-04-01' AS DATE) WHEN g.m <> '' THEN TRY_CAST(g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(CASE WHEN g.d = '' THEN '1' ELSE g.d END, 2, '0') AS DATE)
    WHEN a <> '' AND NOT regexp_matches(t, '春|夏|秋|冬|上旬|中旬|下旬') THEN TRY_CAST(a || '-01-01' AS DATE) END AS due_start,
  CASE WHEN contains(t, '年度') THEN 'fiscal_year' WHEN g.d <> '' THEN 'day' WHEN g.m <> '' THEN 'month' ELSE 'year' END AS p FROM g)
SELECT event_id, pos_no::INT AS pos_no, date_text, due_start, CASE p WHEN 'day' THEN due_start WHEN 'month' THEN last_day(due_start) ELSE CAST(due_start + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) END AS due_end,
  CASE WHEN due_start IS NULL THEN 'unknown' ELSE p END AS precision FROM b""")
def q_schedule_bounds(t):
    schedules = t("tracked_events").select("event_id", F.posexplode("schedules").alias("pos_no", "s"))
    return schedules.select("event_id", "pos_no", F.col("s.date_text").alias("date_text"), dates.schedule_bounds(F.col("s.date_text")).alias("b")).select("event_id", "pos_no", "date_text", "b.due_start", "b.due_end", "b.precision")


@query(f"""
WITH s AS (SELECT event_id, unnest(schedules) AS s FROM tracked_events)
SELECT event_id, count(*) AS n_due FROM s WHERE s.schedule_status = 'scheduled' AND s.due_start IS NOT NULL AND s.due_end IS NOT NULL
  AND TRY_CAST(s.due_start AS DATE) - INTERVAL 7 DAY <= TIMESTAMP '{COLLECTION_NOW}' AND TRY_CAST(s.due_end AS DATE) + INTERVAL 180 DAY >= TIMESTAMP '{COLLECTION_NOW}' GROUP BY 1""")
def q_due_schedules(t):
    now = F.lit(COLLECTION_NOW).cast("timestamp")
    start, end = (F.try_to_date(F.col(f"s.{c}"), "yyyy-MM-dd") for c in ("due_start", "due_end"))
    due = (F.col("s.schedule_status") == "scheduled") & (F.date_sub(start, 7).cast("timestamp") <= now) & (F.date_add(end, 180).cast("timestamp") >= now)
    return t("tracked_events").select("event_id", F.explode("schedules").alias("s")).where(due).groupBy("event_id").agg(F.count("*").alias("n_due"))


@query("""
SELECT event_id, user_id, coalesce(ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_late,
  max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS high_water_mark FROM events""")
def q_late_data(t):
    """Rows are kept, late or not; only the mark says how far a user's time has come."""
    marked = scan.running_max(t("events").select("event_id", "user_id", "ts"), ["user_id"], "event_id", "ts", "_before", "high_water_mark")
    return marked.select("event_id", "user_id", F.coalesce(F.col("ts") < F.col("_before"), F.lit(False)).alias("is_late"), "high_water_mark")


@query("""
WITH p AS (SELECT event_id, unnest(progress_history) AS p FROM tracked_events)
SELECT event_id, count(*) AS n_steps, count(DISTINCT p.stage) AS n_stages, min(p.progress_at) AS first_at, max(p.progress_at) AS last_at FROM p GROUP BY 1""")
def q_progress_history(t):
    steps = t("tracked_events").select("event_id", F.explode("progress_history").alias("p"))
    return steps.groupBy("event_id").agg(F.count("*").alias("n_steps"), F.count_distinct("p.stage").alias("n_stages"), F.min("p.progress_at").alias("first_at"), F.max("p.progress_at").alias("last_at"))


@query("""
WITH s AS (SELECT event_id, user_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, before AS from_type, event_type AS to_type, ts FROM s WHERE before IS NULL OR before <> event_type""")
def q_transitions(t):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = t("events").select("event_id", "user_id", before.alias("from_type"), F.col("event_type").alias("to_type"), "ts")
    return steps.where("from_type is null or from_type != to_type")


@query("""
SELECT user_id, count(*) AS observation_count, min(ts) AS first_seen_at, max(ts) AS last_seen_at, arg_max(event_id, (ts, event_id)) AS last_payload FROM events GROUP BY 1""")
def q_review_log(t):
    return keyed.review_log(t("events"), "user_id", "ts", "event_id")


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - CASE WHEN run = 0 THEN 0 ELSE 1 END AS attempts FROM e)
SELECT user_id, max(attempts) AS most_attempts, max(attempts) >= 3 AS needs_review FROM a GROUP BY 1""")
def q_retry_state(t):
    """Failures in a row, started anew by anything else."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = t("events").select("user_id", "event_type", F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    counted = runs.groupBy("user_id", "run").agg(F.count_if(F.col("event_type") == "error").alias("attempts"))
    return counted.groupBy("user_id").agg(F.max("attempts").alias("most_attempts")).withColumn("needs_review", F.col("most_attempts") >= 3)


@query("""
WITH m AS (SELECT DISTINCT sha256(coalesce(title,'') || chr(31) || coalesce(description,'')) AS k FROM articles)
SELECT article_id, sha256(coalesce(title,'') || chr(31) || coalesce(description,'')) AS request_key FROM incoming_articles WHERE sha256(coalesce(title,'') || chr(31) || coalesce(description,'')) NOT IN (SELECT k FROM m)""")
def q_memo_misses(t):
    key = fingerprint("title", "description").alias("request_key")
    return t("incoming_articles").select("article_id", key).join(t("articles").select(key).distinct(), "request_key", "left_anti").select("article_id", "request_key")


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def q_recency_evict(t):
    return keyed.latest_per_key(t("events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 5)


@query("""
WITH c AS (SELECT revision_id, article_key, title, lead(title) OVER (PARTITION BY article_key ORDER BY observed_at) AS following FROM article_revisions),
s AS (SELECT revision_id, list_filter(list_distinct(string_split(coalesce(title, ''), '')), lambda x: x <> '') AS a, list_filter(list_distinct(string_split(coalesce(following, ''), '')), lambda x: x <> '') AS b FROM c)
SELECT revision_id, CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0.0 END::DOUBLE AS overlap FROM s""")
def q_overlap_coefficient(t):
    following = F.lead("title").over(Window.partitionBy("article_key").orderBy("observed_at"))
    rows = t("article_revisions").select("revision_id", "title", following.alias("following"))
    return rows.select("revision_id", pairs.character_overlap("title", "following").alias("overlap"))


@query("""
WITH u AS (SELECT group_key, list_sort(list_distinct(list_transform(articles, lambda x: coalesce(x.url, '')))) AS urls FROM news_groups)
SELECT group_key, substr(sha256('[' || array_to_string(list_transform(urls, lambda x: '"' || x || '"'), ', ') || ']'), 1, 24) AS url_key, len(urls) AS n_urls FROM u""")
def q_group_key(t):
    urls = F.array_sort(F.array_distinct(F.transform("articles", lambda x: F.coalesce(x["url"], F.lit("")))))
    text = F.concat(F.lit('["'), F.array_join(urls, '", "'), F.lit('"]'))
    return t("news_groups").select("group_key", F.substring(F.sha2(F.when(F.size(urls) > 0, text).otherwise(F.lit("[]")), 256), 1, 24).alias("url_key"), F.size(urls).cast("long").alias("n_urls"))


@query("""
WITH n AS (SELECT group_key, articles, len(articles) AS n FROM news_groups),
p AS (SELECT group_key, unnest(range(1, n + 1)) AS i, n, articles FROM n)
SELECT group_key, i::INT AS pos_no, articles[i].title AS title FROM p WHERE i <= 4 OR i > n - 12""")
def q_event_context(t):
    """The first four and last twelve articles of a group."""
    rows = t("news_groups").select("group_key", F.size("articles").alias("n"), F.posexplode("articles").alias("i", "a"))
    return rows.where((F.col("i") < 4) | (F.col("i") >= F.col("n") - 12)).select("group_key", (F.col("i") + 1).alias("pos_no"), F.col("a.title").alias("title"))


@query("""
SELECT event_id, category, count(*) OVER (PARTITION BY category) - 1 AS n_partners, min(event_id) OVER (PARTITION BY category) AS class_id FROM tracked_events WHERE category IS NOT NULL""")
def q_event_pairs(t):
    """All pairs of events of one category, as each event's class and its number of partners; no pair is written out."""
    rows = t("tracked_events").where("category is not null").select("event_id", "category")
    classes = rows.groupBy("category").agg((F.count("*") - 1).alias("n_partners"), F.min("event_id").alias("class_id"))
    return rows.join(classes, "category").select("event_id", "category", "n_partners", "class_id")


@query("""
WITH RECURSIVE e AS (SELECT event_a_id AS a, event_b_id AS b FROM merge_preview WHERE event_a_id <> event_b_id),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(v, w) AS (SELECT a, a FROM s UNION SELECT r.v, s.b FROM r JOIN s ON s.a = r.w)
SELECT v, min(w) AS block FROM r GROUP BY v""")
def q_linked_blocks(t):
    return dedupe.linked_blocks(t("merge_preview").select(F.col("event_a_id").alias("a"), F.col("event_b_id").alias("b")))


@query()
def q_cluster_complete_linkage(t):
    edges = t("merge_preview").where("event_a_id is not null and event_b_id is not null and event_a_id != event_b_id")
    return dedupe.complete_linkage(edges.select(F.col("event_a_id").alias("a"), F.col("event_b_id").alias("b"), "pair_no"), "pair_no")


@query("""
WITH u AS (SELECT url, article_id, title, 0 AS turn FROM articles UNION ALL SELECT url, article_id, title, 1 AS turn FROM incoming_articles)
SELECT url, arg_max(title, (turn, article_id)) AS title, arg_max(article_id, (turn, article_id)) AS article_id, min((turn, article_id))[2] AS first_id FROM (SELECT url, article_id, coalesce(title, '') AS title, turn FROM u) GROUP BY url""")
def q_inbox_union(t):
    """Last write wins per url, the first place is kept."""
    rows = [t(x).select("url", "article_id", F.coalesce("title", F.lit("")).alias("title"), F.lit(i).alias("turn")) for i, x in enumerate(("articles", "incoming_articles"))]
    ordered = rows[0].unionByName(rows[1]).select("url", F.struct("turn", "article_id").alias("at"), "title")
    kept = keyed.keep_last_at_first(ordered, ["url"], ["at"])
    return kept.select("url", "title", F.col("at.article_id").alias("article_id"), F.col("first_position.article_id").alias("first_id"))


@query(f"""
WITH m AS (SELECT url, {_PRINT.format('a')} AS mark, article_id, 0 AS turn FROM articles a WHERE url IS NOT NULL UNION ALL SELECT url, {_PRINT.format('i')}, article_id, 1 FROM incoming_articles i WHERE url IS NOT NULL),
l AS (SELECT url, turn, arg_max(mark, (article_id, mark)) AS mark, max(article_id) AS last_id, min(article_id) AS first_id FROM m GROUP BY 1, 2),
o AS (SELECT * FROM l WHERE turn = 0), n AS (SELECT * FROM l WHERE turn = 1)
SELECT coalesce(o.url, n.url) AS url, coalesce(n.mark, o.mark) AS mark, coalesce(o.mark <> n.mark, false) AS is_changed,
  CASE WHEN o.url IS NULL OR coalesce(o.mark <> n.mark, false) THEN n.first_id ELSE o.first_id END AS first_id, CASE WHEN coalesce(o.mark <> n.mark, false) THEN 1 ELSE 0 END::BIGINT AS n_history
FROM o FULL JOIN n ON o.url = n.url""")
def q_state_upsert(t):
    from tidemark.operators import state

    def marks(name):
        at = F.timestamp_micros("article_id").alias("at")
        return state.fresh(t(name).select("url", fingerprint("url", "title", "description", "published").alias("m"), at), "url", "m", "at")

    after = state.upsert(marks("articles"), marks("incoming_articles"), "url")
    return after.select("url", "mark", "is_changed", F.unix_micros("first_seen_at").alias("first_id"), F.size("history").cast("long").alias("n_history"))


@query()
def q_reprints(t):
    from tidemark.functions.unicode import headline
    from tidemark.operators.reprints import reprints
    from tidemark.operators.timestamps import with_instant

    feeds = t("feeds")
    portals = feeds.where("is_portal").select(F.col("feed_name").alias("feed"), F.lit(1).alias("rank")).distinct()
    timed = with_instant(t("articles"), "published", F.col("rss_source.name"), feeds, "at")
    body = X.without_tags(F.when(~F.contains(F.coalesce("description", F.lit("")), F.lit("<a ")), F.col("description")))
    rows = timed.select(F.col("article_id").alias("id"), "url", headline(F.col("title"), F.col("rss_source.name")).alias("headline"), F.coalesce("rss_source.name", F.lit("")).alias("feed"), "at", F.when(F.length(body) >= 40, body).otherwise("").alias("body"))
    return reprints(rows.join(portals, "feed", "left").fillna(0, ["rank"]))


@query("""
WITH x AS (SELECT group_key, unnest(articles) AS a FROM news_groups), h AS (SELECT group_key, regexp_replace(split_part(coalesce(a.title, ''), ' - ', 1), '[ 　]+', '', 'g') AS h FROM x)
SELECT group_key, count(*) AS n_articles, count(DISTINCT h) AS n_headlines, count(*) - count(DISTINCT h) AS n_excluded FROM h GROUP BY 1""")
def q_group_dedupe(t):
    heading = F.regexp_replace(F.split_part(F.coalesce("a.title", F.lit("")), F.lit(" - "), F.lit(1)), "[ 　]+", "").alias("h")
    rows = t("news_groups").select("group_key", F.explode("articles").alias("a")).select("group_key", heading)
    each = rows.groupBy("group_key", "h").agg(F.count("*").alias("n"))
    return each.groupBy("group_key").agg(F.sum("n").alias("n_articles"), F.count("*").alias("n_headlines"), (F.sum("n") - F.count("*")).alias("n_excluded"))


@query("""
WITH RECURSIVE e AS (SELECT event_a_id AS a, event_b_id AS b FROM merge_preview WHERE event_a_id <> event_b_id),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(v, w) AS (SELECT a, a FROM s UNION SELECT r.v, s.b FROM r JOIN s ON s.a = r.w),
g AS (SELECT v, min(w) AS block FROM r GROUP BY v), m AS (SELECT coalesce(g.block, t.event_id) AS block, t.* FROM tracked_events t LEFT JOIN g ON g.v = t.event_id)
SELECT block, min((created_at, event_id))[2] AS event_id, min(created_at) AS created_at, max(updated_at) AS updated_at, count(*) AS n_events, CAST(sum(coalesce(article_count, 0)) AS BIGINT) AS article_count FROM m GROUP BY block""")
def q_merged_events(t):
    """Events linked by merge pairs, as one: the oldest id, the latest update, all articles."""
    blocks = dedupe.linked_blocks(t("merge_preview").select(F.col("event_a_id").alias("a"), F.col("event_b_id").alias("b"))).withColumnRenamed("v", "event_id")
    rows = t("tracked_events").join(blocks, "event_id", "left").withColumn("block", F.coalesce("block", "event_id"))
    oldest = F.min(F.struct("created_at", "event_id"))["event_id"]
    return rows.groupBy("block").agg(oldest.alias("event_id"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.count("*").alias("n_events"), F.sum(F.coalesce("article_count", F.lit(0))).alias("article_count"))


@query("""
SELECT feed, count(*) AS n_items, count(*) FILTER (WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END) AS n_objects FROM inbox_items GROUP BY 1""")
def q_answer_objects(t):
    from tidemark.functions.answers import answer_object

    return t("inbox_items").select("feed", answer_object(F.col("payload")).isNotNull().alias("ok")).groupBy("feed").agg(F.count("*").alias("n_items"), F.count_if("ok").alias("n_objects"))


@query("SELECT event_id, event_name, updated_at FROM tracked_events ORDER BY updated_at DESC NULLS LAST, event_id LIMIT 50")
def q_latest_updates(t):
    return t("tracked_events").select("event_id", "event_name", "updated_at").orderBy(F.desc_nulls_last("updated_at"), "event_id").limit(50)


@query("""
WITH a AS (SELECT url, CAST(collected_at AS TIMESTAMP) AS seen FROM articles UNION ALL SELECT url, CAST(received_at AS TIMESTAMP) FROM incoming_articles)
SELECT url, min(seen) AS first_seen_at, count(*) AS n_seen FROM a WHERE url IS NOT NULL GROUP BY 1""")
def q_first_seen(t):
    rows = t("articles").select("url", F.col("collected_at").alias("at")).unionByName(t("incoming_articles").select("url", F.col("received_at").alias("at")))
    return rows.where("url is not null").groupBy("url").agg(F.min("at").alias("first_seen_at"), F.count("*").alias("n_seen"))


@query("""
WITH a AS (SELECT event_id, count(*) AS n, count(DISTINCT coalesce(url, '')) AS n_urls FROM articles WHERE event_id IS NOT NULL GROUP BY 1),
c AS (SELECT e.event_id, e.publication_status, array_to_string(list_filter([CASE WHEN e.article_count IS DISTINCT FROM coalesce(a.n, 0) THEN 'article_count_mismatch' END, CASE WHEN a.n IS NULL THEN 'empty_event' END,
  CASE WHEN a.n_urls < a.n THEN 'duplicate_article_url' END], lambda x: x IS NOT NULL), ',') AS issues FROM tracked_events e LEFT JOIN a ON a.event_id = e.event_id)
SELECT event_id, issues, CASE WHEN issues <> '' THEN 'held' ELSE coalesce(publication_status, '') END AS status FROM c""")
def q_issue_codes(t):
    """All reasons against an event, in a fixed order; an event with any is held."""
    mine = t("articles").where("event_id is not null").groupBy("event_id").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("url", F.lit(""))).alias("n_urls"))
    rows = t("tracked_events").select("event_id", "publication_status", "article_count").join(mine, "event_id", "left")
    codes = F.array(
        F.when(~F.col("article_count").eqNullSafe(F.coalesce("n", F.lit(0))), "article_count_mismatch"),
        F.when(F.col("n").isNull(), "empty_event"),
        F.when(F.col("n_urls") < F.col("n"), "duplicate_article_url"),
    )
    named = rows.select("event_id", "publication_status", F.array_join(F.array_compact(codes), ",").alias("issues"))
    return named.select("event_id", "issues", F.when(F.col("issues") != "", "held").otherwise(F.coalesce("publication_status", F.lit(""))).alias("status"))


@query("""
WITH e AS (SELECT event_id, event_name, created_at FROM tracked_events WHERE event_name IS NOT NULL)
SELECT event_name, count(DISTINCT event_id) AS n_events, min(event_id) AS first_event FROM e GROUP BY 1 HAVING count(DISTINCT event_id) > 1""")
def q_shared_names_audit(t):
    named = t("tracked_events").where("event_name is not null").groupBy("event_name").agg(F.count_distinct("event_id").alias("n_events"), F.min("event_id").alias("first_event"))
    return named.where("n_events > 1")


@query("""
WITH s AS (SELECT event_id, unnest(schedules) AS s FROM tracked_events),
k AS (SELECT event_id, s.label AS label, s.date_text AS date_text, s.schedule_status AS status, coalesce(s.due_start, '') AS due FROM s)
SELECT event_id, substr(sha256(coalesce(label, '')), 1, 16) AS label_key, arg_max(coalesce(date_text, ''), (due, coalesce(date_text, ''))) AS date_text, count(*) AS n_versions, count(DISTINCT coalesce(date_text, '')) AS n_texts FROM k GROUP BY event_id, coalesce(label, '')""")
def q_schedule_history(t):
    """Schedules by event and label: the latest date, and how many versions and different texts there were."""
    rows = t("tracked_events").select("event_id", F.explode("schedules").alias("s")).select("event_id", F.coalesce("s.label", F.lit("")).alias("label"), F.coalesce("s.date_text", F.lit("")).alias("date_text"), F.coalesce("s.due_start", F.lit("")).alias("due"))
    kept = rows.groupBy("event_id", "label").agg(F.max(F.struct("due", "date_text"))["date_text"].alias("date_text"), F.count("*").alias("n_versions"), F.count_distinct("date_text").alias("n_texts"))
    return kept.select("event_id", F.substring(F.sha2("label", 256), 1, 16).alias("label_key"), "date_text", "n_versions", "n_texts")


@query(f"""
SELECT user_id, max(ts) AS last_activity, CASE WHEN date_diff('day', CAST(max(ts) AS DATE), DATE '{EVENTS_NOW[:10]}') >= 5 THEN 'dormant' WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'completed' ELSE 'active' END AS lifecycle
FROM events GROUP BY 1""")
def q_lifecycle(t):
    last = t("events").groupBy("user_id").agg(F.max("ts").alias("last_activity"), F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("_kind"))
    idle = F.datediff(F.lit(EVENTS_NOW[:10]).cast("date"), F.to_date("last_activity"))
    return last.select("user_id", "last_activity", F.when(idle >= 5, "dormant").when(F.col("_kind") == "purchase", "completed").otherwise("active").alias("lifecycle"))


@query("""
SELECT p.pair_no, CASE WHEN p.event_a_id IS NULL OR p.event_b_id IS NULL THEN 'missing_id' WHEN p.event_a_id = p.event_b_id THEN 'same_event' WHEN a.event_id IS NULL OR b.event_id IS NULL THEN 'unknown_event'
  WHEN a.category IS DISTINCT FROM b.category THEN 'category_differs' WHEN a.publication_status = 'held' OR b.publication_status = 'held' THEN 'held' ELSE 'accepted' END AS reason
FROM merge_preview p LEFT JOIN tracked_events a ON a.event_id = p.event_a_id LEFT JOIN tracked_events b ON b.event_id = p.event_b_id""")
def q_decision_reasons(t):
    """Each decision with the first reason against it, in a fixed order."""
    known = t("tracked_events").select("event_id", "category", "publication_status")
    a, b = (known.select(F.col("event_id").alias(f"event_{x}_id"), F.struct("category", F.col("publication_status").alias("status")).alias(x)) for x in "ab")
    rows = t("merge_preview").select("pair_no", "event_a_id", "event_b_id").join(a, "event_a_id", "left").join(b, "event_b_id", "left")
    reason = (
        F.when(F.col("event_a_id").isNull() | F.col("event_b_id").isNull(), "missing_id")
        .when(F.col("event_a_id") == F.col("event_b_id"), "same_event")
        .when(F.col("a").isNull() | F.col("b").isNull(), "unknown_event")
        .when(~F.col("a.category").eqNullSafe(F.col("b.category")), "category_differs")
        .when((F.col("a.status") == "held") | (F.col("b.status") == "held"), "held")
        .otherwise("accepted")
    )
    return rows.select("pair_no", reason.alias("reason"))


@query("""
WITH p AS (SELECT event_id, article_id, unnest(list_distinct(regexp_extract_all(title, '[一-龯]{1,3}[市区町村]'))) AS place FROM articles WHERE title IS NOT NULL AND event_id IS NOT NULL)
SELECT event_id, count(DISTINCT place) AS n_places, count(DISTINCT article_id) AS n_articles, count(DISTINCT place) > 1 AS may_conflict FROM p GROUP BY 1""")
def q_place_conflicts(t):
    """Events whose articles name different places; counted per event, no article is compared with another."""
    places = F.array_distinct(F.regexp_extract_all("title", F.lit("([一-龯]{1,3}[市区町村])"), 1))
    rows = t("articles").where("title is not null and event_id is not null").select("event_id", "article_id", F.explode(places).alias("place"))
    return rows.groupBy("event_id").agg(F.count_distinct("place").alias("n_places"), F.count_distinct("article_id").alias("n_articles")).withColumn("may_conflict", F.col("n_places") > 1)


@query("""
SELECT event_id, length(regexp_replace(coalesce(event_name, ''), '[^\\p{L}\\p{N}]', '', 'g')) AS n_letters,
  length(regexp_replace(coalesce(event_name, ''), '[^\\p{L}\\p{N}]', '', 'g')) >= 3 AND NOT regexp_matches(coalesce(event_name, ''), '^[\\p{N}\\s]*$') AND NOT regexp_matches(coalesce(event_name, ''), 'ニュース|新聞|テレビ') AS is_specific
FROM tracked_events""")
def q_specific_values(t):
    """Names that say something: three letters or digits, not only digits, no medium."""
    name = F.coalesce("event_name", F.lit(""))
    n = F.length(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))
    return t("tracked_events").select("event_id", n.alias("n_letters"), ((n >= 3) & ~name.rlike(r"^[\p{N}\s]*$") & ~name.rlike("ニュース|新聞|テレビ")).alias("is_specific"))


@query("""
WITH x AS (SELECT group_key, unnest(articles) AS a, generate_subscripts(articles, 1) AS i FROM news_groups),
s AS (SELECT group_key, a.url AS url, a.title AS title, i FROM x WHERE regexp_matches(coalesce(a.url, ''), '(?i)^https?://[^/?#\\s]+') AND coalesce(a.title, '') <> ''),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY group_key, url ORDER BY i) = 1)
SELECT group_key, count(*) AS n_kept, array_to_string(list(title ORDER BY i), ' | ') AS titles FROM f GROUP BY 1""")
def q_clean_articles(t):
    """Within each group's array: articles with a safe url and a title, the first per url, in order; no shuffle at all."""
    safe = F.filter("articles", lambda a: X.safe_url(a["url"]) & (F.coalesce(a["title"], F.lit("")) != ""))
    rows = t("news_groups").select("group_key", safe.alias("s"))
    urls = F.transform("s", lambda a: a["url"])
    first = F.filter("s", lambda a, i: F.array_position(urls, a["url"]) == i + 1)
    kept = rows.select("group_key", first.alias("k")).where(F.size("k") > 0)
    return kept.select("group_key", F.size("k").cast("long").alias("n_kept"), F.array_join(F.transform("k", lambda a: a["title"]), " | ").alias("titles"))


@query("""
SELECT event_id, coalesce(nullif(event_name, ''), '(untitled)') AS event_name, coalesce(category, '対象外') AS category, coalesce(lifecycle, 'active') AS lifecycle, greatest(coalesce(source_article_count, 0), coalesce(article_count, 0)) AS source_article_count,
  len(coalesce(progress_history, [])) AS progress_count FROM tracked_events""")
def q_defaulted_events(t):
    return t("tracked_events").select(
        "event_id", F.coalesce(F.nullif("event_name", F.lit("")), F.lit("(untitled)")).alias("event_name"), F.coalesce("category", F.lit("対象外")).alias("category"), F.coalesce("lifecycle", F.lit("active")).alias("lifecycle"),
        F.greatest(F.coalesce("source_article_count", F.lit(0)), F.coalesce("article_count", F.lit(0))).alias("source_article_count"), F.greatest(F.coalesce(F.size("progress_history"), F.lit(0)), F.lit(0)).cast("long").alias("progress_count"),
    )


@query("""
WITH k AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[一-龯]{3,}|[ぁ-んァ-ヶ]{3,}'))) AS word FROM documents WHERE text IS NOT NULL)
SELECT word, count(*) AS n_documents, min(doc_id) AS first_id FROM k GROUP BY 1 HAVING count(*) >= 3""")
def q_common_words(t):
    """Words of three or more characters, with the number of documents that have them."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("([一-龯]{3,}|[ぁ-んァ-ヶ]{3,})"), 1))
    rows = t("documents").where("text is not null").select("doc_id", F.explode(words).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_id")).where("n_documents >= 3")


@query("""
WITH v AS (SELECT l_orderkey, min(l_shipdate) AS verified FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT o.o_orderkey, CASE WHEN v.verified IS NOT NULL AND o.o_orderstatus <> 'O' AND v.verified >= o.o_orderdate THEN v.verified ELSE o.o_orderdate END AS due,
  v.verified IS NOT NULL AND o.o_orderstatus <> 'O' AND v.verified >= o.o_orderdate AS is_updated FROM orders o LEFT JOIN v ON v.l_orderkey = o.o_orderkey""")
def q_verified_update(t):
    """A conditional update: verified dates replace a row's own where all guards hold."""
    verified = t("lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("verified"))
    guard = F.coalesce(F.col("verified").isNotNull() & (F.col("o_orderstatus") != "O") & (F.col("verified") >= F.col("o_orderdate")), F.lit(False))
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate").join(verified, "o_orderkey", "left")
    return rows.select("o_orderkey", F.when(guard, F.col("verified")).otherwise(F.col("o_orderdate")).alias("due"), guard.alias("is_updated"))


@query("""
WITH g AS (SELECT DISTINCT x.url AS url, 'group' AS stage, group_key AS reference FROM (SELECT group_key, unnest(articles) AS x FROM news_groups) WHERE x.url IS NOT NULL),
i AS (SELECT DISTINCT url, 'incoming' AS stage, CAST(batch_no AS VARCHAR) AS reference FROM incoming_articles WHERE url IS NOT NULL),
r AS (SELECT * FROM g UNION ALL SELECT * FROM i)
SELECT url, count(*) AS n_references, array_to_string(list(stage || ':' || reference ORDER BY stage, reference), ',') AS refs FROM r GROUP BY 1""")
def q_downstream_refs(t):
    """Where else a url waits: distinct references first, so that lists hold no repeats while they grow."""
    groups = t("news_groups").select("group_key", F.explode("articles.url").alias("url")).select("url", F.lit("group").alias("stage"), F.col("group_key").alias("reference"))
    batches = t("incoming_articles").select("url", F.lit("incoming").alias("stage"), F.col("batch_no").cast("string").alias("reference"))
    rows = groups.unionByName(batches).where("url is not null").distinct()
    lists = rows.groupBy("url").agg(F.count("*").alias("n_references"), F.array_sort(F.collect_list(F.struct("stage", "reference"))).alias("r"))
    return lists.select("url", "n_references", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["stage"], x["reference"])), ",").alias("refs"))


@query("""
WITH x AS (SELECT group_key, unnest(articles) AS a FROM news_groups), k AS (SELECT DISTINCT title FROM articles WHERE title IS NOT NULL)
SELECT group_key, count(*) AS n_articles, count(k.title) AS n_proved, count(*) = count(k.title) AS all_proved FROM x LEFT JOIN k ON k.title = x.a.title GROUP BY 1""")
def q_all_proved(t):
    """Relational division: groups of which every member is known."""
    known = t("articles").where("title is not null").select("title").distinct().withColumn("_k", F.lit(1))
    rows = t("news_groups").select("group_key", F.explode("articles.title").alias("title")).join(known, "title", "left")
    return rows.groupBy("group_key").agg(F.count("*").alias("n_articles"), F.count("_k").alias("n_proved")).withColumn("all_proved", F.col("n_articles") == F.col("n_proved"))


@query("""
WITH g AS (SELECT DISTINCT event_id FROM (SELECT event_a_id AS event_id FROM merge_preview UNION ALL SELECT event_b_id FROM merge_preview) WHERE event_id IS NOT NULL)
SELECT event_id, event_name FROM tracked_events t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.event_id = t.event_id)""")
def q_ungrouped_singletons(t):
    paired = t("merge_preview").select(F.explode(F.array("event_a_id", "event_b_id")).alias("event_id")).where("event_id is not null").distinct()
    return t("tracked_events").select("event_id", "event_name").join(paired, "event_id", "left_anti")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderdate, o_orderkey) AS place FROM orders""")
def q_queue_rotation(t):
    """In each queue untouched rows come first, tried ones behind."""
    tried = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return t("orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(tried, "o_orderdate", "o_orderkey")).alias("place"))


@query("""
SELECT split_part(payload_reason, ':', 1) AS reason, count(*) AS n FROM (SELECT event_type || ':' || CAST(user_id AS VARCHAR) AS payload_reason FROM events) GROUP BY 1""")
def q_reason_prefix(t):
    reason = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    return t("events").select(F.split_part(reason, F.lit(":"), F.lit(1)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT article_id, url, title, published, trim(regexp_replace(regexp_replace(coalesce(description, ''), '<[^>]*>', ' ', 'g'), '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}]+', ' ', 'g')) AS body FROM articles)
SELECT article_id, url, published, title, CASE WHEN body = '' OR starts_with(body, coalesce(title, body || '.')) THEN '' ELSE body END AS description FROM b""")
def q_source_context(t):
    """What a judge is shown of an article: a description that only repeats the headline is left out."""
    body = X.without_tags(F.col("description"))
    rows = t("articles").select("article_id", "url", "published", "title", body.alias("b"))
    repeats = (F.col("b") == "") | F.coalesce(F.startswith("b", "title"), F.lit(False))
    return rows.select("article_id", "url", "published", "title", F.when(repeats, F.lit("")).otherwise(F.col("b")).alias("description"))


@query("""
WITH u AS (SELECT group_key, list_sort(list_distinct(list_transform(articles, lambda x: coalesce(x.url, ''))))::VARCHAR AS urls FROM news_groups)
SELECT group_key, min(group_key) OVER (PARTITION BY urls) AS class_id, count(*) OVER (PARTITION BY urls) AS n_copies, (SELECT count(*) FROM u) - count(*) OVER (PARTITION BY urls) AS n_partners FROM u""")
def q_judged_pairs(t):
    """All pairs of groups a judge would be asked about: those of different urls.  Each group with its class of equal urls and the number of
    groups outside it; the pairs are those of different classes and aren't written out."""
    urls = F.array_sort(F.array_distinct(F.transform("articles", lambda x: F.coalesce(x["url"], F.lit("")))))
    rows = t("news_groups").select("group_key", urls.alias("urls"))
    classes = rows.groupBy("urls").agg(F.min("group_key").alias("class_id"), F.count("*").alias("n_copies"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    counted = classes.join(F.broadcast(total)).select("urls", "class_id", "n_copies", (F.col("total") - F.col("n_copies")).alias("n_partners"))
    return rows.join(counted, "urls").select("group_key", "class_id", "n_copies", "n_partners")


@query("""
WITH d AS (SELECT event_id, sha256(to_json({'category': category, 'event_id': event_id, 'event_name': event_name, 'publication_status': publication_status})) AS target_digest,
  sha256(to_json({'event_name': event_name, 'lifecycle': lifecycle})) AS stage_digest FROM tracked_events)
SELECT event_id, target_digest, stage_digest, substr(target_digest, 1, 24) AS review_id FROM d""")
def q_event_digests(t):
    """Digests of the fields that decisions rely on, as JSON with sorted names; the first 24 digits name a review."""
    as_json = lambda *names: F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    rows = t("tracked_events").select("event_id", as_json("category", "event_id", "event_name", "publication_status").alias("target_digest"), as_json("event_name", "lifecycle").alias("stage_digest"))
    return rows.withColumn("review_id", F.substring("target_digest", 1, 24))


@query("""
WITH h AS (SELECT group_key, event_name, list_transform(articles, lambda x: coalesce(x.url, '') || chr(9) || coalesce(x.published, '') || chr(9) || trim(split_part(coalesce(x.title, ''), ' - ', 1))) AS a FROM news_groups)
SELECT group_key, coalesce(event_name, '') || chr(10) || array_to_string(a, chr(10)) AS group_text FROM h""")
def q_group_texts(t):
    """What a judge is shown of a group: its name, then url, time and headline of each article, in order."""
    line = lambda x: F.concat_ws("\t", F.coalesce(x["url"], F.lit("")), F.coalesce(x["published"], F.lit("")), F.trim(F.split_part(F.coalesce(x["title"], F.lit("")), F.lit(" - "), F.lit(1))))
    lines = F.array_join(F.transform("articles", line), "\n")
    return t("news_groups").select("group_key", F.concat(F.coalesce("event_name", F.lit("")), F.lit("\n"), lines).alias("group_text"))


@query("""
WITH c AS (SELECT DISTINCT unnest([event_a_id, event_b_id]) AS event_id FROM merge_preview)
SELECT t.event_id, t.category, row_number() OVER (PARTITION BY t.category ORDER BY CASE WHEN c.event_id IS NULL THEN 1 ELSE 0 END, t.event_id)::INT AS place FROM tracked_events t LEFT JOIN c ON c.event_id = t.event_id""")
def q_operator_targets(t):
    """Events of a category in the order they are offered: candidates first, each part by id."""
    candidates = t("merge_preview").select(F.explode(F.array("event_a_id", "event_b_id")).alias("event_id")).where("event_id is not null").distinct().withColumn("_c", F.lit(0))
    rows = t("tracked_events").select("event_id", "category").join(candidates, "event_id", "left")
    return rows.select("event_id", "category", F.row_number().over(Window.partitionBy("category").orderBy(F.coalesce("_c", F.lit(1)), "event_id")).alias("place"))

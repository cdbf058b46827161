"""The queries of this subpackage's operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import components, formatting, garbled, mixing, near, packing, plain, store, survivor, tokens
from tidemark.scratch import stored


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return plain.odd_fields(spark.read.parquet(f"{sf}/articles.parquet"), "article_id", "title", "description")


def p1_plain(spark: SparkSession, sf: str) -> DataFrame:
    articles = spark.read.parquet(f"{sf}/articles.parquet").select("article_id", "title", "description")
    return plain.normalise(articles, "title", "description").select("article_id", "title_plain", "description_plain")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.repeats(spark.read.parquet(f"{sf}/inbox_items.parquet"))


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.collapse(spark.read.parquet(f"{sf}/inbox_items.parquet"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_pairs(spark.read.parquet(f"{sf}/articles.parquet"), "article_id", "title", "description", least=0.7)


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_groups(spark.read.parquet(f"{sf}/articles.parquet"), "article_id", "title", "description", least=0.7)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = components.components(spark.read.parquet(f"{sf}/merge_preview.parquet"), "event_a_id", "event_b_id")
    return groups.where("component != vertex").select(F.col("component").alias("first_event_id"), F.col("vertex").alias("event_id"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = components.components(spark.read.parquet(f"{sf}/merge_preview.parquet"), "event_a_id", "event_b_id")
    return groups.select(F.col("vertex").alias("event_id"), F.col("component").alias("group_id"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    best = survivor.golden(spark.read.parquet(f"{sf}/article_revisions.parquet"), spark.read.parquet(f"{sf}/feeds.parquet"), least=2, values=False)
    fields = F.array(*(F.struct(F.lit(x).alias("field"), F.col(f"{x}.record").alias("revision_id")) for x in ("url", "title")))
    return best.select("article_key", F.explode(fields).alias("f")).select("article_key", "f.field", "f.revision_id").where("revision_id is not null")


def p6_golden(spark: SparkSession, sf: str) -> DataFrame:
    best = survivor.golden(spark.read.parquet(f"{sf}/article_revisions.parquet"), spark.read.parquet(f"{sf}/feeds.parquet"))
    return best.select("article_key", "url.values.url", "url.values.rss_source", "title.values.title", "title.values.published", "title.values.description")


def p6_bundles(spark: SparkSession, sf: str) -> DataFrame:
    best = survivor.bundled(spark.read.parquet(f"{sf}/article_revisions.parquet"), spark.read.parquet(f"{sf}/feeds.parquet"))
    return best.select("article_key", *(F.col(f"{b}.record").alias(f"{b}_id") for b in ("url", "source", "title")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    articles, incoming = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("articles", "incoming_articles"))
    return store.repeated(articles, incoming, "article_id", "url", ("title", "description"), least=0.7)


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents, tokenized once and stored."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    return stored(documents.select("doc_id", "source", tokens.token_count(F.col("text")).alias("n_tokens")))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(_sizes(spark, sf), "doc_id", "n_tokens", spark.read.parquet(f"{sf}/container_sizes.parquet"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_rates(p8_containers(spark, sf), spark.read.parquet(f"{sf}/container_sizes.parquet"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf), spark.read.parquet(f"{sf}/mix_targets.parquet"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf), spark.read.parquet(f"{sf}/mix_targets.parquet"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.restore(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.restore(spark.read.parquet(f"{sf}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_plain, p2_found, p2_records, p3_found, p3_groups, p5_found, p5_groups, p6_found, p6_golden, p6_bundles, p7_found, p8_containers, p8_fill, p9_mix, p9_shares, p10_found, p10_restored)
}

_LINKS = """
  WITH RECURSIVE e AS (
    SELECT event_a_id AS a, event_b_id AS b FROM merge_preview
    WHERE event_a_id IS NOT NULL AND event_b_id IS NOT NULL AND event_a_id <> event_b_id),
  s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach(v, w) AS (SELECT a, a FROM s UNION SELECT r.v, s.b FROM reach r JOIN s ON s.a = r.w),
  g AS (SELECT v, min(w) AS f FROM reach GROUP BY v)
"""
_BARE = r"regexp_replace(lower(upper(coalesce({0}, ''))), '[\p{{P}}\p{{Z}}\p{{Cc}}\s\x{{FEFF}}\x{{200B}}$+<=>^`|~＄＋＜＝＞＾｀｜～]+', '', 'g')"
_GROUPED = f"""
  WITH p AS (SELECT item_id, CASE WHEN json_valid(payload) THEN payload END AS j FROM inbox_items),
  f AS (SELECT item_id, coalesce(json_extract_string(j, '$.title'), '') AS t, coalesce(json_extract_string(j, '$.url'), '') AS u FROM p WHERE j IS NOT NULL),
  k AS (SELECT item_id, {_BARE.format("t")} AS t, {_BARE.format("regexp_extract(u, '^([^?]*)', 1)")} AS u,
    list_sort(list_filter(list_transform(string_split_regex(regexp_extract(u, '^[^?]*[?](.*)$', 1), '[&;]'),
      lambda x: {_BARE.format("regexp_extract(x, '^([^=]*)', 1)")} || '=' || {_BARE.format("regexp_extract(x, '^[^=]*=(.*)$', 1)")}), lambda x: x <> '=')) AS q
    FROM f WHERE t || u <> '')
"""
_BEST = """
  WITH r AS (SELECT a.*, coalesce(f.trust, -2147483648) AS trust, regexp_replace(coalesce(a.title, ''), '[\\s\\p{Z}.．…‥・･]+$', '') AS stem,
    count(*) OVER (PARTITION BY article_key) AS n FROM article_revisions a LEFT JOIN feeds f ON f.feed_name = a.rss_source.name WHERE article_key IS NOT NULL),
  c AS (SELECT article_key, 'url' AS field, trust, observed_at, revision_id FROM r WHERE n >= 2 AND regexp_matches(url, '^https?://[^/?#\\s:]')
    UNION ALL SELECT article_key, 'title', trust, observed_at, revision_id FROM r WHERE n >= 2 AND regexp_matches(title, '[\\p{L}\\p{N}]')
      AND NOT EXISTS (SELECT 1 FROM r b WHERE b.article_key = r.article_key AND starts_with(b.stem, r.stem) AND b.stem <> r.stem))
"""
SQL: dict[str, str] = {
    "p2_found": _GROUPED + "SELECT first_item_id, item_id FROM (SELECT item_id, min(item_id) OVER (PARTITION BY t, u, q) AS first_item_id FROM k) WHERE item_id <> first_item_id",
    "p2_records": _GROUPED + "SELECT min(item_id) AS item_id, count(*) AS n_copies FROM k GROUP BY t, u, q UNION ALL SELECT item_id, 1 FROM inbox_items WHERE item_id NOT IN (SELECT item_id FROM k)",
    "p6_found": _BEST + "SELECT article_key, field, revision_id FROM c QUALIFY row_number() OVER (PARTITION BY article_key, field ORDER BY trust DESC, observed_at DESC, revision_id DESC) = 1",
    "p5_found": _LINKS + "SELECT f AS first_event_id, v AS event_id FROM g WHERE f <> v",
    "p5_groups": _LINKS + "SELECT v AS event_id, f AS group_id FROM g",
}

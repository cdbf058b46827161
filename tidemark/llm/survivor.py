"""Problem 6: the best representative of each group, chosen in consistent bundles.

Fields that belong together (an address and its parts, a url and the source it came from) form a bundle
and are taken from one record.  The bundles of a group are chosen together by branch-and-bound: most
trusted first, then most recent, while fields tied by a functional dependency agree.  Bundles of a lower level come first; those of a
higher one fit themselves to what was chosen.  Before that, candidates that another one beats under every constraint are dropped while
aggregating, so that a group of any size comes to a few candidates in the map-side step.  Only groups whose best candidates contradict each other are
searched at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tidemark.functions.text import host

#: Dots, ellipses and blanks at the end of a cut-off text.
CUT_END = r"[\s\p{Z}.．…‥・･]+$"
#: Texts are compared with those that share so many first characters; shorter ones in a step of their own.
HEAD = 8
#: Most hosts of feeds that are written into a plan.
MOST_HOSTS = 10_000


@dataclass(frozen=True)
class Bundle:
    """Fields taken from one record; ``ties`` name the expressions on which bundles must agree, null agreeing with anything."""

    name: str
    fields: Sequence[str]
    usable: Column
    ties: dict[str, Column] = field(default_factory=dict)
    level: int = 0


def usable_url(url: Column) -> Column:
    """True for http:// or https:// followed by a host."""
    return F.coalesce(url.rlike(r"^https?://[^/?#\s:]"), F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def beginnings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) of the distinct texts that another text of the same key begins with.

    In order of code points a text is followed directly by one it begins, if there is any; windows of one
    key and one HEAD keep that local.  Texts shorter than HEAD are looked up among the beginnings of the others.
    """
    distinct = texts.select(key, text).where(F.length(text) > 0).distinct()
    order = Window.partitionBy(key, F.substring(text, 1, HEAD)).orderBy(text)
    long = distinct.withColumn("_next", F.lead(text).over(order)).where((F.length(text) >= HEAD) & F.startswith("_next", text)).select(key, text)
    short = distinct.where(F.length(text) < HEAD)
    others = distinct.join(short.select(key).distinct(), key, "left_semi").where(F.length(text) > 1)
    sizes = F.sequence(F.lit(1), F.least(F.lit(HEAD - 1), F.length(text) - 1))
    begun = others.select(key, F.explode(F.transform(sizes, lambda n: F.substring(F.col(text), F.lit(1), n))).alias(text)).distinct()
    return long.unionByName(short.join(begun, [key, text], "left_semi"))


def choose(candidates: list[list[dict]], ties: list[list[str]], levels: list[int] | None = None) -> list[int | None]:
    """Branch-and-bound: the candidate of each bundle so that, level by level, trust, then recency, sum up highest and ties agree.

    ``candidates[i]`` are sorted from best to worst, which decides what is still even; each has ``trust``, ``at`` and its tie values, None
    agreeing with all.  A bundle may stay empty (None), which counts below any candidate.
    """
    n, levels = len(candidates), levels or [0] * len(candidates)
    width = 4 * (max(levels, default=0) + 1)

    def worth(i: int, j: int, c: dict) -> tuple:
        at = 4 * levels[i]
        return (*(0,) * at, 1, c["trust"], c["at"], -j, *(0,) * (width - at - 4))

    nothing = (0,) * width
    values = [[worth(i, j, c) for j, c in enumerate(cs)] for i, cs in enumerate(candidates)]
    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    rest = [nothing] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = add(rest[i + 1], max(values[i], default=nothing))
    best: tuple = ((-1,) * width, [None] * n)

    def descend(i: int, total: tuple, chosen: list, fixed: dict) -> None:
        nonlocal best
        if add(total, rest[i]) <= best[0]:
            return
        if i == n:
            best = (total, chosen)
            return
        for j, c in enumerate(candidates[i]):
            if all(c[t] is None or fixed.get(t, c[t]) == c[t] for t in ties[i]):
                descend(i + 1, add(total, values[i][j]), [*chosen, j], fixed | {t: c[t] for t in ties[i] if c[t] is not None})
        descend(i + 1, total, [*chosen, None], fixed)

    descend(0, nothing, [], {})
    return best[1]


def candidates(rows: DataFrame, key: str, record: str, at: str, bundle: Bundle) -> DataFrame:
    """(key, <bundle>): the usable values of a bundle from best to worst, one for each value of its ties.

    Of values with equal ties the most trusted, then latest, then greatest record id beats all others under any
    constraint, so only that is kept; it is found map-side.  Null keys belong to no group.
    """
    ties = sorted(bundle.ties)
    seconds = F.unix_micros(F.coalesce(F.col(at), F.lit("1970-01-01").cast("timestamp")))
    value = F.struct(F.col("_trust").alias("trust"), seconds.alias("at"), F.col(record).alias("record"), *([F.struct(*bundle.fields).alias("values")] if bundle.fields else []), *(bundle.ties[t].cast("string").alias(t) for t in ties))
    named = rows.where(F.col(key).isNotNull() & bundle.usable).select(key, value.alias("_c"))
    if not ties:
        return named.groupBy(key).agg(F.array(F.max("_c")).alias(bundle.name))
    each = named.groupBy(key, *(F.col(f"_c.{t}").alias("_" + t) for t in ties)).agg(F.max("_c").alias("_c"))
    return each.groupBy(key).agg(F.sort_array(F.collect_list("_c"), asc=False).alias(bundle.name))


def survivors(keys: DataFrame, key: str, lists: Sequence[DataFrame], bundles: Sequence[Bundle]) -> DataFrame:
    """(key, <bundle> struct per bundle): what branch-and-bound chooses from the candidates of each key.

    A bundle without usable candidate, or left out for the sake of a more trusted one it contradicts, is null.
    """
    ties, levels = [sorted(b.ties) for b in bundles], [b.level for b in bundles]
    found = keys.select(key)
    for one in lists:
        found = found.join(one, key, "left")
    # where the best candidates agree, they are the choice; only other groups go to the search, batch by batch
    differ = F.lit(False)
    for tie in sorted(set().union(*ties)):
        first = F.array_compact(F.array(*(F.get(F.col(b.name), F.lit(0))[tie] for b in bundles if tie in b.ties)))
        differ = differ | (F.size(F.array_distinct(first)) > 1)

    def scored(b: Bundle) -> Column:
        few = F.transform(b.name, lambda c: F.struct(c["trust"].alias("trust"), c["at"].alias("at"), *(c[t].alias(t) for t in sorted(b.ties))))
        return F.when(differ, F.coalesce(few, F.array().cast(few_type(b))))

    def few_type(b: Bundle) -> str:
        return f"array<struct<trust: {dict(found.select(F.col(b.name)[0]['trust'].alias('t')).dtypes)['t']}, at: bigint{''.join(f', {t}: string' for t in sorted(b.ties))}>>"

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def pick(*columns: pa.Array) -> pa.Array:
        groups = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([choose(list(g), ties, levels) if g[0] is not None else None for g in groups], pa.list_(pa.int32()))

    if not any(ties):
        return found.select(key, *(F.get(F.col(b.name), F.lit(0)).alias(b.name) for b in bundles))
    chosen = found.withColumn("_pick", pick(*map(scored, bundles)))
    return chosen.select(key, *(F.get(F.col(b.name), F.when(F.col("_pick").isNull(), 0).otherwise(F.get("_pick", F.lit(i)))).alias(b.name) for i, b in enumerate(bundles)))


def ranked(rows: DataFrame, feeds: DataFrame, feed: Column) -> DataFrame:
    """Add ``_trust``: that of the feed; feeds that aren't listed, or without trust, rank lowest."""
    trust = feeds.where("feed_name is not null").groupBy(F.col("feed_name").alias("_feed")).agg(F.max("trust").alias("_trust"))
    return rows.withColumn("_feed", feed).join(trust, "_feed", "left").withColumn("_trust", F.coalesce("_trust", F.lit(-(1 << 31)))).drop("_feed")


def _titles(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The rows with a usable title: it has a letter or digit and, without dots, ellipses and blanks at its end, isn't the
    beginning of a longer title of the same key.  Titles that agree but for their ending stand or fall together: one row each, before any join."""
    value = F.struct("_trust", "observed_at", "revision_id", F.struct(*fields).alias("values"))
    stemmed = rows.withColumn("_stem", F.regexp_replace(F.coalesce("title", F.lit("")), CUT_END, ""))
    stems = stemmed.groupBy("article_key", "_stem").agg(F.max(F.when(has_letter(F.col("title")), value)).alias("_v"))
    whole = stems.where("_v is not null").join(beginnings(stems, "article_key", "_stem"), ["article_key", "_stem"], "left_anti")
    return whole.select("article_key", "_v._trust", "_v.observed_at", "_v.revision_id", *(F.col(f"_v.values.{c}").alias(c) for c in fields))


def _chosen(revisions: DataFrame, feeds: DataFrame, bundles: Sequence[Bundle], least: int) -> DataFrame:
    wanted = ("article_key", "revision_id", "observed_at", "url", "title", "published", "description", "rss_source")
    rows = ranked(revisions.select(*wanted), feeds, F.col("rss_source.name")).where("article_key is not null")
    if any("site" in b.ties for b in bundles):
        hosts = feeds.where("feed_name is not null").groupBy(F.col("feed_name").alias("_f")).agg(F.lower(F.max("host")).alias("_site"))
        rows = rows.join(hosts, F.col("rss_source.name") == F.col("_f"), "left").drop("_f")
    keys = rows.groupBy("article_key").count().where(F.col("count") >= least)
    lists = [candidates(_titles(rows, dict.fromkeys([*b.fields, "rss_source"])) if b.name == "title" else rows, "article_key", "revision_id", "observed_at", b) for b in bundles]
    return survivors(keys, "article_key", lists, bundles)


def _sites(feeds: DataFrame) -> Column:
    """The host of a row's url; only hosts of feeds can agree with a source, those of all other urls are alike in contradicting it (unless hosts are too many for the plan)."""
    known = [r[0] for r in feeds.where("host is not null").select(F.lower("host")).distinct().limit(MOST_HOSTS + 1).collect()]
    site = host(F.col("url"))
    return site if len(known) > MOST_HOSTS else F.when(site.isin(known), site).otherwise(F.lit(""))


def golden(revisions: DataFrame, feeds: DataFrame, least: int = 1, values: bool = True) -> DataFrame:
    """(article_key, url, title, source): the best url and the best title, whatever feeds they come from, and the best source that fits both.

    Url and title are of the first level; nothing ties them to each other.  The source is of the second: its host is that of the url, its feed that of the
    title, and it is null where none fits.  ``bundled`` weighs all three alike.  Without ``values`` only the records are named, and no text is carried along.
    """
    if not values:
        revisions = revisions.withColumn("rss_source", F.struct(F.col("rss_source.name").alias("name")))
    feeds = feeds if "host" in feeds.columns else feeds.withColumn("host", F.lit(None).cast("string"))
    feed = F.col("rss_source.name")
    url = Bundle("url", ("url", "rss_source") if values else (), usable_url(F.col("url")), {"site": _sites(feeds)})
    title = Bundle("title", ("title", "published", "description") if values else (), F.lit(True), {"feed": feed})
    source = Bundle("source", ("rss_source",) if values else (), feed.isNotNull(), {"site": F.col("_site"), "feed": feed}, level=1)
    return _chosen(revisions, feeds, [url, title, source], least).select("article_key", "url", "title", "source")


def bundled(revisions: DataFrame, feeds: DataFrame, least: int = 1) -> DataFrame:
    """(article_key, url, source, title): survivors that don't contradict each other, of the highest trust in all, then the latest.

    The host of the url is that of the source's feed, and the title comes from the source's feed.  A feed that isn't listed or has no host, and a
    missing feed name, agree with anything; a bundle that would contradict more trusted ones is null.
    """
    feed = F.col("rss_source.name")
    url = Bundle("url", ("url",), usable_url(F.col("url")), {"site": _sites(feeds)})
    source = Bundle("source", ("rss_source",), feed.isNotNull(), {"site": F.col("_site"), "feed": feed})
    title = Bundle("title", ("title", "published", "description"), F.lit(True), {"feed": feed})
    return _chosen(revisions, feeds, [url, source, title], least)

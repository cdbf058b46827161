"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about an event.
STOPWORDS = (
    "札幌", "北海道", "ニュース", "発表", "明らか", "関係者", "きょう", "今日", "昨日", "今月", "今年", "市内", "道内", "市", "道", "県",
    "男性", "女性", "人", "方", "問題", "について", "めぐり", "など", "こと",
)
#: Runs of two or more kanji, hiragana, katakana (without the prolonged sound mark) or ASCII letters and digits.
KEYWORD = "[一-龯]{2,}|[ぁ-ん]{2,}|[ァ-ヶ]{2,}|[A-Za-z0-9]{2,}"


def keywords(title: Column) -> Column:
    """Distinct keywords of a title in order of first occurrence; null gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(f"({KEYWORD})"), 1)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOPWORDS)))


def keyword_weight(word: Column) -> Column:
    """3 for five or more characters, 2 for four, else 1."""
    return F.when(F.length(word) >= 5, 3).when(F.length(word) == 4, 2).otherwise(1)


def safe_url(url: Column) -> Column:
    """True for http(s) urls with a host; null counts as unsafe."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def host(url: Column) -> Column:
    """Lower-case host of an http(s) url without user info and port, else the empty string."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def without_tags(html: Column) -> Column:
    """Markup removed, white space runs (of any script) collapsed to one blank, trimmed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def first_line(text: Column, limit: int | None = None) -> Column:
    """The first line of a text, at most ``limit`` characters where given; null stays null."""
    line = F.regexp_extract(text, r"^([^\n]*)", 1)
    return line if limit is None else F.substring(line, 1, limit)

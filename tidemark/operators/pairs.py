"""Candidate pairs from an inverted index of keywords, and set similarity of short texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import keyword_weight, keywords
from tidemark.scratch import scope, stored

#: The commonest words, by which others are put in order; and of these, those that have a bit in a mask, fewer where there are more than MASKS masks.
COMMON, BITS, MASKS = 64, (64, 32, 16), 1 << 17


def postings(docs: DataFrame, key: str, title: str) -> DataFrame:
    """(<key>, word): each document with each of its distinct keywords; null keys and titles give none."""
    return docs.where(F.col(key).isNotNull()).select(key, F.explode(keywords(F.col(title))).alias("word"))


def shared_keywords(docs: DataFrame, key: str, title: str) -> DataFrame:
    """(a, b, score, n_words) of every two documents a < b that share a keyword; score weighs words by length.

    An equi-join on the word with counting, never a comparison of all documents; a common word's list is
    split by the engine's handling of skewed joins.
    """
    index = postings(docs, key, title)
    left, right = (index.select(F.col(key).alias(x), "word") for x in "ab")
    return left.join(right, "word").where("a < b").groupBy("a", "b").agg(F.sum(keyword_weight(F.col("word"))).alias("score"), F.count("*").alias("n_words"))


def best_candidates(pairs: DataFrame, per_document: int = 3, at_most: int = 150) -> DataFrame:
    """The ``per_document`` best pairs of each document, of these the ``at_most`` best of all.

    Ties are decided by the smaller ids.  The cut per document is a group limit before the shuffle, the
    last one a top-k.
    """
    ends = pairs.select("a", "b", "score", F.explode(F.array("a", "b")).alias("end"))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("score"), "a", "b"))
    kept = ends.withColumn("rank", rank).where(F.col("rank") <= per_document).select("a", "b", "score").distinct()
    return kept.orderBy(F.desc("score"), "a", "b").limit(at_most)


def _commonest(docs: DataFrame, n: int) -> list:
    """The ``n`` commonest of ``words``, commonest first."""
    loads = docs.select(F.explode("words").alias("word")).groupBy("word").count()
    return [r[0] for r in loads.orderBy(F.desc("count"), "word").limit(n).collect()]


def _value(word: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), word)


def _weight(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda total, w: total + keyword_weight(w))


def best_shared(docs: DataFrame, key: str, title: str, per_document: int = 3, at_most: int = 150) -> DataFrame:
    """``best_candidates`` of ``shared_keywords`` without listing all pairs; keys are unique.

    Pairs of the score ``least`` and more are found first.  Only they decide which of them are among the best of a document, so that once they
    give ``at_most`` rows these are the answer; until then ``least`` is lowered, at last to 1, which is all pairs.  With words in one order,
    common ones last, the first word that a pair shares is followed in both by words that weigh ``least`` together: all others are left out.
    Of documents with equal words the partners of anybody are the first ``per_document`` besides itself, and those past ``at_most`` more
    come after as many pairs of the same score.
    """
    front = per_document + 1
    with scope() as kept:
        worded = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.array_sort(keywords(F.col(title))).alias("words")).where(F.size("words") > 0)
        place = F.row_number().over(Window.partitionBy("words").orderBy("id"))
        classed = worded.withColumn("place", place).where(F.col("place") <= at_most + front)
        plain = stored(classed.withColumn("weight", _weight(F.col("words"))))
        last = {w: COMMON - i for i, w in enumerate(_commonest(plain, COMMON))}
        if not last:
            return _top(plain.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("score")), at_most)
        order = F.transform("words", lambda w: F.struct(F.coalesce(_value(w, last), F.lit(0)).alias("common"), w.alias("word")))
        plain = stored(plain.withColumn("words", F.array_sort(order)["word"]))
        least = _reached(plain, 2 * at_most)
        while True:
            best = stored(_top(_ranked(_sharing(plain, least, front), per_document), at_most))
            if least == 1 or best.count() == at_most:
                break
            least = max(1, least * 2 // 3)
        kept.append(best)
    return _top(best, at_most)


def _top(pairs: DataFrame, at_most: int) -> DataFrame:
    return pairs.orderBy(F.desc("score"), "a", "b").limit(at_most)


def _reached(docs: DataFrame, rows: int) -> int:
    """The greatest weight that so many of ``docs`` reach, at least 1."""
    n = 0
    for r in docs.groupBy("weight").count().orderBy(F.desc("weight")).toLocalIterator():
        n += r["count"]
        if n >= rows:
            return r["weight"]
    return 1


def _sharing(docs: DataFrame, least: int, front: int) -> DataFrame:
    """(end, partner, score) of the score ``least`` and more; ``partner`` is one of the first ``front`` documents with its words."""
    places = F.sequence(F.lit(1), F.size("words"))
    begin = F.filter(places, lambda i: _weight(F.slice("words", i, F.size("words"))) >= least)
    index = docs.where(F.col("weight") >= least).select("id", "words", "place", F.explode(F.transform(begin, lambda i: F.element_at("words", i))).alias("word"))
    ends, partners = index.select(F.col("id").alias("end"), F.col("words").alias("x"), "word"), index.where(F.col("place") <= front).select(F.col("id").alias("partner"), F.col("words").alias("y"), "word")
    common = F.array_intersect("x", "y")
    met = ends.join(partners, "word").where((F.col("end") != F.col("partner")) & (F.get(common, F.lit(0)) == F.col("word")) & (_weight(common) >= least))
    return met.select("end", "partner", _weight(common).cast("long").alias("score"))


def _ranked(ends: DataFrame, per_document: int) -> DataFrame:
    """(a, b, score) of the best of each end; in the order of pairs, partners of equal score follow each other by their ids."""
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("score"), "partner"))
    best = ends.withColumn("rank", rank).where(F.col("rank") <= per_document)
    return best.select(F.least("end", "partner").alias("a"), F.greatest("end", "partner").alias("b"), "score").distinct()


def partner_counts(docs: DataFrame, key: str, title: str) -> DataFrame:
    """(<key>, n_partners): with how many others a document shares two keywords or more, where there are any; keys are unique.

    The commonest words are bits of a mask.  How many masks have two bits in common with one is counted over distinct masks, of which there are at most
    MASKS; only pairs that share another word, too, are met one by one, under the first of these, and are counted where they meet.
    """
    with scope() as kept:
        worded = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.transform(keywords(F.col(title)), lambda w: F.xxhash64(w)).alias("words"))
        worded = stored(worded.where(F.size("words") > 1))
        common = _commonest(worded, BITS[0])
        for bits in BITS:
            masked = stored(_masked(worded, common[:bits]))
            groups = stored(masked.groupBy("mask").count())
            if groups.count() <= MASKS:  # 2^16 at last
                break
        made = stored(_partners(masked, groups).withColumnRenamed("id", key))
        kept.append(made)
    return made


def _masked(docs: DataFrame, common: list) -> DataFrame:
    """(id, mask, others): the words of ``common`` as bits, and all others in order."""
    if not common:
        return docs.select("id", F.lit(0).cast("long").alias("mask"), F.array_sort("words").alias("others"))
    bits = {w: (1 << i) if i < 63 else -(1 << 63) for i, w in enumerate(common)}
    mask = F.aggregate("words", F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(F.coalesce(_value(w, bits), F.lit(0).cast("long"))))
    return docs.select("id", mask.alias("mask"), F.array_sort(F.filter("words", lambda w: ~w.isin(common))).alias("others"))


def _bits(words: Column) -> Column:
    """Bits of hashed words; two sets without a bit in common have no word in common."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(w, F.lit(64)).cast("int"))))


def _partners(masked: DataFrame, groups: DataFrame) -> DataFrame:
    all_masks = groups.toArrow()  # at most 2 MB
    shared = masked.sparkSession.sparkContext.broadcast(tuple(all_masks.column(c).to_numpy() for c in ("mask", "count")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others, rows = shared.value
        for b in batches:
            mine = b.column(0).to_numpy()
            n = np.array([rows[np.bitwise_count((m & others).view(np.uint64)) >= 2].sum() for m in mine], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n - (np.bitwise_count(mine.view(np.uint64)) >= 2))], ["mask", "by_mask"])

    by_mask = groups.select("mask").repartition(1 + len(all_masks) // 2048, "mask").mapInArrow(count, "mask long, by_mask long")
    index = masked.select("id", "mask", "others", F.posexplode("others").alias("at", "word"))
    # words before and after the one under which two documents meet, as bits: where they have none in common, the words needn't be compared
    before, after = (_bits(part) for part in (F.slice("others", F.lit(1), F.col("at")), F.slice("others", F.col("at") + 2, F.size("others"))))
    index = index.select("id", "mask", "others", "word", before.alias("before"), after.alias("after"))
    # few bytes, much work: as many tasks as that takes
    index = index.repartition(1 + min(4096, masked.count() // 1024), "word")
    sides = [index.select("word", *(F.col(c).alias(s + c) for c in ("id", "mask", "others", "before", "after"))) for s in "xy"]
    same = lambda c: F.col("x" + c).bitwiseAND(F.col("y" + c))
    bits, both = F.bit_count(same("mask")), F.array_intersect("xothers", "yothers")
    enough = (bits == 1) | ((same("after") != 0) & (F.size(both) >= 2))
    first = (same("before") == 0) | (F.get(both, F.lit(0)) == F.col("word"))
    met = sides[0].join(sides[1], "word").where((F.col("xid") != F.col("yid")) & (bits < 2) & enough & first)
    found = met.groupBy(F.col("xid").alias("id")).agg(F.count("*").alias("by_word"))
    total = F.col("by_mask") + F.coalesce("by_word", F.lit(0).cast("long"))
    return masked.join(by_mask, "mask").join(found, "id", "left").select("id", total.alias("n_partners")).where("n_partners > 0")


def character_overlap(left: str, right: str):
    """Distinct characters in both divided by those of the smaller set; 0 where either text is empty or null."""
    a, b = (F.array_distinct(F.filter(F.split(F.coalesce(F.col(x), F.lit("")), ""), lambda c: c != "")) for x in (left, right))
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))

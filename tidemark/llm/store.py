"""A history that is kept in tables: new batches are looked up in it, and what is accepted is appended.

A part of the history is a folder with four tables: ``groups`` (kind, g, id: the text or the url of each row), ``texts`` (node, num, text, runs, parities),
``chunks`` (``history.chunk_packs``) and ``counts`` of the chunks.  The first two lie in folders by bucket of their key and the chunks in columns by bucket, of which
a batch reads those it has keys in.  All tables of a part become visible at once, when the list of parts is replaced.  One writer at a time; ``compact`` makes one part of many.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import history as H
from tidemark.llm import near
from tidemark.llm import shingles as S
from tidemark.scratch import place, scope, stored
from tidemark.sinks import versioned

#: Folders of a table, and buckets of the table of counts (16 MB).
BUCKETS, PLACES = 16, 1 << 22
#: Bytes of a row group of the table of chunks, whose rows are large.
GROUP = 16 << 20
#: Bit of a text's number where that of its part begins; below are the partition (17 bits) and the place in it.
SERIAL_AT = near.PLACE_BITS + 17
_TABLES = {"groups": "kind int, g long, id long", "texts": f"node long, num long, text string, runs int, {', '.join(w + ' long' for w in near.WORDS)}"}


class History:
    """Accepted rows in ``where``, a folder that all executors share.

    A row repeats another if their urls agree (``history.same_url`` of ``history.bare_url``) or the plain forms of ``columns`` share ``least`` of their
    runs.  Null urls and rows without text repeat nothing by that field; rows with a null id are ignored.
    """

    def __init__(self, spark: SparkSession, where: str, record: str, url: str, columns: tuple[str, ...], least: float = 0.7) -> None:
        self.spark, self.where, self.record, self.url, self.columns, self.least = spark, where.rstrip("/"), record, url, columns, least

    def parts(self) -> list[str]:
        return [p for p in (versioned.pointed(self.spark, self.where) or "").split("\n") if p]

    def _read(self, name: str, keys: DataFrame | None = None, key: str = "node") -> DataFrame | None:
        """A table of all parts; of its buckets only those that ``keys`` fall into."""
        made = None
        for part in self.parts():  # each read on its own, so that its bucket folders are found
            one = self.spark.read.schema(f"{_TABLES[name]}, bucket int").parquet(f"{self.where}/{part}/{name}")
            made = one if made is None else made.unionByName(one)
        if made is None:
            return None
        if keys is not None:
            held = [r[0] for r in keys.select(F.pmod(F.col(key), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # at most BUCKETS
            if len(held) < BUCKETS:
                made = made.where(F.col("bucket").isin(held) if held else F.lit(False))
        return made

    def _chunks(self, keys: DataFrame | None = None) -> list[DataFrame]:
        """The table of chunks of each part; of its buckets only those that ``keys`` fall into."""
        held = range(H.BUCKETS) if keys is None else sorted(r[0] for r in keys.select(F.pmod("key", F.lit(H.BUCKETS)).cast("int")).distinct().collect())
        columns = ["texts", *(f"k{i}" for i in held)]
        return [self.spark.read.schema(H.PACKED_DDL).parquet(f"{self.where}/{part}/chunks").select(columns) for part in self.parts()]

    def _texts(self, batch: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
        """(id, site, node) of rows with an id, stored; their texts; counts of their chunks."""
        with scope() as kept:  # what was read isn't needed beside the tables made of it
            named = batch.where(F.col(self.record).isNotNull()).select(F.col(self.record).cast("long").alias("id"), self.url, *self.columns)
            ids, texts, counts = near.read_texts(named, "id", self.columns, PLACES, H.chunk_keys)
            # each made once for a row: not in one step, nor before a filter, which would make it again
            sites = named.select("id", H.bare_url(F.col(self.url)).alias("bare")).select("id", H.same_url(F.col("bare")).alias("site"))
            # no two parts give a number twice
            texts = stored(texts.withColumn("num", F.col("num") + F.lit((1 + self._serial()) << SERIAL_AT)))
            rows = stored(ids.join(sites, "id", "full").where("site is not null or node is not null").select("id", "site", "node"))
            kept += [rows, texts]
        return rows, texts, counts

    def _serial(self) -> int:
        """The largest number of a part so far, which its name gives."""
        names = [p.split("-") for p in self.parts()]
        if any(len(n) != 3 or n[0] != "packed" for n in names):
            raise ValueError(f"{self.where} was written before chunks were packed; load it anew")
        return max((int(n[1]) for n in names), default=0)

    def _append(self, rows: DataFrame, texts: DataFrame, chunks: DataFrame, counts: np.ndarray, instead: bool = False) -> None:
        """Write a part and name it, with those before it or ``instead`` of them; until then nobody sees any of its tables."""
        name = f"packed-{self._serial() + (not instead)}-{uuid.uuid4().hex}"
        path = f"{self.where}/{name}"
        groups = [rows.where(F.col(c).isNotNull()).select(F.lit(i).alias("kind"), F.col(c).alias("g"), "id") for i, c in enumerate(("node", "site"))]
        for table, df, key in (("groups", groups[0].unionByName(groups[1]), "g"), ("texts", texts, "node")):
            df.withColumn("bucket", F.pmod(F.col(key), F.lit(BUCKETS)).cast("int")).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{table}")
        chunks.write.option("compression", "none").option("parquet.block.size", GROUP).parquet(f"{path}/chunks")  # blocks are compressed
        self.spark.createDataFrame(S.packed(counts), "segment int, counts binary").coalesce(1).write.parquet(f"{path}/counts")
        versioned.point(self.spark, self.where, "\n".join([*([] if instead else self.parts()), name]))

    def load(self, rows: DataFrame) -> None:
        """Accept all ``rows`` as they are, repeats among them too."""
        with scope():
            named, texts, counts = self._texts(rows)
            self._append(named, texts, H.chunk_packs(texts), counts)

    def compact(self) -> None:
        """Make one part of all; the old ones stay until nobody reads them and are then to be deleted by hand."""
        if len(self.parts()) > 1:
            groups = self._read("groups")
            rows = groups.select("id", *(F.when(F.col("kind") == i, F.col("g")).alias(c) for i, c in enumerate(("node", "site"))))
            self._append(rows, self._read("texts").drop("bucket"), reduce(DataFrame.unionByName, self._chunks()), self.counts(), instead=True)

    def counts(self) -> np.ndarray:
        """How many texts of the history have a chunk, by bucket of a table of bounded size."""
        total = np.zeros(PLACES, dtype="<u4")
        for part in self.parts():
            total += S.unpacked(self.spark.read.parquet(f"{self.where}/{part}/counts"), PLACES)
        return total

    def accept(self, batch: DataFrame) -> DataFrame:
        """(accepted_id, <record>) of the rows of ``batch`` that repeat an accepted one; all others are accepted and appended.

        Accepted are the rows of the history and each row of the batch with a smaller id that isn't itself a repeat;
        ``accepted_id`` is the smallest id of those a row repeats.
        """
        with scope() as kept:
            rows, texts, fresh = self._texts(batch)
            counts = self.counts() + fresh
            probes = stored(H.probes(texts, counts))
            wanted = S.presence(probes.select("key"), asked := probes.count())
            met = stored(H.meeting(probes, [H.chunk_packs(texts), *self._chunks(probes)], counts, wanted, self.least, asked))
            old = self._read("texts")
            every = texts if old is None else texts.unionByName(old.select(texts.columns))
            some = stored(near.among(met, every))
            pairs = stored(near.may_share(met, some, self.least))
            links = stored(near.confirmed(pairs, some, self.least).distinct())
            repeats = stored(H.settled(self._known(rows, links), links).withColumnRenamed("id", self.record))
            kept.append(repeats)
            accepted = stored(rows.join(repeats.select(F.col(self.record).alias("id")), "id", "left_anti"))
            nodes = stored(accepted.where("node is not null").select("node").distinct())
            new = stored(texts.join(nodes, "node", "left_semi"))
            self._append(accepted, new, H.chunk_packs(new), fresh)
        return repeats

    def _known(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        """``rows`` with ``old``, the smallest row of the history of the same text, a linked text, or the same url."""
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        named = rows.where("node is not null").select("id", F.col("node").alias("g"))
        seen = named.unionByName(named.join(ways, F.col("g") == F.col("a")).select("id", F.col("b").alias("g"))).select("id", F.lit(0).alias("kind"), "g")
        seen = seen.unionByName(rows.where("site is not null").select("id", F.lit(1).alias("kind"), F.col("site").alias("g")))
        groups = self._read("groups", seen, "g")
        if groups is None:
            return rows.withColumn("old", F.lit(None).cast("long"))
        first = groups.groupBy("kind", "g").agg(F.min("id").alias("old"))
        found = seen.join(first, ["kind", "g"]).groupBy("id").agg(F.min("old").alias("old"))
        return rows.join(found, "id", "left")


def repeated(accepted: DataFrame, incoming: DataFrame, record: str, url: str, columns: tuple[str, ...], least: float = 0.7) -> DataFrame:
    """(accepted_id, <record>): the rows of ``incoming`` that repeat a row of ``accepted`` or an accepted one of their own.

    ``accepted`` is loaded into a history, ``incoming`` is looked up in it and appended.
    """
    spark = incoming.sparkSession
    with scope() as kept:  # the history ends with it
        history = History(spark, place(spark, "history-"), record, url, columns, least)
        history.load(accepted)
        repeats = history.accept(incoming)
        kept.append(repeats)
    return repeats

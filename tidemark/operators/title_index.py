"""A stored index of titles: posting lists of their rarest grams, probed with a batch's titles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .block import compared, may_be_alike, prefix_size, title_features

#: Before a fingerprint among the grams, so that equal ones meet too; no gram begins with it.
PRINT = "\x01"


@dataclass
class TitleIndex:
    """Folders ``order`` (g, c: how many titles had a gram when the index was built, which fixes
    the order for good) and ``postings`` (g, place, n, title), both in partitions by the hash of
    the gram. A title is listed under the rarest of its grams alone: those without which it
    cannot be over the gate; grams that were not there at first count as rarest."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("g"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _read(self, table: str, buckets: list[int]) -> DataFrame:
        """A table's rows in some buckets; the files of others are not opened."""
        return self.spark.read.parquet(f"{self.path}/{table}").filter(F.col("bucket").isin(buckets))

    def _buckets_of(self, grams: DataFrame) -> list[int]:
        return sorted(r.bucket for r in grams.select(self._bucket()).distinct().toLocalIterator())

    def build(self, titles: DataFrame) -> None:
        """Start the index anew with ``titles`` (title)."""
        features = materialise(title_features(titles.filter("title IS NOT NULL").distinct()), "index-titles")
        counts = features.select(F.explode("words").alias("g")).groupBy("g").agg(F.count("*").alias("c"))
        counts.withColumn("bucket", self._bucket()).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/order")
        self._write(self._placed(features), "overwrite")

    def add(self, titles: DataFrame) -> None:
        """List titles that are not there yet."""
        features = materialise(title_features(titles.filter("title IS NOT NULL").distinct()), "index-titles")
        prints = features.select("title", F.concat(F.lit(PRINT), "fingerprint").alias("g"))
        known = self._read("postings", self._buckets_of(prints)).join(prints, ["g", "title"], "left_semi").select("title")
        self._write(self._placed(materialise(features.join(known, "title", "left_anti"), "index-new")), "append")

    def _write(self, postings: DataFrame, mode: str) -> None:
        held = postings.withColumn("bucket", self._bucket()).repartition(F.col("bucket")).sortWithinPartitions("bucket", "g")
        held.write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/postings")

    def _placed(self, features: DataFrame) -> DataFrame:
        """(g, place, n, title): the grams of each title up to its prefix, the rarest first, and its
        fingerprint."""
        grams = materialise(features.select("title", F.size("words").alias("n"), F.explode("words").alias("g")), "index-grams")
        order = self._read("order", self._buckets_of(grams)).select("g", "c")
        rarest = Window.partitionBy("title").orderBy(F.coalesce("c", F.lit(0)), "g")
        placed = grams.join(order, "g", "left").withColumn("place", F.row_number().over(rarest))
        placed = placed.filter(F.col("place") <= prefix_size(F.col("n"))).select("g", "place", "n", "title")
        prints = features.select(F.concat(F.lit(PRINT), "fingerprint").alias("g"), F.lit(0).alias("place"), F.size("words").alias("n"), "title")
        return placed.unionByName(prints)

    def probe(self, titles: DataFrame) -> DataFrame:
        """(l_title, r_title, similarity, same_print): for each of ``titles`` the listed ones like it,
        as ``similar_titles`` tells. Only buckets of the probe's rare grams are read, and only
        titles that pass the filters of length and place are compared."""
        features = materialise(title_features(titles.filter("title IS NOT NULL").distinct()), "probe-titles")
        placed = materialise(self._placed(features), "probe-grams")
        l, r = (df.select("g", *[F.col(c).alias(f"{s}_{c}") for c in ("place", "n", "title")]) for s, df in (("l", placed), ("r", self._read("postings", self._buckets_of(placed)))))
        met = l.join(r, "g").filter(F.col("g").startswith(PRINT) | may_be_alike())
        pairs = materialise(met.select("l_title", "r_title").distinct(), "probe-pairs")
        listed = title_features(pairs.select(F.col("r_title").alias("title")).distinct())
        return compared(pairs, features, listed)

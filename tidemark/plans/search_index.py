"""A stored index for the feed's search: posting lists of three-character grams of the searched text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_text

GRAM = 3
#: Characters of all texts for which every bucket gets one more task.
SHARE = 1 << 24


def event_text() -> Column:
    return search_text(*map(F.col, ("title", "title_zh", "summary", "summary_zh")))


def literal_parts(pattern: str) -> list[str]:
    """What stands between the wildcards of a pattern (% and _, a backslash before one makes it plain)."""
    parts = [""]
    for token in re.findall(r"\\.|[%_]|[^\\%_]+|\\$", pattern, re.S):
        if token in "%_":
            parts.append("")
        else:
            parts[-1] += token[1:] if token[0] == "\\" and len(token) == 2 else token
    return [p for p in parts if p]


@dataclass
class SearchIndex:
    """(g, id) in partitions by the hash of the gram; texts in lower case."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def _postings(self, rows: DataFrame) -> DataFrame:
        text = F.lower(F.col("text"))
        n = F.greatest(F.length(text) - (GRAM - 1), F.lit(0))
        grams = F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, GRAM))))
        return rows.select("id", F.explode(grams).alias("g")).withColumn("bucket", self._bucket(F.col("g")))

    def build(self, events: DataFrame) -> None:
        self._write(events, "overwrite")

    def add(self, events: DataFrame) -> None:
        """Events that are new; one whose text changed may be added again, as candidates are verified."""
        self._write(events, "append")

    def _write(self, events: DataFrame, mode: str) -> None:
        """A bucket is dealt out by id over tasks, as many as the characters take: a gram that all
        texts have would bring a row for each event to the one task of its bucket."""
        rows = events.select("id", event_text().alias("text"))
        parts = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARE
        task = (F.col("bucket") * parts + F.pmod(F.xxhash64("id"), F.lit(parts))).cast("int")
        few = rows.repartition(4 * parts, "id")  # what a task makes of its rows stays small too
        held = self._postings(few).repartitionById(self.buckets * parts, task).sortWithinPartitions("bucket", "g", "id")
        held.write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/grams")

    def candidates(self, q: str) -> DataFrame | None:
        """(id) of texts that hold all grams of the pattern's literal parts; None where no part is
        long enough to tell."""
        lower = self.spark.range(1).select(F.lower(F.lit(q))).first()[0]
        grams = sorted({p[i : i + GRAM] for p in literal_parts(lower) for i in range(len(p) - GRAM + 1)})
        if not grams:
            return None
        row = self.spark.range(1).select(F.array_distinct(F.array(*[self._bucket(F.lit(g)) for g in grams]))).first()
        held = self.spark.read.parquet(f"{self.path}/grams").filter(F.col("bucket").isin(list(row[0])) & F.col("g").isin(grams))
        return held.groupBy("id").agg(F.count_distinct("g").alias("n")).filter(F.col("n") == len(grams)).select("id")

    def search(self, events: DataFrame, q: str) -> DataFrame:
        """The events whose text matches ``%q%`` without regard to case: candidates by the index, each
        verified; without candidates all events are read."""
        found = self.candidates(q)
        rows = events if found is None else events.join(found, "id", "left_semi")
        return rows.filter(event_text().ilike(f"%{q}%"))

"""Importance resampling of documents towards a target text, by hashed n-grams of words.

Each slice of texts is a sequence of word ids; its suffixes, sorted by their first words, bring
equal n-grams together as runs of a common prefix. An n-gram is hashed once for each run, and
what belongs to its bucket goes back from the run to all its occurrences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, materialise, small_batches, text_of, texts_of

WORDS, BUCKETS = 3, 10_000
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of a text that are part of no word become blanks, A-Z lower case.
_TABLE = bytes(b if b > 0x7F or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), UPPER.lower().encode()))


@lru_cache(maxsize=4096)
def _zeros_table(length: int) -> np.ndarray:
    """What ``length`` zero bytes make of a CRC, by each of its four bytes: it is linear."""
    zeros = bytes(length)
    still = zlib.crc32(zeros)
    bits = [zlib.crc32(zeros, 1 << i) ^ still for i in range(32)]
    table = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for i in range(8):
            table[k, 1 << i : 2 << i] = table[k, : 1 << i] ^ bits[8 * k + i]
    return table


class Slice:
    """The words of some texts and the runs of equal n-grams among them."""

    def __init__(self, texts: list[bytes], words: int = WORDS) -> None:
        split = [t.translate(_TABLE).split() for t in texts]
        known: dict[bytes, int] = {}
        flat = [known.setdefault(w, len(known)) for part in split for w in part]
        self.lengths = np.array([len(part) for part in split], np.int64)
        self.ids = np.array(flat, np.int64)
        self.words = words
        crcs = [zlib.crc32(w) for w in known]
        spaced = [zlib.crc32(w, zlib.crc32(b" ")) for w in known]
        sizes, self.size_of = np.unique(np.array([len(w) + 1 for w in known], np.int64), return_inverse=True)
        self.crc, self.spaced = np.array(crcs, np.uint32), np.array(spaced, np.uint32)
        self.tables = np.stack([_zeros_table(int(n)) for n in sizes]) if len(sizes) else np.zeros((0, 4, 256), np.uint32)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(places of the suffixes in the order of their first words, words that each has in common
        with the one before). A suffix ends with its text; what differs beyond the first words
        does not matter, so they are sorted by these alone."""
        n = len(self.ids)
        ends = np.repeat(np.cumsum(self.lengths), self.lengths)
        rank = self.ids + 1
        columns = [rank]
        for k in range(1, self.words):
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - k)] = rank[k:]
            ahead[np.arange(n) + k >= ends] = 0
            columns.append(ahead)
        order = self._sorted(columns)
        common = np.zeros(n, np.int64)
        equal = np.ones(max(0, n - 1), bool)
        for column in columns:
            held = column[order]
            equal &= (held[1:] == held[:-1]) & (held[1:] > 0)
            common[1:] += equal
        return order, common

    def _sorted(self, columns: list[np.ndarray]) -> np.ndarray:
        bits = max(1, int(len(self.crc) + 1).bit_length())
        if bits * len(columns) <= 63:  # all words of a suffix in one key
            key = columns[0]
            for column in columns[1:]:
                key = key << bits | column
            return np.argsort(key)
        return np.lexsort(columns[::-1])

    def buckets(self, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
        """For n-grams of one word, two, ...: the bucket at each place where one begins, -1 where
        the text ends sooner."""
        n = len(self.ids)
        order, common = self.suffixes()
        left = np.repeat(np.cumsum(self.lengths), self.lengths) - np.arange(n)
        for k in range(1, self.words + 1):
            out = np.full(n, -1, np.int64)
            starts = np.flatnonzero(common < k)  # where a run of suffixes with k words in common begins
            place = order[starts]
            whole = left[place] >= k  # else the run is of one suffix that is too short
            starts_at = place[whole]
            crc = self.crc[self.ids[starts_at]]
            for j in range(1, k):
                word = self.ids[starts_at + j]
                table = self.size_of[word]
                shifted = self.spaced[word]
                for b in range(4):
                    shifted = shifted ^ self.tables[table, b, crc >> (8 * b) & 0xFF]
                crc = shifted
            of_run = np.full(len(starts), -1, np.int64)
            of_run[whole] = crc.astype(np.int64) % buckets
            out[order] = np.repeat(of_run, np.diff(np.append(starts, n)))
            yield out


def bucket_counts(docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many n-grams of up to ``words`` words fall into each bucket. Null and empty
    texts have none, an empty table gives no row; a very long text is read whole. A task adds up
    its counts, so what is exchanged is at most a row for each bucket and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in small_batches(batches, "text"):
            for found in Slice(texts_of(batch, "text"), words).buckets(buckets):
                total += np.bincount(found[found >= 0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """For each bucket floor(1000 ln(((t+1)(S+B)) / ((s+1)(T+B)))) from the ``bucket_counts`` of the
    target (t, of T) and of the corpus (s, of S). The driver gets a row for each bucket."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for held, counts in ((s, corpus), (t, target)):
        for r in counts.toLocalIterator():
            held[r.bucket] = r.n
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def weights(docs: DataFrame, gain: list[int], words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row: the sum of its n-grams' gains. Null and
    empty texts have no words and weight 0; repeated rows give equal rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gained = np.array([*gain, 0], np.int64)  # the last stands for no n-gram
        for batch in small_batches(batches, "text"):
            part = Slice(texts_of(batch, "text"), words)
            at = np.zeros(len(part.ids) + 1, np.int64)
            for found in part.buckets(len(gain)):
                at[1:] += gained[found]
            bounds = np.concatenate([[0], np.cumsum(part.lengths)])
            summed = np.cumsum(at)[bounds]
            features = sum(np.maximum(part.lengths - k, 0) for k in range(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(part.lengths), pa.array(features), pa.array(np.diff(summed))], ["doc_id", "n_words", "n_features", "weight"]
            )

    given = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``scored`` (doc_id, score, eligible, ...) with rank: 1, 2, ... for the ``drawn`` eligible rows
    of the highest scores, ties to the smaller id, null for all others.

    Rows are exchanged by ranges of (score, id), so one score that many share is spread too. A
    rank is the place in the row's range plus the rows of the ranges before; the driver gets a
    row for each range."""
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id")]
    by_range = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    placed = materialise(by_range.withColumn("part", F.shiftright(number, 33)).withColumn("place", number.bitwiseAND((1 << 33) - 1)), "resample-places")
    before, shift = [], 0
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n")).toLocalIterator(), key=lambda r: r.part):
        before.append((r.part, shift))
        shift += r.n
    shifts = F.broadcast(spark.createDataFrame(before, "part long, shift long"))
    rank = F.col("place") + F.col("shift") + 1
    return placed.join(shifts, "part").withColumn("rank", F.when(F.col("eligible") & (rank <= drawn), rank)).drop("part", "place", "shift")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, words: int = WORDS, buckets: int = BUCKETS,
    seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row.

    A row's weight is the sum of its n-grams' gains; its score adds a Gumbel draw that the hash
    of ``<seed>:<id>`` gives, so that the highest scores are a sample without replacement in
    proportion to exp(weight / 1000). Of the rows with at least ``least_words`` words, ``percent``
    in a hundred (rounded down) are drawn and have a rank. A null id counts as empty in the hash
    and comes first among ties; rows that repeat an id and a score have ranks in any order.
    Words are compared after lower-casing A-Z; null texts have none. An empty target gives all
    n-grams the gains of t = 0, an empty table gives an empty one. Every text is read whole and
    twice: once for the counts, once for the scores, which need all counts.
    """
    gain = gains(bucket_counts(docs, words, buckets, text_col), bucket_counts(target, words, buckets, target_col), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    found = weights(docs, gain, words, id_col, text_col)
    scored = materialise(found.withColumn("score", F.col("weight") + gumbel).withColumn("eligible", F.col("n_words") >= least_words), "resample-scores")
    drawn = percent * scored.filter("eligible").count() // 100
    return ranked(scored, drawn).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def selected(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose ids are drawn, all columns; rows that repeat a drawn id all stay."""
    drawn = resample(docs, target, id_col=id_col, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(drawn, id_col, "left_semi")


def oracle_sql(percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = 42) -> str:
    """DuckDB SQL for the rows of ``resample`` of documents towards benchmark: n-grams as text, the
    CRC of each distinct one byte by byte from the table that eight shifts of each byte give."""

    def words_of(table: str) -> str:
        lower = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
        return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"

    def grams(key: str, table: str) -> str:
        two, three = (" || ' ' || ".join(f"w[i + {k}]" for k in range(1, n + 1)) for n in (2, 3))
        parts = [f"SELECT {key}, {text} AS g FROM (SELECT {key}, w, unnest(range(greatest(len(w) - {n}, 0))) AS i FROM {table})" for n, text in enumerate(("w[i + 1]", two, three))]
        return " UNION ALL ".join(parts)

    return f"""
        WITH RECURSIVE bits(b, i, c) AS (
            SELECT range, 0, range FROM range(256)
            UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE i < 8
        ), crcs AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
        d AS MATERIALIZED (SELECT doc_id, {words_of('documents')}), e AS MATERIALIZED (SELECT item_id, {words_of('benchmark')}),
        dg AS MATERIALIZED ({grams('doc_id', 'd')}), eg AS MATERIALIZED ({grams('item_id', 'e')}),
        h AS MATERIALIZED (
            SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(g))), lambda k: CAST('0x' || substr(hex(encode(g)), 2 * k + 1, 2) AS BIGINT))),
                                      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {buckets} AS bucket
            FROM (SELECT g FROM dg UNION SELECT g FROM eg), crcs
        ), s AS (SELECT bucket, count(*) AS n FROM dg JOIN h USING (g) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM eg JOIN h USING (g) GROUP BY bucket),
        gain AS (
            SELECT b.range AS bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM s) AS DOUBLE) + {buckets}))
                                                           / ((coalesce(s.n, 0) + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM t) AS DOUBLE) + {buckets})))) AS BIGINT) AS gain
            FROM range({buckets}) AS b LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range
        ), weight AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM dg JOIN h USING (g) JOIN gain USING (bucket) GROUP BY doc_id),
        scored AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                   CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM d LEFT JOIN weight USING (doc_id)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id) AS place FROM scored
        )
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, n_features, weight, score,
               CASE WHEN n_words >= {least_words} AND place <= (SELECT {percent} * count(*) // 100 FROM scored WHERE n_words >= {least_words}) THEN place END AS rank
        FROM placed
    """

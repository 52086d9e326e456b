"""What the operators of this subpackage share: reading tables, written tables in
the shared folder, and slicing of Arrow batches to a bounded number of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import intermediates, kept, materialise, remove, shared_dir

__all__ = ["ascii_lower", "buckets_for", "crc_mod", "intermediates", "kept", "materialise", "read", "remove", "shared_dir", "small_batches", "text_of", "texts_of", "unused"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLICE_BYTES = 2 << 20
BUCKET_BYTES = 256 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def buckets_for(spark: SparkSession, size: int) -> int:
    """In how many buckets to write what is made of ``size`` bytes of text: one for each
    BUCKET_BYTES, at least as many as the session has shuffle partitions, at most as many as
    Spark allows."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(most, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that to a text of ASCII alone and is
    much cheaper than ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``column`` each (one row
    at least), so that a task's Python objects stay small however large a batch is."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of each row's text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]



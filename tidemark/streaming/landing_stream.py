"""Micro-batches of landed payloads into the store."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ingest
from ..plans.store import Store


def ingest_stream(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    store: Store,
    source: str,
    to_listings: Callable[[DataFrame], DataFrame],
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Take in what has landed since the last call, then stop; a scheduler calls it again.
    A batch is part of what the source has, so nothing is retired. The batch's number is the
    run's id: one that is run again after its run was logged is left out, and one that failed
    before merges into the same keys."""
    pages = (
        spark.readStream.schema("value string")
        .option("wholetext", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(landing)
        .select(F.col("value").alias("page"), F.col("_metadata.file_path").alias("name"))
    )

    def batch(df: DataFrame, number: int) -> None:
        run_id = f"{source}-batch-{number}"
        if store.runs().filter(F.col("id") == run_id).isEmpty():
            ingest(store, source, to_listings(df), clock(), complete=False, run_id=run_id)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

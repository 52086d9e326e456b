"""Source records as the state of a stream: what is new, changed, gone and back again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.text import content_hash
from ..operators.merge import record_id

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["source_slug", "external_id"]
#: Times are held as microseconds.
_TIMES = "first_seen_at long, last_seen_at long, gone_at long"
STATE = f"url string, raw string, content_hash string, {_TIMES}"
CHANGE = f"source_slug string, external_id string, change string, at long, {STATE}"


class Records(StatefulProcessor):
    """A record's state by (source_slug, external_id). Seen rows come first in their batch and move its
    timer on; a record that was not shown for so long meets its timer when the watermark has
    passed that time, and gets a tombstone of that time."""

    def __init__(self, every_seconds: float, schema: StructType) -> None:
        self.every, self.schema = round(every_seconds * 1e6), schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("record", self.schema)

    def _expect(self, last: int) -> None:
        for expiry in list(self.handle.listTimers()):
            self.handle.deleteTimer(expiry)
        self.handle.registerTimer((last + self.every) // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        source, external = key
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            held = self.state.get() if self.state.exists() else None
            first, kind = r.at, "new"
            if held is not None:
                _, _, old_hash, first, last, gone = held
                if r.at < last:  # an older crawl that comes late
                    continue
                kind = "revived" if gone is not None else "changed" if old_hash != r.content_hash else "same"
            self.state.update((r.url, r.raw, r.content_hash, first, r.at, None))
            self._expect(r.at)
            yield Row(source_slug=source, external_id=external, change=kind, at=r.at, url=r.url, raw=r.raw, content_hash=r.content_hash, first_seen_at=first, last_seen_at=r.at, gone_at=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        url, raw, digest, first, last, gone = self.state.get()
        missed = last + self.every
        if gone is None and expiredTimerInfo.getExpiryTimeInMs() >= missed // 1000:
            self.state.update((url, raw, digest, first, last, missed))
            yield Row(source_slug=key[0], external_id=key[1], change="gone", at=missed, url=url, raw=raw, content_hash=digest, first_seen_at=first, last_seen_at=last, gone_at=missed)

    def close(self) -> None:
        """Nothing is held besides the state."""


def record_changes(listings: DataFrame, every_seconds: float = 3600.0, late: str = "0 seconds") -> DataFrame:
    """A stream of CHANGE rows from a stream of listings with ``crawl_at``, the time of the crawl that
    showed them: of each listing whether its record is new, changed, the same or revived, and of
    records that were not shown for ``every_seconds``, that they are gone since then. A stream knows
    no complete crawl, only time: it should be as long as crawls may fail to come, and what is
    gone by mistake is revived when it is shown again. The state grows with the number of records and lies in the state store's files, keyed by record."""
    spark = listings.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    given = listings.select(*KEY, "url", "raw", content_hash(F.col("raw")).alias("content_hash"), "seq", F.col("crawl_at").cast("timestamp").alias("crawl_at"))
    given = given.withColumn("at", F.unix_micros("crawl_at"))
    keyed = given.withWatermark("crawl_at", late).groupBy(*KEY)
    found = keyed.transformWithState(Records(every_seconds, StructType.fromDDL(STATE)), StructType.fromDDL(CHANGE), outputMode="Update", timeMode="EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("at", "first_seen_at", "last_seen_at", "gone_at")})


def latest(changes: DataFrame) -> DataFrame:
    """Records (schema SOURCE_RECORD) as they stand after all changes."""
    order = F.struct("at", (F.col("change") != "gone").cast("int"))
    last = changes.groupBy(*KEY).agg(F.max_by(F.struct("url", "raw", "content_hash", "first_seen_at", "last_seen_at", "gone_at"), order).alias("r"))
    return last.select(record_id(F.col("source_slug"), F.col("external_id")).alias("id"), *KEY, "r.*")

"""Stored tables in partitions: a run writes those it touches, a manifest points to the rest."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.localtime import local_date

TABLES = {
    "events": "EVENT", "venues": "VENUE", "source_records": "SOURCE_RECORD", "event_links": "EVENT_LINK",
    "merge_reviews": "MERGE_REVIEW",
}
#: What is stored besides: an event's links and those to live records, and the day of a link's event.
EXTRA = {"events": "links int, live int", "event_links": "day string"}
KEYS = {"events": ["id"], "venues": ["id"], "source_records": ["id"], "event_links": ["source_record_id"], "merge_reviews": ["event_id", "candidate_event_id"]}
#: Manifests, and what they point to, that are kept for readers.
KEPT = 2
LOCK_SECONDS = 6 * 3600


class Busy(RuntimeError):
    """Another run of the source is under way."""


def table_schema(table: str) -> StructType:
    return getattr(schemas, TABLES[table])


def stored_schema(table: str) -> StructType:
    own = StructType(list(table_schema(table).fields))
    return StructType(own.fields + StructType.fromDDL(EXTRA[table]).fields) if table in EXTRA else own


def day_of(starts_at: Column) -> Column:
    """The partition of an event: the local day on which it starts, which never changes."""
    return F.coalesce(local_date(starts_at).cast("string"), F.lit("none"))


@dataclass
class Store:
    """Tables as Parquet in partitions, events by local day, the others by the hash of their key.

    A run writes new versions of the partitions it touches and then a manifest, a small file that
    names the version of every partition, so a reader sees all of a step or nothing, and files
    of other partitions stay as they are."""

    spark: SparkSession
    path: str
    buckets: int = 16

    # --- files
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str = "") -> list[str]:
        _, fs = self._fs()
        at = self._at(folder) if folder else self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _put(self, name: str, text: str) -> None:
        _, fs = self._fs()
        out = fs.create(self._at(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    # --- manifests
    def version(self) -> int:
        found = [re.fullmatch(r"manifest-(\d+)\.json", n) for n in self._names()]
        return max([0, *(int(m[1]) for m in found if m)])

    def manifest(self, version: int | None = None) -> dict[str, dict[str, int]]:
        """By table the version of each partition."""
        version = self.version() if version is None else version
        if not version:
            return {}
        jvm, fs = self._fs()
        source = fs.open(self._at(f"manifest-{version}.json"))
        try:
            held = json.loads(jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()
        self.buckets = held["buckets"]
        return held["tables"]

    # --- tables
    def part(self, table: str) -> Column:
        """The partition of a row."""
        if table == "events":
            return day_of(F.col("starts_at"))
        keys = KEYS[table]
        if table == "merge_reviews":  # a pair has no order
            keys = [F.least(*keys), F.greatest(*keys)]
        return self.bucket(*keys)

    def bucket(self, *keys: Column | str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("string")

    def stored(self, table: str, only: list[str] | None = None) -> DataFrame:
        """A table with all that is stored, from the named partitions alone where some are named."""
        held = self.manifest().get(table, {})
        paths = [f"{self.path}/{table}/v{v}/p={p}" for p, v in sorted(held.items()) if only is None or p in only]
        if not paths:
            return self.spark.createDataFrame([], stored_schema(table))
        return self.spark.read.schema(stored_schema(table)).parquet(*paths)

    def read(self, table: str) -> DataFrame:
        return self.stored(table).select(*[f.name for f in table_schema(table)])

    def days(self, first: str, last: str) -> list[str]:
        return [p for p in self.manifest().get("events", {}) if first <= p <= last]

    def apply(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]]) -> None:
        """By table (rows that replace those of their key or are new, rows to be deleted); both with
        the columns that tell key and partition. Only partitions with a change are read and written."""
        tables = {k: dict(v) for k, v in self.manifest().items()}
        version, touched_any = self.version() + 1, False
        for name, (rows, gone) in changes.items():
            p, keys = self.part(name), KEYS[name]
            marks = [df.select(*keys, p.alias("p")) for df in (rows, gone) if df is not None]
            if not marks:
                continue
            mark = marks[0] if len(marks) == 1 else marks[0].union(marks[1])
            touched = sorted(r.p for r in mark.select("p").distinct().toLocalIterator())
            if not touched:
                continue
            touched_any = True
            content = self.stored(name, touched).join(mark.select(*keys), keys, "left_anti")
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in stored_schema(name)]
            content = content.select(*columns) if rows is None else content.select(*columns).unionByName(rows.select(*columns))
            content.withColumn("p", p).hint("rebalance", "p").write.partitionBy("p").parquet(f"{self.path}/{name}/v{version}")
            written = [n[2:] for n in self._names(f"{name}/v{version}") if n.startswith("p=")]
            held = tables.setdefault(name, {})
            for part in touched:
                held.pop(part, None)
            held.update({part: version for part in written})
        if touched_any:
            self._put(f"manifest-{version}.json", json.dumps({"buckets": self.buckets, "tables": tables}))
            self._forget(version)

    def _forget(self, version: int) -> None:
        """Remove manifests but the last ones, and versions of which they name no partition."""
        _, fs = self._fs()
        kept = [v for v in range(max(1, version - KEPT + 1), version + 1) if fs.exists(self._at(f"manifest-{v}.json"))]
        manifests = [self.manifest(v) for v in kept]
        for name in self._names():
            if (m := re.fullmatch(r"manifest-(\d+)\.json", name)) and int(m[1]) not in kept:
                fs.delete(self._at(name), False)
        for table in TABLES:
            used = {(v, p) for m in manifests for p, v in m.get(table, {}).items()}
            for folder in self._names(table):
                v = int(folder[1:])
                if v > version:
                    continue
                parts = [n for n in self._names(f"{table}/{folder}") if n.startswith("p=")]
                left = [n for n in parts if (v, n[2:]) in used]
                for n in parts if left else []:
                    if n not in left:
                        fs.delete(self._at(f"{table}/{folder}/{n}"), True)
                if not left:
                    fs.delete(self._at(f"{table}/{folder}"), True)

    # --- runs
    def runs(self) -> DataFrame:
        """The log of runs: of each the last that was said of it."""
        if "ingest_runs" not in self._names():
            return self.spark.createDataFrame([], schemas.INGEST_RUN)
        rows = self.spark.read.schema(schemas.INGEST_RUN).parquet(f"{self.path}/ingest_runs")
        said = F.struct(F.col("status") != "running", "finished_at")
        return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), said).alias("r")).select("r.*")

    def add_run(self, source: str, now: datetime, stats: dict, error: str | None = None, run_id: str | None = None, running: bool = False) -> str:
        """Log a run: that it has begun, or how it ended."""
        run_id = run_id or f"{source}-{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        counters = ("fetched", "created", "updated", "merged", "flagged", "skipped")
        status = "running" if running else "failed" if error else "ok"
        row = self.spark.range(1).select(
            F.lit(run_id).alias("id"), F.lit(source).alias("source_slug"), F.lit(status).alias("status"),
            *[F.lit(stats.get(k, 0)).cast("long").alias(k) for k in counters], F.lit(error).cast("string").alias("error"), F.lit(now).alias("started_at"),
            F.lit(None if running else now).cast("timestamp").alias("finished_at"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/ingest_runs")
        return run_id

    @contextmanager
    def only_run(self, source: str) -> Iterator[None]:
        """Around a run: a source has one at a time. A lock that is hours old was left by a run
        that died."""
        _, fs = self._fs()
        name = f"locks/{source}"
        if fs.exists(self._at(name)) and time.time() - fs.getFileStatus(self._at(name)).getModificationTime() / 1000 > LOCK_SECONDS:
            fs.delete(self._at(name), False)
        try:
            self._put(name, "")
        except Py4JJavaError as error:
            raise Busy(f"{source} is being run") from error
        try:
            yield
        finally:
            fs.delete(self._at(name), False)

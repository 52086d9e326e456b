"""Runs of sources over stored tables: records, venues, events, links, reviews."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.geo import nearest_city
from ..functions.text import infer_category, title_fingerprint, venue_key
from ..operators import merge
from ..operators.block import WINDOW_SECONDS
from ..operators.report import counters
from ..operators.resolve import resolve
from ..sources.landing import HORIZON_DAYS, enabled_sources, source_config, with_horizon
from ..storage import intermediates, kept, materialise
from .store import Busy, Store, day_of, stored_schema

STALE_HOURS = 6
#: A failed run is tried again so many times, each time after twice as long.
RETRIES, BACKOFF_SECONDS = 2, 30.0
COUNTERS = ("fetched", "created", "updated", "merged", "flagged", "skipped")


def with_last_run(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources with the end of their last run."""
    last = runs.groupBy(F.col("source_slug").alias("slug")).agg(F.max("finished_at").alias("last_run_at"))
    return sources.drop("last_run_at").join(last, "slug", "left")


def prepare(listings: DataFrame, now: datetime) -> DataFrame:
    """Adds what the merge needs: whether it is stale, city, category, keys of venue and event."""
    city = F.coalesce("city_slug", nearest_city(F.col("point.lat"), F.col("point.lng")))
    key = merge.record_id(venue_key(F.col("venue_name")), F.coalesce("city_slug", F.lit("")))
    return (
        listings.withColumn("skipped", F.col("starts_at") < F.lit(now - timedelta(hours=STALE_HOURS)))
        .withColumn("city_slug", city)
        .withColumn("category", infer_category(F.col("category_hint"), F.col("title"), F.col("summary")))
        .withColumn("venue_id", F.when(F.col("venue_name").isNotNull(), key))
        .withColumn("record_id", merge.record_id(F.col("source_slug"), F.col("external_id")))
        .withColumn("id", F.sha2(F.concat_ws("\x1f", "record_id", F.col("starts_at").cast("string"), F.col("seq").cast("string")), 256))
        .withColumn("title_fingerprint", title_fingerprint(F.col("title")))
    )


def _parts(df: DataFrame, column) -> list[str]:
    """The partitions that rows are in: at most as many as the table has."""
    return sorted(r.p for r in df.select(column.alias("p")).distinct().toLocalIterator())


def ingest(store: Store, source: str, listings: DataFrame, now: datetime, complete: bool = True, run_id: str | None = None) -> dict:
    """Merge a batch of listings (schema LISTING, seq unique) of one source into the store and log
    it as a run. ``complete`` tells that the batch is all that the source has: see ``retire``.
    Gives the run's counters."""
    with intermediates(store.spark):
        stats, seen = take_in(store, listings, now)
        if complete:
            retire(store, source, seen, now)
    store.add_run(source, now, stats, run_id=run_id)
    return stats


def take_in(store: Store, listings: DataFrame, now: datetime) -> tuple[dict, DataFrame]:
    """Merge listings into the store, matched in the order of seq: (counters, (external_id) seen).

    Stored rows are read and written in the partitions of the batch's keys and, of events, of
    the days around it. Numbers of links follow from the links that are new or moved. The
    counters are observed while the batch and its outcome are written."""
    with intermediates(store.spark):
        return _take_in(store, listings, now)


def _take_in(store: Store, listings: DataFrame, now: datetime) -> tuple[dict, DataFrame]:
    at, batch_of, outcome_of = F.lit(now), Observation(), Observation()
    ahead = F.when(~F.col("skipped"), F.col("starts_at"))
    rows = prepare(listings, now).observe(
        batch_of, F.count("*").alias("fetched"), F.count_if("skipped").alias("skipped"), F.min(F.unix_seconds(ahead)).alias("low"), F.max(F.unix_seconds(ahead)).alias("high")
    )
    rows = kept(rows, "ingest-batch")
    stats = dict.fromkeys(COUNTERS, 0) | {k: batch_of.get[k] for k in ("fetched", "skipped")}
    seen = rows.select("external_id")
    if batch_of.get["low"] is None:
        return stats, seen
    fresh = rows.filter("not skipped")

    # records and links by the hash of the record's id
    parts = _parts(fresh, store.bucket("record_id"))
    ids = fresh.select(F.col("record_id").alias("id")).distinct()
    old_records = store.stored("source_records", parts).join(ids, "id", "left_semi")
    records = materialise(merge.upsert_records(old_records, fresh, at), "ingest-records")
    venue_ids = fresh.filter("venue_id IS NOT NULL").select(F.col("venue_id").alias("id")).distinct()
    old_venues = store.stored("venues", _parts(venue_ids, store.bucket("id"))).join(venue_ids, "id", "left_semi")

    # only events that a listing of the batch can meet: their days, then their times
    bounds = [F.timestamp_seconds(F.lit(batch_of.get[k] + d)) for k, d in (("low", -WINDOW_SECONDS), ("high", WINDOW_SECONDS + 1))]
    first, last = store.spark.range(1).select(*[day_of(b) for b in bounds]).first()
    around = store.stored("events", store.days(first, last)).filter((F.col("starts_at") >= bounds[0]) & (F.col("starts_at") <= bounds[1]))
    out = resolve(fresh, around.withColumnRenamed("source_url", "url")).drop("id")
    changed = records.select(F.col("id").alias("record_id"), "changed")
    linked = fresh.join(out, "seq").join(changed, "record_id").observe(outcome_of, *counters())
    linked = materialise(linked, "ingest-outcome")
    stats |= {k: outcome_of.get[k] for k in ("created", "updated", "merged", "flagged")}

    founders = linked.filter("outcome = 'created'").select(
        F.col("event_id").alias("id"), "title", F.lit(None).cast("string").alias("title_zh"), "summary",
        F.lit(None).cast("string").alias("summary_zh"), "category", "starts_at", "ends_at", "is_free", "price_from",
        F.lit("NZD").alias("currency"), "venue_id", "point", "city_slug", "cover_image_url", F.col("url").alias("source_url"),
        F.col("source_slug").alias("source_name"), F.lit(1).alias("source_count"), "popularity", "title_fingerprint",
        at.alias("created_at"), at.alias("updated_at"), F.lit(0).alias("links"), F.lit(0).alias("live"),
    )
    met = around.select(F.col("id").alias("event_id"), day_of(F.col("starts_at")).alias("day"))
    days = met.union(founders.select("id", day_of(F.col("starts_at"))))
    links = merge.link_records(
        store.spark.createDataFrame([], stored_schema("event_links")).drop("day"),
        linked.select(
            "event_id", F.col("record_id").alias("source_record_id"), F.col("confidence").cast("float").alias("confidence"),
            F.when(F.col("outcome") == "created", F.lit('{"origin":"new"}')).otherwise(F.col("signals")).alias("signals"), "seq",
        ),
    )
    links = materialise(links.join(days, "event_id"), "ingest-links")
    changes = materialise(merge.link_changes(records, store.stored("event_links", parts), links), "ingest-changes")

    # events that are met, and those that lose a link, wherever they are
    best = ["summary", "cover_image_url", "ends_at", "point", "price_from", "is_free", "popularity"]
    added = linked.filter("outcome = 'merged'").select("event_id", *best, "seq")
    touched = changes.select("event_id").union(added.select("event_id")).distinct()
    there = store.stored("events", sorted({*_parts(changes, F.col("day")), *store.days(first, last)}))
    base = there.join(touched, there["id"] == touched["event_id"], "left_semi").unionByName(founders)
    own = base.select(F.col("id").alias("event_id"), *[F.col(c).cast("double") if c == "price_from" else F.col(c) for c in best], F.lit(-1).cast("long").alias("seq"))
    merged = merge.best_of(own.unionByName(added)).withColumnRenamed("event_id", "id")
    events = merge.counted(base.drop(*best).join(merged, "id"), changes)

    flagged = linked.filter("review_id IS NOT NULL").select(
        "event_id", F.col("review_id").alias("candidate_event_id"), F.col("review_confidence").cast("float").alias("confidence"),
        F.col("review_signals").alias("signals"), F.lit(None).cast("string").alias("resolved"), "seq",
    )
    reviews = merge.new_reviews(store.stored("merge_reviews", _parts(flagged, store.part("merge_reviews"))), flagged)
    tables = {"events": events, "venues": merge.upsert_venues(old_venues, fresh), "source_records": records, "event_links": links, "merge_reviews": reviews}
    store.apply({name: (materialise(rows, f"ingest-{name}"), None) for name, rows in tables.items()})
    return stats, seen


def retire(store: Store, source: str, seen: DataFrame, now: datetime) -> None:
    """After a complete run: the source's live records that were not ``seen`` (external_id) get a
    tombstone, and events without a live record go with their links and reviews. Where nothing
    was seen nothing changes. Which events lose their last live record follows from the links of
    the records that are gone; for the others the stored number of live links is asked."""
    if seen.isEmpty():
        return
    with intermediates(store.spark):
        own = store.stored("source_records").filter((F.col("source_slug") == source) & F.col("gone_at").isNull()).select("id", "external_id")
        gone = materialise(own.join(seen.select("external_id").distinct(), "external_id", "left_anti").select("id"), "retire-gone")
        parts = _parts(gone, store.bucket("id"))
        records = store.stored("source_records", parts).join(gone, "id", "left_semi").withColumn("gone_at", F.lit(now))
        lost = store.stored("event_links", parts).join(gone, F.col("source_record_id") == F.col("id"), "left_semi")
        changes = materialise(merge.summed(lost.select("event_id", "day", F.lit(0).alias("links"), F.lit(-1).alias("live"))), "retire-changes")
        there = store.stored("events", _parts(changes, F.col("day")))
        events = materialise(merge.counted(there.join(changes, there["id"] == changes["event_id"], "left_semi"), changes), "retire-events")
        before = store.stored("events").filter("live <= 0").join(events, "id", "left_anti")
        orphans = materialise(events.filter("live <= 0").select("id", "starts_at").union(before.select("id", "starts_at")), "retire-orphans")
        steps = {"source_records": (records, None), "events": (events.filter("live > 0"), orphans)}
        if not orphans.isEmpty():
            links = store.stored("event_links").select("event_id", "source_record_id")
            steps["event_links"] = (None, links.join(orphans, links["event_id"] == orphans["id"], "left_semi"))
            reviews = store.stored("merge_reviews").select("event_id", "candidate_event_id")
            either = [reviews.join(orphans, reviews[c] == orphans["id"], "left_semi") for c in ("event_id", "candidate_event_id")]
            steps["merge_reviews"] = (None, either[0].union(either[1]).distinct())
        store.apply(steps)


def run_source(
    store: Store, sources: DataFrame, slug: str, fetch: Callable[[dict], DataFrame | Iterable[DataFrame]], now: datetime, limit: int | None = None,
    horizon_days: int = HORIZON_DAYS, retries: int = 0, backoff_seconds: float = BACKOFF_SECONDS,
) -> dict:
    """One run: an unknown source is an error, a disabled one does nothing, another run of the
    source under way is an error (Busy).

    ``fetch`` gives listings, or several batches of them one after the other. The two APIs ask with
    a horizon, so their listings beyond it are left out; pages with markup have none. A limited
    run never retires what it did not see. A failure half way keeps the batches before it; it is
    logged, tried again ``retries`` times and raised at last."""
    found = source_config(sources, slug).first()
    if found is None:
        raise KeyError(f"unknown source {slug}")
    if not found["enabled"]:
        return {}
    for turn in range(retries + 1):
        if turn:
            time.sleep(backoff_seconds * 2 ** (turn - 1))
        try:
            with store.only_run(slug):
                return _run(store, slug, fetch, found["config"] or {}, now, limit, horizon_days)
        except Busy:
            raise
        except Exception:
            if turn == retries:
                raise
    raise AssertionError("not reached")


def _run(store: Store, slug: str, fetch: Callable, config: dict, now: datetime, limit: int | None, horizon_days: int) -> dict:
    stats = dict.fromkeys(COUNTERS, 0)
    run_id = store.add_run(slug, now, stats, running=True)
    try:
        with intermediates(store.spark):
            given, seen = fetch(config), None
            for batch in [given] if isinstance(given, DataFrame) else given:
                listings = with_horizon(batch, slug, now, horizon_days)
                if limit is not None:
                    listings = listings.orderBy("seq").limit(limit - stats["fetched"])
                more, ids = take_in(store, listings, now)
                stats = {k: stats[k] + more[k] for k in COUNTERS}
                seen = ids if seen is None else seen.union(ids)
                if limit is not None and stats["fetched"] >= limit:
                    break
            if limit is None and seen is not None:
                retire(store, slug, seen, now)
    except Exception as error:
        store.add_run(slug, now, stats, str(error) or type(error).__name__, run_id)
        raise
    store.add_run(slug, now, stats, run_id=run_id)
    return stats


def run_all(store: Store, sources: DataFrame, fetch: Callable[[str, dict], DataFrame | Iterable[DataFrame]], now: datetime, **options) -> dict[str, dict | Exception]:
    """All enabled sources in order; one that fails does not stop the others, but if every
    one does, the last failure is raised."""
    results: dict[str, dict | Exception] = {}
    for row in enabled_sources(sources).collect():  # a row for each source
        try:
            results[row.slug] = run_source(store, sources, row.slug, lambda config, s=row.slug: fetch(s, config), now, **options)
        except Exception as error:  # noqa: BLE001  reported with the results
            results[row.slug] = error
    failed = [x for x in results.values() if isinstance(x, Exception)]
    if failed and len(failed) == len(results):
        raise failed[-1]
    return results

"""Keyed merges of stored tables with a batch: each gives the table as it is to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, venue_key


def _last(batch: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    newest = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return batch.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def record_id(source: Column, external: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", source, external), 256)


def upsert_records(records: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Records by (source_slug, external_id): the batch's last row replaces url, raw and hash,
    renews last_seen_at and revives. ``changed`` tells a known record with another hash, ``was``
    whether a record was live or gone before, null if it is new."""
    key = ["source_slug", "external_id"]
    new = _last(batch, key).select(*key, F.col("url").alias("n_url"), F.col("raw").alias("n_raw"), F.lit(True).alias("seen"))
    both = records.join(new, key, "full_outer")
    seen, known = F.coalesce("seen", F.lit(False)), F.col("first_seen_at").isNotNull()
    n_hash = content_hash(F.col("n_raw"))
    pick = lambda a, b: F.when(seen, a).otherwise(b)
    return both.select(
        record_id(F.col("source_slug"), F.col("external_id")).alias("id"),
        *key,
        pick(F.col("n_url"), F.col("url")).alias("url"),
        pick(F.col("n_raw"), F.col("raw")).alias("raw"),
        pick(n_hash, F.col("content_hash")).alias("content_hash"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        pick(now, F.col("last_seen_at")).alias("last_seen_at"),
        F.when(~seen, F.col("gone_at")).alias("gone_at"),
        (seen & known & (F.col("content_hash") != n_hash)).alias("changed"),
        F.when(known, F.when(F.col("gone_at").isNull(), "live").otherwise("gone")).alias("was"),
    )


def upsert_venues(venues: DataFrame, batch: DataFrame) -> DataFrame:
    """Venues by (name_key, city or ''): the first name stays, the newest known address and
    point win. batch: venue_name, address, city_slug, point, seq."""
    old = venues.select("name", "name_key", "address", "city_slug", "point", F.lit(-1).cast("long").alias("seq"))
    new = batch.filter(F.col("venue_name").isNotNull()).select(
        F.col("venue_name").alias("name"), venue_key(F.col("venue_name")).alias("name_key"), "address", "city_slug", "point", "seq"
    )
    seq = F.col("seq")
    rows = old.unionByName(new).withColumn("city_key", F.coalesce("city_slug", F.lit("")))
    return rows.groupBy("name_key", "city_key").agg(
        F.min_by("name", seq).alias("name"),
        F.max_by("address", F.when(F.col("address").isNotNull(), seq)).alias("address"),
        F.max_by("point", F.when(F.col("point").isNotNull(), seq)).alias("point"),
    ).select(
        record_id(F.col("name_key"), F.col("city_key")).alias("id"), "name", "name_key", "address",
        F.when(F.col("city_key") != "", F.col("city_key")).alias("city_slug"), "point",
    )


def best_of(rows: DataFrame, key: str = "event_id", order: str = "seq") -> DataFrame:
    """One event from the listings linked to it, its own row first: the first known summary,
    cover, end and point; the least price; free if any is; the greatest popularity."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return rows.groupBy(key).agg(
        *[first(c) for c in ("summary", "cover_image_url", "ends_at", "point")],
        F.min("price_from").alias("price_from"),
        F.bool_or("is_free").alias("is_free"),
        F.max("popularity").alias("popularity"),
    )


def link_records(links: DataFrame, batch: DataFrame) -> DataFrame:
    """Links by record: a record belongs to one event, the batch's last."""
    old = links.withColumn("seq", F.lit(-1).cast("long"))
    return _last(old.unionByName(batch.select(*links.columns, "seq")), ["source_record_id"]).drop("seq")


def source_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("event_id").agg(F.count("*").cast("int").alias("source_count"))


def new_reviews(reviews: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's first review of each unordered pair that is not known."""
    pair = [F.least("event_id", "candidate_event_id").alias("lo"), F.greatest("event_id", "candidate_event_id").alias("hi")]
    first = Window.partitionBy("lo", "hi").orderBy("seq")
    new = batch.select(*reviews.columns, "seq", *pair).withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    return new.join(reviews.select(*pair), ["lo", "hi"], "left_anti").select(*reviews.columns)


def flag_reviews(reviews: DataFrame, batch: DataFrame) -> DataFrame:
    """Reviews by unordered pair: what is known stays, repeats are left out."""
    return reviews.unionByName(new_reviews(reviews, batch))


def link_changes(records: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(event_id, day, links, live): by how much events gain or lose links, and links to live
    records, when ``new`` links (source_record_id, event_id, day) take the place of ``old`` ones.
    records: (id, was live | gone | null), which are live from now on."""
    was_live = F.coalesce(F.col("was") == "live", F.lit(False))
    both = new.join(old.select("source_record_id", F.col("event_id").alias("o_event"), F.col("day").alias("o_day")), "source_record_id", "left")
    both = both.join(records.select(F.col("id").alias("source_record_id"), was_live.alias("was_live")), "source_record_id")
    stays = F.coalesce(F.col("o_event") == F.col("event_id"), F.lit(False))
    gain = F.struct("event_id", "day", (~stays).cast("int").alias("links"), (~(stays & F.col("was_live"))).cast("int").alias("live"))
    loss = F.struct(F.col("o_event").alias("event_id"), F.col("o_day").alias("day"), F.lit(-1).alias("links"), (-F.col("was_live").cast("int")).alias("live"))
    moved = F.when(F.col("o_event").isNotNull() & ~stays, F.array(gain, loss)).otherwise(F.array(gain))
    return summed(both.select(F.explode(moved).alias("c")).select("c.*"))


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy("event_id", "day").agg(F.sum("links").cast("int").alias("links"), F.sum("live").cast("int").alias("live"))


def counted(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Events with their numbers of links brought up to date; an event without any counts one source."""
    d = changes.select(F.col("event_id").alias("id"), F.col("links").alias("d_links"), F.col("live").alias("d_live"))
    out = events.join(d, "id", "left").withColumns({"links": F.col("links") + F.coalesce("d_links", F.lit(0)), "live": F.col("live") + F.coalesce("d_live", F.lit(0))})
    return out.withColumn("source_count", F.greatest("links", F.lit(1))).drop("d_links", "d_live")


def tombstone(records: DataFrame, source: str, seen: DataFrame, now: Column) -> DataFrame:
    """Live records of a source that are not among the seen external ids get gone_at; nothing
    changes where nothing was seen."""
    seen = seen.select("external_id").distinct().withColumn("__seen", F.lit(True))
    if seen.isEmpty():
        return records
    gone = (F.col("source_slug") == source) & F.col("gone_at").isNull() & F.col("__seen").isNull()
    return (
        records.join(seen, "external_id", "left")
        .withColumn("gone_at", F.when(gone, now).otherwise(F.col("gone_at")))
        .select(*records.columns)
    )


def drop_orphans(events: DataFrame, links: DataFrame, records: DataFrame) -> DataFrame:
    """Events with a link to a live record."""
    live = links.join(records.filter("gone_at IS NULL"), links["source_record_id"] == records["id"], "left_semi")
    return events.join(live, events["id"] == live["event_id"], "left_semi")


def drop_links(links: DataFrame, events: DataFrame) -> DataFrame:
    """Links whose event is still there (the cascade of ``drop_orphans``)."""
    return links.join(events, links["event_id"] == events["id"], "left_semi")


def drop_reviews(reviews: DataFrame, events: DataFrame) -> DataFrame:
    both = reviews
    for column in ("event_id", "candidate_event_id"):
        both = both.join(events.select(F.col("id").alias(column)), column, "left_semi")
    return both.select(*reviews.columns)

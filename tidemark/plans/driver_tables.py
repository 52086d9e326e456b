"""Listings, events and venues made from the star-schema tables, to run the library on them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dimensions import CATEGORIES

NOW = datetime(2024, 1, 15, 2, tzinfo=timezone.utc)
LAT, LNG = -36.85, 174.76


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; the session runs in UTC, as timestamps without zone are UTC wall clocks here."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("user_id")
    known = e % 10 != 0
    lat = LAT + ((k * 37) % 100 - 50) / 50.0
    lng = LNG + ((k * 53) % 100 - 50) / 50.0
    text = F.lit(None).cast("string")
    return read(spark, sf_dir, "events").select(
        F.lpad(e.cast("string"), 10, "0").alias("id"),
        F.concat_ws(" ", "event_type", k.cast("string")).alias("title"),
        text.alias("title_zh"), F.col("props").alias("summary"), text.alias("summary_zh"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (e % 9 + 1).cast("int")).alias("category"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("starts_at"),
        F.lit(None).cast("timestamp").alias("ends_at"),
        (e % 5 == 0).alias("is_free"),
        F.when(e % 10 != 3, F.col("value")).alias("price_from"),
        F.lit("NZD").alias("currency"),
        F.when(known, F.struct(lat.alias("lat"), lng.alias("lng"))).alias("point"),
        F.when(k % 3 == 0, F.lit("wellington")).otherwise(F.lit("auckland")).alias("city_slug"),
        text.alias("cover_image_url"), text.alias("source_url"), F.lit("demo").alias("source_name"),
        F.lit(1).alias("source_count"), (e % 5000).cast("int").alias("popularity"),
        F.when(e % 10 != 7, k.cast("string")).alias("venue_id"),
    )


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("address"),
        F.lit(None).cast("struct<lat:double,lng:double>").alias("point"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, id, title, starts_at, url, venue_id, point): a part's name with a decoration."""
    e = F.col("event_id")
    parts = read(spark, sf_dir, "part")
    total = parts.agg(F.count("*").alias("parts"))
    named = (
        read(spark, sf_dir, "events").crossJoin(F.broadcast(total))  # one row
        .withColumn("p_partkey", e % F.col("parts"))
        .join(parts.select("p_partkey", "p_name"), "p_partkey")
    )
    name = F.col("p_name")
    title = (
        F.when(e % 4 == 0, F.concat(F.lit("The "), name)).when(e % 4 == 1, F.concat(name, F.lit(" (Live)")))
        .when(e % 4 == 2, F.upper(name)).otherwise(F.concat(F.lit("Café "), name))
    )
    point = F.struct((LAT + (e % 7) * 0.001).alias("lat"), F.lit(LNG).alias("lng"))
    return named.select(
        e.alias("seq"), F.lpad(e.cast("string"), 10, "0").alias("id"), title.alias("title"), F.col("ts").cast("timestamp").alias("starts_at"),
        F.concat(F.lit("https://x.example/"), (e % 997).cast("string")).alias("url"),
        F.when(e % 3 == 0, (F.col("user_id") % 5).cast("string")).alias("venue_id"),
        F.when(e % 10 != 0, point).alias("point"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records: (source_slug, external_id, url, raw, seq), each user an external id."""
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_slug"), F.col("user_id").cast("string").alias("external_id"),
        F.concat(F.lit("https://x.example/"), e.cast("string")).alias("url"), F.col("props").alias("raw"), e.alias("seq"),
    )

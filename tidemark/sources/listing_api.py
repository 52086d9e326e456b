"""The two paged listing APIs. Input rows are (raw: one event as JSON text, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.coerce import least_positive, number, present, truthy, widest
from ..functions.geo import nearest_city, point
from ..functions.localtime import parse_instant, parse_local
from ..functions.text import join_present, summary_text
from .markup import in_order


def events_a(pages: DataFrame) -> DataFrame:
    """Pages (page: JSON text, name) of the first API to (raw, seq), in the order of their names;
    a page of another shape has none."""
    found = in_order(pages).select(F.from_json("page", schemas.API_A_PAGE).alias("p")).select(F.explode("p.events").alias("raw"))
    return found.withColumn("seq", F.monotonically_increasing_id())


def events_b(pages: DataFrame) -> DataFrame:
    """The same for the second API."""
    found = in_order(pages).select(F.from_json("page", schemas.API_B_PAGE).alias("p")).select(F.explode("p._embedded.events").alias("raw"))
    return found.withColumn("seq", F.monotonically_increasing_id())


def _numbers(array: Column, field: str) -> Column:
    return F.transform(array, lambda x: number(x[field]))


def _bad_number(text: Column) -> Column:
    return text.isNotNull() & number(text).isNull()


def _as_listing(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.LISTING])


def normalize_a(events: DataFrame, slug: str = "listing_a", url_base: str = "https://listing-a.example/event/") -> DataFrame:
    """Listings of the first API: times without an offset are local, the cover is the widest
    form of the primary image. Without a title, a start or an id there is no listing."""
    e = events.select("raw", "seq", F.from_json("raw", schemas.API_A_EVENT).alias("e")).select("raw", "seq", "e.*")
    images = F.col("images.images")
    primary = F.coalesce(F.try_element_at(F.filter(images, lambda i: truthy(i["is_primary"])), F.lit(1)), F.try_element_at(images, F.lit(1)))
    # a point with one coordinate null reads the other as given and the null as 0
    lat, lng = F.col("point.lat"), F.col("point.lng")
    given = lat.isNotNull() | lng.isNotNull()
    e = e.withColumn("starts_at", parse_local(F.col("datetime_start"))).withColumn("title", present(F.col("name")))
    e = e.filter(F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("starts_at").isNotNull())
    e = e.filter(~(_bad_number(lat) | _bad_number(lng)))
    return _as_listing(
        e.select(
            F.lit(slug).alias("source_slug"),
            F.col("id").alias("external_id"),
            F.coalesce("url", F.concat(F.lit(url_base), F.col("id"))).alias("url"),
            "title",
            summary_text(F.col("description"), tags=True).alias("summary"),
            "starts_at",
            parse_local(F.col("datetime_end")).alias("ends_at"),
            truthy(F.col("is_free")).alias("is_free"),
            least_positive(_numbers(F.col("ticket_types.ticket_types"), "price")).alias("price_from"),
            present(F.col("location.name")).alias("venue_name"),
            F.coalesce(present(F.col("address")), present(F.col("location_summary"))).alias("address"),
            F.when(given, point(F.coalesce(number(lat), F.lit(0.0)), F.coalesce(number(lng), F.lit(0.0)))).alias("point"),
            F.lit(None).alias("city_slug"),
            F.col("category.name").alias("category_hint"),
            widest(primary["transforms"]["transforms"]).alias("cover_image_url"),
            F.lit(0).alias("popularity"),
            "raw",
            "seq",
        )
    )


def normalize_b(events: DataFrame, slug: str = "listing_b", url_base: str = "https://listing-b.example/event/") -> DataFrame:
    """Listings of the second API: an instant if given (a broken one is no listing), else local
    date and time; cancelled ones are left out, postponed ones are least popular; (0, 0) is no
    point."""
    e = events.select("raw", "seq", F.from_json("raw", schemas.API_B_EVENT).alias("e")).select("raw", "seq", "e.*")
    start = F.col("dates.start")
    wall = F.when(start["localTime"].isNotNull(), F.concat_ws(" ", start["localDate"], start["localTime"])).otherwise(start["localDate"])
    instant = F.when(F.coalesce(start["dateTime"], F.lit("")) != "", parse_instant(start["dateTime"])).otherwise(parse_local(wall))
    status = F.coalesce(F.lower("dates.status.code"), F.lit(""))
    venue = F.try_element_at(F.col("_embedded.venues"), F.lit(1))
    kind = F.try_element_at(F.col("classifications"), F.lit(1))
    lat, lng = number(venue["location"]["latitude"]), number(venue["location"]["longitude"])
    e = e.withColumn("starts_at", instant).withColumn("title", present(F.col("name")))
    e = e.filter(F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("starts_at").isNotNull() & (status != "cancelled"))
    e = e.withColumn("point", F.when((lat != 0) | (lng != 0), point(lat, lng)))
    return _as_listing(
        e.select(
            F.lit(slug).alias("source_slug"),
            F.col("id").alias("external_id"),
            F.coalesce("url", F.concat(F.lit(url_base), F.col("id"))).alias("url"),
            "title",
            summary_text(F.coalesce("info", "pleaseNote")).alias("summary"),
            "starts_at",
            parse_instant(F.col("dates.end.dateTime")).alias("ends_at"),
            F.lit(False).alias("is_free"),
            least_positive(_numbers(F.col("priceRanges"), "min")).alias("price_from"),
            present(venue["name"]).alias("venue_name"),
            join_present(", ", venue["address"]["line1"], venue["city"]["name"]).alias("address"),
            "point",
            nearest_city(F.col("point.lat"), F.col("point.lng")).alias("city_slug"),
            join_present(" ", kind["segment"]["name"], kind["genre"]["name"]).alias("category_hint"),
            widest(F.col("images")).alias("cover_image_url"),
            F.when(status == "postponed", 0).otherwise(1).alias("popularity"),
            "raw",
            "seq",
        )
    )

"""Landed payloads to listings: a registry of adapters over what crawlers left behind."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import listing_api, markup

Adapter = Callable[..., DataFrame]
HORIZON_DAYS = 120

ADAPTERS: dict[str, Adapter] = {"listing_a": listing_api.normalize_a, "listing_b": listing_api.normalize_b}


def adapter_for(slug: str) -> Adapter:
    """Unknown slugs are pages with markup."""
    return ADAPTERS.get(slug, markup.normalize_pages)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, name): the landed answers of an API, one JSON document for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("page"), F.col("_metadata.file_path").alias("name"))


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled").select("slug").orderBy("slug")


def source_config(sources: DataFrame, slug: str) -> DataFrame:
    return sources.filter(F.col("slug") == slug).select("slug", "enabled", "config").limit(1)


def page_bounds(total_pages: int, size: int = 200, ceiling: int = 1000) -> list[int]:
    """Pages of the second API that can be asked for: it ends at a ceiling of results."""
    return [p for p in range(total_pages) if p * size < ceiling]


def horizon_end(now: datetime, days: int = HORIZON_DAYS) -> datetime:
    """How far ahead a crawl asks for."""
    return now + timedelta(days=days)


def within_horizon(listings: DataFrame, now: datetime, days: int = HORIZON_DAYS) -> DataFrame:
    """Listings that start by the end of the horizon; a source may answer with later ones."""
    return listings.filter(F.col("starts_at") <= F.lit(horizon_end(now, days)))


def with_horizon(listings: DataFrame, slug: str, now: datetime, days: int = HORIZON_DAYS) -> DataFrame:
    """The APIs ask with the horizon as a bound, so it holds for their listings alone: what a page
    with markup shows is all there, however far ahead."""
    return within_horizon(listings, now, days) if slug in ADAPTERS else listings


def dry_run(listings: DataFrame, limit: int | None = None) -> list[str]:
    """The first listings as JSON, nothing written."""
    return listings.orderBy("seq").limit(limit or 1).toJSON().collect()


def renormalize(records: DataFrame, adapter: Adapter, **options) -> DataFrame:
    """Listings anew from stored raw payloads."""
    return adapter(records.filter("gone_at IS NULL").select("raw", F.monotonically_increasing_id().alias("seq")), **options)


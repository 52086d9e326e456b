"""Schemas of listings, events, stored tables and raw payloads. Numbers in payloads are
read as strings, as sources quote them at will."""

from __future__ import annotations

from functools import cache

from pyspark.sql import types as T


_DDL: dict[str, str] = {}


def __getattr__(name: str) -> T.StructType:
    """Schemas are parsed by the session, so on first use rather than on import."""
    if name not in _DDL:
        raise AttributeError(name)
    return _parsed(name)


@cache
def _parsed(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])


POINT = "struct<lat: double, lng: double>"

_DDL["LISTING"] = (
    "source_slug string NOT NULL, external_id string NOT NULL, url string, title string NOT NULL, summary string, "
    "starts_at timestamp NOT NULL, ends_at timestamp, is_free boolean NOT NULL, price_from double, venue_name string, "
    f"address string, point {POINT}, city_slug string, category_hint string, cover_image_url string, "
    "popularity int NOT NULL, raw string, seq bigint"
)
_DDL["EVENT"] = (
    "id string, title string, title_zh string, summary string, summary_zh string, category string, starts_at timestamp, "
    "ends_at timestamp, is_free boolean, price_from decimal(10,2), currency string, venue_id string, "
    f"point {POINT}, city_slug string, cover_image_url string, source_url string, source_name string, source_count int, "
    "popularity int, title_fingerprint string, created_at timestamp, updated_at timestamp"
)
_DDL["SOURCE"] = ("slug string, name string, kind string, attribution string, enabled boolean, config map<string,string>, last_run_at timestamp")
_DDL["VENUE"] = (f"id string, name string, name_key string, address string, city_slug string, point {POINT}")
_DDL["SOURCE_RECORD"] = (
    "id string, source_slug string, external_id string, url string, raw string, content_hash string, "
    "first_seen_at timestamp, last_seen_at timestamp, gone_at timestamp"
)
_DDL["EVENT_LINK"] = ("event_id string, source_record_id string, confidence float, signals string")
_DDL["MERGE_REVIEW"] = ("event_id string, candidate_event_id string, confidence float, signals string, resolved string")
_DDL["INGEST_RUN"] = (
    "id string, source_slug string, status string, fetched long, created long, updated long, merged long, flagged long, "
    "skipped long, error string, started_at timestamp, finished_at timestamp"
)

_DDL["API_A_EVENT"] = (
    "id string, url string, name string, description string, datetime_start string, datetime_end string, is_free string, "
    "address string, point struct<lat: string, lng: string>, location struct<name: string>, location_summary string, "
    "category struct<name: string>, images struct<images: array<struct<is_primary: string, transforms: "
    "struct<transforms: array<struct<url: string, width: string>>>>>>, "
    "ticket_types struct<ticket_types: array<struct<price: string>>>"
)
_DDL["API_B_EVENT"] = (
    "id string, name string, url string, info string, pleaseNote string, dates struct<start: struct<dateTime: string, "
    "localDate: string, localTime: string, dateTBA: string, timeTBA: string>, end: struct<dateTime: string>, "
    "status: struct<code: string>>, classifications array<struct<segment: struct<name: string>, genre: struct<name: string>>>, "
    "priceRanges array<struct<min: string>>, images array<struct<url: string, width: string>>, "
    "_embedded struct<venues: array<struct<name: string, address: struct<line1: string>, city: struct<name: string>, "
    "location: struct<latitude: string, longitude: string>>>>"
)
#: Pages as landed: one JSON document for each answer of the API; events stay text so that their raw form is kept.
_DDL["API_A_PAGE"] = ("events array<string>")
_DDL["API_B_PAGE"] = ("_embedded struct<events: array<string>>, page struct<totalPages: string, number: string>")

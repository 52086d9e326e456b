"""The feed: a validated query, its predicates, keyset pages and cards."""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dimensions import CATEGORIES, CATEGORY_LABELS, CITIES, CITY_LABELS, CITY_SLUGS, DATE_BUCKETS
from ..functions.geo import within_box, within_radius
from ..functions.localtime import bucket_range, iso_millis, when_label
from ..functions.text import label, localized, search_text

_BOX = re.compile(r"-?\d+(?:\.\d+)?(?:,-?\d+(?:\.\d+)?){3}")


def flag(value: object) -> bool:
    """A request's flag as browsers coerce it: any text but the empty one is true, "false" too."""
    return bool(value)


@dataclass(frozen=True)
class FeedQuery:
    city: str | None = None
    category: str | None = None
    date: str = "week"
    free: object = None
    q: str | None = None
    bbox: str | tuple[float, float, float, float] | None = None
    cursor: str | None = None
    limit: int = 60

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        for name, allowed in (("city", CITY_SLUGS), ("category", CATEGORIES), ("date", DATE_BUCKETS)):
            value = getattr(self, name)
            if value is not None and value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if isinstance(self.bbox, str):
            if not _BOX.fullmatch(self.bbox):
                raise ValueError("bbox must be west,south,east,north")
            put("bbox", tuple(map(float, self.bbox.split(","))))
        if self.q is not None:
            put("q", self.q.strip())
            if not 1 <= len(self.q) <= 120:
                raise ValueError("q must have 1 to 120 characters")
        put("limit", int(self.limit))
        if not 1 <= self.limit <= 200:
            raise ValueError("limit must be 1 to 200")
        put("free", None if self.free is None else flag(self.free))


#: What the first page of the site asks for.
LANDING = {"city": "auckland", "date": "week", "limit": 60}


@dataclass
class Page:
    events: DataFrame
    next_cursor: str | None


def encode_cursor(at: datetime, id_: str) -> str:
    at = at.astimezone(timezone.utc)
    text = f"{at:%Y-%m-%dT%H:%M:%S}.{at.microsecond // 1000:03d}Z|{id_}"
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> tuple[datetime, str] | None:
    """Null for anything that is not a cursor."""
    try:
        text = base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4)).decode()
        at, _, id_ = text.partition("|")
        return (datetime.fromisoformat(at.replace("Z", "+00:00")), id_) if id_ else None
    except ValueError:
        return None


def after(at: Column, id_: Column, cursor_at: object, cursor_id: object) -> Column:
    """(at, id) > cursor, written so that the bound on ``at`` reaches the files."""
    return (at >= F.lit(cursor_at)) & ((at > F.lit(cursor_at)) | (id_ > F.lit(cursor_id)))


def predicates(query: FeedQuery, now: datetime, text: Column | None = None) -> list[Column]:
    """One predicate for each parameter that is given. A box replaces the radius around the
    city; rows without a point are in neither."""
    start, end = bucket_range(query.date, now)
    found = [F.col("starts_at") >= F.lit(start)]
    if end:
        found.append(F.col("starts_at") < F.lit(end))
    if query.city:
        found.append(F.col("city_slug") == query.city)
    if query.category:
        found.append(F.col("category") == query.category)
    if query.free:
        found.append(F.col("is_free"))
    if query.q:
        text = search_text(*map(F.col, ("title", "title_zh", "summary", "summary_zh"))) if text is None else text
        found.append(text.ilike(f"%{query.q}%"))  # % and _ in q match as wildcards
    lat, lng = F.col("point.lat"), F.col("point.lng")
    if query.bbox:
        found.append(within_box(lat, lng, query.bbox))
    elif query.city:
        city = next(c for c in CITIES if c[0] == query.city)
        found.append(within_radius(lat, lng, city[1:3], city[3]))
    if cursor := decode_cursor(query.cursor):
        found.append(after(F.col("starts_at"), F.col("id"), *cursor))
    return found


def card(event: str = "e", venue: str = "v") -> list[Column]:
    """The event's columns with its venue as a struct, null where there is none."""
    e = lambda c: F.col(f"{event}.{c}")
    v = lambda c: F.col(f"{venue}.{c}")
    plain = (
        "id title title_zh summary summary_zh category starts_at ends_at is_free currency point city_slug "
        "cover_image_url source_url source_name source_count popularity"
    ).split()
    where = F.struct(
        v("id").alias("id"), F.coalesce(v("name"), F.lit("")).alias("name"), v("address").alias("address"),
        e("city_slug").alias("city_slug"), v("point").alias("point"),
    )
    return [*map(e, plain), e("price_from").cast("double").alias("price_from"), F.when(v("id").isNotNull(), where).alias("venue")]


def feed(events: DataFrame, venues: DataFrame, query: FeedQuery, now: datetime) -> DataFrame:
    """One row more than the limit, in order, as cards. The events are cut to the page before
    the venues are joined, so whatever the number of venues the join is small."""
    rows = reduce(lambda df, p: df.filter(p), predicates(query, now), events)
    top = rows.orderBy("starts_at", "id").limit(query.limit + 1)
    return top.alias("e").join(venues.alias("v"), F.col("e.venue_id") == F.col("v.id"), "left").select(*card()).orderBy("starts_at", "id")


def labelled(cards: DataFrame, now: Column, lang: str = "en") -> DataFrame:
    """Cards as a page in one language shows them: title, labels of category and city, and when."""
    at = F.col("starts_at")
    return cards.select(
        "id", localized(F.col("title"), F.col("title_zh"), lang).alias("title"), label(F.col("category"), CATEGORY_LABELS, lang).alias("category"),
        label(F.col("city_slug"), CITY_LABELS, lang).alias("city"), when_label(at.cast("timestamp_ntz"), now, lang).alias("when"), iso_millis(at).alias("starts_at"),
    )


def find_page(events: DataFrame, venues: DataFrame, query: FeedQuery, now: datetime) -> Page:
    found = feed(events, venues, query, now)
    rows = found.take(query.limit + 1)  # at most 201 rows
    page, cursor = rows[: query.limit], None
    if len(rows) > query.limit:
        cursor = encode_cursor(page[-1]["starts_at"].replace(tzinfo=timezone.utc), page[-1]["id"])
    return Page(events.sparkSession.createDataFrame(page, found.schema), cursor)


def event_by_id(events: DataFrame, venues: DataFrame, id_: str) -> DataFrame:
    found = events.filter(F.col("id") == id_).limit(1)
    return found.alias("e").join(venues.alias("v"), F.col("e.venue_id") == F.col("v.id"), "left").select(*card())


def demo_feed(rows: DataFrame, query: FeedQuery, now: datetime) -> DataFrame:
    """The feed over demo rows: a box keeps rows without a point, there is no radius and no
    cursor, the search is literal in the two titles, the order is by start alone."""
    start, end = bucket_range(query.date, now)
    out = rows.filter(F.col("starts_at") >= F.lit(start))
    out = out.filter(F.col("starts_at") < F.lit(end)) if end else out
    if query.city:
        out = out.filter(F.col("city_slug") == query.city)
    if query.category:
        out = out.filter(F.col("category") == query.category)
    if query.free:
        out = out.filter("is_free")
    if query.q:
        text = F.lower(F.concat_ws(" ", "title", "title_zh"))
        out = out.filter(F.contains(text, F.lit(query.q.lower())))
    if query.bbox:
        lat, lng = F.col("lat"), F.col("lng")
        out = out.filter(lat.isNull() | lng.isNull() | within_box(lat, lng, query.bbox))
    return out.orderBy("starts_at").limit(query.limit)


def page_json(page: Page, demo: bool = False, degraded: bool = False) -> str:
    """The answer of the feed's API: the page's cards as JSON; only demo rows are counted."""
    rows = page.events.agg(F.to_json(F.collect_list(F.struct("*"))).alias("j")).first().j  # at most 200 rows
    cursor = f'"{page.next_cursor}"' if page.next_cursor else "null"
    extra = ', "degraded": true' if degraded else ""
    return f'{{"events": {rows}, "nextCursor": {cursor}, "total": {page.events.count() if demo else "null"}, "demo": {str(demo).lower()}{extra}}}'

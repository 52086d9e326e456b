"""Sources on the web as a Spark data source: ``spark.read.format("listing_pages")``.

A row is a page as it was answered, or the error in its place, so what was read before a failure
is kept. One partition reads the pages of the first API one after the other, as only a page tells
whether there is another; the second API's first page tells how many there are, and each is a
partition, as is each seed with markup.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..storage import kept
from . import landing, listing_api, markup

FORMAT = "listing_pages"
SCHEMA = "number int, name string, page string, error string"
# Results of a page, the second API's ceiling, seconds between pages, to wait for an answer, before the one retry.
SIZE, CEILING = 200, 1000
PAUSE = {"a": 0.4, "b": 0.25, "markup": 0.8}
TIMEOUT, RETRY_AFTER = 20.0, 1.5
AGENT = "tidemark-crawler"


class FetchFailed(RuntimeError):
    """A page of an API that could not be read."""


class Page(InputPartition):
    def __init__(self, number: int, url: str, follow: bool = False) -> None:
        self.number, self.url, self.follow = number, url, follow


def get(url: str, headers: dict[str, str], retries: int, retry_after: float) -> str:
    for turn in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"user-agent": AGENT, **headers}), timeout=TIMEOUT) as answer:
                return answer.read().decode("utf-8", "replace")
        except (OSError, urllib.error.URLError):
            if turn == retries:
                raise
            time.sleep(retry_after * (turn + 1))
    raise AssertionError("not reached")


class Pages:
    """What is asked for: options ``api`` (a, b, markup), ``base`` or ``seeds`` (JSON), ``now``, ``horizonDays``,
    ``rows``, ``country``, ``key`` or ``user`` and ``password``, ``pause`` and ``retryAfter`` in seconds."""

    def __init__(self, options: dict[str, str]) -> None:
        o = {k.lower(): v for k, v in options.items()}
        self.api, self.base = o.get("api", "markup"), o.get("base", "").rstrip("/")
        if self.api not in PAUSE:
            raise ValueError("api must be a, b or markup")
        self.seeds = json.loads(o.get("seeds", "[]"))
        self.now = datetime.fromisoformat(o["now"]) if "now" in o else None
        self.days, self.size = int(o.get("horizondays", landing.HORIZON_DAYS)), int(o.get("rows", SIZE))
        self.country, self.key = o.get("country", "NZ"), o.get("key", "")
        self.pause, self.retry_after = float(o.get("pause", PAUSE[self.api])), float(o.get("retryafter", RETRY_AFTER))
        self.headers = {"accept": "application/json"} if self.api != "markup" else {}
        if "user" in o:
            self.headers["authorization"] = "Basic " + base64.b64encode(f"{o['user']}:{o.get('password', '')}".encode()).decode()

    def url(self, number: int) -> str:
        """The address of a page (a: of the results from ``number`` on), bounded by the horizon."""
        now = (self.now or datetime.now(timezone.utc)).astimezone(timezone.utc)
        until = now + timedelta(days=self.days)
        if self.api == "a":
            asked = {"rows": self.size, "offset": number, "order": "date", "end_date": f"{until:%Y-%m-%d}"}
        else:
            asked = {"apikey": self.key, "countryCode": self.country, "size": self.size, "page": number, "sort": "date,asc", "startDateTime": f"{now:%Y-%m-%dT%H:%M:%SZ}", "endDateTime": f"{until:%Y-%m-%dT%H:%M:%SZ}"}
        return f"{self.base}/events.json?{urllib.parse.urlencode(asked)}"

    def partitions(self) -> list[Page]:
        if self.api == "markup":
            return [Page(i, seed) for i, seed in enumerate(self.seeds)]
        if self.api == "a":
            return [Page(0, "", True)]
        try:
            held = json.loads(get(self.url(0), self.headers, 1, self.retry_after))
            total = int((held.get("page") or {}).get("totalPages") or 1)
        except (OSError, ValueError, AttributeError, TypeError):
            total = 1  # the partition meets the error again and tells it
        return [Page(i, self.url(i)) for i in landing.page_bounds(max(total, 1), self.size, CEILING)]

    def read(self, part: Page) -> Iterator[tuple]:
        retries = 0 if self.api == "markup" else 1
        if not part.follow:
            if part.number:
                time.sleep(self.pause)
            yield self._one(part.number, part.url, retries)
            return
        offset, number = 0, 0
        while True:
            row = self._one(number, self.url(offset), retries)
            if row[3] is None and not (events := _events(row[2])):
                return  # the end, or a page of another shape
            yield row
            if row[3] is not None or len(events) < self.size:
                return
            offset, number = offset + len(events), number + 1
            time.sleep(self.pause)

    def _one(self, number: int, url: str, retries: int) -> tuple:
        name = url if self.api == "markup" else f"{number:06d}"
        try:
            return number, name, get(url, self.headers, retries, self.retry_after), None
        except (OSError, urllib.error.URLError, ValueError) as error:
            return number, name, None, f"{type(error).__name__}: {error}"


def _events(page: str) -> list:
    try:
        events = json.loads(page).get("events")
    except (ValueError, AttributeError):
        return []
    return events if isinstance(events, list) else []


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return Pages(self.options).partitions()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from Pages(self.options).read(partition)


class PageStreamReader(DataSourceStreamReader):
    """A crawl each ``every`` seconds (3600): the offset is the crawl's number, and a stream that was
    down for several crawls makes one."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.every = float({k.lower(): v for k, v in options.items()}.get("every", 3600))

    def initialOffset(self) -> dict:
        return {"crawl": 0}

    def latestOffset(self) -> dict:
        return {"crawl": int(time.time() // self.every)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return Pages(self.options).partitions() if end["crawl"] > start["crawl"] else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from Pages(self.options).read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for crawls that are done."""


class ListingPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStreamReader(self.options)


def options_for(slug: str, config: dict[str, str], now: datetime, horizon_days: int = landing.HORIZON_DAYS) -> dict[str, str]:
    """The data source's options from a source's ``config``; its values win."""
    api = {"listing_a": "a", "listing_b": "b"}.get(slug, "markup")
    return {"api": api, "now": now.isoformat(), "horizonDays": str(horizon_days), **config}


def listings_of(pages: DataFrame, slug: str, config: dict[str, str] | None = None) -> DataFrame:
    """Listings of the pages that could be read."""
    good = pages.filter("error IS NULL")
    if slug == "listing_a":
        return listing_api.normalize_a(listing_api.events_a(good))
    if slug == "listing_b":
        return listing_api.normalize_b(listing_api.events_b(good))
    return markup.normalize_pages(good.select("name", F.col("name").alias("url"), F.col("page").alias("html")), slug, (config or {}).get("defaultCity"))


def fetcher(spark: SparkSession, slug: str, now: datetime, horizon_days: int = landing.HORIZON_DAYS) -> Callable[[dict], Iterator[DataFrame]]:
    """``fetch`` for ``run_source``: the pages are read once and written; the listings of those that
    could be read come first, then the failure of an API's page. A seed that cannot be read is
    left out."""
    spark.dataSource.register(ListingPages)

    def fetch(config: dict) -> Iterator[DataFrame]:
        pages = kept(spark.read.format(FORMAT).options(**options_for(slug, config, now, horizon_days)).load(), "web-pages")
        yield listings_of(pages, slug, config)
        if slug in landing.ADAPTERS and (bad := pages.filter("error IS NOT NULL").orderBy("number").first()):
            raise FetchFailed(bad.error)

    return fetch

"""Counts over nodes, listings and runs."""

from __future__ import annotations

import json
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_ws
from ..sources import markup


def type_histogram(nodes: DataFrame, kind: str = "type", order: str = "seq") -> DataFrame:
    """Types by count, the most frequent first, equals in order of appearance."""
    return nodes.groupBy(kind).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def coverage(listings: DataFrame) -> DataFrame:
    """How many listings have a point, a venue, an image, and how many there are."""
    return listings.agg(
        F.count("*").alias("usable"),
        F.count_if(F.col("point").isNotNull()).alias("with_point"),
        F.count_if(F.col("venue_name").isNotNull()).alias("with_venue"),
        F.count_if(F.col("cover_image_url").isNotNull()).alias("with_image"),
    )


def counters() -> list[Column]:
    """What became of listings (outcome, changed, review_id), as aggregates."""
    merged = F.col("outcome") == "merged"
    return [
        F.count_if(F.col("outcome") == "created").alias("created"), F.count_if(merged & F.col("changed")).alias("updated"),
        F.count_if(merged & ~F.col("changed")).alias("merged"), F.count_if(F.col("review_id").isNotNull()).alias("flagged"),
    ]


def run_stats(outcomes: DataFrame) -> DataFrame:
    """outcome, changed, review_id and skipped of each fetched listing -> the run's counters."""
    return outcomes.agg(F.count("*").alias("fetched"), *counters(), F.count_if(F.col("skipped")).alias("skipped"))


#: A page of fewer characters is taken for one that is drawn by scripts.
LEAST_PAGE = 500
SAMPLE, VERBOSE_SAMPLE = 3, 20


def probe_pages(pages: DataFrame, default_city: str | None = None) -> DataFrame:
    """(page_url, gate, nodes, events, usable, with_point, with_venue, with_image) for each page
    (url, html and, where it is known, status; urls distinct).

    The gate is the first that a page does not pass: unreadable (a status that is no success), empty,
    no markup, no event nodes, no usable listing (none with a title and a start), no coordinates
    (its listings are on no map), else ok. Nothing can be concluded of an unreadable or empty page."""
    found = markup.nodes(pages.select("url", "html"))
    listings = markup.normalize_nodes(found, "probe", default_city, keep=["page_url"])
    of_nodes = found.groupBy("page_url").agg(F.count("*").alias("nodes"), F.count_if("is_event").alias("events"))
    has = lambda c: F.count_if(F.col(c).isNotNull())
    of_listings = listings.groupBy("page_url").agg(
        F.count("*").alias("usable"), has("point").alias("with_point"), has("venue_name").alias("with_venue"), has("cover_image_url").alias("with_image")
    )
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    size = F.length(trim_ws(F.coalesce("html", F.lit(""))))
    rows = pages.select(F.col("url").alias("page_url"), status.alias("status"), size.alias("size"))
    counts = ["nodes", "events", "usable", "with_point", "with_venue", "with_image"]
    rows = rows.join(of_nodes, "page_url", "left").join(of_listings, "page_url", "left").fillna(0, counts)
    gate = (
        F.when(~F.col("status").between(200, 299), "unreadable").when(F.col("size") < LEAST_PAGE, "empty").when(F.col("nodes") == 0, "no markup")
        .when(F.col("events") == 0, "no event nodes").when(F.col("usable") == 0, "no usable listing").when(F.col("with_point") == 0, "no coordinates").otherwise("ok")
    )
    return rows.select("page_url", gate.alias("gate"), *counts)


def source_row(url: str, slug: str | None = None, city: str | None = None) -> dict[str, object]:
    """The row for the sources table that a page with markup would get."""
    host = urlsplit(url).hostname or ""
    config = {"seeds": json.dumps([url])} | ({"defaultCity": city} if city else {})
    own = host.removeprefix("www.").split(".")[0]
    return {"slug": slug or own, "name": host, "kind": "jsonld", "attribution": f"Event data from {host}", "enabled": False, "config": config}


def probe(page: DataFrame, slug: str | None = None, city: str | None = None, verbose: bool = False) -> dict[str, object]:
    """One page (url, html, status) at a glance: its gate and counts, the types of its nodes, a
    sample of its listings, and a row for the sources table."""
    found = probe_pages(page, city).first().asDict()
    url, nodes = found.pop("page_url"), markup.nodes(page.select("url", "html"))
    if found["gate"] in ("unreadable", "empty"):
        return {"gate": found["gate"]}
    listings = markup.normalize_nodes(nodes, slug or "probe", city).orderBy("seq").limit(VERBOSE_SAMPLE if verbose else SAMPLE)
    return {
        **found,
        "dropped": found["events"] - found["usable"],
        "types": [(r.type, r.n) for r in type_histogram(nodes).collect()],  # the types of one page
        "sample": [r.asDict(True) for r in listings.collect()],
        "source": source_row(url, slug, city),
    }

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import mapgrid
from tidemark.plans import feed
from tidemark.plans.ingest import ingest, run_all, run_source, with_last_run
from tidemark.plans.store import Busy, Store
from tidemark.sources.demo import demo_events
from tidemark.sources.listing_api import events_a, normalize_a
from tidemark.streaming.landing_stream import ingest_stream

NOW = datetime(2026, 3, 1, tzinfo=timezone.utc)


def row(spark, rows, source="s"):
    base = {f.name: None for f in schemas.LISTING} | {"source_slug": source, "is_free": False, "popularity": 0}
    full = []
    for seq, r in enumerate(rows):
        x = base | {"seq": seq, "url": f"https://{source}.example/{r['external_id']}", "raw": json.dumps(r, default=str), "starts_at": NOW + timedelta(days=3)} | r
        full.append(tuple(x[f.name] for f in schemas.LISTING))
    return spark.createDataFrame(full, schemas.LISTING)


def titles(store):
    return {r.title: r for r in store.read("events").collect()}


def test_runs_merge_retire_and_revive(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 2)
    a = {"external_id": "1", "title": "Harbour market", "point": (-36.85, 174.76), "venue_name": "The Wharf", "price_from": 20.0}
    b = {"external_id": "2", "title": "Night of jazz"}
    assert ingest(store, "s", row(spark, [a, b]), NOW)["created"] == 2
    again = ingest(store, "s", row(spark, [a, b]), NOW)
    assert (again["merged"], again["created"], again["updated"]) == (2, 0, 0) and len(titles(store)) == 2
    # another source with the same event: cheaper, free, one event with two links
    other = ingest(store, "t", row(spark, [{"external_id": "9", "title": "Harbour Market!", "venue_name": "Wharf", "point": (-36.85, 174.76), "price_from": 10.0, "is_free": True}], "t"), NOW)
    market = titles(store)["Harbour market"]
    assert other["merged"] == 1 and market.source_count == 2 and float(market.price_from) == 10 and market.is_free
    # changed payload
    assert ingest(store, "s", row(spark, [a | {"summary": "new"}, b]), NOW)["updated"] == 1
    # b is gone after a complete run and so is its event; a limited run retires nothing
    ingest(store, "s", row(spark, [a]), NOW, complete=False)
    assert "Night of jazz" in titles(store)
    ingest(store, "s", row(spark, [a]), NOW)
    assert "Night of jazz" not in titles(store)
    assert store.read("source_records").filter("gone_at IS NOT NULL").count() == 1
    ingest(store, "s", row(spark, [a, b]), NOW)
    assert "Night of jazz" in titles(store) and store.read("source_records").filter("gone_at IS NOT NULL").count() == 0
    assert store.read("venues").count() == 1 and store.runs().count() == 7


def test_stale_listings_are_skipped_but_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 2)
    old = {"external_id": "1", "title": "Over", "starts_at": NOW - timedelta(hours=7)}
    stats = ingest(store, "s", row(spark, [old, {"external_id": "2", "title": "Soon"}]), NOW)
    assert (stats["fetched"], stats["skipped"], stats["created"]) == (2, 1, 1)


def test_sources(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 2)
    sources = spark.createDataFrame([("bad", None, "api", None, True, None, None), ("good", None, "api", None, True, {"k": "v"}, None), ("off", None, "api", None, False, None, None)], schemas.SOURCE)
    with pytest.raises(KeyError):
        run_source(store, sources, "none", lambda c: None, NOW)
    assert run_source(store, sources, "off", lambda c: None, NOW) == {}

    def fetch(slug, config):
        if slug == "bad":
            raise OSError("down")
        return row(spark, [{"external_id": "1", "title": config["k"]}], slug)

    got = run_all(store, sources, fetch, NOW)
    assert isinstance(got["bad"], OSError) and got["good"]["created"] == 1 and "off" not in got
    assert {(r.source_slug, r.status, r.error) for r in store.runs().collect()} == {("bad", "failed", "down"), ("good", "ok", None)}
    assert {r.slug: r.last_run_at is not None for r in with_last_run(sources, store.runs()).collect()} == {"bad": True, "good": True, "off": False}
    with pytest.raises(OSError):
        run_all(store, sources.filter("slug = 'bad'"), fetch, NOW)


def full_recount(store):
    """Events with their links and links to live records, counted anew from the tables."""
    live = {r.id for r in store.read("source_records").filter("gone_at IS NULL").collect()}
    links = {}
    for r in store.read("event_links").collect():
        links.setdefault(r.event_id, []).append(r.source_record_id in live)
    return links


def test_counts_and_orphans_follow_from_changes(spark, tmp_path):
    """Random complete and limited runs of two sources; records move between events, go and come
    back: stored counts equal a full recount, and no event is left without a live record."""
    rng = random.Random(11)
    names = ["Harbour market", "Night of jazz", "Crater walk"]
    store = Store(spark, str(tmp_path / "store"), 3)
    for turn in range(6):
        source, complete = rng.choice("st"), turn % 3 != 1
        rows = [
            {"external_id": str(i), "title": rng.choice(names), "starts_at": NOW + timedelta(days=rng.choice([3, 4]), hours=rng.choice([0, 1])), "url": f"https://{source}.example/{turn}/{i}"}
            for i in rng.sample(range(8), 5)
        ]
        ingest(store, source, row(spark, rows, source), NOW, complete=complete)
        links = full_recount(store)
        events = {r.id: r for r in store.stored("events").collect()}
        assert {k: (r.links, r.live) for k, r in events.items()} == {k: (len(links.get(k, [])), sum(links.get(k, []))) for k in events}
        assert all(r.source_count == max(r.links, 1) for r in events.values()) and set(links) <= set(events)
        assert not complete or all(r.live > 0 for r in events.values())
        assert all(r.event_id in events and r.candidate_event_id in events for r in store.read("merge_reviews").collect())


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    far = {"external_id": "2", "title": "Night of jazz", "starts_at": NOW + timedelta(days=20)}
    ingest(store, "s", row(spark, [{"external_id": "1", "title": "Harbour market"}, far]), NOW)

    def files():
        return {t: set(store.read(t).inputFiles()) for t in ("events", "source_records", "event_links")}

    before = files()
    ingest(store, "s", row(spark, [{"external_id": "1", "title": "Harbour market", "summary": "new"}]), NOW, complete=False)
    after = files()
    for table in before:
        assert len(before[table]) == len(after[table]) == 2 and len(before[table] & after[table]) == 1, table
    assert all("/p=2026-03-21/" in f for f in before["events"] & after["events"])
    ingest(store, "s", row(spark, [{"external_id": "1", "title": "Harbour market", "summary": "newer"}]), NOW, complete=False)
    left = {str(p) for p in (tmp_path / "store" / "events").rglob("*.parquet")}
    held = {f.removeprefix("file://").removeprefix("file:") for f in files()["events"] | after["events"]}
    assert left == held  # what the last two steps point to
    assert len(list((tmp_path / "store").glob("manifest-*.json"))) == 2


def test_only_the_apis_have_a_horizon(spark, tmp_path):
    """Events on a page with markup stay, however far ahead; an API's beyond the horizon are left out."""
    store = Store(spark, str(tmp_path / "store"), 2)
    sources = spark.createDataFrame([(s, None, "x", None, True, None, None) for s in ("venue_site", "listing_a")], schemas.SOURCE)
    rows = [{"external_id": str(d), "title": f"Show number {d} of {d}", "starts_at": NOW + timedelta(days=d)} for d in (10, 100, 200)]
    for days in (400, 120):
        assert run_source(store, sources, "venue_site", lambda c: row(spark, rows, "venue_site"), NOW, horizon_days=days)["fetched"] == 3
    assert store.read("source_records").filter("gone_at IS NULL").count() == 3 == store.read("events").count()
    assert run_source(store, sources, "listing_a", lambda c: row(spark, rows, "listing_a"), NOW)["fetched"] == 2


def test_a_failure_keeps_what_came_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 2)
    sources = spark.createDataFrame([("s", None, "x", None, True, None, None)], schemas.SOURCE)
    tries = []

    def fetch(config):
        tries.append(store.runs().filter("status = 'running'").count())
        yield row(spark, [{"external_id": "1", "title": "Harbour market"}])
        if len(tries) == 1:
            raise OSError("page 2 is down")
        yield row(spark, [{"external_id": "2", "title": "Night of jazz"}])

    with pytest.raises(OSError):
        run_source(store, sources, "s", fetch, NOW)
    assert list(titles(store)) == ["Harbour market"]
    (failed,) = store.runs().collect()
    assert (failed.status, failed.fetched, failed.created, failed.error) == ("failed", 1, 1, "page 2 is down")
    tries.clear()
    assert run_source(store, sources, "s", fetch, NOW, retries=2, backoff_seconds=0)["created"] == 1
    assert tries == [1, 1] and sorted(titles(store)) == ["Harbour market", "Night of jazz"]
    assert sorted(r.status for r in store.runs().collect()) == ["failed", "failed", "ok"]
    with store.only_run("s"), pytest.raises(Busy):
        run_source(store, sources, "s", fetch, NOW, retries=2)
    with store.only_run("s"):
        pass


def test_stream_takes_in_what_landed(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    event = {"id": 1, "name": "Indie Night", "datetime_start": "2026-03-14 19:30:00"}
    (landing / "1.json").write_text(json.dumps({"events": [event]}))
    store = Store(spark, str(tmp_path / "store"), 2)
    for more in (None, {"id": 2, "name": "Jazz", "datetime_start": "2026-03-15 19:30:00"}):
        if more:
            (landing / "2.json").write_text(json.dumps({"events": [event, more]}))
        ingest_stream(spark, str(landing), str(tmp_path / "offsets"), store, "listing_a", lambda p: normalize_a(events_a(p)), lambda: NOW).awaitTermination()
    assert sorted(titles(store)) == ["Indie Night", "Jazz"]


def test_feed_query_is_validated():
    for bad in ({"city": "x"}, {"date": "soon"}, {"bbox": "1,2,3"}, {"q": " "}, {"limit": 0}, {"limit": 201}):
        with pytest.raises(ValueError):
            feed.FeedQuery(**bad)
    assert feed.FeedQuery(free="false").free is True and feed.FeedQuery().limit == 60


def test_cursor():
    at = datetime(2026, 3, 14, 6, 30, 0, 123456, tzinfo=timezone.utc)
    assert feed.decode_cursor(feed.encode_cursor(at, "x|y")) == (at.replace(microsecond=123000), "x|y")
    assert feed.decode_cursor("junk") is None and feed.decode_cursor(None) is None


def test_pages_cover_the_feed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 2)
    names = ["Alpha", "Bravo", "Charlie", "Delta", "Echo"]
    ingest(store, "s", row(spark, [{"external_id": n, "title": n} for n in names]), NOW)
    seen, cursor = [], None
    while True:
        page = feed.find_page(store.read("events"), store.read("venues"), feed.FeedQuery(limit=2, cursor=cursor), NOW)
        seen += [r.title for r in page.events.collect()]
        cursor = page.next_cursor
        if not cursor:
            break
    assert sorted(seen) == names
    assert json.loads(feed.page_json(page))["nextCursor"] is None


def test_demo_feed(spark):
    rows = demo_events(spark, NOW)
    query = feed.FeedQuery(**feed.LANDING | {"date": "all"})
    assert rows.count() == 12 and feed.demo_feed(rows, query, NOW).count() == 7
    assert feed.demo_feed(rows, feed.FeedQuery(date="all", free=True), NOW).count() == 5
    assert feed.demo_feed(rows, feed.FeedQuery(date="all", q="100%"), NOW).count() == 0


def test_map_layers(spark):
    points = spark.createDataFrame([(i, -36.85, 174.76) for i in range(12)] + [(99, None, None)], "id long, lat double, lng double")
    assert [(r.point_count, r.size) for r in mapgrid.clusters(points, 9).collect()] == [(12, "medium")]
    weights = spark.createDataFrame([(None,), (0,), (4000,), (9000,)], "p int").select(mapgrid.heat_weight(F.col("p"))).collect()
    assert [round(r[0], 6) for r in weights] == [0.3, 0.3, 1.0, 1.0]

"""The data source against a server on this machine."""

import json
import threading
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from tidemark import schemas
from tidemark.plans.ingest import run_source
from tidemark.plans.store import Store
from tidemark.sources import web

NOW = datetime(2026, 3, 1, tzinfo=timezone.utc)
TITLES = [f"Concert of the choir number {i}" for i in range(7)]


class Server(ThreadingHTTPServer):
    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.asked, self.fail, self.flaky = [], set(), set()
        self.base = f"http://127.0.0.1:{self.server_port}"


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_GET(self):
        url = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        self.server.asked.append((url.path, q, self.headers.get("authorization")))
        key = q.get("offset") or q.get("page") or url.path
        if key in self.server.fail or key in self.server.flaky:
            self.server.flaky.discard(key)
            self.send_response(503)
            self.end_headers()
            return
        start = lambda i: f"2026-03-{10 + i} 19:30:00"
        if url.path == "/a/events.json":
            first, rows = int(q["offset"]), int(q["rows"])
            body = json.dumps({"events": [{"id": i, "name": t, "datetime_start": start(i)} for i, t in enumerate(TITLES)][first : first + rows]})
        elif url.path == "/b/events.json":
            first, size = int(q["page"]) * int(q["size"]), int(q["size"])
            events = [{"id": f"b{i}", "name": t, "dates": {"start": {"localDate": f"2026-03-{10 + i}"}}} for i, t in enumerate(TITLES)][first : first + size]
            body = json.dumps({"_embedded": {"events": events}, "page": {"totalPages": -(-len(TITLES) // size), "number": int(q["page"])}})
        else:
            event = {"@type": "MusicEvent", "name": f"Evening at {url.path[1:]}", "startDate": "2027-03-14T19:30:00Z"}
            body = f"<html><script type='application/ld+json'>{json.dumps(event)}</script></html>"
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())


@pytest.fixture
def server():
    held = Server()
    thread = threading.Thread(target=held.serve_forever, daemon=True)
    thread.start()
    yield held
    held.shutdown()
    held.server_close()


def read(spark, **options):
    spark.dataSource.register(web.ListingPages)
    rows = spark.read.format(web.FORMAT).options(pause="0", retryAfter="0", now=NOW.isoformat(), **options).load().collect()  # sorting there would read twice
    return sorted(rows, key=lambda r: r.number)


def test_pages_of_the_first_api_follow_one_another(spark, server):
    rows = read(spark, api="a", base=server.base + "/a", rows="3", horizonDays="30", user="u", password="p")
    assert [len(json.loads(r.page)["events"]) for r in rows] == [3, 3, 1]
    asked = [q for _, q, _ in server.asked]
    assert [q["offset"] for q in asked] == ["0", "3", "6"] and asked[0]["end_date"] == "2026-03-31" and server.asked[0][2] == "Basic dTpw"
    server.fail.add("3")
    rows = read(spark, api="a", base=server.base + "/a", rows="3")
    assert [(r.page is None, r.error is None) for r in rows] == [(False, True), (True, False)]
    server.fail.clear()
    server.flaky.add("3")  # fails once
    assert len(read(spark, api="a", base=server.base + "/a", rows="3")) == 3


def test_pages_of_the_second_api_are_partitions(spark, server):
    server.fail.add("1")
    rows = read(spark, api="b", base=server.base + "/b", rows="2", key="k", horizonDays="10")
    assert [r.error is None for r in rows] == [True, False, True, True]
    assert {(q["startDateTime"], q["endDateTime"], q["apikey"]) for _, q, _ in server.asked} == {("2026-03-01T00:00:00Z", "2026-03-11T00:00:00Z", "k")}
    assert [r.name for r in rows] == sorted(r.name for r in rows)
    pages = web.Pages({"api": "b", "base": server.base + "/b", "rows": "200"})
    assert len(pages.partitions()) == 1
    with pytest.raises(ValueError):
        web.Pages({"api": "c"})


def test_page_ceiling(monkeypatch):
    monkeypatch.setattr(web, "get", lambda *a: json.dumps({"page": {"totalPages": 40}}))
    assert [p.number for p in web.Pages({"api": "b", "base": "x"}).partitions()] == [0, 1, 2, 3, 4]


def test_pages_of_another_shape_end_the_walk(monkeypatch):
    for page in ("[]", "nothing", '{"events": 3}', '{"events": []}'):
        monkeypatch.setattr(web, "get", lambda *a, p=page: p)
        held = web.Pages({"api": "a", "base": "x"})
        assert list(held.read(held.partitions()[0])) == []


def test_runs_from_the_web(spark, server, tmp_path):
    """A failing page of an API fails the run after the others are taken in; a seed that fails is left out."""
    store = Store(spark, str(tmp_path / "store"), 2)
    seeds = json.dumps([f"{server.base}/{x}" for x in ("hall", "down", "pier")])
    config = {"pause": "0", "retryAfter": "0"}
    sources = spark.createDataFrame(
        [("listing_b", None, "api", None, True, config | {"base": server.base + "/b", "rows": "2"}, None), ("sites", None, "jsonld", None, True, config | {"seeds": seeds, "defaultCity": "taupo"}, None)],
        schemas.SOURCE,
    )
    server.fail |= {"1", "/down"}
    with pytest.raises(web.FetchFailed):
        run_source(store, sources, "listing_b", web.fetcher(spark, "listing_b", NOW), NOW)
    found = {r.title: r for r in store.read("events").collect()}
    assert sorted(found) == [t for i, t in enumerate(TITLES) if i not in (2, 3)]
    assert [(r.status, r.fetched) for r in store.runs().collect()] == [("failed", 5)]
    assert run_source(store, sources, "sites", web.fetcher(spark, "sites", NOW), NOW)["created"] == 2  # a year ahead
    assert {r.title for r in store.read("events").filter("city_slug = 'taupo'").collect()} == {"Evening at hall", "Evening at pier"}


def test_a_stream_crawls_when_its_time_has_come(spark, server, tmp_path):
    spark.dataSource.register(web.ListingPages)
    got = []
    stream = spark.readStream.format(web.FORMAT).options(api="a", base=server.base + "/a", rows="4", pause="0", every="3600000").load()
    query = stream.writeStream.foreachBatch(lambda df, n: got.append([r.number for r in df.collect()])).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [sorted(x) for x in got if x] == [[0, 1]]
    reader = web.PageStreamReader({"every": "60"})
    assert reader.partitions({"crawl": 5}, {"crawl": 5}) == [] and reader.initialOffset() == {"crawl": 0}
    assert abs(reader.latestOffset()["crawl"] - datetime.now(timezone.utc).timestamp() / 60) <= 2

"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dimensions import CATEGORIES, CATEGORY_LABELS, CATEGORY_RULES, CITIES, CITY_LABELS, NOISE_WORDS
from .functions import geo, localtime, text
from .operators import block, mapgrid, match, merge, nearby, report
from .operators.resolve import resolve
from .operators.title_index import TitleIndex
from .plans import driver_tables as tables
from .plans import feed as feeds
from .plans import zones
from .plans.driver_tables import NOW, read
from .plans.search_index import SearchIndex
from .sources import markup
from .storage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _wall(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


# --- feed ---------------------------------------------------------------------------------
_CATEGORY_LIST = ", ".join(f"'{c}'" for c in CATEGORIES)
_FEED = f"""
    WITH e AS (
      SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS id, event_type || ' ' || user_id AS title, props AS summary,
        [{_CATEGORY_LIST}][event_id % 9 + 1] AS category, date_trunc('hour', ts) AS starts_at, event_id % 5 = 0 AS is_free,
        CASE WHEN event_id % 10 != 3 THEN value END AS price_from,
        CASE WHEN event_id % 10 != 0 THEN -36.85 + ((user_id * 37) % 100 - 50) / 50.0::DOUBLE END AS lat,
        CASE WHEN event_id % 10 != 0 THEN 174.76 + ((user_id * 53) % 100 - 50) / 50.0::DOUBLE END AS lng,
        CASE WHEN user_id % 3 = 0 THEN 'wellington' ELSE 'auckland' END AS city_slug,
        CASE WHEN event_id % 10 != 7 THEN user_id END AS venue
      FROM events)
    SELECT id, title, category, starts_at, is_free, round(price_from, 6) AS price_from, city_slug, round(lat, 6) AS lat,
      round(lng, 6) AS lng, c_name AS venue_name
    FROM e LEFT JOIN customer ON venue = c_custkey WHERE """
_END = " ORDER BY starts_at, id LIMIT 61"
_WEEK = "starts_at >= TIMESTAMP '2024-01-15 02:00:00' AND starts_at < TIMESTAMP '2024-01-22 11:00:00'"
_ALL = "starts_at >= TIMESTAMP '2024-01-15 02:00:00'"


def _hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"2 * 6371000 * asin(least(1.0, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin((radians({lng2}) - radians({lng1})) / 2), 2))))"
    )


def _feed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    page = feeds.feed(tables.feed_events(spark, sf_dir), tables.venues(spark, sf_dir), feeds.FeedQuery(**options), NOW)
    return _cards(page)


def _cards(page: DataFrame) -> DataFrame:
    return page.select(
        "id", "title", "category", _wall("starts_at"), "is_free", F.round("price_from", 6).alias("price_from"), "city_slug",
        F.round("point.lat", 6).alias("lat"), F.round("point.lng", 6).alias("lng"), F.col("venue.name").alias("venue_name"),
    )


@query(_FEED + _WEEK + _END)
def feed_week(spark, sf_dir):
    return _feed(spark, sf_dir)


@query(_FEED + "starts_at >= TIMESTAMP '2024-01-19 11:00:00' AND starts_at < TIMESTAMP '2024-01-21 11:00:00'" + _END)
def feed_weekend(spark, sf_dir):
    return _feed(spark, sf_dir, date="weekend")


@query(_FEED + "starts_at >= TIMESTAMP '2024-01-15 11:00:00' AND starts_at < TIMESTAMP '2024-01-16 11:00:00'" + _END)
def feed_tomorrow(spark, sf_dir):
    return _feed(spark, sf_dir, date="tomorrow")


@query(_FEED + _ALL + " AND category = 'music' AND is_free" + _END)
def feed_free(spark, sf_dir):
    return _feed(spark, sf_dir, date="all", category="music", free="false")


@query(_FEED + _ALL + " AND lng BETWEEN 174.5 AND 175.0 AND lat BETWEEN -37.0 AND -36.5" + _END)
def feed_bbox(spark, sf_dir):
    return _feed(spark, sf_dir, date="all", bbox="174.5,-37.0,175.0,-36.5")


@query(_FEED + _ALL + " AND city_slug = 'auckland' AND " + _hav("lat", "lng", "-36.8509", "174.7645") + " <= 45000" + _END)
def feed_radius(spark, sf_dir):
    return _feed(spark, sf_dir, date="all", city="auckland")


@query(_FEED + _ALL + " AND title || '  ' || summary || ' ' ILIKE '%sign_p%7%'" + _END)
def feed_search_ilike(spark, sf_dir):
    return _feed(spark, sf_dir, date="all", q="SIGN_p%7")


@query(
    _FEED
    + _ALL
    + " AND (starts_at, id) > (SELECT (s, i) FROM (SELECT date_trunc('hour', ts) AS s, lpad(CAST(event_id AS VARCHAR), 10, '0') AS i FROM events"
    " WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-15 02:00:00' ORDER BY 1, 2 LIMIT 1 OFFSET 59))" + _END
)
def feed_keyset_page2(spark, sf_dir):
    first = feeds.find_page(tables.feed_events(spark, sf_dir), tables.venues(spark, sf_dir), feeds.FeedQuery(date="all"), NOW)
    return _feed(spark, sf_dir, date="all", cursor=first.next_cursor)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stored_feed(spark: SparkSession, sf_dir: str, events: DataFrame, **options) -> DataFrame:
    return _cards(feeds.feed(events, tables.venues(spark, sf_dir), feeds.FeedQuery(date="all", **options), NOW))


@query(_FEED + _ALL + " AND title || '  ' || summary || ' ' ILIKE '%sign_p%7%'" + _END)
def feed_search_indexed(spark, sf_dir):
    """The search by a stored index of grams: only candidates' texts are looked at."""
    events = tables.feed_events(spark, sf_dir)
    index = SearchIndex(spark, _folder(spark, "search-index"))
    index.build(events)
    return _stored_feed(spark, sf_dir, index.search(events, "SIGN_p%7"), q="SIGN_p%7")


@query(_FEED + _ALL + " AND lng BETWEEN 174.5 AND 175.0 AND lat BETWEEN -37.0 AND -36.5" + _END)
def feed_bbox_zoned(spark, sf_dir):
    """The box over events that are stored by zones: files outside of it are not opened."""
    path = _folder(spark, "zones")
    zones.write(tables.feed_events(spark, sf_dir), path)
    return _stored_feed(spark, sf_dir, zones.read(spark, path, (174.5, -37.0, 175.0, -36.5)), bbox="174.5,-37.0,175.0,-36.5")


@query(_FEED + _ALL + " AND city_slug = 'auckland' AND " + _hav("lat", "lng", "-36.8509", "174.7645") + " <= 45000" + _END)
def feed_radius_zoned(spark, sf_dir):
    path = _folder(spark, "zones")
    zones.write(tables.feed_events(spark, sf_dir), path)
    city = CITIES[0]
    return _stored_feed(spark, sf_dir, zones.read(spark, path, zones.box_around(city[1:3], city[3])), city=city[0])


_DEMO = "SELECT date_trunc('hour', ts) AS starts_at FROM events WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-15 02:00:00' AND user_id % 3 = 0 AND event_id % 5 = 0 ORDER BY 1 LIMIT 200"


@query(_DEMO)
def feed_demo(spark, sf_dir):
    """The feed over rows in memory; its order is by start alone, so only starts tell."""
    events = tables.feed_events(spark, sf_dir).withColumns({"lat": F.col("point.lat"), "lng": F.col("point.lng")})
    return feeds.demo_feed(events, feeds.FeedQuery(date="all", city="wellington", free=True, limit=200), NOW).select(_wall("starts_at"))


def _sql_label(column: str, labels: dict, which: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v[which]}'" for k, v in labels.items()) + " END"


_LABELS = " UNION ALL ".join(
    f"""SELECT id, '{lang}' AS lang, title, {_sql_label('category', CATEGORY_LABELS, i)} AS category, {_sql_label('city_slug', CITY_LABELS, i)} AS city,
    strftime(starts_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS starts_at FROM page"""
    for i, lang in enumerate(("en", "zh"))
)


@query(f"WITH page AS ({_FEED + _WEEK + _END}) {_LABELS}")
def feed_labels(spark, sf_dir):
    """A page in two languages."""
    page = feeds.feed(tables.feed_events(spark, sf_dir), tables.venues(spark, sf_dir), feeds.FeedQuery(), NOW)
    now = F.lit("2024-01-15 02:00:00").cast("timestamp_ntz")
    both = [feeds.labelled(page, now, lang).withColumn("lang", F.lit(lang)) for lang in ("en", "zh")]
    return both[0].unionByName(both[1]).drop("when")


@query(_FEED + "id = '0000000042'")
def event_by_id(spark, sf_dir):
    return _cards(feeds.event_by_id(tables.feed_events(spark, sf_dir), tables.venues(spark, sf_dir), "0000000042"))


# --- time ---------------------------------------------------------------------------------
def _local(x: str) -> str:
    return f"timezone('Pacific/Auckland', timezone('UTC', {x}))"


def _utc(x: str) -> str:
    return f"timezone('UTC', timezone('Pacific/Auckland', {x}))"


@query(f"""SELECT o_orderkey, {_local('o_orderdate')} AS wall, CAST(CAST({_local('o_orderdate')} AS DATE) AS VARCHAR) AS day,
    CAST(isodow({_local('o_orderdate')}) AS INTEGER) AS weekday,
    {_utc(f"CAST(CAST({_local('o_orderdate')} AS DATE) AS TIMESTAMP)")} AS day_start,
    CAST(date_diff('second', o_orderdate, {_local('o_orderdate')}) / 3600.0 AS DOUBLE) AS offset_hours FROM orders""")
def nz_local_parts(spark, sf_dir):
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", localtime.local_wall(at).alias("wall"), localtime.local_date(at).cast("string").alias("day"), localtime.local_weekday(at).cast("int").alias("weekday"),
        localtime.start_of_day(at).alias("day_start"), localtime.offset_hours(at).cast("double").alias("offset_hours"),
    )


_WALL = "o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) + INTERVAL 30 MINUTE"


@query(f"SELECT o_orderkey, {_utc(_WALL)} AS utc FROM orders")
def nz_wall_to_utc(spark, sf_dir):
    wall = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"), mins=F.lit(30))
    return read(spark, sf_dir, "orders").select("o_orderkey", localtime.wall_to_utc(wall).alias("utc"))


def _day(n: str) -> str:
    return _utc(f"CAST(CAST({_local('o_orderdate')} AS DATE) + CAST({n} AS INTEGER) AS TIMESTAMP)")


_SAT = f"CASE isodow({_local('o_orderdate')}) WHEN 7 THEN -1 ELSE 6 - isodow({_local('o_orderdate')}) END"


@query(f"""SELECT o_orderkey, {_day('1')} AS today_to, {_day('1')} AS tomorrow_from, {_day('2')} AS tomorrow_to,
    greatest(o_orderdate, {_day(f'({_SAT})')}) AS weekend_from, {_day(f'({_SAT}) + 2')} AS weekend_to, {_day('8')} AS week_to FROM orders""")
def date_buckets(spark, sf_dir):
    at = F.col("o_orderdate")
    bounds = {b: localtime.bucket_bounds(b, at) for b in ("today", "tomorrow", "weekend", "week")}
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", bounds["today"][1].alias("today_to"), bounds["tomorrow"][0].alias("tomorrow_from"), bounds["tomorrow"][1].alias("tomorrow_to"),
        bounds["weekend"][0].alias("weekend_from"), bounds["weekend"][1].alias("weekend_to"), bounds["week"][1].alias("week_to"),
    )


@query(f"""SELECT event_id, CASE date_diff('day', DATE '2024-01-15', CAST({_local('ts')} AS DATE)) WHEN 0 THEN 'Today' WHEN 1 THEN 'Tomorrow'
    ELSE strftime({_local('ts')}, '%a, %-d %b') END || ' ' || strftime({_local('ts')}, '%H:%M') AS label FROM events""")
def when_labels(spark, sf_dir):
    now = F.lit("2024-01-15 02:00:00").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").select("event_id", localtime.when_label(F.col("ts"), now).alias("label"))


# --- text ---------------------------------------------------------------------------------
@query("SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def deaccent_docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.deaccent(F.col("text"))).alias("plain"))


def _sql_clean(x: str) -> str:
    plain = f"regexp_replace(regexp_replace(strip_accents(lower({x})), '\\([^)]*\\)', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g')"
    return f"regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"


_NOISE = "[" + ", ".join(f"'{w}'" for w in NOISE_WORDS) + "]"


def _sql_tokens(x: str) -> str:
    return f"list_filter(string_split({_sql_clean(x)}, ' '), lambda w: w != '' AND NOT list_contains({_NOISE}, w))"


def _sql_print(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({_sql_tokens(x)})), ' ')"


_TITLE = "CASE event_id % 4 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN p_name || ' (Live)' WHEN 2 THEN upper(p_name) ELSE 'Café ' || p_name END"


@query(f"SELECT p_partkey, {_sql_print(_TITLE.replace('event_id', 'p_partkey'))} AS fingerprint FROM part")
def fingerprint_part(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    title = F.when(k == 0, F.concat(F.lit("The "), name)).when(k == 1, F.concat(name, F.lit(" (Live)"))).when(k == 2, F.upper(name)).otherwise(F.concat(F.lit("Café "), name))
    return read(spark, sf_dir, "part").select("p_partkey", text.title_fingerprint(title).alias("fingerprint"))


@query("SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(strip_accents('The ' || s_name)), '^the\\s+', ''), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name_key FROM supplier")
def venue_key_supplier(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.venue_key(F.concat(F.lit("The "), "s_name")).alias("name_key"))


_CASE = " ".join(f"WHEN regexp_matches(t, '{'|'.join(words)}') THEN '{slug}'" for slug, words in CATEGORY_RULES)


@query(f"SELECT doc_id, CASE WHEN t = '' THEN 'other' {_CASE} ELSE 'other' END AS category FROM (SELECT doc_id, lower(text || ' ' || source) AS t FROM documents)")
def category_infer(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.infer_category(F.col("text"), F.col("source")).alias("category"))


@query("SELECT event_id, sha256(props)[1:32] AS content_hash FROM events")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", text.content_hash(F.col("props")).alias("content_hash"))


@query("SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), lambda x: trim(x))[1] AS script FROM pages")
def script_extract(spark, sf_dir):
    found = F.regexp_extract_all(F.col("html"), F.lit("(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", F.trim(F.try_element_at(found, F.lit(1))).alias("script"))


@query("SELECT page_id, substring(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 600) AS summary FROM pages")
def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.summary_text(F.col("html"), tags=True).alias("summary"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), '^www\\.', ''), '\\..*$', '') AS slug FROM pages")
def host_slugs(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.host_slug(F.col("url")).alias("slug"))


@query("""SELECT c_custkey, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda h, c: (h * 31 + c) & 4294967295) % 6 AS INTEGER) AS kind FROM customer""")
def placeholder_hash(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.placeholder(F.col("c_name")).alias("kind"))


# --- similarity ---------------------------------------------------------------------------
def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct names that share their first word."""
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    a = names.select(F.col("p_name").alias("a"), F.split("p_name", " ")[0].alias("w"))
    b = names.select(F.col("p_name").alias("b"), F.split("p_name", " ")[0].alias("w"))
    return a.join(b, "w").filter("a < b").select("a", "b")


_PAIRS = "FROM (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM (SELECT DISTINCT p_name FROM part) x JOIN (SELECT DISTINCT p_name FROM part) y ON split_part(x.p_name, ' ', 1) = split_part(y.p_name, ' ', 1) AND x.p_name < y.p_name)"


def _sql_grams(x: str) -> str:
    p = f"'  ' || trim(regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    return f"list_distinct(list_transform(range(1, length({p}) - 1), lambda i: substring({p}, i, 3)))"


def _sql_words(x: str) -> str:
    w = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w != '')"
    return f"list_distinct(flatten(list_transform({w}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def _sql_jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both} / CAST(len({a}) + len({b}) - {both} AS DOUBLE) END"


def _sql_dice(a: str, b: str) -> str:
    return f"2.0 * len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) AS DOUBLE)"


@query(f"SELECT a, b, round(CAST({_sql_jaccard('ta', 'tb')} AS DOUBLE), 6) AS jaccard FROM (SELECT a, b, list_distinct({_sql_tokens('a')}) AS ta, list_distinct({_sql_tokens('b')}) AS tb {_PAIRS})")
def token_jaccard_pairs(spark, sf_dir):
    pairs = _name_pairs(spark, sf_dir)
    return pairs.select("a", "b", F.round(text.jaccard(text.title_tokens(F.col("a")), text.title_tokens(F.col("b"))), 6).alias("jaccard"))


@query(f"SELECT a, b, round(CAST({_sql_dice('ga', 'gb')} AS DOUBLE), 6) AS dice FROM (SELECT a, b, {_sql_grams('a')} AS ga, {_sql_grams('b')} AS gb {_PAIRS})")
def trigram_dice_pairs(spark, sf_dir):
    pairs = _name_pairs(spark, sf_dir)
    return pairs.select("a", "b", F.round(text.dice(text.title_grams(F.col("a")), text.title_grams(F.col("b"))), 6).alias("dice"))


@query(f"SELECT a, b, round(CAST(CAST({_sql_jaccard('wa', 'wb')} AS FLOAT) AS DOUBLE), 6) AS similarity FROM (SELECT a, b, {_sql_words('a')} AS wa, {_sql_words('b')} AS wb {_PAIRS})")
def word_trigram_pairs(spark, sf_dir):
    pairs = _name_pairs(spark, sf_dir)
    found = text.trigram_similarity(text.word_trigrams(F.col("a")), text.word_trigrams(F.col("b")))
    return pairs.select("a", "b", F.round(found.cast("double"), 6).alias("similarity"))


# --- places -------------------------------------------------------------------------------
def _km(c: tuple) -> str:
    x = f"radians({c[2]} - lng) * cos(radians((lat + {c[1]}) / 2))"
    return f"sqrt(pow({x}, 2) + pow(radians({c[1]} - lat), 2)) * 6371"


_CENTRES = [*[(c[1], c[2]) for c in CITIES], (-30.0, 170.0)]
_NEAR = ", ".join(f"struct_pack(km := {_km(c)}, i := {i}, slug := '{c[0]}', r := {c[3]})" for i, c in enumerate(CITIES))


@query(f"""WITH p AS (SELECT c_custkey, [{', '.join(str(c[0]) for c in _CENTRES)}][c_custkey % 6 + 1]::DOUBLE + ((c_custkey * 37) % 100 - 50) / 100.0::DOUBLE AS lat,
    [{', '.join(str(c[1]) for c in _CENTRES)}][c_custkey % 6 + 1]::DOUBLE AS lng FROM customer)
    SELECT c_custkey, list_min(list_filter([{_NEAR}], lambda c: c.km <= c.r)).slug AS city,
    round({_hav('lat', 'lng', '-36.8509', '174.7645')}, 3) AS meters FROM p""")
def haversine_nearest_city(spark, sf_dir):
    k = F.col("c_custkey")
    at = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in _CENTRES]), (k % 6 + 1).cast("int"))
    points = read(spark, sf_dir, "customer").select("c_custkey", (at(0) + ((k * 37) % 100 - 50) / 100.0).alias("lat"), at(1).alias("lng"))
    lat, lng = F.col("lat"), F.col("lng")
    meters = geo.haversine_m(lat, lng, F.lit(CITIES[0][1]), F.lit(CITIES[0][2]))
    return points.select("c_custkey", geo.nearest_city(lat, lng).alias("city"), F.round(meters, 3).alias("meters"))


_GEO = "SELECT event_id, event_id % 5000 AS popularity, CASE WHEN event_id % 10 != 0 THEN -36.85 + ((user_id * 37) % 100 - 50) / 50.0::DOUBLE END AS lat, CASE WHEN event_id % 10 != 0 THEN 174.76 + ((user_id * 53) % 100 - 50) / 50.0::DOUBLE END AS lng FROM events"
_CELLS = mapgrid.TILE * 2.0**9 / mapgrid.CLUSTER_PIXELS
_X = f"CAST(floor((lng + 180) / 360 * {_CELLS}) AS BIGINT)"
_Y = f"CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * {_CELLS}) AS BIGINT)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.feed_events(spark, sf_dir).select("id", "popularity", F.col("point.lat").alias("lat"), F.col("point.lng").alias("lng"))


@query(f"""SELECT tile_x, tile_y, point_count, CASE WHEN point_count < 10 THEN 'small' WHEN point_count < 30 THEN 'medium' ELSE 'large' END AS size
    FROM (SELECT {_X} AS tile_x, {_Y} AS tile_y, count(*) AS point_count FROM ({_GEO}) WHERE lat IS NOT NULL GROUP BY 1, 2)""")
def map_grid(spark, sf_dir):
    return mapgrid.clusters(_points(spark, sf_dir), 9)


@query(f"""SELECT {_X} AS tile_x, {_Y} AS tile_y, round(sum(0.3 + 0.7 * least(greatest(popularity, 0), 4000) / 4000.0::DOUBLE), 6) AS heat
    FROM ({_GEO}) WHERE lat IS NOT NULL GROUP BY 1, 2""")
def heat_weight(spark, sf_dir):
    x, y = mapgrid.tile(F.col("lat"), F.col("lng"), 9)
    points = _points(spark, sf_dir).filter("lat IS NOT NULL")
    return points.groupBy(x.alias("tile_x"), y.alias("tile_y")).agg(F.round(F.sum(mapgrid.heat_weight(F.col("popularity"))), 6).alias("heat"))


@query(f"""SELECT event_id AS id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(round(lng * 100) AS BIGINT) || ',' || CAST(round(lat * 100) AS BIGINT)
    || ']}},"properties":{{"id":' || event_id || ',"popularity":' || popularity || ',"active":' || (event_id = 42) || '}}}}' AS feature FROM ({_GEO}) WHERE lat IS NOT NULL""")
def geojson_features(spark, sf_dir):
    id_ = F.col("id").cast("long")
    hundredths = lambda c: F.round(F.col(c) * 100).cast("long")
    feature = mapgrid.geojson_feature(id_, F.col("popularity"), hundredths("lat"), hundredths("lng"), id_ == 42)
    return _points(spark, sf_dir).select(id_.alias("id"), feature.alias("feature")).filter("feature IS NOT NULL")


# --- matching -----------------------------------------------------------------------------
_LISTINGS = f"""l AS (SELECT event_id AS seq, lpad(CAST(event_id AS VARCHAR), 10, '0') AS id, {_TITLE} AS title, ts AS starts_at,
      'https://x.example/' || (event_id % 997) AS url, CASE WHEN event_id % 3 = 0 THEN CAST(user_id % 5 AS VARCHAR) END AS venue_id,
      CASE WHEN event_id % 10 != 0 THEN -36.85 + (event_id % 7) * 0.001::DOUBLE END AS lat
      FROM events JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part)),
    t AS (SELECT title, list_distinct({_sql_tokens('title')}) AS tokens, {_sql_print('title')} AS fp, {_sql_grams('title')} AS grams, {_sql_words('title')} AS words
      FROM (SELECT DISTINCT title FROM l)),
    tp AS (SELECT x.title AS lt, y.title AS rt, x.fp = y.fp AS same_print,
      greatest({_sql_jaccard('x.tokens', 'y.tokens')}, {_sql_dice('x.grams', 'y.grams')}) AS similarity
      FROM t x JOIN t y ON x.fp = y.fp OR CAST({_sql_jaccard('x.words', 'y.words')} AS FLOAT)::DOUBLE > 0.3),
    c AS (SELECT a.id AS left_id, b.id AS right_id, similarity, same_print, abs(epoch_us(a.starts_at) - epoch_us(b.starts_at)) / 6e7 AS minutes,
      a.url = b.url AS same_url, CASE WHEN a.venue_id IS NOT NULL AND b.venue_id IS NOT NULL THEN (a.venue_id = b.venue_id)::INT::DOUBLE
      WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN greatest(0.0, least(1.0, 1 - ({_hav('a.lat', '174.76', 'b.lat', '174.76')} - 150) / 350.0)) END AS geo
      FROM l a JOIN tp ON a.title = lt JOIN l b ON b.title = rt AND a.id < b.id AND abs(epoch_us(a.starts_at) - epoch_us(b.starts_at)) <= 7200000000),
    m AS (SELECT *, greatest(0.0, least(1.0, 1 - (minutes - 30) / 90.0)) AS time FROM c),
    s AS (SELECT *, similarity < 0.55 OR time <= 0 OR coalesce(geo <= 0, false) AS veto,
      CASE WHEN geo IS NULL THEN 0.6 * similarity + 0.25 * time ELSE 0.5 * similarity + 0.2 * time + 0.3 * geo END AS score FROM m),
    v AS (SELECT left_id, right_id, similarity, same_print, minutes, CASE WHEN same_url THEN 1.0 WHEN veto THEN 0.0 ELSE score END AS confidence,
      CASE WHEN same_url THEN 'same' WHEN veto THEN 'different' WHEN score >= 0.8 THEN 'same' WHEN score >= 0.62 THEN 'review' ELSE 'different' END AS verdict FROM s)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.listings(spark, sf_dir)
    pairs = block.candidate_pairs(rows, rows, ["id", "url", "venue_id", "point"]).filter("l_id < r_id")
    minutes = F.abs(block.seconds_between("l_starts_at", "r_starts_at")) / 60
    place = match.place_score(F.col("l_venue_id"), F.col("r_venue_id"), F.col("l_point"), F.col("r_point"))
    found = match.verdict(F.col("similarity"), F.col("time"), F.col("geo"), match.equal_urls(F.col("l_url"), F.col("r_url")))
    # in steps, so that the distance of a pair is computed once
    return pairs.withColumns({"minutes": minutes, "geo": place}).withColumn("time", match.time_score(F.col("minutes"))).withColumn("m", found)


@query(f"WITH {_LISTINGS} SELECT left_id, right_id, round(similarity, 6) AS title, CAST(round(minutes * 6e7) AS BIGINT) AS micros, round(confidence, 6) AS confidence, verdict FROM v")
def match_pairs(spark, sf_dir):
    return _matched(spark, sf_dir).select(
        F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), F.round("similarity", 6).alias("title"),
        F.round(F.col("minutes") * 6e7).cast("long").alias("micros"), F.round("m.confidence", 6).alias("confidence"), F.col("m.verdict").alias("verdict"),
    )


@query(f"WITH {_LISTINGS} SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def match_verdict_counts(spark, sf_dir):
    return nearby.verdict_counts(tables.listings(spark, sf_dir))


@query(f"WITH {_LISTINGS} SELECT lt AS l_title, rt AS r_title, round(similarity, 6) AS similarity, same_print FROM tp")
def title_index_probe(spark, sf_dir):
    """All titles listed in a stored index, half of them later, and all of them looked up in it."""
    titles = tables.listings(spark, sf_dir).select("title").distinct()
    index = TitleIndex(spark, _folder(spark, "title-index"))
    index.build(titles.filter("title < 'a'"))
    index.add(titles)
    return index.probe(titles).select("l_title", "r_title", F.round("similarity", 6).alias("similarity"), "same_print")


@query(f"""WITH {_LISTINGS} SELECT left_id, right_id, CAST(place AS INTEGER) AS place FROM (SELECT left_id, right_id,
    row_number() OVER (PARTITION BY left_id ORDER BY same_print DESC, minutes, right_id) AS place FROM v) WHERE place <= 25""")
def shortlist_top25(spark, sf_dir):
    found = nearby.nearest_likes(tables.listings(spark, sf_dir))
    return found.select(F.col("l_key").alias("left_id"), F.col("r_key").alias("right_id"), "place")


@query(f"""WITH RECURSIVE {_LISTINGS}, e AS MATERIALIZED (SELECT CAST(left_id AS BIGINT) AS a, CAST(right_id AS BIGINT) AS b FROM v UNION ALL SELECT CAST(right_id AS BIGINT), CAST(left_id AS BIGINT) FROM v),
    r(node, root) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM e GROUP BY a UNION (SELECT node, min(root) FROM (
      SELECT e.b AS node, r.root FROM r JOIN e ON e.a = r.node JOIN recurring.r AS k ON k.node = e.b WHERE r.root < k.root
      UNION ALL SELECT k.node, j.root FROM recurring.r AS k JOIN recurring.r AS j ON j.node = k.root WHERE j.root < k.root) GROUP BY node))
    SELECT node, root FROM r""")
def dedup_components(spark, sf_dir):
    """Components of the candidate pairs by their smallest listing."""
    return block.linked_groups(tables.listings(spark, sf_dir))


@query()
def dedup_fold(spark, sf_dir):
    """The ordered fold; procedural, so tested against a plain sequential fold instead."""
    return resolve(tables.listings(spark, sf_dir))


# --- stored tables ------------------------------------------------------------------------
@query("""SELECT user_id AS event_id, arg_min(event_type, event_id) FILTER (event_id % 4 != 0) AS summary, arg_min(props, event_id) FILTER (event_id % 7 = 0) AS cover_image_url,
    min(value) FILTER (value > 5) AS price_from, bool_or(event_id % 50 = 0) AS is_free, CAST(max(event_id % 5000) AS INTEGER) AS popularity FROM events GROUP BY 1""")
def enrich_bestof(spark, sf_dir):
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("event_id"), F.when(e % 4 != 0, F.col("event_type")).alias("summary"), F.when(e % 7 == 0, F.col("props")).alias("cover_image_url"),
        F.lit(None).cast("timestamp").alias("ends_at"), F.lit(None).cast("struct<lat:double,lng:double>").alias("point"),
        F.when(F.col("value") > 5, F.col("value")).alias("price_from"), (e % 50 == 0).alias("is_free"), (e % 5000).cast("int").alias("popularity"), e.alias("seq"),
    )
    return merge.best_of(rows).drop("ends_at", "point")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of the even rows as stored, those of the odd rows as a batch."""
    rows = tables.records(spark, sf_dir)
    empty = rows.limit(0).select("source_slug", "external_id", "url", "raw", text.content_hash(F.col("raw")).alias("content_hash"), *[F.lit(None).cast("timestamp").alias(c) for c in ("first_seen_at", "last_seen_at", "gone_at")])
    old = merge.upsert_records(empty, rows.filter("seq % 2 = 0"), F.lit("2024-02-01").cast("timestamp"))
    return old.drop("changed", "id"), rows.filter("seq % 2 = 1")


_REC = "SELECT event_type AS source_slug, CAST(user_id AS VARCHAR) AS external_id, arg_max('https://x.example/' || event_id, event_id) AS url, arg_max(props, event_id) AS raw FROM events WHERE event_id % 2 = {} GROUP BY 1, 2"


@query(f"""SELECT source_slug, external_id, CASE WHEN n.raw IS NULL THEN o.url ELSE n.url END AS url, sha256(coalesce(n.raw, o.raw))[1:32] AS content_hash,
    o.raw IS NULL AS is_new, coalesce(o.raw != n.raw, false) AS changed FROM ({_REC.format(0)}) o FULL JOIN ({_REC.format(1)}) n USING (source_slug, external_id)""")
def record_upsert(spark, sf_dir):
    old, batch = _stored(spark, sf_dir)
    now = F.lit("2024-02-02").cast("timestamp")
    return merge.upsert_records(old, batch, now).select("source_slug", "external_id", "url", "content_hash", (F.col("first_seen_at") == now).alias("is_new"), "changed")


@query("""SELECT trim(regexp_replace(lower(event_type), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name_key, CASE WHEN user_id % 3 != 0 THEN CAST(user_id % 7 AS VARCHAR) END AS city_slug,
    arg_min(event_type, event_id) AS name, arg_max(props, event_id) FILTER (event_id % 3 = 0) AS address FROM events GROUP BY 1, 2""")
def venue_upsert(spark, sf_dir):
    e, k = F.col("event_id"), F.col("user_id")
    rows = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("venue_name"), F.when(e % 3 == 0, F.col("props")).alias("address"), F.when(k % 3 != 0, (k % 7).cast("string")).alias("city_slug"),
        F.lit(None).cast("struct<lat:double,lng:double>").alias("point"), e.alias("seq"),
    )
    empty = rows.limit(0).select(F.col("venue_name").alias("name"), F.lit("").alias("name_key"), "address", "city_slug", "point")
    return merge.upsert_venues(empty, rows).select("name_key", "city_slug", "name", "address")


_LINKS = "SELECT user_id AS record, arg_max(event_id % 20, event_id) AS event_id FROM events GROUP BY 1"


@query(f"""WITH o AS (SELECT user_id AS r, arg_max(event_id % 20, event_id) AS e, arg_max(event_id % 3 != 0, event_id) AS live FROM events WHERE event_id % 2 = 0 GROUP BY 1),
    n AS (SELECT user_id AS r, arg_max(event_id % 20, event_id) AS e FROM events WHERE event_id % 2 = 1 GROUP BY 1),
    a AS (SELECT r, e, live FROM o UNION ALL SELECT n.r, n.e, true FROM n),
    later AS (SELECT coalesce(n.e, o.e) AS e, n.r IS NOT NULL OR o.live AS live FROM o FULL JOIN n USING (r)),
    before AS (SELECT e, count(*) AS n, count(*) FILTER (live) AS l FROM o GROUP BY 1), after AS (SELECT e, count(*) AS n, count(*) FILTER (live) AS l FROM later GROUP BY 1)
    SELECT e AS event_id, CAST(coalesce(after.n, 0) - coalesce(before.n, 0) AS INTEGER) AS links, CAST(coalesce(after.l, 0) - coalesce(before.l, 0) AS INTEGER) AS live
    FROM (SELECT DISTINCT event_id % 20 AS e FROM events) LEFT JOIN before USING (e) LEFT JOIN after USING (e)""")
def link_changes(spark, sf_dir):
    """By how much a batch changes the numbers of links, from the links that move alone; the SQL counts
    all links before and after."""
    e, k = F.col("event_id"), F.col("user_id")
    rows = read(spark, sf_dir, "events").select(k.alias("source_record_id"), (e % 20).alias("event_id"), F.lit("day").alias("day"), (e % 3 != 0).alias("live"), e.alias("seq"))
    last = lambda df: df.groupBy("source_record_id").agg(F.max_by(F.struct("event_id", "day", "live"), "seq").alias("x")).select("source_record_id", "x.*")
    old, new = last(rows.filter("seq % 2 = 0")), last(rows.filter("seq % 2 = 1")).drop("live")
    records = new.select(F.col("source_record_id").alias("id")).join(old.select(F.col("source_record_id").alias("id"), F.when(F.col("live"), "live").otherwise("gone").alias("was")), "id", "left")
    found = merge.link_changes(records, old.drop("live"), new).drop("day")
    every = rows.select("event_id").distinct().join(found, "event_id", "left")
    return every.fillna(0, ["links", "live"])


@query(f"SELECT event_id, CAST(count(*) AS INTEGER) AS source_count FROM ({_LINKS}) GROUP BY 1")
def link_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select((F.col("event_id") % 20).alias("event_id"), F.col("user_id").alias("source_record_id"), F.col("event_id").alias("seq"))
    old, batch = rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")
    kept = merge.link_records(merge.link_records(rows.limit(0).drop("seq"), old), old.union(batch))
    return merge.source_counts(kept)


@query("""SELECT DISTINCT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi FROM lineitem""")
def review_pairs(spark, sf_dir):
    """Unordered pairs flagged once, in two batches, the second partly known."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("event_id"), F.col("l_suppkey").alias("candidate_event_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    first = merge.flag_reviews(rows.limit(0).drop("seq"), rows.filter("seq % 2 = 0"))
    both = merge.flag_reviews(first, rows)
    return both.select(F.least("event_id", "candidate_event_id").alias("lo"), F.greatest("event_id", "candidate_event_id").alias("hi"))


@query("SELECT o_orderkey, o_orderpriority AS source, o_orderpriority = '2-HIGH' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS gone FROM orders")
def tombstone_anti(spark, sf_dir):
    records = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("external_id"), F.col("o_orderpriority").alias("source_slug"), F.lit(None).cast("timestamp").alias("gone_at"))
    seen = read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("external_id"))
    out = merge.tombstone(records, "2-HIGH", seen, F.lit("2024-02-01").cast("timestamp"))
    return out.select(F.col("external_id").alias("o_orderkey"), F.col("source_slug").alias("source"), F.col("gone_at").isNotNull().alias("gone"))


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_quantity > 48)")
def orphan_semi(spark, sf_dir):
    events = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    links = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("source_record_id"))
    records = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(~((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48)), F.col("l_shipdate")).alias("gone_at"))
    return merge.drop_orphans(events, links, records)


# --- reports ------------------------------------------------------------------------------
@query("SELECT event_type AS type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1")
def type_histogram(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("event_id").alias("seq"))
    return report.type_histogram(rows)


@query("""SELECT count(*) AS usable, count(*) FILTER (event_id % 10 != 0) AS with_point, count(*) FILTER (event_id % 10 != 7) AS with_venue,
    count(*) FILTER (value > 10) AS with_image FROM events""")
def coverage_counts(spark, sf_dir):
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.when(e % 10 != 0, e).alias("point"), F.when(e % 10 != 7, e).alias("venue_name"), F.when(F.col("value") > 10, e).alias("cover_image_url"))
    return report.coverage(rows)


@query("""SELECT count(*) AS fetched, count(*) FILTER (event_type = 'view') AS created, count(*) FILTER (event_type = 'click' AND value > 10) AS updated,
    count(*) FILTER (event_type = 'click' AND value <= 10) AS merged, count(*) FILTER (event_type = 'view' AND user_id % 5 = 0) AS flagged,
    count(*) FILTER (event_type NOT IN ('view', 'click')) AS skipped FROM events""")
def run_stats(spark, sf_dir):
    kind, k = F.col("event_type"), F.col("user_id")
    rows = read(spark, sf_dir, "events").select(
        F.when(kind == "view", "created").when(kind == "click", "merged").alias("outcome"), (F.col("value") > 10).alias("changed"),
        F.when((kind == "view") & (k % 5 == 0), k).alias("review_id"), (~kind.isin("view", "click")).alias("skipped"),
    )
    return report.run_stats(rows)


@query("SELECT l_orderkey, min(l_discount) FILTER (l_discount > 0) AS least_price, bool_or(l_discount = 0) AS is_free FROM lineitem GROUP BY 1")
def nested_min_price(spark, sf_dir):
    from .functions.coerce import least_positive

    offers = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("p"))
    return offers.select("l_orderkey", least_positive(F.col("p")).alias("least_price"), F.exists("p", lambda p: p == 0).alias("is_free"))


@query("""SELECT l_orderkey, arg_max('u' || l_linenumber, l_quantity * 100 - l_linenumber) AS cover FROM lineitem GROUP BY 1""")
def argmax_image(spark, sf_dir):
    from .functions.coerce import widest

    image = F.struct("l_linenumber", F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("url"), F.col("l_quantity").cast("string").alias("width"))
    images = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(image)).alias("i"))
    return images.select("l_orderkey", widest(F.col("i")).alias("cover"))


@query(f"""SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS external_id, event_type || ' ' || user_id AS title, {_utc("date_trunc('second', ts)")} AS starts_at,
    event_id % 5 = 0 AS is_free, CASE WHEN event_id % 3 = 0 OR value <= 0 THEN NULL ELSE value END AS price_from,
    'https://listing-a.example/event/' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS url FROM events""")
def normalize_listing_a(spark, sf_dir):
    """Payloads of the first API made from events, then read back."""
    from .sources.listing_api import normalize_a

    e = F.col("event_id")
    price = F.when(e % 3 != 0, F.col("value").cast("string"))
    payload = F.struct(
        F.lpad(e.cast("string"), 10, "0").alias("id"), F.concat(F.lit(" "), F.concat_ws(" ", "event_type", "user_id")).alias("name"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime_start"), F.when(e % 5 == 0, "1").otherwise("0").alias("is_free"),
        F.struct(F.array(F.struct(F.lit("0").alias("price")), F.struct(price.alias("price"))).alias("ticket_types")).alias("ticket_types"),
    )
    rows = read(spark, sf_dir, "events").select(F.to_json(payload).alias("raw"), e.alias("seq"))
    return normalize_a(rows).select("external_id", "title", _wall("starts_at"), "is_free", "price_from", "url")


_B_LOCAL = "event_id % 4 = 1"


@query(f"""SELECT CAST(event_id AS VARCHAR) AS external_id, event_type || ' ' || user_id AS title,
    CASE WHEN {_B_LOCAL} THEN {_utc("date_trunc('second', ts)")} ELSE date_trunc('second', ts) END AS starts_at, CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS INTEGER) AS popularity,
    CASE WHEN value > 0 THEN value END AS price_from, 'Hall ' || user_id % 9 AS venue_name, CASE WHEN event_id % 3 = 0 THEN user_id || ' Quay St, Auckland' ELSE 'Auckland' END AS address,
    'Music ' || event_type AS category_hint, 'https://listing-b.example/event/' || event_id AS url FROM events WHERE event_id % 11 != 0""")
def normalize_listing_b(spark, sf_dir):
    """Payloads of the second API made from events, then read back: cancelled ones are left out."""
    from .sources.listing_api import normalize_b

    e, k = F.col("event_id"), F.col("user_id")
    local = e % 4 == 1
    start = F.struct(
        F.when(~local, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("dateTime"), F.when(local, F.date_format("ts", "yyyy-MM-dd")).alias("localDate"),
        F.when(local, F.date_format("ts", "HH:mm:ss")).alias("localTime"),
    )
    status = F.struct(F.when(e % 11 == 0, "cancelled").when(e % 7 == 0, "Postponed").otherwise("onsale").alias("code"))
    venue = F.struct(
        F.concat(F.lit("Hall "), k % 9).alias("name"), F.struct(F.when(e % 3 == 0, F.concat(k, F.lit(" Quay St"))).alias("line1")).alias("address"),
        F.struct(F.lit("Auckland").alias("name")).alias("city"),
    )
    kind = F.struct(F.struct(F.lit("Music").alias("name")).alias("segment"), F.struct(F.col("event_type").alias("name")).alias("genre"))
    payload = F.struct(
        e.cast("string").alias("id"), F.concat_ws(" ", "event_type", "user_id").alias("name"), F.struct(start.alias("start"), status.alias("status")).alias("dates"),
        F.array(kind).alias("classifications"), F.array(F.struct(F.lit(0.0).alias("min")), F.struct(F.col("value").alias("min"))).alias("priceRanges"),
        F.struct(F.array(venue).alias("venues")).alias("_embedded"),
    )
    rows = read(spark, sf_dir, "events").select(F.to_json(payload).alias("raw"), e.alias("seq"))
    return normalize_b(rows).select("external_id", "title", _wall("starts_at"), "popularity", "price_from", "venue_name", "address", "category_hint", "url")


_NODE_TYPE = "CASE event_type WHEN 'view' THEN 'MusicEvent' WHEN 'click' THEN 'Event' ELSE 'Thing' END"


def _markup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each user with its events in the markup, some of them under @graph, some pages
    short, some without markup."""
    e, k = F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type") == "view", "MusicEvent").when(F.col("event_type") == "click", "Event").otherwise("Thing")
    where = F.struct(F.struct((-36.85 + (e % 7) * 0.01).alias("latitude"), F.lit(174.76).alias("longitude")).alias("geo"))
    node = F.struct(
        kind.alias("@type"), F.concat(F.lit("https://n.example/"), e).alias("url"), F.concat_ws(" ", "event_type", "user_id").alias("name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startDate"), F.when(k % 4 == 1, where).alias("location"), F.struct(F.col("value").cast("string").alias("price")).alias("offers"),
    )
    pages = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(node).alias("nodes"))
    body = F.when(k % 2 == 0, F.to_json("nodes")).otherwise(F.to_json(F.struct(F.col("nodes").alias("@graph"))))
    script = F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    html = F.concat(F.lit("<html>"), F.when(k % 5 != 0, script).otherwise(""), F.when(k % 10 != 0, F.lit("<p>" + "text " * 120 + "</p>")).otherwise(""), F.lit("</html>"))
    return pages.select(F.concat(F.lit("https://p.example/"), k).alias("url"), html.alias("html"), F.when(k % 13 == 0, 503).otherwise(200).alias("status"))


@query(f"""SELECT 'https://p.example/' || user_id AS page_url, {_NODE_TYPE} AS type, event_type IN ('view', 'click') AS is_event, 'https://n.example/' || event_id AS node_url FROM events WHERE user_id % 5 != 0
    UNION ALL SELECT DISTINCT 'https://p.example/' || user_id, NULL, false, NULL FROM events WHERE user_id % 5 != 0 AND user_id % 2 = 1""")
def markup_nodes(spark, sf_dir):
    """All objects of the pages' markup, those with @graph among them."""
    found = markup.nodes(_markup_pages(spark, sf_dir))
    return found.select("page_url", "type", "is_event", F.try_variant_get("node", "$.url", "string").alias("node_url"))


@query("""SELECT 'https://n.example/' || event_id AS external_id, event_type || ' ' || user_id AS title, date_trunc('second', ts) AS starts_at, value = 0 AS is_free,
    CASE WHEN value > 0 THEN value END AS price_from, CASE WHEN user_id % 4 = 1 THEN 'auckland' ELSE 'taupo' END AS city_slug FROM events WHERE user_id % 5 != 0 AND event_type IN ('view', 'click')""")
def markup_listings(spark, sf_dir):
    found = markup.normalize_nodes(markup.nodes(_markup_pages(spark, sf_dir)), "pages", "taupo")
    return found.select("external_id", "title", _wall("starts_at"), "is_free", "price_from", "city_slug")


@query("""SELECT 'https://p.example/' || user_id AS page_url, CASE WHEN user_id % 13 = 0 THEN 'unreadable' WHEN user_id % 10 = 0 THEN 'empty' WHEN user_id % 5 = 0 THEN 'no markup'
    WHEN events = 0 THEN 'no event nodes' WHEN user_id % 4 != 1 THEN 'no coordinates' ELSE 'ok' END AS gate, nodes, events, usable, with_point FROM (
      SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 0 ELSE count(*) + user_id % 2 END AS nodes, CASE WHEN user_id % 5 = 0 THEN 0 ELSE count(*) FILTER (event_type IN ('view', 'click')) END AS events,
        CASE WHEN user_id % 5 = 0 THEN 0 ELSE count(*) FILTER (event_type IN ('view', 'click')) END AS usable,
        CASE WHEN user_id % 5 = 0 OR user_id % 4 != 1 THEN 0 ELSE count(*) FILTER (event_type IN ('view', 'click')) END AS with_point FROM events GROUP BY user_id)""")
def probe_report(spark, sf_dir):
    """What a probe concludes of each page."""
    return report.probe_pages(_markup_pages(spark, sf_dir)).select("page_url", "gate", "nodes", "events", "usable", "with_point")

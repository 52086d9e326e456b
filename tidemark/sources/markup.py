"""Event markup in web pages: JSON-LD nodes and their listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.coerce import least_positive, variant_number, variant_text
from ..functions.geo import nearest_city, point
from ..functions.localtime import parse_instant
from ..functions.text import WS, infer_category, join_present, trim_ws
from ..storage import materialise


def in_order(pages: DataFrame) -> DataFrame:
    """Pages in the order of their file names (column ``name``), whatever files a task reads: with
    row numbers that rise along partitions, listings arrive in the order of their pages. Pages
    without a name stay as they are."""
    return pages.orderBy("name") if "name" in pages.columns else pages


SCRIPT = "(?is)<script[^>]+type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"
def _get(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _children(level: DataFrame) -> DataFrame:
    """A row for each element of a level's arrays and @graph arrays, with the element's own text.
    The text is cut once for all elements of an array, not looked up in the page for each."""
    values = F.coalesce(*[F.try_variant_get("node", p, "array<variant>") for p in ("$", "$['@graph']")])
    text = F.when(F.col("is_object"), F.get_json_object("raw", "$['@graph']")).otherwise(F.col("raw"))
    pairs = F.arrays_zip(values.alias("node"), F.from_json(text, "array<string>").alias("raw"))
    found = level.select("page_seq", "page_url", "block", "path", F.posexplode(pairs).alias("pos", "e"))
    return found.select("page_seq", "page_url", "block", F.concat("path", F.array("pos")).alias("path"), "e.node", "e.raw")


def _containers(rows: DataFrame) -> DataFrame:
    """Objects and arrays of a level, written once: (page_seq, page_url, block, path, node, raw, is_object)."""
    held = lambda kind: F.try_variant_get("node", "$", kind).isNotNull()
    rows = rows.withColumn("is_object", held("map<string,variant>"))
    return materialise(rows.filter(F.col("is_object") | held("array<variant>")), "markup-level")


def nodes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(seq, page_url, block, path, node, raw, type, is_event): every object in the page's JSON-LD,
    out of arrays and @graph however deep; broken blocks are skipped. Values of other properties
    are not walked. ``raw`` is the object written anew, its properties in the order of the page,
    without blanks between and without needless escapes, at any depth: a change of those alone
    is no change of the object. ``seq`` follows the order of the pages (see ``in_order``). Each
    block is parsed once, and each level of nesting written once."""
    blocks = pages.select("*", F.monotonically_increasing_id().alias("page_seq")).select(
        "page_seq", F.col(url).alias("page_url"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(SCRIPT), F.lit(1))).alias("block", "body")
    )
    body = trim_ws(F.col("body"))
    level = _containers(blocks.select("page_seq", "page_url", "block", F.array().cast("array<int>").alias("path"), F.try_parse_json(body).alias("node"), F.get_json_object(body, "$").alias("raw")))
    found = level.filter("is_object")
    while not level.isEmpty():
        level = _containers(_children(level))
        found = found.unionByName(level.filter("is_object"))
    type_ = _get(F.col("node"), "$['@type']")
    as_text = F.try_variant_get(type_, "$", "string")
    many = F.try_variant_get(type_, "$", "array<string>")
    is_event = F.when(_kind(type_) == "STRING", as_text.rlike("(?i)Event$")).when(
        _kind(type_).startswith("ARRAY"), F.exists(many, lambda t: t.rlike("(?i)Event$"))
    )
    seq = F.struct("page_seq", "block", "path")
    return found.select(seq.alias("seq"), "page_url", "block", "path", "node", "raw", as_text.alias("type"), F.coalesce(is_event, F.lit(False)).alias("is_event"))


def normalize_nodes(found: DataFrame, slug: str = "markup", default_city: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Listings of event nodes: a title and a start that can be read are needed; times without
    an offset are UTC; a price of 0 (or blank) is free. ``keep`` names columns of ``found`` to add."""
    v = F.col("node")
    text = lambda path: variant_text(_get(v, path))
    offers = _get(v, "$.offers")
    each = F.when(_kind(offers).startswith("ARRAY"), F.try_variant_get(offers, "$", "array<variant>")).when(_kind(offers).startswith("OBJECT"), F.array(offers))
    prices = F.transform(each, lambda o: variant_number(F.try_variant_get(o, "$.price", "variant")))
    image = _get(v, "$.image")
    address = _get(v, "$.location.address")
    parts = [variant_text(_get(v, f"$.location.address.{x}")) for x in ("streetAddress", "addressLocality", "addressRegion")]
    where = point(variant_number(_get(v, "$.location.geo.latitude")), variant_number(_get(v, "$.location.geo.longitude")))
    rows = found.filter("is_event").select(
        "*", text("$.name").alias("title"), parse_instant(text("$.startDate")).alias("starts_at"), where.alias("point"), prices.alias("prices"),
        F.coalesce(text("$.url"), F.col("page_url")).alias("url"), text("$.description").alias("description"),
    ).filter("title IS NOT NULL AND starts_at IS NOT NULL")
    out = rows.select(
        F.lit(slug).alias("source_slug"),
        F.coalesce(text("$['@id']"), F.col("url")).alias("external_id"),
        "url",
        "title",
        F.substring(F.regexp_replace("description", f"{WS}+", " "), 1, 600).alias("summary"),
        "starts_at",
        parse_instant(text("$.endDate")).alias("ends_at"),
        F.coalesce(F.exists("prices", lambda p: p == 0), F.lit(False)).alias("is_free"),
        least_positive(F.col("prices")).alias("price_from"),
        text("$.location.name").alias("venue_name"),
        F.when(_kind(address) == "STRING", F.try_variant_get(address, "$", "string")).when(_kind(address).startswith("OBJECT"), join_present(", ", *parts)).alias("address"),
        "point",
        F.coalesce(nearest_city(F.col("point.lat"), F.col("point.lng")), F.lit(default_city)).alias("city_slug"),
        F.coalesce(text("$.eventAttendanceMode"), infer_category(F.col("title"), F.col("description"))).alias("category_hint"),
        F.when(_kind(image).startswith("ARRAY"), variant_text(_get(image, "$[0]"))).otherwise(variant_text(image)).alias("cover_image_url"),
        F.lit(0).alias("popularity"),
        "raw",
        "seq",
        *(keep or []),
    )
    out = out.orderBy("seq").withColumn("seq", F.monotonically_increasing_id())
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.LISTING], *(keep or []))


def normalize_pages(pages: DataFrame, slug: str = "markup", default_city: str | None = None) -> DataFrame:
    return normalize_nodes(nodes(in_order(pages)), slug, default_city)



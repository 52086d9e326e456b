"""Loose values of payloads: numbers, flags and names that come as text or as objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import null_if_empty, trim_ws


def number(text: Column) -> Column:
    """A finite number or null; blank text is 0."""
    value = F.trim(text).try_cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return F.when(trim_ws(text) == "", F.lit(0.0)).otherwise(finite)


def truthy(text: Column) -> Column:
    return F.coalesce(text.isin("true", "1"), F.lit(False))


def present(text: Column) -> Column:
    """Trimmed text, null if empty."""
    return null_if_empty(trim_ws(text))


def least_positive(values: Column) -> Column:
    """The least number above 0 in an array, null if there is none."""
    return F.array_min(F.filter(values, lambda v: v > 0))


def widest(images: Column, url: str = "url", width: str = "width") -> Column:
    """The url of the widest image that has one; the first of equals."""
    with_url = F.filter(images, lambda i: i[url].isNotNull() & (i[url] != ""))
    ranked = F.transform(with_url, lambda i, k: F.struct(F.coalesce(number(i[width]), F.lit(0.0)).alias("w"), (-k).alias("k"), i[url].alias("u")))
    return F.array_max(ranked)["u"]


def variant_text(value: Column, depth: int = 3) -> Column:
    """Text of a string, or of an object's name (again such a value), trimmed; else null."""
    kind = F.schema_of_variant(value)
    name = variant_text(F.try_variant_get(value, "$.name", "variant"), depth - 1) if depth else F.lit(None).cast("string")
    return F.when(kind == "STRING", present(F.try_variant_get(value, "$", "string"))).when(kind.startswith("OBJECT"), name)


def variant_number(value: Column) -> Column:
    """Number of a string or number, else null; blank text is 0."""
    kind = F.schema_of_variant(value)
    known = kind.isin("STRING", "BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(known, number(F.try_variant_get(value, "$", "string")))

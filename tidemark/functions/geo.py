"""Distances, decay and the nearest city as column expressions. A point is (lat, lng)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dimensions import CITIES

EARTH_M = 6_371_000.0


def point(lat: Column, lng: Column) -> Column:
    """Null unless both coordinates are there."""
    return F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.cast("double").alias("lat"), lng.cast("double").alias("lng")))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def flat_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Equirectangular distance; good enough within a city."""
    x = F.radians(lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(x * x + F.pow(F.radians(lat2 - lat1), 2)) * (EARTH_M / 1000)


def decay(value: Column, full: float, zero: float) -> Column:
    """1 up to ``full``, 0 from ``zero`` on, a line between; null stays null."""
    return F.when(value <= full, F.lit(1.0)).when(value >= zero, F.lit(0.0)).when(value.isNotNull(), 1 - (value - full) / (zero - full))


def nearest_city(lat: Column, lng: Column) -> Column:
    """The nearest city whose radius holds the point (ties: the one listed first), else null."""
    found = [
        F.struct(flat_km(lat, lng, F.lit(c[1]), F.lit(c[2])).alias("km"), F.lit(i).alias("i"), F.lit(c[0]).alias("slug"), F.lit(c[3]).alias("radius"))
        for i, c in enumerate(CITIES)
    ]
    best = F.array_min(F.filter(F.array(*found), lambda c: c["km"] <= c["radius"]))
    return F.when(lat.isNotNull() & lng.isNotNull(), best["slug"])


def within_radius(lat: Column, lng: Column, center: tuple[float, float], km: float) -> Column:
    """A box that pushes down to the files, then the distance. Null points are outside."""
    dlat = math.degrees(km / (EARTH_M / 1000)) * 1.001
    dlng = dlat / max(0.01, math.cos(math.radians(center[0])))
    box = lat.between(center[0] - dlat, center[0] + dlat) & lng.between(center[1] - dlng, center[1] + dlng)
    return box & (haversine_m(lat, lng, F.lit(center[0]), F.lit(center[1])) <= km * 1000)


def within_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    """box: (west, south, east, north)."""
    west, south, east, north = box
    return lng.between(west, east) & lat.between(south, north)

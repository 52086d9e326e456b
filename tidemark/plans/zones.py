"""Events stored by zones along a space-filling curve, so that a box or a radius reads few files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of each coordinate: cells of 0.18 by 0.35 degrees.
BITS = 10
#: Ranges of zones that a box is at most cut into; beyond, ranges take in zones around the box.
RANGES = 64
NOWHERE = -1
Box = tuple[float, float, float, float]


def _steps(value: Column, low: float, span: float, bits: int) -> Column:
    top = (1 << bits) - 1
    return F.least(F.greatest(F.floor((value - low) / span * (1 << bits)), F.lit(0)), F.lit(top))


def zone(lat: Column, lng: Column, bits: int = BITS) -> Column:
    """The cell's number on the curve: the bits of latitude and longitude in turn; NOWHERE without a point."""
    y, x = _steps(lat, -90.0, 180.0, bits), _steps(lng, -180.0, 360.0, bits)
    out = F.lit(0).cast("long")
    for b in range(bits):
        for value, shift in ((x, 2 * b), (y, 2 * b + 1)):
            out = out + F.shiftleft(F.shiftright(value, b).bitwiseAND(F.lit(1)).cast("long"), shift)
    return F.when(lat.isNull() | lng.isNull() | F.isnan(lat) | F.isnan(lng), F.lit(NOWHERE)).otherwise(out).cast("int")


def ranges(box: Box, bits: int = BITS, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of zones (ends included) that hold all cells of the box (west, south, east, north):
    quarters of the map are cut until they lie in the box, or there are ``most``."""
    west, south, east, north = box
    cell = lambda v, low, span: min(max(math.floor((v - low) / span * (1 << bits)), 0), (1 << bits) - 1)
    x0, x1, y0, y1 = cell(west, -180.0, 360.0), cell(east, -180.0, 360.0), cell(south, -90.0, 180.0), cell(north, -90.0, 180.0)
    if x0 > x1 or y0 > y1:
        return []
    whole, open_ = [], [(0, 0, 0, bits)]  # first zone, x, y, bits left
    while open_:
        first, x, y, left = open_.pop(0)
        size = 1 << left
        if x > x1 or y > y1 or x + size - 1 < x0 or y + size - 1 < y0:
            continue
        inside = x0 <= x and x + size - 1 <= x1 and y0 <= y and y + size - 1 <= y1
        if inside or not left or len(whole) + len(open_) + 4 > most:
            whole.append((first, first + size * size - 1))
            continue
        half, quarter = size >> 1, (size >> 1) * (size >> 1)
        open_ += [(first + k * quarter, x + (k & 1) * half, y + (k >> 1) * half, left - 1) for k in range(4)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(whole):
        if out and a == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def box_around(centre: tuple[float, float], km: float) -> Box:
    """A box that holds the circle, a little wider for rounding."""
    lat, lng = centre
    d = math.degrees(km / 6371.0) * 1.001 + 1e-6
    wide = math.cos(math.radians(min(abs(lat) + d, 89.999)))
    e = math.degrees(2 * math.asin(min(1.0, math.sin(km / 6371.0 / 2) / wide))) * 1.001 + 1e-6
    return lng - e, lat - d, lng + e, lat + d


def write(events: DataFrame, path: str, bits: int = BITS) -> None:
    """Events (with ``point``) as Parquet in folders by zone; a crowded zone gets several files."""
    zoned = events.withColumn("zone", zone(F.col("point.lat"), F.col("point.lng"), bits))
    zoned.hint("rebalance", "zone").sortWithinPartitions("zone", "starts_at", "id").write.mode("overwrite").partitionBy("zone").parquet(path)


def read(spark: SparkSession, path: str, box: Box | None = None, bits: int = BITS) -> DataFrame:
    """Stored events; with a box only folders of zones that it touches are opened. A box over the
    line of 180 degrees has no east of its west and finds nothing, as in the feed."""
    held = spark.read.parquet(path)
    if box is not None:
        inside = F.lit(False)
        for a, b in ranges(box, bits):
            inside = inside | F.col("zone").between(a, b)
        held = held.filter(inside)
    return held.drop("zone")

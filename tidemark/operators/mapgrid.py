"""Map layers: clusters, heat and GeoJSON features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 512
CLUSTER_PIXELS = 44
CLUSTER_ZOOM = 14


def tile(lat: Column, lng: Column, zoom: float, pixels: int = CLUSTER_PIXELS) -> tuple[Column, Column]:
    """Web-mercator cell of ``pixels`` at a zoom."""
    cells = TILE * 2**zoom / pixels
    x = (lng + 180) / 360
    y = 0.5 - F.log((1 + F.sin(F.radians(lat))) / (1 - F.sin(F.radians(lat)))) / (4 * math.pi)
    return F.floor(x * cells), F.floor(y * cells)


def clusters(points: DataFrame, zoom: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """(tile_x, tile_y, point_count, size): size class by count, below 10, below 30, above.
    Beyond the cluster zoom a cell is a point. Rows without a point are left out."""
    pixels = CLUSTER_PIXELS if zoom <= CLUSTER_ZOOM else 1
    x, y = tile(F.col(lat), F.col(lng), zoom, pixels)
    counts = points.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).groupBy(x.alias("tile_x"), y.alias("tile_y")).agg(F.count("*").alias("point_count"))
    size = F.when(F.col("point_count") < 10, "small").when(F.col("point_count") < 30, "medium").otherwise("large")
    return counts.withColumn("size", size)


def heat_weight(popularity: Column) -> Column:
    clamped = F.least(F.greatest(F.coalesce(popularity, F.lit(0)), F.lit(0)), F.lit(4000))
    return 0.3 + 0.7 * clamped / 4000.0


def geojson_feature(id_: Column, popularity: Column, lat: Column, lng: Column, active: Column) -> Column:
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    properties = F.struct(id_.alias("id"), popularity.alias("popularity"), active.alias("active"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
    return F.when(lat.isNotNull() & lng.isNotNull(), feature)

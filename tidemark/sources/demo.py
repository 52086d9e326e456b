"""A dozen rows to show the feed without any stored events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

_COLUMNS = (
    "id string, title string, title_zh string, category string, starts_at timestamp, venue_name string, lat double, "
    "lng double, city_slug string, popularity int, is_free boolean, price_from double"
)
#: (title, category, hours from now, venue, lat, lng, city, popularity, free)
_ROWS = (
    ("Harbour lights concert", "music", 5, "Pier hall", -36.8427, 174.7671, "auckland", 900, False),
    ("Saturday farmers market", "market", 20, "Old station", -36.8689, 174.7772, "auckland", 420, True),
    ("Crater rim walk", "outdoor", 26, "Domain gate", -36.8593, 174.7756, "auckland", 150, True),
    ("Club netball final", "sports", 30, "North courts", -36.8011, 174.7489, "auckland", 310, False),
    ("Puppets for small people", "family", 44, "Library room", -36.8518, 174.7653, "auckland", 80, True),
    ("Evening paddle", "water", 50, "East beach", -36.8484, 174.8311, "auckland", 60, False),
    ("Print room exhibition", "arts", 70, "Upper gallery", -36.8512, 174.7664, "auckland", 210, True),
    ("Hill brewers' tasting", "food", 28, "Tram shed", -41.2969, 174.7735, "wellington", 500, False),
    ("Chamber orchestra", "music", 52, "Town hall", -41.2890, 174.7772, "wellington", 640, False),
    ("Valley wine day", "food", 75, "River vineyard", -45.0067, 168.8770, "queenstown", 700, False),
    ("Ridge trail race", "sports", 98, "Bob's cove", -45.0713, 168.5126, "queenstown", 260, False),
    ("Lake picnic", "family", 120, "South shore", -38.6921, 176.0806, "taupo", 90, True),
)


def demo_events(spark: SparkSession, now: datetime) -> DataFrame:
    rows = [
        (f"d{i}", title, None, category, now + timedelta(hours=hours), venue, lat, lng, city, popularity, free, None if free else 45.0)
        for i, (title, category, hours, venue, lat, lng, city, popularity, free) in enumerate(_ROWS, 1)
    ]
    return spark.createDataFrame(rows, _COLUMNS)

"""Calendar of the fixed local zone. Instants are timestamps (session zone UTC) or UTC wall
clocks without zone; local wall clocks are timestamps without zone."""

from __future__ import annotations

from datetime import datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dimensions import ZONE

NAIVE = "^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2})?(\\.\\d+)?$"
ZONED = "^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2})?(\\.\\d+)?(Z|[+-]\\d{2}:?\\d{2})$"
DATE_ONLY = "^\\d{4}-\\d{2}-\\d{2}$"


def local_wall(utc: Column) -> Column:
    """UTC wall clock to local wall clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc.cast("timestamp_ntz"))


def offset_hours(utc: Column) -> Column:
    wall = utc.cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", wall, local_wall(utc)) / 3600


def local_date(utc: Column) -> Column:
    return F.to_date(local_wall(utc))


def local_weekday(utc: Column) -> Column:
    """1 for Monday to 7."""
    return F.weekday(local_date(utc)) + 1


def start_of_day(utc: Column, days: int = 0) -> Column:
    """The instant of local midnight, some days on. Midnight is never skipped in this zone."""
    midnight = F.date_add(local_date(utc), days).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(ZONE), F.lit("UTC"), midnight)


def wall_to_utc(wall: Column) -> Column:
    """Local wall clock to UTC in two passes of the offset: an hour that occurs twice gives the
    later instant, one that is skipped moves on an hour."""
    wall = wall.cast("timestamp_ntz")
    guess = wall - (local_wall(wall) - wall)
    return wall - (local_wall(guess) - guess)


def parse_local(text: Column) -> Column:
    """Text to an instant: with an offset as it is, without one as local wall clock, a date
    alone as local midnight, all else null."""
    text = F.trim(text)
    absolute = F.try_to_timestamp(F.regexp_replace(text, "([+-]\\d{2})(\\d{2})$", "$1:$2"))
    wall = text.try_cast("timestamp_ntz")
    return (
        F.when(text.rlike(ZONED), absolute)
        .when(text.rlike(NAIVE) | text.rlike(DATE_ONLY), wall_to_utc(wall).cast("timestamp"))
        .otherwise(F.lit(None).cast("timestamp"))
    )


def parse_instant(text: Column) -> Column:
    """Text to an instant: without an offset (or a date alone) it is UTC."""
    text = F.trim(text)
    normal = F.regexp_replace(text, "([+-]\\d{2})(\\d{2})$", "$1:$2")
    known = text.rlike(ZONED) | text.rlike(NAIVE) | text.rlike(DATE_ONLY)
    return F.when(known, F.try_to_timestamp(F.when(text.rlike(DATE_ONLY), text).otherwise(normal)))


def bucket_range(bucket: str, now: datetime) -> tuple[datetime, datetime | None]:
    """[from, to) of a date bucket at ``now`` (UTC, aware): the weekend starts now if it is on,
    the week ends with the eighth local day."""
    zone = ZoneInfo(ZONE)
    today = now.astimezone(zone).date()

    def midnight(days: int) -> datetime:
        return datetime.combine(today + timedelta(days), time(), zone).astimezone(timezone.utc)

    weekday = today.isoweekday()
    saturday = 0 if weekday >= 6 else 6 - weekday
    if bucket == "today":
        return now, midnight(1)
    if bucket == "tomorrow":
        return midnight(1), midnight(2)
    if bucket == "weekend":
        start = midnight(saturday if weekday != 7 else -1)
        return max(now, start), midnight((saturday if weekday != 7 else -1) + 2)
    if bucket == "week":
        return now, midnight(8)
    if bucket == "all":
        return now, None
    raise ValueError(f"unknown date bucket {bucket!r}")


def bucket_bounds(bucket: str, now: Column) -> tuple[Column, Column]:
    """The same over a column of instants."""
    weekday = local_weekday(now)
    now = now.cast("timestamp_ntz")
    saturday = F.when(weekday == 7, -1).otherwise(6 - weekday)
    day = lambda n: F.convert_timezone(F.lit(ZONE), F.lit("UTC"), F.date_add(local_date(now), n).cast("timestamp_ntz"))
    if bucket == "today":
        return now, day(1)
    if bucket == "tomorrow":
        return day(1), day(2)
    if bucket == "weekend":
        return F.greatest(now, day(saturday)), day(saturday + 2)
    if bucket == "week":
        return now, day(8)
    return now, F.lit(None).cast("timestamp_ntz")


_ZH_DAYS = "一二三四五六日"


def when_label(utc: Column, now: Column, lang: str = "en") -> Column:
    """Today, tomorrow or a date, with the local time of day."""
    wall, days = local_wall(utc), F.date_diff(local_date(utc), local_date(now))
    clock = F.date_format(wall, "HH:mm")
    if lang == "zh":
        weekday = F.element_at(F.array(*[F.lit("周" + c) for c in _ZH_DAYS]), F.weekday(F.to_date(wall)) + 1)
        other = F.concat(F.month(wall), F.lit("月"), F.dayofmonth(wall), F.lit("日"), weekday)
        named = F.when(days == 0, F.lit("今天")).when(days == 1, F.lit("明天")).otherwise(other)
    else:
        named = F.when(days == 0, F.lit("Today")).when(days == 1, F.lit("Tomorrow")).otherwise(F.date_format(wall, "EEE, d MMM"))
    return F.concat(named, F.lit(" "), clock)


def iso_millis(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")



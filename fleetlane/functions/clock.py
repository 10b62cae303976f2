"""Instants and business days. Instants are UTC timestamps; the session's time zone is taken to be UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Africa/Cairo"


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_start(date: Column, zone: str = ZONE) -> Column:
    """The instant at which a local date begins, also where clocks are put forward at midnight."""
    return F.to_utc_timestamp(date.cast("timestamp"), zone)


def day_bounds(ts: Column, zone: str = ZONE) -> Column:
    """struct(date, start_at, end_at) of the half-open business day of an instant."""
    date = local_date(ts, zone)
    return F.struct(date.alias("date"), day_start(date, zone).alias("start_at"), day_start(F.date_add(date, 1), zone).alias("end_at"))


def resolve_day(now: datetime | None = None, day_utc: datetime | None = None, mode: str = "cairo") -> tuple[datetime, datetime]:
    """The report window of a run: an explicit UTC start and 24 hours, the UTC day, or the business day of now."""
    if day_utc is not None:
        return day_utc, day_utc + timedelta(days=1)
    zone = timezone.utc if mode == "utc" else ZoneInfo(ZONE)
    local = (now or datetime.now(timezone.utc)).astimezone(zone).replace(hour=0, minute=0, second=0, microsecond=0)
    return local.astimezone(timezone.utc), (local + timedelta(days=1)).astimezone(timezone.utc)


def resolved_day(now: Column, day_utc: Column, mode: Column, zone: str = ZONE) -> Column:
    """struct(mode, start_at, end_at) of resolve_day() as columns: an explicit UTC start and 24 hours, the UTC day, or the business
    day. The mode's case and blanks don't matter; any other one, and none, is the business day."""
    day = lambda name, start: F.struct(F.lit(name).alias("mode"), start.alias("start_at"), F.timestamp_add("HOUR", F.lit(24), start).alias("end_at"))
    local = local_date(now, zone)
    business = F.struct(F.lit("cairo").alias("mode"), day_start(local, zone).alias("start_at"), day_start(F.date_add(local, 1), zone).alias("end_at"))
    utc = F.lower(F.regexp_replace(F.coalesce(mode, F.lit("")), r"[\s\p{Z}]+", "")) == "utc"
    return F.when(day_utc.isNotNull(), day("explicit", day_utc)).when(utc, day("utc", F.date_trunc("DAY", now))).otherwise(business)


def from_epoch(value: Column) -> Column:
    """Milliseconds since the epoch of a number in seconds (under 1e12) or milliseconds."""
    return F.when(F.abs(value) < 1e12, value * 1000).otherwise(value).cast("long")


def parsed_millis(text: Column) -> Column:
    """Milliseconds of a time written as ISO text or as a number; null where it is neither."""
    number = F.try_to_number(F.when(text.rlike(r"^\d{1,18}$"), text), F.lit("9" * 18))
    return F.coalesce(from_epoch(number), F.unix_millis(F.try_to_timestamp(text)))

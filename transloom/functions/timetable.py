"""Times of a timetable: seconds of a service day that may pass 24 hours, and service days that begin at noon less twelve hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_seconds(text: Column) -> Column:
    """Seconds of 'H:MM:SS', hours padded or not and of 24 and more; null if it isn't of that form."""
    parts = F.split(F.trim(text), ":")
    whole = F.regexp_like(F.trim(text), F.lit(r"^\d+:\d{1,2}:\d{1,2}$"))
    at = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    return F.when(whole, at(1) * 3600 + at(2) * 60 + at(3))


def day_time(seconds: Column) -> Column:
    """'HH:MM:SS' of seconds of a day, hours of 24 and more kept; null for negative ones."""
    s = seconds.cast("long")
    return F.when(s >= 0, F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def iso_date(number: Column) -> Column:
    """Date of 'YYYYMMDD' given as text or number; null if it is none."""
    return F.try_to_date(F.trim(number.cast("string")), "yyyyMMdd")


def day_start_ut(date: Column, tz: str | Column = "UTC") -> Column:
    """Unix time at which a service day begins: local noon less twelve hours, so that days of a clock change are right."""
    noon = F.to_timestamp_ltz(F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" 12:00:00 UTC")), F.lit("yyyy-MM-dd HH:mm:ss z"))
    return F.unix_timestamp(F.to_utc_timestamp(noon, tz)) - 43200 if not isinstance(tz, str) or tz != "UTC" else (F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86400)


def day_start_of_ut(ut: Column, tz: str = "UTC") -> Column:
    """The service day's beginning for an instant: that of its local calendar day."""
    return day_start_ut(F.to_date(F.from_utc_timestamp(F.timestamp_seconds(ut), tz)), tz)


def next_day_start(start: Column, days: int = 1, tz: str = "UTC") -> Column:
    """The beginning of the service day so many calendar days on."""
    noon = F.from_utc_timestamp(F.timestamp_seconds(start + 43200), tz)
    return day_start_ut(F.date_add(F.to_date(noon), days), tz)


def local_time(ut: Column, tz: str = "UTC") -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(ut), tz)


def local_to_ut(local: Column, tz: str = "UTC") -> Column:
    return F.unix_timestamp(F.to_utc_timestamp(local, tz))


def utc_text(ut: Column) -> Column:
    """'Jul 31 2015 06:44:59' in UTC."""
    return F.date_format(F.timestamp_seconds(ut), "MMM dd yyyy HH:mm:ss")


def utc_offset(tz: str, date) -> str:
    """'+0200' of a zone on a date, for the driver's own use."""
    import datetime as dt
    import zoneinfo

    return dt.datetime(date.year, date.month, date.day, 12, tzinfo=zoneinfo.ZoneInfo(tz)).strftime("%z")

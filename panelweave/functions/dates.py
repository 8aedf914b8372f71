"""Date and time column helpers. Timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EXCHANGE_ZONE = "America/New_York"


def day(c: Column) -> Column:
    """Calendar day of a text, date or timestamp value; unparsable text becomes NULL."""
    return c.try_cast("timestamp_ntz").cast("date")


def utc_day(text: Column) -> Column:
    """UTC day of a text with an optional zone offset, whatever the session zone; unparsable becomes NULL.

    A text without offset is read in the session zone.
    """
    local = F.try_to_timestamp(text).cast("timestamp_ntz")
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), local))


def loose_year(text: Column) -> Column:
    """Year from the first four characters, else from a parsed date, else 0."""
    head = F.substring(text, 1, 4)
    return F.coalesce(
        F.when(head.rlike("^[0-9]{4}$"), head.cast("int")),
        F.year(F.try_to_timestamp(text)),
        F.lit(0),
    )


def yyyymmdd(d: Column) -> Column:
    return F.year(d) * 10000 + F.month(d) * 100 + F.day(d)


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def weekday(d: Column) -> Column:
    """Monday = 0 .. Sunday = 6."""
    return F.weekday(d)


def add_business_days(d: Column, n: int) -> Column:
    """Shift by n >= 0 weekdays, no holidays; weekend dates count from the Friday before."""
    if n == 0:
        return d
    wd = F.least(F.weekday(d), F.lit(4))
    friday_or_same = F.date_sub(d, F.weekday(d) - wd)
    weeks = F.floor((wd + F.lit(n)) / F.lit(5)).cast("int")
    return F.date_add(friday_or_same, F.lit(n) + F.lit(2) * weeks)


def exchange_time(ts_utc: Column, zone: str = EXCHANGE_ZONE) -> Column:
    """Wall-clock time at the exchange for a UTC timestamp, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts_utc.cast("timestamp_ntz"))


def session_label(ts_utc: Column, zone: str = EXCHANGE_ZONE) -> Column:
    """premarket [04:00,09:30), regular [09:30,16:00), postmarket [16:00,20:00], else closed."""
    t = F.date_format(exchange_time(ts_utc, zone), "HH:mm:ss.SSSSSS")
    return (
        F.when((t >= "04:00") & (t < "09:30"), F.lit("premarket"))
        .when((t >= "09:30") & (t < "16:00"), F.lit("regular"))
        .when((t >= "16:00") & (t <= "20:00:00.000000"), F.lit("postmarket"))
        .otherwise(F.lit("closed"))
    )

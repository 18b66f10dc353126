"""Wall-clock time: epochs, stop bins, weekdays, analysis windows and unit conversions."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of the named windows.
PERIODS = {"past_year": 365, "quarter": 90, "month": 30, "week": 7, "day": 1}
MPH_PER_KMH = 0.621371


def wall_micros(ts: Column) -> Column:
    """Microseconds of a wall-clock time since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def stop_bin(ts: Column, minutes: int = 15) -> Column:
    """Number of the bin that is centred on a multiple of `minutes`, halves to even."""
    return F.rint(wall_micros(ts) / F.lit(60e6 * minutes)).cast("bigint")


def time_bucket(ts: Column, seconds: float) -> Column:
    """Number of the bucket that begins at a multiple of `seconds`."""
    return F.floor(wall_micros(ts) / F.lit(1e6 * seconds))


def weekday(ts: Column) -> Column:
    """Mon ... Sun."""
    return F.date_format(ts, "E")


def week_start(ts: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", ts).cast("date")


def kmh_to_mph(kmh: Column) -> Column:
    """Whole miles an hour, halves to even; null stays null."""
    return F.rint(kmh * F.lit(MPH_PER_KMH))


def local_time(utc: Column, zone: str) -> Column:
    """Wall-clock time in a zone of a UTC wall clock or instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))


def as_date(value: date | datetime | str) -> date:
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    if isinstance(value, str):
        return date.fromisoformat(value[:10])
    raise TypeError(f"not a date: {value!r}")


def compute_window(period: str, start=None, end=None, today: date | None = None) -> tuple[date, date]:
    """First and last day of a named period that ends today, or of a custom one."""
    if period == "custom":
        if start is None or end is None:
            raise ValueError("a custom window needs a start and an end")
        first, last = as_date(start), as_date(end)
        if last <= first:
            raise ValueError(f"the window ends on {last}, not after its start {first}")
        return first, last
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}; known: {', '.join([*PERIODS, 'custom'])}")
    last = as_date(end) if end is not None else today or date.today()
    return last - timedelta(days=PERIODS[period]), last


def window_label(start, end) -> str:
    return f"{as_date(start):%Y-%m-%d}_to_{as_date(end):%Y-%m-%d}"


def total_weeks(start, end) -> int:
    return max(1, (as_date(end) - as_date(start)).days // 7 + 1)

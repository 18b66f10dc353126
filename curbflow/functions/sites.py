"""Service-site fields: cleaners and the rules that make and check route identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone prefixes by commodity, the service region in feet, valid days and weeks.
REF_PREFIXES = ("61", "62", "63", "64", "65", "51", "52")
REC_PREFIXES = ("61", "62", "63", "64", "65", "51", "52")
AUTO_ORG_PREFIXES = ("71", "72", "73", "74", "75")
MANUAL_PREFIXES = ("51", "52")
REGION = (5_800_000.0, 6_600_000.0, 1_700_000.0, 2_200_000.0)
DAYS = ("1", "2", "3", "4", "5")
WEEKS = ("B", "O")
#: Sequence numbers from which a stop is recycling, and organics on a manual route.
REC_FROM, MANUAL_ORG_FROM = 40, 60


def digits(raw: Column) -> Column:
    """Digits of a text, without a trailing `.0`; null if there are none."""
    text = F.regexp_replace(F.trim(raw.cast("string")), r"\.0$", "")
    return F.nullif(F.regexp_replace(text, r"[^0-9]+", ""), F.lit(""))


def route4(raw: Column) -> Column:
    """The last four digits, zero-padded."""
    return F.lpad(F.right(digits(raw), F.lit(4)), 4, "0")


def day(raw: Column) -> Column:
    own = digits(raw)
    return F.when(own.isin(*DAYS), own)


def week(raw: Column) -> Column:
    own = F.upper(F.trim(raw.cast("string")))
    return F.when(own.isin(*WEEKS), own)


def route_id(*parts: Column) -> Column:
    """Route, day and (for recycling) week in one; null if a part is missing."""
    return F.concat(*parts)


def _parts(route: Column) -> tuple[Column, Column]:
    return F.substring(route, 1, 2), F.substring(route, 3, 2).try_cast("int")


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def valid_ref(route: Column, on: Column) -> Column:
    prefix, sequence = _parts(route)
    return _sure(prefix.isin(*REF_PREFIXES) & on.isin(*DAYS) & (sequence < REC_FROM))


def valid_rec(route: Column, on: Column, in_week: Column) -> Column:
    prefix, sequence = _parts(route)
    high = (~prefix.isin(*MANUAL_PREFIXES)) | (sequence < MANUAL_ORG_FROM)
    return _sure(prefix.isin(*REC_PREFIXES) & on.isin(*DAYS) & in_week.isin(*WEEKS) & (sequence >= REC_FROM) & high)


def valid_org(route: Column, on: Column) -> Column:
    prefix, sequence = _parts(route)
    auto = prefix.isin(*AUTO_ORG_PREFIXES) & (sequence < REC_FROM)
    manual = prefix.isin(*MANUAL_PREFIXES) & (sequence >= MANUAL_ORG_FROM)
    return _sure((auto | manual) & on.isin(*DAYS))


def in_region(x: Column, y: Column, box: tuple[float, float, float, float] = REGION) -> Column:
    """Inside the service region, edges included."""
    return _sure(x.between(box[0], box[1]) & y.between(box[2], box[3]))


def valid_lon_lat(lon: Column, lat: Column) -> Column:
    return _sure(lon.try_cast("double").between(-180.0, 180.0) & lat.try_cast("double").between(-90.0, 90.0))

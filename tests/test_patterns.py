from datetime import date, datetime, timedelta

import pytest

from curbflow.config import PatternConfig
from curbflow.functions import times
from curbflow.operators import patterns
from curbflow.schemas import PATTERNS

START, END = "2025-03-01", "2026-02-28"
PARCEL = "APN string, route_ref string, route_org string, route_rec string"


def frame(spark, visits):
    return spark.createDataFrame([("P1", v, t) for v, t in visits], "apn string, vehicle_id string, dt_local timestamp_ntz")


def every(vehicle, first, days, count, hour):
    return [(vehicle, datetime.combine(first + timedelta(days=days * k), datetime.min.time()).replace(hour=hour)) for k in range(count)]


def detect(spark, visits, **more):
    parcels = spark.createDataFrame([("P1", "R1", "O1", "C1"), ("P2", "R1", None, None)], PARCEL)
    return patterns.detect_patterns(frame(spark, visits), parcels, START, END, **more)


def test_weekly(spark):
    row = detect(spark, every("V1", date(2025, 3, 4), 7, 52, 8)).filter("APN = 'P1'").first()
    assert (row.weekly1_vehicle, row.weekly1_dow, row.weekly1_hour) == ("V1", "Tue", 8)
    assert row.weekly1_regularity >= 0.95 and row.weekly1_visits >= 50 and row.route_ref == "R1" and row.biweekly_vehicle is None


def test_biweekly_and_two_weekly(spark):
    seen = every("V_REC", date(2025, 3, 5), 14, 26, 10) + every("V_REF", date(2025, 3, 4), 7, 52, 8) + every("V_ORG", date(2025, 3, 6), 7, 52, 9)
    row = detect(spark, seen).filter("APN = 'P1'").first()
    assert (row.biweekly_vehicle, row.biweekly_dow, row.biweekly_hour) == ("V_REC", "Wed", 10) and row.biweekly_score >= 0.58
    assert {row.weekly1_vehicle, row.weekly2_vehicle} == {"V_REF", "V_ORG"}


def test_sparse_empty_and_chunk(spark):
    few = every("V1", date(2025, 3, 4), 7, 2, 8)
    found = detect(spark, few)
    assert found.columns == PATTERNS and found.count() == 2 and found.filter("weekly1_vehicle IS NOT NULL").count() == 0
    assert detect(spark, few[:0] or every("V1", date(2020, 1, 1), 7, 1, 8)).count() == 2
    only = spark.createDataFrame([("P1",)], "APN string")
    assert [r.APN for r in detect(spark, few, apns=only).collect()] == ["P1"]


def test_ratio_threshold(spark):
    assert detect(spark, every("V1", date(2025, 3, 4), 7, 10, 8)).filter("weekly1_vehicle IS NOT NULL").count() == 0
    assert PatternConfig().weeks(53) == (13, 13)


def test_validate_and_coverage(spark):
    report = patterns.validate_patterns(detect(spark, every("V1", date(2025, 3, 4), 7, 52, 8)))
    assert patterns.coverage(report, "weekly1") == 0.5 and patterns.coverage(report, "biweekly") == 0.0
    with pytest.raises(ValueError):
        patterns.coverage(report, "daily")


def test_windows():
    with pytest.raises(ValueError):
        times.compute_window("custom", "2024-01-02", "2024-01-01")
    with pytest.raises(ValueError):
        times.compute_window("custom")
    with pytest.raises(ValueError):
        times.compute_window("decade")
    with pytest.raises(TypeError):
        times.as_date(7)
    assert times.total_weeks("2024-01-01", "2024-01-02") == 1


def test_bad_window(spark):
    with pytest.raises(ValueError):
        patterns.detect_patterns(frame(spark, every("V", date(2025, 3, 4), 7, 1, 8)), spark.createDataFrame([], PARCEL), END, START)

import random
from datetime import timedelta

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from curbflow.config import EngineConfig
from curbflow.operators import dayview, layers, ranking, timeline
from curbflow.plans import days, views

SCHEMA = "vehicle_id string, dt_utc timestamp_ntz, dt_local timestamp_ntz, lat double, lon double, speed_mph double, route_id string, apn string, in_landfill boolean, at_depot boolean"
KINDS = {"D": (None, False, True), "L": (None, True, False), "A": ("A", False, False), "B": ("B", False, False), "W": (None, False, False)}


def day(spark, text, step=60, speed=5.0, vehicle="100001"):
    """One ping for each letter: D depot, L landfill, A and B routes, W windshield."""
    rows = [(vehicle, k * step, 32.7 + 0.001 * k, -117.2, speed, KINDS[c][0], None, KINDS[c][1], KINDS[c][2]) for k, c in enumerate(text)]
    raw = spark.createDataFrame(rows, "vehicle_id string, s int, lat double, lon double, speed_mph double, route_id string, apn string, in_landfill boolean, at_depot boolean")
    at = F.timestamp_add("SECOND", F.col("s"), F.lit("2024-01-18 06:00:00").cast("timestamp_ntz"))
    return raw.withColumn("dt_local", at).withColumn("dt_utc", at).drop("s")


def segments(spark, text):
    return [(r.segment_type, r.load_number) for r in timeline.build_timeline(day(spark, text)).orderBy("segment_id").collect()]


def test_choreography(spark):
    assert segments(spark, "DDWWAAWLLWDD") == [("depot_departure", None), ("windshield", 1), ("collection", 1), ("windshield", 1), ("dump", 1), ("windshield", 1), ("depot_arrival", None)]
    assert [x for x in segments(spark, "DWALWBLWD") if x[0] in ("dump", "collection")] == [("collection", 1), ("dump", 1), ("collection", 2), ("dump", 2)]
    assert segments(spark, "AABB") == [("collection", 1), ("collection", 1)]
    assert segments(spark, "DDD") == [("depot_departure", None)]


def walk(kinds):
    """Loads by walking a day's segments in order."""
    out, load, dumped = [], 1, False
    for k, kind in enumerate(kinds):
        if kind.startswith("depot"):
            out.append(None)
            dumped = False
            continue
        if dumped:
            ahead = False
            for later in kinds[k:]:
                if later.startswith("depot"):
                    break
                ahead |= later in ("collection", "dump")
            if ahead:
                load += 1
            dumped = False
        out.append(load)
        dumped = kind == "dump"
    return out


def test_loads_match_a_walk(spark):
    draw = random.Random(5)
    days = {f"v{i}": [draw.choice(["depot_arrival", "windshield", "collection", "dump"]) for _ in range(draw.randint(1, 12))] for i in range(150)}
    rows = [(v, "2024-01-18", k + 1, kind) for v, kinds in days.items() for k, kind in enumerate(kinds)]
    got = timeline.load_numbers(spark.createDataFrame(rows, "vehicle_id string, day string, segment_id int, segment_type string")).collect()
    by = {(r.vehicle_id, r.segment_id): r.load_number for r in got}
    for v, kinds in days.items():
        assert [by[v, k + 1] for k in range(len(kinds))] == walk(kinds), kinds


def test_mileage_and_duration(spark):
    plain = timeline.build_timeline(day(spark, "AAAAAA")).first()
    assert plain.duration_seconds == 300.0 and plain.n_pings == 6 and 0.3 < plain.miles < 0.4
    more = timeline.build_timeline(day(spark, "AAAAAA"), EngineConfig(mileage_inflation_pct=0.1)).first()
    assert more.miles == pytest.approx(1.1 * plain.miles)


@pytest.mark.parametrize(
    ("text", "expected"),
    [("DWALWD", set()), ("DLWALD", {"loaded_depot_departure"}), ("DWAWLWAD", {"loaded_depot_return"}), ("DALALALALD", {"overrun_loads"}), ("DABALD", {"mid_load_route_switch"}), ("DDD", set())],
)
def test_violations(spark, text, expected):
    found = timeline.flag_violations(timeline.build_timeline(day(spark, text))).collect()
    assert {r.violation_type for r in found} == expected
    assert all(r.segment_id == -1 for r in found if r.violation_type == "overrun_loads")


def test_null_speed_is_windshield(spark):
    assert day(spark, "A").withColumn("speed_mph", F.lit(None).cast("double")).select(timeline.phase().alias("p")).first().p == "windshield"


def test_trail_and_rank(spark):
    pings = day(spark, "A" * 30, step=5)
    assert 4 <= dayview.downsample(pings, 30).count() <= 7
    assert dayview.downsample(pings, 0).count() == 30
    ranked = ranking.rank_vehicles(pings.unionByName(day(spark, "AA", vehicle="100002"))).collect()
    assert [(r.vehicle_id, r.n_pings) for r in ranked] == [("100001", 30)]


def test_tonnage_window(spark):
    dumps = timeline.build_timeline(day(spark, "DWALWD")).filter("segment_type = 'dump'").select("vehicle_id", "day", "segment_id", "start_dt_local", "end_dt_local")
    tickets = spark.sql("SELECT '100001' AS co_fleet_id, t AS event_dt, 2.5D AS tons FROM VALUES (TIMESTAMP_NTZ'2024-01-18 06:48:00'), (TIMESTAMP_NTZ'2024-01-18 06:48:01'), (TIMESTAMP_NTZ'2024-01-18 05:18:00') AS v(t)")
    assert dayview.load_tonnage(dumps, tickets).first().tons == 5.0
    assert dayview.load_tonnage(dumps, tickets.drop("tons")).first().tons is None


def test_master_index_is_of_all_pings(spark):
    boxes = [(r.route_id, r.rte_min_lon, r.rte_min_lat, r.rte_max_lon, r.rte_max_lat) for r in layers.route_boxes(views.routes(spark, DATA)).collect()]
    held = {}
    for r in views.pings(spark, DATA).collect():
        held.setdefault((f"{r.dt_local:%Y-%m-%d}", r.vehicle_id), []).append((r.lon, r.lat))
    expected = set()
    for key, at in held.items():
        (west, south), (east, north) = map(min, zip(*at)), map(max, zip(*at))
        expected |= {(*key, route) for route, x1, y1, x2, y2 in boxes if not (east < x1 or west > x2 or north < y1 or south > y2)}
    assert sorted(tuple(r) for r in days.master_index(spark, DATA).collect()) == sorted(expected)
    assert {r.file_path for r in days.files_for_route(spark, DATA).collect()} == {f"{d}/{v}" for d, v, route in expected if route == "R6" and "2024-01-05" <= d <= "2024-01-20"}


def test_tons_are_of_all_pings(spark):
    pings = [(r.vehicle_id, r.dt_local, r.event_id % 100 / 8) for r in views.pings(spark, DATA).collect()]
    dumps = [r for r in days.timeline_segments(spark, DATA).collect() if r.segment_type == "dump"]
    pad, tons, first = timedelta(minutes=45), {}, {}
    for r in sorted(dumps, key=lambda r: r.segment_id):
        near = [t for v, at, t in pings if v == r.vehicle_id and r.start_dt_local - pad <= at <= r.end_dt_local + pad]
        tons[r.vehicle_id, r.day, r.segment_id] = sum(near)
        first.setdefault((r.vehicle_id, r.day, r.load_number), sum(near))
    assert {(r.vehicle_id, r.day, r.segment_id): r.tons for r in days.load_tonnage(spark, DATA).collect()} == tons
    loads = days.load_breakdown(spark, DATA).collect()
    kept = {(r.vehicle_id, r.day, r.load_number) for r in days.timeline_segments(spark, DATA).collect() if r.load_number is not None}
    assert len(loads) == len(kept) and {(r.vehicle_id, r.day, r.load_number) for r in loads} == kept > set(first)
    for r in loads:
        assert r.tons == (pytest.approx(first[r.vehicle_id, r.day, r.load_number], abs=0.006) if r.landfill else None)


def test_status_is_of_all_days_and_routes(spark):
    seen = {(r.vehicle_id, r.dt_local.date()) for r in views.visit_pings(spark, DATA).collect()}
    members = {(route, r.APN) for r in views.visit_parcels(spark, DATA).collect() for route in (r.route_ref, r.route_org)}
    rows = [(r.vehicle_id, r.day, r.route_id, r.APN) for r in days.parcel_status(spark, DATA).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(*x, *y) for x in seen for y in members}
    assert days.parcels_geojson(spark, DATA).count() == len({(*x, y) for x in seen for y, _ in members})

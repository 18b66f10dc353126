"""GPS sources: what they ask of a service or a database, how often, and what the cache keeps."""

from datetime import datetime

import pytest

from curbflow.schemas import PINGS
from curbflow.sources import gps

RAW = "vehicle_id string, dt_raw string, lat double, lon double, speed_mph double"


class Counting:
    """A source with pings of vehicle a on one day; counts what it is asked for."""

    def __init__(self, spark):
        self.spark, self.asked, self.rows, self.broken = spark, [], [("a", "2024-01-18T20:00:00Z", 1.0, 2.0, 3.0), ("a", "2024-01-18T19:00:00Z", 1.0, 2.0, 3.0)], False

    def fetch(self, vehicle_ids, start, end):
        self.asked.append(tuple(vehicle_ids))
        if self.broken:
            raise OSError("no answer")
        return gps.normalise_rest(self.spark.createDataFrame([r for r in self.rows if r[0] in vehicle_ids], RAW), start, end)


def test_cache_asks_once(spark, tmp_path):
    source = Counting(spark)
    cache = gps.GpsCache(spark, str(tmp_path / "cache"), source)
    for _ in range(2):
        got = cache.fleet_day(["a", " b "], "2024-01-18").collect()
        assert [r.vehicle_id for r in got] == ["a", "a"]
    assert source.asked == [("a", "b")]  # b has no ping that day, and is not asked for again
    assert cache.fleet_day(["a", "c/d"], "2024-01-18").count() == 2 and cache.vehicle_day("c/d", "2024-01-18").count() == 0
    assert source.asked == [("a", "b"), ("c/d",)]
    assert cache.fleet_day(["a"], "2024-01-19").schema.simpleString() == spark.createDataFrame([], PINGS).schema.simpleString()
    assert cache.fleet_day([], "2024-01-18").count() == 0


def test_cache_refresh(spark, tmp_path):
    source = Counting(spark)
    cache = gps.GpsCache(spark, str(tmp_path / "cache"), source)
    assert cache.vehicle_day("a", "2024-01-18").count() == 2
    source.broken = True
    with pytest.raises(OSError):
        cache.vehicle_day("a", "2024-01-18", refresh=True)
    assert cache.vehicle_day("a", "2024-01-18").count() == 2
    source.broken, source.rows = False, []
    assert cache.vehicle_day("a", "2024-01-18", refresh=True).count() == 0
    assert cache.vehicle_day("a", "2024-01-18").count() == 0 and len(source.asked) == 3
    assert not [p for p in (tmp_path / "cache").iterdir() if p.name.startswith("_fetched")]


def test_rest_asks_each_device_and_day_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def call(session, device, first, last):
        (log / f"{session}-{device}-{first[:10]}-{datetime.now().timestamp()}").touch()
        return [{"dateTime": first.replace("T08", "T12"), "latitude": 1, "longitude": 2, "speed": 100}]

    devices = gps.RestGps.device_lookup([{"id": "b2", "name": " 100001 "}, {"id": "b1", "name": "100001"}, {"id": "b3", "name": " "}, {"id": "b4", "name": "100002"}])
    assert devices == {"100001": "b1", "100002": "b4"}
    source = gps.RestGps(spark, call, devices, login=lambda c: c["user"], user="me", password="x", database="d")
    rows = source.fetch([" 100001", "100002"], "2024-01-18", "2024-01-19").collect()
    assert sorted((r.vehicle_id, str(r.dt_local.date()), r.speed_mph) for r in rows) == [(v, d, 62.0) for v in ("100001", "100002") for d in ("2024-01-18", "2024-01-19")]
    assert sorted(p.name.rsplit("-", 1)[0] for p in log.iterdir()) == [f"me-{d}-2024-01-{n}" for d in ("b1", "b4") for n in (18, 19)]
    with pytest.raises(ValueError):
        source.fetch(["100003"], "2024-01-18", "2024-01-18")


def test_jdbc_pushes_devices_and_days(spark, monkeypatch):
    monkeypatch.delenv("GPS_JDBC_URL", raising=False)
    devices = spark.createDataFrame([(7, " 100001 "), (3, "100001"), (8, "100002"), (9, "")], "device_id int, name string")
    with pytest.raises(ValueError):
        gps.JdbcGps(spark, devices)
    asked = []

    class Local(gps.JdbcGps):
        def read(self, query):
            asked.append(query)
            return spark.sql("SELECT 3 AS device_id, TIMESTAMP_NTZ'2024-07-01 12:00:00' AS utc_naive, 1D AS lat, 2D AS lon, 50D AS speed_kmh")

    source = Local(spark, devices, "jdbc:none")
    rows = source.fetch(["100001"], "2024-07-01", "2024-07-02").collect()
    assert [(r.vehicle_id, r.speed_mph) for r in rows] == [("100001", 31.0)] * 2
    assert len(asked) == 2 and all('"DeviceId" IN (3)' in q for q in asked)
    assert "2024-07-01 07:00:00" in asked[0] and "2024-07-02 07:00:00" in asked[0] and "2024-07-03 07:00:00" in asked[1]
    with pytest.raises(ValueError, match="100009"):
        source.fetch(["100001", "100009"], "2024-07-01", "2024-07-01")
    assert source.queries(["x'y"], "2024-07-01", "2024-07-01")[0].endswith("IN ('x''y')")

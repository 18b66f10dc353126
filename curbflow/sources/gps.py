"""GPS sources: a protocol, a REST source, a JDBC source, and the cache by day and vehicle."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Protocol, runtime_checkable
from uuid import uuid4
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from curbflow.config import LOCAL_ZONE
from curbflow.functions.times import as_date, kmh_to_mph, local_time
from curbflow.operators.tickets import exists
from curbflow.schemas import PINGS, names

FETCH_ROWS = 250_000


@runtime_checkable
class GpsSource(Protocol):
    def fetch(self, vehicle_ids: list[str], start: date | str, end: date | str) -> DataFrame:
        """Canonical pings of these vehicles on the local days from start to end, both included; never None."""


def utc_bounds(start, end, zone: str = LOCAL_ZONE) -> tuple[datetime, datetime]:
    """UTC wall clocks between which the local days lie: the first included, the last not."""
    first, last = as_date(start), as_date(end) + timedelta(days=1)
    utc = ZoneInfo("UTC")
    return tuple(datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(zone)).astimezone(utc).replace(tzinfo=None) for d in (first, last))


def normalise_rest(raw: DataFrame, start, end, zone: str = LOCAL_ZONE) -> DataFrame:
    """Rows (vehicle_id, dt_raw, lat, lon, speed_mph) as canonical pings of the local days; unreadable times go."""
    utc = F.try_to_timestamp(F.regexp_replace(F.trim("dt_raw"), r"Z$", "+00:00"))
    utc = F.to_utc_timestamp(utc, F.current_timezone()).cast("timestamp_ntz")
    rows = raw.withColumn("_utc", utc).withColumn("dt_local", local_time(F.col("_utc"), zone)).filter(F.to_date("dt_local").between(F.lit(as_date(start)), F.lit(as_date(end))))
    numbers = {c: F.col(c).cast("string").try_cast("double") for c in ("lat", "lon", "speed_mph")}
    return _canonical(rows.withColumns(numbers))


def normalise_jdbc(raw: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Rows (vehicle_id, utc_naive, lat, lon, speed_kmh) as canonical pings; rows without a time go."""
    rows = raw.filter(F.col("utc_naive").isNotNull()).withColumn("_utc", F.col("utc_naive").cast("timestamp_ntz"))
    return _canonical(rows.withColumn("dt_local", local_time(F.col("_utc"), zone)).withColumn("speed_mph", kmh_to_mph(F.col("speed_kmh"))))


def _canonical(rows: DataFrame) -> DataFrame:
    """Canonical columns. Not sorted: a global sort would read its input twice, the cache's files are sorted when written."""
    utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("_utc")).cast("timestamp")
    return rows.withColumn("dt_utc", utc).select(*names(PINGS))


class RestPartition(InputPartition):
    def __init__(self, vehicle: str, device: str, day: str):
        super().__init__((vehicle, device, day))
        self.vehicle, self.device, self.day = vehicle, device, day


class RestReader(DataSourceReader):
    """One partition for each vehicle and local day; read() asks the given function for its device's records."""

    def __init__(self, options: dict):
        self.devices = json.loads(options["devices"])
        self.start, self.end = as_date(options["start"]), as_date(options["end"])
        self.zone = options.get("zone", LOCAL_ZONE)
        self.call: Callable = options["_call"]

    def partitions(self):
        days = [(self.start + timedelta(days=k)).isoformat() for k in range((self.end - self.start).days + 1)]
        return [RestPartition(v, d, day) for v, d in sorted(self.devices.items()) for day in days]

    def read(self, partition):
        first, last = utc_bounds(partition.day, partition.day, self.zone)
        for r in self.call(partition.device, first.isoformat() + "Z", last.isoformat() + "Z"):
            kmh = r.get("speed")
            yield partition.vehicle, r["dateTime"], r.get("latitude"), r.get("longitude"), 0.0 if kmh is None else float(round(kmh * 0.621371))


class RestGps:
    """Pings of a telematics service. call(device, from, to) returns its log records as dicts.

    devices: vehicle name -> device id, as device_lookup() gives; without it, names are ids. A login function is called
    once in each task with `credentials`, and its result goes before the other arguments of call.
    """

    SCHEMA = "vehicle_id string, dt_raw string, lat double, lon double, speed_mph double"

    def __init__(self, spark: SparkSession, call: Callable[[str, str, str], Iterable[dict]], devices: dict[str, str] | None = None, zone: str = LOCAL_ZONE, login: Callable[[dict], object] | None = None, **given: str):
        self.spark, self.devices, self.zone = spark, devices, zone
        self.call = call if login is None else _with_login(call, login, self.credentials(**given))

    @staticmethod
    def credentials(user: str | None = None, password: str | None = None, database: str | None = None) -> dict[str, str]:
        """From arguments or GPS_USER, GPS_PASSWORD and GPS_DATABASE."""
        found = {"user": user or os.environ.get("GPS_USER"), "password": password or os.environ.get("GPS_PASSWORD"), "database": database or os.environ.get("GPS_DATABASE")}
        if missing := [k for k, v in found.items() if not v]:
            raise ValueError(f"missing credentials: {', '.join(missing)}")
        return found

    @staticmethod
    def device_lookup(records: Iterable[dict]) -> dict[str, str]:
        """Vehicle name -> device id of the service's device records: names trimmed, the smallest id of each, blank ones gone."""
        found: dict[str, str] = {}
        for r in records:
            if name := (r.get("name") or "").strip():
                found[name] = min(found.get(name, r["id"]), r["id"])
        return found

    def fetch(self, vehicle_ids: list[str], start, end) -> DataFrame:
        names = [v.strip() for v in vehicle_ids]
        if self.devices is not None and (unknown := [v for v in names if v not in self.devices]):
            raise ValueError(f"unknown devices: {', '.join(unknown)}")
        own = {v: v if self.devices is None else self.devices[v] for v in names}
        call, options = self.call, {"devices": json.dumps(own), "start": str(as_date(start)), "end": str(as_date(end)), "zone": self.zone}
        columns = self.SCHEMA

        class Source(DataSource):
            @classmethod
            def name(cls):
                return "gps_rest"

            def schema(self):
                return columns

            def reader(self, schema):
                return RestReader(options | {"_call": call})

        self.spark.dataSource.register(Source)
        return normalise_rest(self.spark.read.format("gps_rest").load(), start, end, self.zone)


def _with_login(call: Callable, login: Callable[[dict], object], credentials: dict) -> Callable:
    def run(device: str, first: str, last: str):
        return call(login(credentials), device, first, last)

    return run


class JdbcGps:
    """Pings of a database.

    The query is a template with {start}, {end} (UTC, the last not included) and {devices} (ids, comma-separated), so that
    the database returns only the pings that are wanted; each local day is one partition, read FETCH_ROWS rows at a time.
    """

    QUERY = 'SELECT "DeviceId" AS device_id, "DateTimeUTC_naive" AS utc_naive, "Latitude" AS lat, "Longitude" AS lon, "Speed" AS speed_kmh FROM gps_log WHERE "DateTimeUTC_naive" >= \'{start}\' AND "DateTimeUTC_naive" < \'{end}\' AND "DeviceId" IN ({devices})'

    def __init__(self, spark: SparkSession, devices: DataFrame, url: str | None = None, query: str | None = None, zone: str = LOCAL_ZONE, **options: str):
        self.url = url or os.environ.get("GPS_JDBC_URL")
        if not self.url:
            raise ValueError("no JDBC URL: give one or set GPS_JDBC_URL")
        self.spark, self.query, self.zone, self.options = spark, query or self.QUERY, zone, options
        self.devices = device_names(devices)

    def queries(self, device_ids: list, start, end) -> list[str]:
        """One for each local day."""
        ids = ", ".join(str(d) if isinstance(d, int) else "'" + str(d).replace("'", "''") + "'" for d in device_ids)
        days = [as_date(start) + timedelta(days=k) for k in range((as_date(end) - as_date(start)).days + 1)]
        return [self.query.format(start=first, end=last, devices=ids) for first, last in (utc_bounds(d, d, self.zone) for d in days)]

    def read(self, query: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, query=query, fetchsize=str(FETCH_ROWS), **self.options).load()

    def fetch(self, vehicle_ids: list[str], start, end) -> DataFrame:
        names = sorted({v.strip() for v in vehicle_ids})
        found = self.devices.filter(F.col("vehicle_id").isin(names)).collect()  # a row for each vehicle asked for
        if unknown := sorted(set(names) - {r["vehicle_id"] for r in found}):
            raise ValueError(f"unknown vehicles: {', '.join(unknown)}")
        raw = reduce(DataFrame.unionByName, [self.read(q) for q in self.queries([r["device_id"] for r in found], start, end)])
        wanted = self.spark.createDataFrame(found, self.devices.schema)
        return normalise_jdbc(raw.join(F.broadcast(wanted), "device_id"), self.zone)


def device_names(devices: DataFrame) -> DataFrame:
    """(device_id, vehicle_id): names trimmed, the device with the smallest id for each, blank ones gone."""
    rows = devices.select("device_id", F.trim("name").alias("vehicle_id")).filter(F.col("vehicle_id") != "")
    return rows.groupBy("vehicle_id").agg(F.min("device_id").alias("device_id")).select("device_id", "vehicle_id")


class GpsCache:
    """Pings at rest, partitioned by local day and vehicle; misses are fetched and written.

    A vehicle-day that has been fetched has a folder, also if it holds no ping, so that it is not asked for again.
    """

    def __init__(self, spark: SparkSession, path: str, source: GpsSource):
        self.spark, self.path, self.source = spark, path.rstrip("/"), source

    def partition(self, day, vehicle_id: str) -> str:
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"{self.path}/day={as_date(day)}/vehicle_id={escape(vehicle_id.strip())}"

    def fleet_day(self, vehicle_ids: list[str], day, refresh: bool = False) -> DataFrame:
        """Pings of these vehicles on a day. Only the missing ones are fetched, or all on refresh."""
        ids = list(dict.fromkeys(v.strip() for v in vehicle_ids))
        missing = [v for v in ids if refresh or not exists(self.spark, self.partition(day, v))]
        if missing:
            self._store(self.source.fetch(missing, day, day), missing, day)
        folder, schema = f"{self.path}/day={as_date(day)}", f"{PINGS}, day string"
        if not ids or not exists(self.spark, folder):
            return self.spark.createDataFrame([], PINGS)
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(folder)  # lists this day only
        return rows.filter(F.col("vehicle_id").isin(ids)).select(*names(PINGS))

    def _store(self, fetched: DataFrame, vehicle_ids: list[str], day) -> None:
        """Written beside the cache first: a fetch that fails leaves it as it was, and no vehicle-day is seen half written."""
        beside = f"{self.path}/_fetched-{uuid4().hex}"
        own = f"{beside}/day={as_date(day)}"
        rows = fetched.withColumn("day", F.lit(str(as_date(day)))).repartition("vehicle_id").sortWithinPartitions("vehicle_id", "dt_utc")
        rows.write.option("partitionOverwriteMode", "static").partitionBy("day", "vehicle_id").parquet(beside)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        system = hadoop(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for v in vehicle_ids:
            target = hadoop(self.partition(day, v))
            source = hadoop(f"{own}/{target.getName()}")
            system.delete(target, True)
            system.mkdirs(target.getParent())
            if not (system.exists(source) and system.rename(source, target)):
                system.mkdirs(target)
        system.delete(hadoop(beside), True)

    def vehicle_day(self, vehicle_id: str, day, refresh: bool = False) -> DataFrame:
        return self.fleet_day([vehicle_id], day, refresh)

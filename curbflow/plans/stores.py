"""Queries of sources, sinks and end-to-end runs: tables are written to a scratch folder, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow import report
from curbflow.config import FacilitiesConfig
from curbflow.functions import geo
from curbflow.operators import dayview, runs, sites, spatial, tickets, vehicle_days
from curbflow.plans import days, fields, signatures, space, views
from curbflow.schemas import ENRICHED, PINGS, names
from curbflow.session import scratch
from curbflow.sources import gps, layers, wkb

DAY = "2024-01-15"


def _stored_days(df: DataFrame, folder: str) -> str:
    df.withColumn("day", F.date_format("dt_local", "yyyy-MM-dd")).repartition("day", "vehicle_id").write.partitionBy("day", "vehicle_id").parquet(folder)
    return folder


def enrich_days_run(spark, sf):
    folder = scratch(spark)
    pings = _stored_days(views.pings(spark, sf).select("event_id", *names(PINGS)), f"{folder}/pings")
    out = runs.enrich_days(spark, pings, f"{folder}/enriched", views.routes(spark, sf), views.parcels(spark, sf), views.landfills(spark, sf), views.depot(spark), space.CONFIG)
    return out.select("event_id", F.col("vehicle_id").cast("string").alias("vehicle_id"), "route_id", "apn", "in_landfill", "at_depot")


def _segments(spark, sf):
    folder = scratch(spark)
    return runs.build_all_segments(spark, _stored_days(views.enriched(spark, sf).select(*names(ENRICHED)), f"{folder}/enriched"), f"{folder}/segments")


def segments_run(spark, sf):
    own = _segments(spark, sf)[0]
    kept = ("vehicle_id", "segment_id", "segment_type", "load_number", "route_id", "start_dt_local", "end_dt_local", "duration_seconds", "n_pings")
    return own.select(*kept, F.round("miles", 4).alias("miles"), F.to_date("day").alias("day"))


def violations_run(spark, sf):
    return _segments(spark, sf)[1].withColumn("vehicle_id", F.col("vehicle_id").cast("string"))


def _patterns(spark, sf):
    folder = scratch(spark)
    _stored_days(views.visit_pings(spark, sf), f"{folder}/enriched")
    return folder, runs.run_patterns(spark, f"{folder}/enriched", views.visit_parcels(spark, sf), f"{folder}/patterns", "custom", signatures.START, signatures.END, signatures.CONFIG)


def patterns_run(spark, sf):
    folder, _ = _patterns(spark, sf)
    return runs.load_patterns(spark, f"{folder}/patterns", "2024-01-01_to_2024-01-30").withColumn("biweekly_pct14", F.round("biweekly_pct14", 9))


def patterns_run_manifest(spark, sf):
    return _patterns(spark, sf)[1].select("route_id", "n_parcels", "ran", "window_start", "window_end")


def _exports(spark, sf, folder: str) -> str:
    """One scale export with all tickets, and one that cannot be read."""
    t = views.tickets(spark, sf)
    rows = t.select(F.col("route_raw").alias("ROUTE#"), F.col("order_key").alias("TRANSACTION #"), F.date_format("shipped", "yyyy-MM-dd HH:mm:ss").alias("RPT_DT"), F.col("fleet_raw").alias("TRUCK"), F.bround("tons_value", 3).cast("string").alias("TONS"), F.col("material_raw").alias("MATL_TYP_DESC"), F.col("loads_raw").alias("NBR_LOADS"), F.col("dump_raw").alias("DUMP LOCATION"))
    rows.coalesce(1).write.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{folder}/csv", header=True)
    spark.range(1).select(F.lit("no workbook")).coalesce(1).write.text(f"{folder}/txt")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path(f"{folder}/in"))
    for kind, name in (("csv", "SCALE_010124.csv"), ("txt", "SCALE_010224.xlsx")):
        system.rename(system.globStatus(path(f"{folder}/{kind}/part-*"))[0].getPath(), path(f"{folder}/in/{name}"))
    return f"{folder}/in"


def ingest_registry(spark, sf):
    folder = scratch(spark)
    found = runs.run_ingest(spark, _exports(spark, sf, folder), f"{folder}/out")
    return found.select("file_name", "source", "file_date", "status", "rows_read", "rows_kept")


def ingest_store(spark, sf):
    """The store after the same exports have come twice."""
    folder = scratch(spark)
    exports = _exports(spark, sf, folder)
    for _ in range(2):
        runs.run_ingest(spark, exports, f"{folder}/out")
    return spark.read.parquet(f"{folder}/out/tickets").groupBy("source", "year").agg(F.count("*").alias("n"), F.min("record_key").alias("first_key"))


def ticket_store(spark, sf):
    """Keys of two overlapping batches that are merged one after the other."""
    folder, rows = scratch(spark), fields._batch(spark, sf)
    tickets.upsert(rows.filter("line_number <= 2").drop("line_number"), folder, "FIELD")
    tickets.upsert(rows.drop("line_number"), folder, "FIELD")
    return spark.read.parquet(folder).select("source", "year", "record_key")


class _Pings:
    def __init__(self, pings: DataFrame):
        self.pings = pings

    def fetch(self, vehicle_ids, start, end) -> DataFrame:
        own = self.pings.filter(F.col("vehicle_id").isin(vehicle_ids) & F.to_date("dt_local").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
        return own.select(*names(PINGS))


def cache_fleet_day(spark, sf):
    """A fleet's day read through the cache: one half of the vehicles is there, the other is fetched."""
    ids = [f"100{k:03d}" for k in range(13)]
    cache = gps.GpsCache(spark, scratch(spark), _Pings(views.pings(spark, sf)))
    cache.fleet_day(ids[:6], DAY)
    return cache.fleet_day(ids, DAY).select("vehicle_id", "dt_local", "lat", "lon", "speed_mph")


def rest_normalise(spark, sf):
    p = views.pings(spark, sf)
    raw = p.select("vehicle_id", F.when(F.col("event_id") % 50 == 0, "soon").otherwise(F.date_format("dt_local", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("dt_raw"), "lat", F.col("lon"), F.rint("speed_mph").alias("speed_mph"))
    return gps.normalise_rest(raw, "2024-01-02", "2024-01-30").select("vehicle_id", "dt_local", "lat", "lon", "speed_mph")


def jdbc_normalise(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", F.col("value").alias("speed_kmh"))
    raw = views.pings(spark, sf).join(e, "event_id").select("vehicle_id", F.when(F.col("event_id") % 50 != 0, F.col("dt_local")).alias("utc_naive"), "lat", "lon", "speed_kmh")
    return gps.normalise_jdbc(raw).select("vehicle_id", "dt_local", "lat", "lon", "speed_mph")


def day_index_store(spark, sf):
    folder = scratch(spark)
    vehicle_days.store_day_indexes(days.vehicle_day_index(spark, sf), folder)
    return vehicle_days.load_day_indexes(spark, folder)


def _as_wkb(layer: DataFrame, folder: str) -> str:
    layer.withColumn("geometry", wkb.encode("segs")).drop("segs").write.parquet(folder)
    return folder


def route_layer(spark, sf):
    """Pings joined with routes that were written as well-known binary and loaded."""
    path = _as_wkb(views.routes(spark, sf).select(F.col("route_id").alias("ROUTE_ID"), "segs"), f"{scratch(spark)}/routes.parquet")
    return spatial.attach_routes(views.pings(spark, sf), layers.load_routes(spark, path, "ROUTE_ID", crs="EPSG:4326")).select("event_id", "route_id")


def parcel_layer(spark, sf):
    own = views.parcels(spark, sf).select("APN", "route_ref", "route_org", "route_rec", "segs")
    found = layers.load_parcels(spark, _as_wkb(own, f"{scratch(spark)}/parcels.parquet"), "EPSG:4326")
    return found.select("APN", *[F.round(c, 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


def facility_layer(spark, sf):
    """Facilities written as GeoJSON and loaded."""
    both = views.landfills(spark, sf).select("name", "segs").unionByName(views.depot(spark))
    feature = dayview.feature_json(geo.geometry_json(F.col("segs")), F.struct("name"))
    path = f"{scratch(spark)}/facilities.geojson"
    both.agg(dayview.collection_json(F.collect_list(feature))).coalesce(1).write.text(path)
    found = layers.load_facilities(spark, path, FacilitiesConfig(name_col="name"), "EPSG:4326")
    kinds = [own.select("name", F.lit(k).alias("kind"), "reach_ft", *[F.round(c, 6).alias(n) for n, c in geo.bounds(F.col("segs")).items()]) for k, own in found.items()]
    return kinds[0].unionByName(kinds[1])


def site_route_store(spark, sf):
    folder = scratch(spark)
    sites.write_routes(sites.route_ids(sites.clean_parts(views.sites(spark, sf))), folder, "ref")
    return spark.read.parquet(folder).groupBy(F.col("route_id").cast("string").alias("route_id")).agg(F.count("*").alias("n"))


def _pages(spark, paths: list[str]) -> DataFrame:
    """What the pages hold: how many dots and loads."""
    if not paths:
        return spark.createDataFrame([], "day string, route_id string, vehicle_id string, n_dots long")
    rows = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)__([^/]+)\.html$", k)
    dots = F.regexp_extract("value", r'"trail":(\{.*?\}\]\}|\{"type":"FeatureCollection","features":\[\]\}),"parcels":', 1)
    return rows.select(part(1).alias("day"), part(2).alias("route_id"), part(3).alias("vehicle_id"), F.regexp_count(dots, F.lit('"type":"Feature",')).cast("long").alias("n_dots"))


def _inputs(spark, sf):
    own = views.enriched(spark, sf)
    return own, days._timeline(spark, sf), views.parcels(spark, sf), views.routes(spark, sf)


def pages_of_routes(spark, sf):
    facilities = views.landfills(spark, sf).select("name", "segs").unionByName(views.depot(spark)).withColumnRenamed("name", "Name")
    return _pages(spark, report.render_all_routes_for_day(*_inputs(spark, sf), scratch(spark), DAY, facilities=facilities, min_pings=1))


def pages_of_vehicles(spark, sf):
    return _pages(spark, report.render_top_n_vehicles(*_inputs(spark, sf), scratch(spark), DAY, 5, min_pings=1))


_LOCAL = "dt_local - INTERVAL 8 HOUR"
_DOTS = """dt AS (SELECT vehicle_id, count(DISTINCT floor(epoch_us(dt_local) / 30e6)) AS n_dots FROM d GROUP BY 1)"""
_OF_DAY = f"WITH {views.ENRICHED}, d AS (SELECT * FROM enriched WHERE dt_local::DATE = DATE '{DAY}'), {_DOTS}"

QUERIES = {
    f.__name__: f
    for f in (enrich_days_run, segments_run, violations_run, patterns_run, patterns_run_manifest, ingest_registry, ingest_store, ticket_store, cache_fleet_day, rest_normalise, jdbc_normalise, day_index_store, route_layer, parcel_layer, facility_layer, site_route_store, pages_of_routes, pages_of_vehicles)
}
ORACLES = {
    "enrich_days_run": space.ORACLES["enrich_full"],
    "segments_run": days.ORACLES["timeline_segments"],
    "violations_run": days.ORACLES["violations"],
    "patterns_run": signatures.ORACLES["patterns_wide"],
    "patterns_run_manifest": """SELECT 'C' || (user_id % 5)::VARCHAR AS route_id, count(DISTINCT user_id) AS n_parcels, true AS ran, DATE '2024-01-01' AS window_start, DATE '2024-01-30' AS window_end FROM events GROUP BY 1""",
    "ingest_registry": """SELECT 'SCALE_010124.csv' AS file_name, 'SCALE' AS source, DATE '2024-01-01' AS file_date, 'OK' AS status, count(*) AS rows_read, count(*) AS rows_kept FROM lineitem
 UNION ALL SELECT 'SCALE_010224.xlsx', 'SCALE', DATE '2024-01-02', 'FAIL', 0, 0""",
    "ingest_store": f"WITH {views.TICKETS} SELECT 'SCALE' AS source, year, count(DISTINCT k) AS n, min(k) AS first_key FROM (SELECT year(shipped)::INTEGER AS year, {fields._KEY_S} AS k FROM tickets) GROUP BY 2",
    "ticket_store": f"WITH {views.TICKETS} SELECT DISTINCT 'FIELD' AS source, year(shipped)::INTEGER AS year, {fields._KEY_F.replace('{fill}', '')} AS record_key FROM tickets",
    "cache_fleet_day": f"WITH {views.PINGS} SELECT vehicle_id, dt_local, lat, lon, speed_mph FROM pings WHERE dt_local::DATE = DATE '{DAY}'",
    "rest_normalise": f"WITH {views.PINGS} SELECT vehicle_id, {_LOCAL} AS dt_local, lat, lon, round_even(speed_mph, 0) AS speed_mph FROM pings WHERE event_id % 50 <> 0 AND ({_LOCAL})::DATE BETWEEN DATE '2024-01-02' AND DATE '2024-01-30'",
    "jdbc_normalise": f"WITH {views.PINGS} SELECT vehicle_id, {_LOCAL} AS dt_local, lat, lon, round_even(value * 0.621371e0, 0) AS speed_mph FROM pings JOIN events USING (event_id) WHERE event_id % 50 <> 0",
    "day_index_store": days.ORACLES["vehicle_day_index"],
    "route_layer": space.ORACLES["route_within_join"],
    "parcel_layer": f"WITH {views.PARCELS} SELECT APN, round(min_lon, 6) AS min_lon, round(min_lat, 6) AS min_lat, round(max_lon, 6) AS max_lon, round(max_lat, 6) AS max_lat FROM parcels",
    "facility_layer": f"""WITH {views.LANDFILLS} SELECT name, 'landfill' AS kind, 50e0 AS reach_ft, round(x, 6) AS min_x, round(y, 6) AS min_y, round(x + 0.012e0, 6) AS max_x, round(y + 0.012e0, 6) AS max_y FROM landfills
 UNION ALL SELECT 'Central Yard', 'depot', 0e0, -117.21e0, 32.69e0, -117.19e0, 32.71e0""",
    "site_route_store": fields.ORACLES["sites_by_route"],
    "pages_of_routes": f"""{_OF_DAY}, r AS (SELECT route_id, vehicle_id, count(*) AS n FROM d WHERE route_id IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY count(*) DESC, vehicle_id) = 1)
 SELECT '{DAY}' AS day, r.route_id, r.vehicle_id, n_dots FROM r JOIN dt USING (vehicle_id)""",
    "pages_of_vehicles": f"""{_OF_DAY}, t AS (SELECT vehicle_id FROM d GROUP BY 1 ORDER BY count(*) DESC, vehicle_id LIMIT 5)
 SELECT DISTINCT '{DAY}' AS day, d.route_id, d.vehicle_id, n_dots FROM d JOIN t USING (vehicle_id) JOIN dt USING (vehicle_id) WHERE d.route_id IS NOT NULL""",
}

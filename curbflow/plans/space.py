"""Queries of the spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbflow.config import FEET_PER_DEGREE, ROUTE_EDGE_DEGREES, EngineConfig
from curbflow.functions import geo
from curbflow.operators import layers, ranking, spatial
from curbflow.plans import views

#: A wider depot than in production, so that the sparse test pings meet it.
CONFIG = EngineConfig(depot_radius_ft=5000.0, parcel_edge_ft=100.0, slow_mph_max=25.0)
EDGE, RADIUS = CONFIG.parcel_edge_ft / FEET_PER_DEGREE, CONFIG.depot_radius_ft / FEET_PER_DEGREE


def route_within_join(spark, sf):
    return spatial.attach_routes(views.pings(spark, sf), views.routes(spark, sf)).select("event_id", "route_id")


def parcel_dwithin_join(spark, sf):
    return spatial.attach_parcels(views.pings(spark, sf), views.parcels(spark, sf), CONFIG).select("event_id", "apn")


def parcel_nearest_join(spark, sf):
    return spatial.attach_parcels(views.pings(spark, sf), views.parcels(spark, sf), CONFIG, "nearest").select("event_id", "apn")


def landfill_flag(spark, sf):
    return spatial.flag_landfills(views.pings(spark, sf), views.landfills(spark, sf)).select("event_id", "in_landfill")


def depot_flag(spark, sf):
    return spatial.flag_depot(views.pings(spark, sf), views.depot(spark), CONFIG).select("event_id", "at_depot")


def enriched(spark, sf):
    return spatial.enrich(views.pings(spark, sf), views.routes(spark, sf), views.parcels(spark, sf), views.landfills(spark, sf), views.depot(spark), CONFIG)


def enrich_full(spark, sf):
    return enriched(spark, sf).select("event_id", "vehicle_id", "route_id", "apn", "in_landfill", "at_depot")


def rank_vehicles(spark, sf):
    joined = spatial.attach_routes(views.pings(spark, sf), views.routes(spark, sf))
    return ranking.rank_vehicles(joined, min_pings=2)  # the test pings are sparse


def site_parcel_join(spark, sf):
    sites = views.pings(spark, sf).select("event_id", "lon", "lat")
    return spatial.attach_apns(sites, views.parcels(spark, sf)).select("event_id", "parcel_apn")


def project_to_feet(spark, sf):
    x, y = geo.project(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:2230")
    return views.pings(spark, sf).select("event_id", F.round(x, 2).alias("x_ft"), F.round(y, 2).alias("y_ft"))


def project_round_trip(spark, sf):
    x, y = geo.project(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:2230")
    there = views.pings(spark, sf).select("event_id", "lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = geo.project(F.col("x"), F.col("y"), "EPSG:2230", "EPSG:4326")
    return there.select("event_id", F.round(lon, 6).alias("lon6"), F.round(lat, 6).alias("lat6"))


def parcel_bbox_filter(spark, sf):
    return layers.bbox_filter(views.parcels(spark, sf), (-117.25, 32.65, -117.15, 32.75)).select("APN")


def parcel_bounds_centroid(spark, sf):
    x, y = geo.centroid(F.col("segs"))
    return views.parcels(spark, sf).select("APN", F.round(x, 6).alias("cx"), F.round(y, 6).alias("cy"), *[F.round(c, 6).alias(k) for k, c in geo.bounds(F.col("segs")).items()])


def route_bbox_dissolve(spark, sf):
    pieces = views.routes(spark, sf).withColumn("route_id", F.concat(F.lit("G"), (F.col("k") % 7).cast("string")))
    return rounded_boxes(layers.route_boxes(pieces))


def rounded_boxes(df):
    return df.select("route_id", *[F.round(c, 6).alias(c) for c in ("rte_min_lon", "rte_min_lat", "rte_max_lon", "rte_max_lat")])


def route_index_auto_manual(spark, sf):
    routes = views.routes(spark, sf)
    auto, manual = routes.filter("k < 15"), routes.filter("k >= 10")
    return rounded_boxes(layers.route_index(auto, manual))


def facilities_split(spark, sf):
    both = views.landfills(spark, sf).select("name", "segs").unionByName(views.depot(spark))
    return layers.split_facilities(both, name_col="name").select("name", "kind", "reach_ft")


_BOX = """abs(p.lon - r.cx) / r.a + abs(p.lat - r.cy) / r.b < 1"""
_NEAR = f"""p.speed_mph <= {CONFIG.slow_mph_max} AND sqrt(greatest(c.min_lon - p.lon, 0e0, p.lon - c.max_lon) ** 2 + greatest(c.min_lat - p.lat, 0e0, p.lat - c.max_lat) ** 2) <= {EDGE!r}"""
_FILL = "EXISTS (SELECT 1 FROM landfills f WHERE p.lon > f.x AND p.lon < f.x + 0.012e0 AND p.lat > f.y AND p.lat < f.y + 0.012e0)"
_DEPOT = f"coalesce(sqrt((p.lon + 117.2e0) ** 2 + (p.lat - 32.7e0) ** 2) <= {RADIUS!r}, false)"
_EDGES = f"""round(min({{x}} - {{a}}) - {ROUTE_EDGE_DEGREES!r}, 6) AS rte_min_lon, round(min(cy - {{b}}) - {ROUTE_EDGE_DEGREES!r}, 6) AS rte_min_lat,
 round(max({{x}} + {{a}}) + {ROUTE_EDGE_DEGREES!r}, 6) AS rte_max_lon, round(max(cy + {{b}}) + {ROUTE_EDGE_DEGREES!r}, 6) AS rte_max_lat"""
_PLAIN, _REACH = _EDGES.format(x="cx", a="a", b="b"), 150.0 / FEET_PER_DEGREE


def _projection_sql() -> str:
    n, f, rho0 = geo.Lambert.constants()
    c = geo.Lambert
    return f"""WITH {views.PINGS}, t AS (SELECT event_id, radians(lon) AS lam, radians(lat) AS phi, sin(radians(lat)) * {c.E!r} AS s FROM pings),
 r AS (SELECT event_id, pow(tan(pi() / 4 - phi / 2) / pow((1 - s) / (1 + s), {c.E / 2!r}), {n!r}) * {c.A * f!r} AS rho, (lam - ({c.LAM0!r})) * {n!r} AS theta FROM t)
 SELECT event_id, round((rho * sin(theta) + {c.EAST!r}) / {c.FOOT!r}, 2) AS x_ft, round(({rho0!r} - rho * cos(theta) + {c.NORTH!r}) / {c.FOOT!r}, 2) AS y_ft FROM r"""


QUERIES = {
    f.__name__: f
    for f in (route_within_join, parcel_dwithin_join, parcel_nearest_join, landfill_flag, depot_flag, enrich_full, rank_vehicles, site_parcel_join, project_to_feet, project_round_trip, parcel_bbox_filter, parcel_bounds_centroid, route_bbox_dissolve, route_index_auto_manual, facilities_split)
}
ORACLES = {
    "route_within_join": f"WITH {views.PINGS}, {views.ROUTES} SELECT event_id, route_id FROM pings p LEFT JOIN routes r ON {_BOX}",
    "parcel_dwithin_join": f"WITH {views.PINGS}, {views.PARCELS} SELECT event_id, APN AS apn FROM pings p LEFT JOIN parcels c ON {_NEAR}",
    "parcel_nearest_join": f"""WITH {views.PINGS}, {views.PARCELS} SELECT event_id, apn FROM (SELECT event_id, APN AS apn, row_number() OVER (PARTITION BY event_id
 ORDER BY greatest(c.min_lon - p.lon, 0e0, p.lon - c.max_lon) ** 2 + greatest(c.min_lat - p.lat, 0e0, p.lat - c.max_lat) ** 2 NULLS LAST, APN) AS n FROM pings p LEFT JOIN parcels c ON {_NEAR}) WHERE n = 1""",
    "landfill_flag": f"WITH {views.PINGS}, {views.LANDFILLS} SELECT event_id, {_FILL} AS in_landfill FROM pings p",
    "depot_flag": f"WITH {views.PINGS} SELECT event_id, {_DEPOT} AS at_depot FROM pings p",
    "enrich_full": f"""WITH {views.PINGS}, {views.ROUTES}, {views.PARCELS}, {views.LANDFILLS} SELECT event_id, vehicle_id, route_id, APN AS apn, {_FILL} AS in_landfill, {_DEPOT} AS at_depot
 FROM pings p LEFT JOIN routes r ON {_BOX} LEFT JOIN parcels c ON {_NEAR}""",
    "rank_vehicles": f"""WITH {views.PINGS}, {views.ROUTES} SELECT route_id, strftime(dt_local, '%Y-%m-%d') AS day, vehicle_id, count(*) AS n_pings, min(dt_local) AS first_dt_local, max(dt_local) AS last_dt_local
 FROM pings p JOIN routes r ON {_BOX} GROUP BY ALL HAVING count(*) >= 2""",
    "site_parcel_join": f"WITH {views.PINGS}, {views.PARCELS} SELECT event_id, APN AS parcel_apn FROM pings p LEFT JOIN parcels c ON p.lon > c.min_lon AND p.lon < c.max_lon AND p.lat > c.min_lat AND p.lat < c.max_lat",
    "project_to_feet": _projection_sql(),
    "project_round_trip": f"WITH {views.PINGS} SELECT event_id, round(lon, 6) AS lon6, round(lat, 6) AS lat6 FROM pings",
    "parcel_bbox_filter": f"WITH {views.PARCELS} SELECT APN FROM parcels WHERE NOT (max_lon < -117.25e0 OR min_lon > -117.15e0 OR max_lat < 32.65e0 OR min_lat > 32.75e0)",
    "parcel_bounds_centroid": f"""WITH {views.PARCELS} SELECT APN, round((min_lon + max_lon) / 2, 6) AS cx, round((min_lat + max_lat) / 2, 6) AS cy, round(min_lon, 6) AS min_x, round(min_lat, 6) AS min_y,
 round(max_lon, 6) AS max_x, round(max_lat, 6) AS max_y FROM parcels""",
    "route_bbox_dissolve": f"WITH {views.ROUTES} SELECT 'G' || (k % 7)::VARCHAR AS route_id, {_PLAIN} FROM routes GROUP BY 1",
    "route_index_auto_manual": f"""WITH {views.ROUTES}, w AS (SELECT *, CASE WHEN k < 15 THEN 0e0 ELSE {_REACH!r} END AS wide FROM routes)
 SELECT route_id, {_EDGES.format(x='cx', a='a - wide', b='b - wide').replace('+ a - wide', '+ a + wide').replace('+ b - wide', '+ b + wide').replace('- a - wide', '- a - wide')} FROM w GROUP BY 1""",
    "facilities_split": f"WITH {views.LANDFILLS} SELECT name, 'landfill' AS kind, 50e0 AS reach_ft FROM landfills UNION ALL SELECT 'Central Yard', 'depot', 0e0",
}

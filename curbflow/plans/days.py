"""Queries of timelines, vehicle-days and day views."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbflow.functions import geo, times
from curbflow.operators import dayview, layers, ranking, timeline, vehicle_days
from curbflow.plans import views


def phase_classify(spark, sf):
    return views.enriched(spark, sf).select("event_id", timeline.phase().alias("phase"))


def haversine_pairs(spark, sf):
    p = views.pings(spark, sf)
    return p.select("event_id", F.round(geo.haversine_miles(F.col("lat"), F.col("lon"), F.lit(32.7), F.lit(-117.2)), 6).alias("miles"))


def segment_islands(spark, sf):
    return timeline.phased(views.enriched(spark, sf)).select("event_id", "phase", "segment_id")


def _timeline(spark, sf):
    return timeline.build_timeline(views.enriched(spark, sf))


def timeline_segments(spark, sf):
    return _timeline(spark, sf).withColumn("miles", F.round("miles", 4))


def load_numbers(spark, sf):
    return _timeline(spark, sf).select("vehicle_id", "day", "segment_id", "segment_type", "load_number")


def violations(spark, sf):
    return timeline.flag_violations(_timeline(spark, sf))


def vehicle_day_index(spark, sf):
    return vehicle_days.summarise(views.pings(spark, sf).withColumn("file", F.concat_ws("/", F.date_format("dt_local", "yyyy-MM-dd"), "vehicle_id")), "file").withColumns({c: F.round(c, 6) for c in ("lat_min", "lat_max", "lon_min", "lon_max")})


def _index(spark, sf):
    filed = views.pings(spark, sf).withColumn("file", F.concat_ws("/", F.date_format("dt_local", "yyyy-MM-dd"), "vehicle_id"))
    return vehicle_days.master_index(vehicle_days.summarise(filed, "file"), layers.route_boxes(views.routes(spark, sf)))


def master_index(spark, sf):
    return _index(spark, sf).select("day", "vehicle_id", "route_id")


def files_for_route(spark, sf):
    return vehicle_days.files_for_route(_index(spark, sf), "R6", "2024-01-05", "2024-01-20")


def top_n_vehicles_routes(spark, sf):
    return ranking.top_vehicle_routes(views.enriched(spark, sf), "2024-01-15", 5, 1)


def trail_downsample(spark, sf):
    return dayview.downsample(views.pings(spark, sf), 3600).select("event_id")


def trail_phase(spark, sf):
    return dayview.attach_phase(views.enriched(spark, sf), _timeline(spark, sf)).select("event_id", "phase", "color")


def trail_geojson(spark, sf):
    """The dots of every trail, read back from its text."""
    trails = dayview.trail_geojson(views.enriched(spark, sf), _timeline(spark, sf))
    shape = "struct<features: array<struct<geometry: struct<coordinates: array<double>>, properties: struct<phase: string, color: string, dt_local: string, speed_mph: double, route_id: string>>>>"
    dots = trails.select("vehicle_id", "day", "n_dots", F.posexplode(F.from_json("trail_json", shape)["features"]).alias("position", "dot"))
    return dots.select("vehicle_id", "day", "n_dots", "position", F.col("dot.geometry.coordinates")[0].alias("lon"), F.col("dot.geometry.coordinates")[1].alias("lat"), "dot.properties.*")


def _status(spark, sf):
    seen = views.visit_pings(spark, sf)
    parcels = views.visit_parcels(spark, sf)
    routes = dayview.route_members(parcels).select(F.col("member_route").alias("route_id")).distinct()
    targets = seen.select("vehicle_id", F.to_date("dt_local").alias("day")).distinct().crossJoin(routes)
    marks = parcels.withColumns({"weekly1_vehicle": F.when(F.substring("APN", -1, 1) == "2", "V1"), "weekly2_vehicle": F.lit(None).cast("string"), "biweekly_vehicle": F.lit(None).cast("string")})
    square = lambda a, b: geo.box(*[F.lit(float(x)) for x in (a, a, b, b)])
    # a square, one with a hole, and two squares
    number = F.substring("APN", 2, 20).cast("long") % 3
    segs = F.when(number == 0, square(0, 9)).when(number == 1, F.concat(square(0, 9), square(3, 6))).otherwise(F.concat(square(0, 1), square(5, 6)))
    return dayview.parcel_status(parcels.withColumn("segs", segs), seen, targets, marks)


def parcel_status(spark, sf):
    return _status(spark, sf).select("vehicle_id", "day", "route_id", "APN", "served", "status", "fill_color", "actual_vehicle")


def parcels_geojson(spark, sf):
    return dayview.parcels_geojson(_status(spark, sf))


def shift_summary(spark, sf):
    return dayview.shift_summary(_timeline(spark, sf)).withColumn("total_miles", F.round("total_miles", 1))


def _tickets(spark, sf):
    return views.pings(spark, sf).select(F.col("vehicle_id").alias("co_fleet_id"), F.col("dt_local").alias("event_dt"), (F.col("event_id") % 100 / F.lit(8.0)).alias("tons"))


def load_breakdown(spark, sf):
    return dayview.load_breakdown(_timeline(spark, sf), _tickets(spark, sf)).withColumn("miles", F.round("miles", 1))


def load_tonnage(spark, sf):
    dumps = _timeline(spark, sf).filter("segment_type = 'dump'").select("vehicle_id", "day", "segment_id", "start_dt_local", "end_dt_local")
    return dayview.load_tonnage(dumps, _tickets(spark, sf)).select("vehicle_id", "day", "segment_id", F.round("tons", 3).alias("tons"))


def stop_bins(spark, sf):
    return views.pings(spark, sf).select("event_id", times.stop_bin(F.col("dt_local")).alias("bin_id"), times.weekday(F.col("dt_local")).alias("dow"), times.week_start(F.col("dt_local")).alias("week_start"), F.hour("dt_local").alias("hour_24"))


def kmh_to_mph(spark, sf):
    return views.table(spark, sf, "events").select("event_id", times.kmh_to_mph(F.col("value")).alias("mph"))


_PHASED = views.ENRICHED + """, ph AS (SELECT *, CASE WHEN at_depot THEN 'depot' WHEN in_landfill THEN 'landfill' WHEN route_id IS NOT NULL AND speed_mph <= 12 THEN 'collection' ELSE 'windshield' END AS phase,
 dt_local::DATE AS day FROM enriched),
 ky AS (SELECT *, CASE WHEN phase = 'collection' THEN 'collection|' || route_id ELSE phase END AS k FROM ph),
 nw AS (SELECT *, CASE WHEN k = lag(k) OVER w THEN 0 ELSE 1 END AS n FROM ky WINDOW w AS (PARTITION BY vehicle_id, day ORDER BY dt_utc, route_id NULLS FIRST, apn NULLS FIRST, lat, lon)),
 sg AS (SELECT *, (sum(n) OVER (PARTITION BY vehicle_id, day ORDER BY dt_utc, route_id NULLS FIRST, apn NULLS FIRST, lat, lon ROWS UNBOUNDED PRECEDING))::INTEGER AS segment_id FROM nw)"""
_HAV = "2 * 3958.7613e0 * asin(least(1e0, sqrt(pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"
_TIMELINE = _PHASED + f""", mv AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM sg WINDOW w AS (PARTITION BY vehicle_id, day, segment_id ORDER BY dt_utc, route_id NULLS FIRST, apn NULLS FIRST, lat, lon)),
 ag AS (SELECT vehicle_id, day, segment_id, min(phase) AS ph, (array_agg(route_id ORDER BY dt_utc, lat, lon))[1] AS rt, min(dt_local) AS start_dt_local, max(dt_local) AS end_dt_local,
 sum(CASE WHEN plat IS NULL THEN 0e0 ELSE {_HAV.format(a='p', b='')} END) AS miles, count(*) AS n_pings FROM mv GROUP BY ALL),
 ty AS (SELECT *, CASE WHEN ph = 'depot' AND segment_id = 1 THEN 'depot_departure' WHEN ph = 'depot' THEN 'depot_arrival' WHEN ph = 'landfill' THEN 'dump' ELSE ph END AS segment_type FROM ag),
 bl AS (SELECT *, sum(CASE WHEN segment_type LIKE 'depot%' THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id, day ORDER BY segment_id) AS blk,
 lag(segment_type) OVER (PARTITION BY vehicle_id, day ORDER BY segment_id) AS prev FROM ty),
 op AS (SELECT *, CASE WHEN prev = 'dump' AND segment_type NOT LIKE 'depot%' AND max(CASE WHEN segment_type IN ('collection', 'dump') THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id, day, blk ORDER BY segment_id
 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 1 THEN 1 ELSE 0 END AS opens FROM bl),
 tl AS (SELECT vehicle_id, day, segment_id, segment_type, CASE WHEN segment_type NOT LIKE 'depot%' THEN (1 + sum(opens) OVER (PARTITION BY vehicle_id, day ORDER BY segment_id))::INTEGER END AS load_number,
 CASE WHEN segment_type = 'collection' THEN rt END AS route_id, start_dt_local, end_dt_local, date_diff('microsecond', start_dt_local, end_dt_local) / 1e6 AS duration_seconds, miles, n_pings FROM op)"""
_DAYS = views.PINGS + """, vd AS (SELECT strftime(dt_local, '%Y-%m-%d') AS day, vehicle_id, count(*) AS rows, min(dt_local) AS min_local, max(dt_local) AS max_local, {r}min(lat){e} AS lat_min, {r}max(lat){e} AS lat_max,
 {r}min(lon){e} AS lon_min, {r}max(lon){e} AS lon_max, strftime(dt_local, '%Y-%m-%d') || '/' || vehicle_id AS file_path FROM pings {w} GROUP BY ALL)"""
_INDEX = _DAYS.format(r="", e="", w="") + f", {views.ROUTES}, rb AS (SELECT route_id, min(cx - a) - 100e0 / 335000 AS x1, min(cy - b) - 100e0 / 335000 AS y1, max(cx + a) + 100e0 / 335000 AS x2, max(cy + b) + 100e0 / 335000 AS y2 FROM routes GROUP BY 1)" + """,
 ix AS (SELECT * FROM vd JOIN rb ON NOT (lon_max < x1 OR lon_min > x2 OR lat_max < y1 OR lat_min > y2))"""
_VISITS = "v AS (SELECT 'A' || user_id::VARCHAR AS apn, 'V' || (event_id % 12)::VARCHAR AS vehicle_id, ts AS dt_local FROM events)"
_STATUS = _VISITS + """, tg AS (SELECT DISTINCT vehicle_id, dt_local::DATE AS day FROM v),
 us AS (SELECT DISTINCT user_id FROM events), mb AS (SELECT user_id, 'C' || (user_id % 5)::VARCHAR AS route_id FROM us UNION SELECT user_id, 'O' || (user_id % 3)::VARCHAR FROM us),
 sv AS (SELECT DISTINCT vehicle_id, dt_local::DATE AS day, apn FROM v),
 jn AS (SELECT tg.vehicle_id, tg.day, mb.route_id, 'A' || mb.user_id::VARCHAR AS APN, mb.user_id % 3 AS shape, 'C' || (mb.user_id % 5)::VARCHAR AS route_ref, 'O' || (mb.user_id % 3)::VARCHAR AS route_org,
 sv.apn IS NOT NULL AS served, CASE WHEN mb.user_id % 10 = 2 THEN 'V1' END AS weekly1_vehicle FROM tg CROSS JOIN mb LEFT JOIN sv ON sv.vehicle_id = tg.vehicle_id AND sv.day = tg.day AND sv.apn = 'A' || mb.user_id::VARCHAR),
 st AS (SELECT *, CASE WHEN served THEN 'served' WHEN weekly1_vehicle IS NOT NULL THEN 'missed' ELSE 'unknown' END AS status,
 CASE WHEN served THEN '#2ecc71' WHEN weekly1_vehicle IS NOT NULL THEN '#e74c3c' ELSE '#bdc3c7' END AS fill_color, CASE WHEN served THEN vehicle_id END AS actual_vehicle FROM jn)"""
_RING = "'[[{a}.0,{a}.0],[{b}.0,{a}.0],[{b}.0,{b}.0],[{a}.0,{b}.0],[{a}.0,{a}.0]]'"
_COLOR = "CASE phase WHEN 'windshield' THEN '#2980b9' WHEN 'collection' THEN '#27ae60' WHEN 'dump' THEN '#c0392b' ELSE '#7f8c8d' END"

QUERIES = {
    f.__name__: f
    for f in (phase_classify, haversine_pairs, segment_islands, timeline_segments, load_numbers, violations, vehicle_day_index, master_index, files_for_route, top_n_vehicles_routes, trail_downsample, trail_phase, trail_geojson, parcel_status, parcels_geojson, shift_summary, load_breakdown, load_tonnage, stop_bins, kmh_to_mph)
}
ORACLES = {
    "phase_classify": f"WITH {_PHASED} SELECT event_id, phase FROM ph",
    "haversine_pairs": f"WITH {views.PINGS} SELECT event_id, round({_HAV.format(a='', b='q.')}, 6) AS miles FROM pings, (SELECT 32.7e0 AS lat, -117.2e0 AS lon) q".replace("radians(lat)", "radians(pings.lat)").replace("radians(lon)", "radians(pings.lon)"),
    "segment_islands": f"WITH {_PHASED} SELECT event_id, phase, segment_id FROM sg",
    "timeline_segments": f"WITH {_TIMELINE} SELECT vehicle_id, segment_id, segment_type, load_number, route_id, start_dt_local, end_dt_local, duration_seconds, round(miles, 4) AS miles, n_pings, day FROM tl",
    "load_numbers": f"WITH {_TIMELINE} SELECT vehicle_id, day, segment_id, segment_type, load_number FROM tl",
    "violations": f"""WITH {_TIMELINE}, ac AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, day ORDER BY segment_id) AS f, row_number() OVER (PARTITION BY vehicle_id, day ORDER BY segment_id DESC) AS l FROM tl WHERE segment_type NOT LIKE 'depot%')
 SELECT vehicle_id, segment_id, 'loaded_depot_departure' AS violation_type, 'high' AS severity, 'First activity is a dump: the truck left the depot loaded.' AS description, day FROM ac WHERE f = 1 AND segment_type = 'dump'
 UNION ALL SELECT vehicle_id, segment_id, 'loaded_depot_return', 'high', 'Last activity is a collection: the truck came back loaded.', day FROM ac WHERE l = 1 AND segment_type = 'collection'
 UNION ALL SELECT vehicle_id, -1, 'overrun_loads', 'medium', max(load_number)::VARCHAR || ' loads in a day, more than 3.', day FROM tl GROUP BY vehicle_id, day HAVING max(load_number) > 3
 UNION ALL SELECT vehicle_id, min(segment_id), 'mid_load_route_switch', 'low', 'Load ' || load_number::VARCHAR || ' served routes ' || string_agg(route_id, ', ' ORDER BY segment_id) || '.', day FROM tl
 WHERE segment_type = 'collection' GROUP BY vehicle_id, day, load_number HAVING count(DISTINCT route_id) > 1""",
    "vehicle_day_index": f"WITH {_DAYS.format(r='round(', e=', 6)', w='')} SELECT * FROM vd",
    "master_index": f"WITH {_INDEX} SELECT day, vehicle_id, route_id FROM ix",
    "files_for_route": f"WITH {_INDEX} SELECT DISTINCT file_path FROM ix WHERE route_id = 'R6' AND day BETWEEN '2024-01-05' AND '2024-01-20'",
    "top_n_vehicles_routes": f"""WITH {views.ENRICHED}, d AS (SELECT * FROM enriched WHERE dt_local::DATE = DATE '2024-01-15'), t AS (SELECT vehicle_id FROM d GROUP BY 1 ORDER BY count(*) DESC, vehicle_id LIMIT 5)
 SELECT vehicle_id, route_id, count(*) AS n_pings FROM d SEMI JOIN t USING (vehicle_id) WHERE route_id IS NOT NULL GROUP BY ALL""",
    "trail_downsample": f"WITH {views.PINGS} SELECT event_id FROM pings QUALIFY row_number() OVER (PARTITION BY vehicle_id, dt_local::DATE, floor(epoch_us(dt_local) / 3600e6) ORDER BY dt_local, event_id) = 1",
    "trail_phase": f"""WITH {_TIMELINE}, hit AS (SELECT e.event_id, arg_max(t.segment_type, t.segment_id) AS st FROM enriched e LEFT JOIN tl t ON t.vehicle_id = e.vehicle_id AND t.day = e.dt_local::DATE AND e.dt_local BETWEEN t.start_dt_local AND t.end_dt_local GROUP BY 1)
 SELECT event_id, phase, {_COLOR} AS color FROM (SELECT event_id, coalesce(st, 'windshield') AS phase FROM hit)""",
    "parcel_status": f"""WITH {_STATUS} SELECT vehicle_id, day, route_id, APN, served, status, fill_color, actual_vehicle FROM st""",
    "parcels_geojson": f"""WITH {_STATUS}, fe AS (SELECT *, '{{"type":"Feature","geometry":{{"type":"' || CASE shape WHEN 2 THEN 'MultiPolygon' ELSE 'Polygon' END || '","coordinates":[' ||
 CASE shape WHEN 0 THEN {_RING.format(a='0', b='9')} WHEN 1 THEN {_RING.format(a='0', b='9')} || ',' || {_RING.format(a='3', b='6')} ELSE '[' || {_RING.format(a='0', b='1')} || '],[' || {_RING.format(a='5', b='6')} || ']' END ||
 ']}},"properties":{{"APN":"' || APN || '","route_ref":"' || route_ref || '","route_org":"' || route_org || '","served":' || served::VARCHAR || ',"status":"' || status || '","fill_color":"' || fill_color || '"' ||
 coalesce(',"actual_vehicle":"' || actual_vehicle || '"', '') || coalesce(',"weekly1_vehicle":"' || weekly1_vehicle || '"', '') || '}}}}' AS f FROM st)
 SELECT vehicle_id, day, route_id, count(*) AS n_parcels, '{{"type":"FeatureCollection","features":[' || string_agg(f, ',' ORDER BY APN) || ']}}' AS parcels_json FROM fe GROUP BY 1, 2, 3""",
    "trail_geojson": f"""WITH {_TIMELINE}, one AS (SELECT * FROM enriched QUALIFY row_number() OVER (PARTITION BY vehicle_id, dt_local::DATE, floor(epoch_us(dt_local) / 30e6) ORDER BY dt_local, event_id) = 1),
 hit AS (SELECT e.event_id, arg_max(t.segment_type, t.segment_id) AS st FROM one e LEFT JOIN tl t ON t.vehicle_id = e.vehicle_id AND t.day = e.dt_local::DATE AND e.dt_local BETWEEN t.start_dt_local AND t.end_dt_local GROUP BY 1),
 dots AS (SELECT one.*, coalesce(st, 'windshield') AS phase FROM one JOIN hit USING (event_id))
 SELECT vehicle_id, dt_local::DATE AS day, count(*) OVER (PARTITION BY vehicle_id, dt_local::DATE) AS n_dots, (row_number() OVER (PARTITION BY vehicle_id, dt_local::DATE ORDER BY dt_local, lat, lon, speed_mph) - 1)::INTEGER AS position,
 lon, lat, phase, {_COLOR} AS color, strftime(dt_local, '%Y-%m-%dT%H:%M:%S') AS dt_local, speed_mph, route_id FROM dots""",
    "shift_summary": f"""WITH {_TIMELINE}, s AS (SELECT vehicle_id, day, strftime(min(start_dt_local), '%H:%M') AS a, strftime(max(end_dt_local), '%H:%M') AS b, coalesce(max(load_number), 0) AS n_loads, count(*) AS n_segments,
 round(round(coalesce(sum(CASE WHEN segment_type NOT LIKE 'depot%' THEN miles END), 0e0), 2), 1) AS total_miles FROM tl GROUP BY 1, 2) SELECT vehicle_id, day, a AS shift_start, b AS shift_end, a || ' → ' || b AS day_time_label, n_loads, n_segments, total_miles FROM s""",
    "load_breakdown": f"""WITH {_TIMELINE}, tk AS (SELECT vehicle_id, dt_local, (event_id % 100) / 8e0 AS tons FROM pings),
 ld AS (SELECT vehicle_id, day, load_number, strftime(min(start_dt_local), '%H:%M') AS start, strftime(max(end_dt_local), '%H:%M') AS "end", round(round(sum(miles), 2), 1) AS miles,
 date_diff('microsecond', min(start_dt_local), max(end_dt_local)) / 1e6 AS duration_seconds, min(CASE WHEN segment_type = 'dump' THEN segment_id END) AS dump FROM tl WHERE load_number IS NOT NULL GROUP BY 1, 2, 3),
 tn AS (SELECT ld.vehicle_id, ld.day, ld.load_number, sum(tk.tons) AS tons FROM ld JOIN tl ON tl.vehicle_id = ld.vehicle_id AND tl.day = ld.day AND tl.segment_id = ld.dump
 JOIN tk ON tk.vehicle_id = ld.vehicle_id AND tk.dt_local BETWEEN tl.start_dt_local - INTERVAL 45 MINUTE AND tl.end_dt_local + INTERVAL 45 MINUTE GROUP BY 1, 2, 3)
 SELECT ld.vehicle_id, ld.day, ld.load_number, start, "end", miles, duration_seconds, CASE WHEN dump IS NOT NULL THEN 'Landfill' END AS landfill, round(tons, 2) AS tons
 FROM ld LEFT JOIN tn ON tn.vehicle_id = ld.vehicle_id AND tn.day = ld.day AND tn.load_number = ld.load_number""",
    "load_tonnage": f"""WITH {_TIMELINE}, tk AS (SELECT vehicle_id, dt_local, (event_id % 100) / 8e0 AS tons FROM pings)
 SELECT tl.vehicle_id, day, segment_id, round(sum(tk.tons), 3) AS tons FROM tl LEFT JOIN tk ON tk.vehicle_id = tl.vehicle_id AND tk.dt_local BETWEEN start_dt_local - INTERVAL 45 MINUTE AND end_dt_local + INTERVAL 45 MINUTE WHERE segment_type = 'dump' GROUP BY 1, 2, 3""",
    "stop_bins": f"WITH {views.PINGS} SELECT event_id, (epoch_us(dt_local) / 1e6 / 900)::BIGINT AS bin_id, strftime(dt_local, '%a') AS dow, date_trunc('week', dt_local)::DATE AS week_start, hour(dt_local)::INTEGER AS hour_24 FROM pings",
    "kmh_to_mph": "SELECT event_id, round_even(value * 0.621371e0, 0) AS mph FROM events",
}

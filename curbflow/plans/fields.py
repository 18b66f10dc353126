"""Queries of scalar functions: identifiers, sites and tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbflow.functions import ids, sites as site_rules, tickets as ticket_rules, times
from curbflow.operators import sites, tickets
from curbflow.plans import views


def vehicle_id_parse(spark, sf):
    t = views.tickets(spark, sf)
    own = ids.parse_vehicle(F.col("fleet_raw"))
    return t.select("order_key", "line_number", own["prefix"].alias("prefix"), own["number"].alias("number"), own["kind"].alias("kind"))


def fleet_classify(spark, sf):
    p = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") % 5 + 1) * 100).cast("string").alias("prefix"))
    return p.select("k", ids.fleet_kind(F.col("prefix")).alias("kind"))


def our_fleet_filter(spark, sf):
    return views.tickets(spark, sf).filter(ids.is_our_fleet(F.col("fleet_raw"), ("100",))).select("order_key", "line_number")


def fleet_id_clean(spark, sf):
    return views.tickets(spark, sf).select("order_key", "line_number", ticket_rules.fleet_id(F.col("fleet_raw")).alias("co_fleet_id"))


def material_scale(spark, sf):
    return views.tickets(spark, sf).select("order_key", "line_number", ticket_rules.material_scale(F.col("material_raw")).alias("matl_norm"))


def material_field(spark, sf):
    m = F.col("material_raw")
    return views.tickets(spark, sf).filter(~ticket_rules.is_demo(m)).select("order_key", "line_number", ticket_rules.material_field(m).alias("matl_norm"))


def parse_moments(spark, sf):
    stamp = F.date_format("shipped", "yyyy-MM-dd")
    raw = F.when(F.col("line_number") == 1, stamp).when(F.col("line_number") == 2, F.date_format("shipped", "M/d/yyyy")).when(F.col("line_number") == 3, "soon").otherwise(F.concat(stamp, F.lit(" 07:08:09")))
    t = views.tickets(spark, sf)
    return t.select("order_key", "line_number", ticket_rules.moment(raw).alias("at"), ticket_rules.number(F.when(F.col("line_number") == 3, "x").otherwise(F.col("loads_raw"))).alias("n"))


def _keyed(spark, sf):
    t = views.tickets(spark, sf)
    return t.select(
        "order_key", "line_number", F.col("shipped").alias("rpt_dt"), F.col("shipped").alias("ld_dt_tm"), ticket_rules.fleet_id(F.col("fleet_raw")).alias("co_fleet_id"), F.bround("tons_value", 3).alias("tons"),
        ticket_rules.material_scale(F.col("material_raw")).alias("matl_norm"), F.col("material_raw").alias("matl_raw"), F.col("route_raw").alias("raw_route"), F.col("loads_raw").alias("raw_nbr_loads"), F.col("dump_raw").alias("raw_dump_location"),
    )


def record_key_scale(spark, sf):
    return tickets.add_keys_scale(_keyed(spark, sf)).select("order_key", "line_number", "event_dt", "year", "record_key")


def record_key_field(spark, sf):
    rows = _keyed(spark, sf).withColumn("raw_tran_num", F.col("order_key").cast("string")).withColumn("raw_landfill_dest_desc", F.col("raw_dump_location"))
    return tickets.add_keys_field(rows).select("order_key", "line_number", "record_key")


def ticket_dedupe(spark, sf):
    rows = tickets.add_keys_scale(_keyed(spark, sf)).drop("order_key", "line_number")
    return tickets.dedupe(rows).groupBy("year").agg(F.count("*").alias("n"), F.min("record_key").alias("first_key"))


def _batch(spark, sf):
    rows = tickets.add_keys_field(_keyed(spark, sf).withColumn("raw_tran_num", F.col("order_key").cast("string")))
    return rows.select("record_key", "year", "tons", "line_number")


def ticket_upsert_summary(spark, sf):
    rows = _batch(spark, sf)
    return tickets.upsert_summary(rows.drop("line_number"), tickets.dedupe(rows.filter("line_number <= 2").drop("line_number"))).drop("dropped")


def ticket_qa(spark, sf):
    found = tickets.quality(_keyed(spark, sf))
    return found.select("rows_out", *[F.round(c, 9).alias(c) for c in ("null_rpt_dt_pct", "null_fleet_pct", "null_tons_pct")], "neg_tons_cnt", F.array_join("matl_raw_values", ";").alias("materials"))


def _files(spark, sf):
    k = F.col("n_nationkey").cast("int")
    name = F.concat(F.when(k % 3 == 0, "/d/SCALE_").when(k % 3 == 1, "/d/FIELD_").otherwise("/d/OTHER_"), F.when(k % 10 == 9, "new").otherwise(F.concat(F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lpad((k + 1).cast("string"), 2, "0"), F.lit("24"))), F.lit(".xlsx"))
    return views.table(spark, sf, "nation").select(name.alias("file_path"), k.alias("modified_time"))


def file_registry(spark, sf):
    return tickets.registry(_files(spark, sf))


def latest_file(spark, sf):
    return tickets.latest(tickets.registry(_files(spark, sf))).select("source", "file_name")


def site_clean_parts(spark, sf):
    return sites.clean_parts(views.sites(spark, sf)).select("site_id", "ref_route4", "ref_day", "rec_route4", "rec_day", "rec_week", "org_route4", "org_day")


def _sites(spark, sf):
    return sites.validity(sites.route_ids(sites.clean_parts(views.sites(spark, sf))))


def site_route_ids(spark, sf):
    return _sites(spark, sf).select("site_id", "route_id_ref", "route_id_rec", "route_id_org")


def site_valid_routes(spark, sf):
    return _sites(spark, sf).select("site_id", "is_ref", "is_rec", "is_org")


def sites_by_route(spark, sf):
    return sites.by_route(sites.route_ids(sites.clean_parts(views.sites(spark, sf))), "ref").groupBy("route_id").agg(F.count("*").alias("n"))


def region_bbox_filter(spark, sf):
    return sites.in_region(views.sites(spark, sf)).select("site_id", "x", "y")


def lon_lat_valid(spark, sf):
    p = views.pings(spark, sf).select("event_id", (F.col("lon") * (F.col("event_id") % 3 + 1)).cast("string").alias("lon"), F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("lat").cast("string")).alias("lat"))
    return p.select("event_id", site_rules.valid_lon_lat(F.col("lon"), F.col("lat")).alias("good"))


def window_resolve(spark, sf):
    rows = []
    for period in times.PERIODS:
        start, end = times.compute_window(period, end="2024-06-30")
        rows.append((period, times.window_label(start, end), times.total_weeks(start, end)))
    return spark.createDataFrame(rows, "period string, label string, weeks int")


def header_resolve(spark, sf):
    headers = ["Route# ", "co_fleet_id", "TRUCK", " Dump  Location"]
    wanted = [["ROUTE#"], ["CO_FLEET_ID", "TRUCK"], ["DUMP LOCATION"], ["TONS"]]
    return spark.createDataFrame([("|".join(w), ticket_rules.resolve_column(headers, w)) for w in wanted], "wanted string, found string")


_FLEET = "CASE WHEN fleet_raw <> 'nan' THEN split_part(replace(fleet_raw, ',', ''), '.', 1) END"
_MATERIAL = "CASE upper(trim(material_raw)) WHEN 'REFUSE' THEN 'REFUSE' WHEN 'RECYCLING' THEN 'RECYCLING' WHEN 'COLLECTIONS ORGANICS' THEN 'ORGANIC' ELSE 'OTHER' END"
_TONS = "regexp_replace(printf('%.3f', round_even(tons_value, 3)), '0{1,2}$', '')"
_STAMP = "strftime(date_trunc('minute', shipped), '%Y-%m-%d %H:%M:%S')"
_KEY_S = f"sha1({_STAMP} || '||' || coalesce({_FLEET}, '') || '||' || route_raw || '||' || loads_raw || '||WEST FILL||' || {_MATERIAL} || '||' || {_TONS})"
_KEY_F = f"sha1({_STAMP} || '||' || coalesce({_FLEET}, '') || '||{{fill}}||' || {_MATERIAL} || '||' || {_TONS} || '||' || order_key::VARCHAR)"
_PARTS = views.SITES + """, dg AS (SELECT *, {d}ref_route_raw{e} AS d_ref, {d}rec_route_raw{e} AS d_rec, {d}org_route_raw{e} AS d_org, {d}ref_day_raw{e} AS e_ref, {d}rec_day_raw{e} AS e_rec, {d}org_day_raw{e} AS e_org FROM sites),
 pt AS (SELECT site_id, lpad(right(d_ref, 4), 4, '0') AS ref_route4, CASE WHEN e_ref IN ('1', '2', '3', '4', '5') THEN e_ref END AS ref_day, lpad(right(d_rec, 4), 4, '0') AS rec_route4,
 CASE WHEN e_rec IN ('1', '2', '3', '4', '5') THEN e_rec END AS rec_day, CASE WHEN upper(trim(rec_week_raw)) IN ('B', 'O') THEN upper(trim(rec_week_raw)) END AS rec_week,
 lpad(right(d_org, 4), 4, '0') AS org_route4, CASE WHEN e_org IN ('1', '2', '3', '4', '5') THEN e_org END AS org_day FROM dg)""".format(d="nullif(regexp_replace(regexp_replace(trim(", e="), '\\.0$', ''), '[^0-9]+', '', 'g'), '')")
_VALID = _PARTS + """, q AS (SELECT *, left(ref_route4, 2) AS p, right(ref_route4, 2)::INTEGER AS s, left(rec_route4, 2) AS rp, right(rec_route4, 2)::INTEGER AS rs, left(org_route4, 2) AS op, right(org_route4, 2)::INTEGER AS os FROM pt),
 ok AS (SELECT *, coalesce(p IN ('61', '62', '63', '64', '65', '51', '52') AND ref_day IS NOT NULL AND s < 40, false) AS is_ref,
 coalesce(rp IN ('61', '62', '63', '64', '65', '51', '52') AND rec_day IS NOT NULL AND rec_week IS NOT NULL AND rs >= 40 AND (rp NOT IN ('51', '52') OR rs < 60), false) AS is_rec,
 coalesce(((op IN ('71', '72', '73', '74', '75') AND os < 40) OR (op IN ('51', '52') AND os >= 60)) AND org_day IS NOT NULL, false) AS is_org FROM q)"""
_FILES = """f AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN '/d/SCALE_' WHEN 1 THEN '/d/FIELD_' ELSE '/d/OTHER_' END || CASE WHEN n_nationkey % 10 = 9 THEN 'new' ELSE lpad((n_nationkey % 12 + 1)::VARCHAR, 2, '0') || lpad((n_nationkey + 1)::VARCHAR, 2, '0') || '24' END || '.xlsx' AS file_path, n_nationkey AS modified_time FROM nation),
 r AS (SELECT file_path, modified_time, split_part(file_path, '/', 3) AS file_name, CASE WHEN file_path LIKE '/d/SCALE%' THEN 'SCALE' ELSE 'FIELD' END AS source, CASE WHEN regexp_matches(file_path, '_[0-9]{6}[.]') THEN
 TRY_CAST('2024-' || substr(file_path, 10, 2) || '-' || substr(file_path, 12, 2) AS DATE) END AS file_date FROM f WHERE file_path NOT LIKE '%OTHER%')"""

QUERIES = {
    f.__name__: f
    for f in (vehicle_id_parse, fleet_classify, our_fleet_filter, fleet_id_clean, material_scale, material_field, parse_moments, record_key_scale, record_key_field, ticket_dedupe, ticket_upsert_summary, ticket_qa, file_registry, latest_file, site_clean_parts, site_route_ids, site_valid_routes, sites_by_route, region_bbox_filter, lon_lat_valid, window_resolve, header_resolve)
}
_T = f"WITH {views.TICKETS}"
ORACLES = {
    "vehicle_id_parse": f"{_T}, c AS (SELECT *, {_FLEET} AS id FROM tickets) SELECT order_key, line_number, left(id, 3) AS prefix, substr(id, 4) AS number, CASE left(id, 3) WHEN '100' THEN 'AUTO' WHEN '200' THEN 'AUTO' END AS kind FROM c",
    "fleet_classify": "SELECT s_suppkey AS k, CASE (s_suppkey % 5 + 1) * 100 WHEN 100 THEN 'AUTO' WHEN 200 THEN 'AUTO' WHEN 300 THEN 'MANUAL' WHEN 400 THEN 'MANUAL' ELSE 'OTHER' END AS kind FROM supplier",
    "our_fleet_filter": f"{_T} SELECT order_key, line_number FROM tickets WHERE fleet_raw LIKE '100%'",
    "fleet_id_clean": f"{_T} SELECT order_key, line_number, {_FLEET} AS co_fleet_id FROM tickets",
    "material_scale": f"{_T} SELECT order_key, line_number, {_MATERIAL} AS matl_norm FROM tickets",
    "material_field": f"{_T} SELECT order_key, line_number, CASE WHEN upper(trim(material_raw)) = 'REFUSE' THEN 'REFUSE' ELSE 'ORGANIC' END AS matl_norm FROM tickets WHERE material_raw <> 'DEMO'",
    "parse_moments": f"{_T} SELECT order_key, line_number, CASE WHEN line_number = 3 THEN NULL WHEN line_number < 3 THEN date_trunc('day', shipped)::TIMESTAMP ELSE date_trunc('day', shipped)::TIMESTAMP + INTERVAL '7:08:09' HOUR TO SECOND END AS at, CASE WHEN line_number <> 3 THEN loads_raw::DOUBLE END AS n FROM tickets".replace("INTERVAL '7:08:09' HOUR TO SECOND", "INTERVAL 25689 SECOND"),
    "record_key_scale": f"{_T} SELECT order_key, line_number, date_trunc('minute', shipped)::TIMESTAMP AS event_dt, year(shipped)::INTEGER AS year, {_KEY_S} AS record_key FROM tickets",
    "record_key_field": f"{_T} SELECT order_key, line_number, {_KEY_F.replace('{fill}', 'WEST FILL')} AS record_key FROM tickets",
    "ticket_dedupe": f"{_T} SELECT year, count(DISTINCT k) AS n, min(k) AS first_key FROM (SELECT year(shipped)::INTEGER AS year, {_KEY_S} AS k FROM tickets) GROUP BY 1",
    "ticket_upsert_summary": f"""{_T}, k AS (SELECT year(shipped)::INTEGER AS year, {_KEY_F.replace('{fill}', '')} AS k, line_number FROM tickets), g AS (SELECT year, k, min(line_number) AS l FROM k GROUP BY 1, 2)
 SELECT year, count(*) FILTER (l <= 2) AS existing, count(*) FILTER (l > 2) AS added, count(*) AS total FROM g GROUP BY 1""",
    "ticket_qa": f"{_T} SELECT count(*) AS rows_out, 0e0 AS null_rpt_dt_pct, round(avg(CASE WHEN fleet_raw = 'nan' THEN 1e0 ELSE 0e0 END), 9) AS null_fleet_pct, 0e0 AS null_tons_pct, 0::BIGINT AS neg_tons_cnt, ' refuse ;Collections Organics;DEMO' AS materials FROM tickets",
    "file_registry": f"WITH {_FILES} SELECT * FROM r",
    "latest_file": f"WITH {_FILES} SELECT source, file_name FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY file_date DESC NULLS FIRST, modified_time DESC, file_name DESC) = 1",
    "site_clean_parts": f"WITH {_PARTS} SELECT * FROM pt",
    "site_route_ids": f"WITH {_PARTS} SELECT site_id, ref_route4 || ref_day AS route_id_ref, rec_route4 || rec_day || rec_week AS route_id_rec, org_route4 || org_day AS route_id_org FROM pt",
    "site_valid_routes": f"WITH {_VALID} SELECT site_id, is_ref, is_rec, is_org FROM ok",
    "sites_by_route": f"WITH {_VALID} SELECT ref_route4 || ref_day AS route_id, count(*) AS n FROM ok WHERE is_ref GROUP BY 1",
    "region_bbox_filter": f"WITH {views.SITES} SELECT site_id, x::DOUBLE AS x, TRY_CAST(y AS DOUBLE) AS y FROM sites WHERE x::DOUBLE BETWEEN 5800000 AND 6600000 AND TRY_CAST(y AS DOUBLE) BETWEEN 1700000 AND 2200000",
    "lon_lat_valid": f"WITH {views.PINGS} SELECT event_id, event_id % 7 <> 0 AND lon * (event_id % 3 + 1) BETWEEN -180 AND 180 AS good FROM pings",
    "window_resolve": "SELECT * FROM (VALUES ('past_year', '2023-07-01_to_2024-06-30', 53), ('quarter', '2024-04-01_to_2024-06-30', 13), ('month', '2024-05-31_to_2024-06-30', 5), ('week', '2024-06-23_to_2024-06-30', 2), ('day', '2024-06-29_to_2024-06-30', 1)) AS t(period, label, weeks)",
    "header_resolve": "SELECT * FROM (VALUES ('ROUTE#', 'Route# '), ('CO_FLEET_ID|TRUCK', 'co_fleet_id'), ('DUMP LOCATION', ' Dump  Location'), ('TONS', NULL)) AS t(wanted, found)",
}

"""Fleet tables derived from the generic test tables: DataFrames, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.functions import geo


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings with event_id, positions spread over a 0.2 degree square."""
    e = table(spark, sf_dir, "events")
    x, y = F.col("event_id") % 997, (37 * F.col("user_id") + 13 * F.col("event_id")) % 991
    return e.select(
        "event_id", F.concat(F.lit("100"), F.lpad((F.col("user_id") % 12).cast("string"), 3, "0")).alias("vehicle_id"),
        F.col("ts").cast("timestamp").alias("dt_utc"), F.col("ts").cast("timestamp_ntz").alias("dt_local"),
        (F.lit(32.6) + F.lit(0.2) * (y / F.lit(991.0))).alias("lat"), (F.lit(-117.3) + F.lit(0.2) * (x / F.lit(997.0))).alias("lon"),
        (F.col("value") - 40 * F.floor(F.col("value") / 40)).alias("speed_mph"),
    )


PINGS = """pings AS (SELECT event_id, '100' || lpad((user_id % 12)::VARCHAR, 3, '0') AS vehicle_id, ts AS dt_utc, ts AS dt_local,
 32.6e0 + 0.2e0 * (((37 * user_id + 13 * event_id) % 991) / 991e0) AS lat, -117.3e0 + 0.2e0 * ((event_id % 997) / 997e0) AS lon,
 value - 40 * floor(value / 40) AS speed_mph FROM events)"""


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings with flags straight from event types, so that timelines do not depend on geometry."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    kind = F.col("event_type")
    route = F.when(kind.isin("view", "click"), F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")))
    flags = e.select("event_id", route.alias("route_id"), F.when(kind == "view", F.concat(F.lit("P"), (F.col("user_id") % 40).cast("string"))).alias("apn"), (kind == "signup").alias("in_landfill"), (kind == "error").alias("at_depot"))
    return pings(spark, sf_dir).join(flags, "event_id")


ENRICHED = PINGS + """, enriched AS (SELECT p.*, CASE WHEN event_type IN ('view', 'click') THEN 'R' || (user_id % 5)::VARCHAR END AS route_id,
 CASE WHEN event_type = 'view' THEN 'P' || (user_id % 40)::VARCHAR END AS apn,
 event_type = 'signup' AS in_landfill, event_type = 'error' AS at_depot FROM pings p JOIN events USING (event_id))"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping diamonds on a five by five grid."""
    k = F.col("n_nationkey").cast("bigint")
    out = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("R"), k.cast("string")).alias("route_id"), k.alias("k"), (F.lit(-117.28) + F.lit(0.04) * (k % 5)).alias("cx"),
        (F.lit(32.62) + F.lit(0.04) * F.floor(k / 5)).alias("cy"), (F.lit(0.018) + F.lit(0.006) * (k % 3)).alias("a"), (F.lit(0.018) + F.lit(0.004) * (k % 2)).alias("b"),
    )
    return out.withColumn("segs", geo.diamond(F.col("cx"), F.col("cy"), F.col("a"), F.col("b")))


ROUTES = """routes AS (SELECT 'R' || n_nationkey::VARCHAR AS route_id, n_nationkey::BIGINT AS k, -117.28e0 + 0.04e0 * (n_nationkey % 5) AS cx,
 32.62e0 + 0.04e0 * (n_nationkey // 5) AS cy, 0.018e0 + 0.006e0 * (n_nationkey % 3) AS a, 0.018e0 + 0.004e0 * (n_nationkey % 2) AS b FROM nation)"""


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small boxes on a lattice."""
    k = F.col("p_partkey")
    half = F.lit(0.0004) + F.lit(0.0002) * (k % 3)
    out = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.lpad(k.cast("string"), 8, "0")).alias("APN"), (k % 4).cast("double").alias("UNITQTY"),
        F.concat(F.lit("R"), (k % 25).cast("string")).alias("route_ref"), F.when(k % 4 != 0, F.concat(F.lit("R"), ((k + 7) % 25).cast("string"))).alias("route_org"),
        F.when(k % 3 != 0, F.concat(F.lit("R"), ((k + 11) % 25).cast("string"))).alias("route_rec"),
        (F.lit(-117.3) + F.lit(0.2) * (((k * 7919) % 1009) / F.lit(1009.0))).alias("cx"), (F.lit(32.6) + F.lit(0.2) * (((k * 104729) % 1013) / F.lit(1013.0))).alias("cy"), half.alias("half"),
    )
    out = out.withColumns({"min_lon": F.col("cx") - F.col("half"), "min_lat": F.col("cy") - F.col("half"), "max_lon": F.col("cx") + F.col("half"), "max_lat": F.col("cy") + F.col("half")})
    return out.withColumn("segs", geo.box(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])).drop("cx", "cy", "half")


PARCELS = """parcel_base AS (SELECT p_partkey AS k, -117.3e0 + 0.2e0 * (((p_partkey * 7919) % 1009) / 1009e0) AS cx,
 32.6e0 + 0.2e0 * (((p_partkey * 104729) % 1013) / 1013e0) AS cy, 0.0004e0 + 0.0002e0 * (p_partkey % 3) AS half FROM part),
 parcels AS (SELECT 'P' || lpad(k::VARCHAR, 8, '0') AS APN, (k % 4)::DOUBLE AS UNITQTY, 'R' || (k % 25)::VARCHAR AS route_ref,
 CASE WHEN k % 4 <> 0 THEN 'R' || ((k + 7) % 25)::VARCHAR END AS route_org, CASE WHEN k % 3 <> 0 THEN 'R' || ((k + 11) % 25)::VARCHAR END AS route_rec,
 cx - half AS min_lon, cy - half AS min_lat, cx + half AS max_lon, cy + half AS max_lat FROM parcel_base)"""


def landfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    out = table(spark, sf_dir, "region").select(F.concat(F.lit("Landfill "), k.cast("string")).alias("name"), (F.lit(-117.29) + F.lit(0.035) * k).alias("x"), (F.lit(32.61) + F.lit(0.03) * k).alias("y"))
    return out.withColumn("segs", geo.box(F.col("x"), F.col("y"), F.col("x") + 0.012, F.col("y") + 0.012))


LANDFILLS = "landfills AS (SELECT 'Landfill ' || r_regionkey::VARCHAR AS name, -117.29e0 + 0.035e0 * r_regionkey AS x, 32.61e0 + 0.03e0 * r_regionkey AS y FROM region)"


def depot(spark: SparkSession) -> DataFrame:
    one = spark.range(1)
    return one.select(F.lit("Central Yard").alias("name"), geo.box(F.lit(-117.21), F.lit(32.69), F.lit(-117.19), F.lit(32.71)).alias("segs"))


def visit_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings at parcels named after users, by twelve vehicles."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("apn"), F.concat(F.lit("V"), (F.col("event_id") % 12).cast("string")).alias("vehicle_id"), F.col("ts").cast("timestamp_ntz").alias("dt_local"))


def visit_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels of those users, in five chunks."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    k = F.col("user_id")
    return u.select(F.concat(F.lit("A"), k.cast("string")).alias("APN"), F.concat(F.lit("C"), (k % 5).cast("string")).alias("route_ref"), F.concat(F.lit("O"), (k % 3).cast("string")).alias("route_org"), F.lit(None).cast("string").alias("route_rec"))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale tickets as text, with the noise of exports."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_suppkey")
    fleet = F.concat(F.when(k % 2 == 0, "100,").otherwise("200"), F.lpad((k % 50).cast("string"), 3, "0"), F.when(k % 3 == 0, ".0").otherwise(""))
    material = F.when(F.col("l_returnflag") == "R", " refuse ").when(F.col("l_returnflag") == "A", "Collections Organics").otherwise("DEMO")
    return li.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), F.when(k % 11 == 0, "nan").otherwise(fleet).alias("fleet_raw"),
        material.alias("material_raw"), F.col("l_shipdate").cast("timestamp_ntz").alias("shipped"), (F.col("l_quantity") / 10 + F.col("l_discount") / 7).alias("tons_value"),
        F.concat(F.lit("R "), (F.col("l_partkey") % 25).cast("string")).alias("route_raw"), (F.col("l_linenumber") % 3).cast("string").alias("loads_raw"), F.lit(" West   Fill ").alias("dump_raw"),
    )


TICKETS = """tickets AS (SELECT l_orderkey AS order_key, l_linenumber AS line_number,
 CASE WHEN l_suppkey % 11 = 0 THEN 'nan' ELSE (CASE WHEN l_suppkey % 2 = 0 THEN '100,' ELSE '200' END) || lpad((l_suppkey % 50)::VARCHAR, 3, '0') || (CASE WHEN l_suppkey % 3 = 0 THEN '.0' ELSE '' END) END AS fleet_raw,
 CASE l_returnflag WHEN 'R' THEN ' refuse ' WHEN 'A' THEN 'Collections Organics' ELSE 'DEMO' END AS material_raw, l_shipdate AS shipped,
 l_quantity / 10 + l_discount / 7 AS tons_value, 'R ' || (l_partkey % 25)::VARCHAR AS route_raw, (l_linenumber % 3)::VARCHAR AS loads_raw, ' West   Fill ' AS dump_raw FROM lineitem)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site rows as text, with the noise of exports."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    zone = F.element_at(F.array(*[F.lit(z) for z in ("61", "65", "51", "52", "71", "75", "99")]), (k % 7 + 1).cast("int"))
    number = F.concat(zone, F.lpad(((k * 13) % 70).cast("string"), 2, "0"))
    noise = F.element_at(F.array(F.lit(""), F.lit(".0"), F.lit(" "), F.lit("x")), (k % 4 + 1).cast("int"))
    return c.select(
        k.cast("string").alias("site_id"), F.concat(number, noise).alias("ref_route_raw"), F.concat((k % 7).cast("string"), F.when(k % 5 == 0, ".0").otherwise("")).alias("ref_day_raw"),
        F.concat(number, noise).alias("rec_route_raw"), (k % 6).cast("string").alias("rec_day_raw"), F.element_at(F.array(F.lit(" b"), F.lit("O"), F.lit("x"), F.lit(None).cast("string")), (k % 4 + 1).cast("int")).alias("rec_week_raw"),
        F.concat(F.lit(" "), number).alias("org_route_raw"), (k % 8).cast("string").alias("org_day_raw"), (F.lit(5_700_000) + (k * 997) % 1_000_000).cast("string").alias("x"), F.when(k % 50 == 0, "n/a").otherwise((F.lit(1_650_000) + (k * 613) % 600_000).cast("string")).alias("y"),
    )


SITES = """site_base AS (SELECT c_custkey AS k, (['61', '65', '51', '52', '71', '75', '99'])[c_custkey % 7 + 1] || lpad(((c_custkey * 13) % 70)::VARCHAR, 2, '0') AS num,
 (['', '.0', ' ', 'x'])[c_custkey % 4 + 1] AS noise FROM customer),
 sites AS (SELECT k::VARCHAR AS site_id, num || noise AS ref_route_raw, (k % 7)::VARCHAR || (CASE WHEN k % 5 = 0 THEN '.0' ELSE '' END) AS ref_day_raw,
 num || noise AS rec_route_raw, (k % 6)::VARCHAR AS rec_day_raw, ([' b', 'O', 'x', NULL])[k % 4 + 1] AS rec_week_raw, ' ' || num AS org_route_raw, (k % 8)::VARCHAR AS org_day_raw,
 (5700000 + (k * 997) % 1000000)::VARCHAR AS x, CASE WHEN k % 50 = 0 THEN 'n/a' ELSE (1650000 + (k * 613) % 600000)::VARCHAR END AS y FROM site_base)"""

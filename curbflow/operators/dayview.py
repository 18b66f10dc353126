"""A day's picture of routes and vehicles: trails, parcels, shifts, loads and their tonnage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.functions import geo
from curbflow.functions.times import time_bucket, wall_micros
from curbflow.operators.timeline import DEPOT_TYPES

# Colours of phases and of parcels.
PHASE_COLORS = {"depot_departure": "#7f8c8d", "depot_arrival": "#7f8c8d", "windshield": "#2980b9", "collection": "#27ae60", "dump": "#c0392b"}
OTHER_COLOR = "#95a5a6"
STATUS_COLORS = {"served": "#2ecc71", "missed": "#e74c3c", "unknown": "#bdc3c7"}
DOWNSAMPLE_SECONDS, PAD_MINUTES = 30, 45


def downsample(pings: DataFrame, seconds: float = DOWNSAMPLE_SECONDS) -> DataFrame:
    """The first ping of every vehicle, day and time bucket; 0 keeps all."""
    if not seconds:
        return pings
    rows = pings.withColumn("_bucket", time_bucket(F.col("dt_local"), seconds)).withColumn("_day", F.to_date("dt_local"))
    first = Window.partitionBy("vehicle_id", "_day", "_bucket").orderBy("dt_local", *[c for c in ("event_id", "lat", "lon") if c in pings.columns])
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_bucket", "_day")


def attach_phase(pings: DataFrame, timeline: DataFrame) -> DataFrame:
    """pings with phase and color: the type of the last segment of the day whose closed interval holds the ping.

    Segments begin in order, so the last one that has begun is found by a running value over pings and segment starts
    together; where it has ended before the ping, an earlier one cannot hold it unless segments overlap at a shared
    instant, which the order of ties settles. Pings outside all segments are windshield.
    """
    kind = {f.name: f.dataType for f in pings.schema.fields}
    rows = pings.select("*", F.lit(None).cast("string").alias("_type"), F.lit(None).cast("timestamp_ntz").alias("_end"), F.lit(None).cast("int").alias("_seg"), F.lit(1).alias("_ping"), F.to_date("dt_local").alias("_day"))
    starts = timeline.select(
        *[{"vehicle_id": F.col("vehicle_id"), "dt_local": F.col("start_dt_local").cast("timestamp_ntz")}.get(c, F.lit(None).cast(t)).alias(c) for c, t in kind.items()],
        F.col("segment_type").alias("_type"), F.col("end_dt_local").cast("timestamp_ntz").alias("_end"), F.col("segment_id").alias("_seg"), F.lit(0).alias("_ping"), F.col("day").alias("_day"),
    )
    day = Window.partitionBy("vehicle_id", "_day").orderBy("dt_local", "_ping", "_seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_ping") == 0, F.struct("_type", "_end")), ignorenulls=True).over(day)
    both = rows.unionByName(starts).withColumn("_last", last).filter("_ping = 1")
    phase = F.when(F.col("dt_local") <= F.col("_last._end"), F.col("_last._type")).otherwise(F.lit("windshield"))
    return both.withColumn("phase", F.coalesce(phase, F.lit("windshield"))).withColumn("color", color(F.col("phase"))).drop("_type", "_end", "_seg", "_ping", "_day", "_last")


def color(phase: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PHASE_COLORS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, phase), F.lit(OTHER_COLOR))


def feature_json(geometry: Column, properties: Column) -> Column:
    """A feature as text, of its geometry's text and a struct."""
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(properties), F.lit("}"))


def collection_json(features: Column) -> Column:
    """A FeatureCollection as text, of an array of its features' texts."""
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}"))


def trail_geojson(enriched: DataFrame, timeline: DataFrame, seconds: float = DOWNSAMPLE_SECONDS) -> DataFrame:
    """One FeatureCollection of dots for each vehicle and day. A vehicle-day of a shift is bounded by its sampling."""
    dots = attach_phase(downsample(enriched, seconds), timeline)
    stamp = F.date_format("dt_local", "yyyy-MM-dd'T'HH:mm:ss")
    properties = F.struct("phase", "color", stamp.alias("dt_local"), "speed_mph", "route_id")
    feature = feature_json(F.to_json(geo.point_geojson(F.col("lon"), F.col("lat"))), properties)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("dt_local", "lat", "lon", feature.alias("feature")))), lambda x: x["feature"])
    return dots.groupBy("vehicle_id", F.to_date("dt_local").alias("day")).agg(F.count("*").alias("n_dots"), collection_json(ordered).alias("trail_json"))


def route_members(parcels: DataFrame) -> DataFrame:
    """(member_route, parcel columns): every parcel once for each route that serves it in any commodity."""
    routes = F.array_distinct(F.filter(F.array("route_ref", "route_org", "route_rec"), lambda r: r.isNotNull()))
    return parcels.withColumn("member_route", F.explode(routes))


def served_apns(enriched: DataFrame) -> DataFrame:
    """(vehicle_id, day, apn): parcels that a vehicle was at on a day, on whatever route."""
    return enriched.filter(F.col("apn").isNotNull()).select("vehicle_id", F.to_date("dt_local").alias("day"), "apn").distinct()


def parcel_status(parcels: DataFrame, enriched: DataFrame, targets: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Parcels of each target (vehicle_id, day, route_id) with served, status, fill_color and the expected vehicles."""
    slots = ["weekly1_vehicle", "weekly2_vehicle", "biweekly_vehicle"]
    rows = targets.join(route_members(parcels), F.col("route_id") == F.col("member_route")).drop("member_route")
    came = served_apns(enriched).select(F.col("vehicle_id"), F.col("day"), F.col("apn").alias("APN"), F.lit(True).alias("came"))
    rows = rows.join(came, ["vehicle_id", "day", "APN"], "left")
    if patterns is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in slots})
    else:
        rows = rows.join(patterns.select("APN", *slots).dropDuplicates(["APN"]), "APN", "left")
    served = F.coalesce("came", F.lit(False))
    status = F.when(served, "served").when(F.coalesce(*slots).isNotNull(), "missed").otherwise("unknown")
    fills = F.create_map(*[F.lit(x) for pair in STATUS_COLORS.items() for x in pair])
    out = rows.withColumn("served", served).withColumn("status", status).withColumn("fill_color", F.element_at(fills, F.col("status")))
    return out.withColumn("actual_vehicle", F.when(F.col("served"), F.col("vehicle_id"))).drop("came")


def parcels_geojson(status: DataFrame) -> DataFrame:
    """One FeatureCollection of parcels (segs) for each target."""
    properties = F.struct("APN", "route_ref", "route_org", "route_rec", "served", "status", "fill_color", "actual_vehicle", "weekly1_vehicle", "weekly2_vehicle", "biweekly_vehicle")
    feature = feature_json(geo.geometry_json(F.col("segs")), properties)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("APN", feature.alias("feature")))), lambda x: x["feature"])
    return status.groupBy("vehicle_id", "day", "route_id").agg(F.count("*").alias("n_parcels"), collection_json(ordered).alias("parcels_json"))


def active() -> Column:
    return ~F.col("segment_type").isin(*DEPOT_TYPES)


def shift_summary(timeline: DataFrame) -> DataFrame:
    """A vehicle-day's hours, loads, segments and miles on the road."""
    own = timeline.groupBy("vehicle_id", "day").agg(
        F.min("start_dt_local").alias("_from"), F.max("end_dt_local").alias("_to"), F.coalesce(F.max("load_number"), F.lit(0)).alias("n_loads"),
        F.count("*").alias("n_segments"), F.round(F.coalesce(F.sum(F.when(active(), F.col("miles"))), F.lit(0.0)), 2).alias("total_miles"),
    )
    start, end = F.date_format("_from", "HH:mm"), F.date_format("_to", "HH:mm")
    return own.select("vehicle_id", "day", start.alias("shift_start"), end.alias("shift_end"), F.concat(start, F.lit(" → "), end).alias("day_time_label"), "n_loads", "n_segments", "total_miles")


def load_tonnage(dumps: DataFrame, tickets: DataFrame, pad_minutes: int = PAD_MINUTES) -> DataFrame:
    """dumps (vehicle_id, start_dt_local, end_dt_local, ...) with tons: the sum of the vehicle's tickets near the dump.

    tickets: vehicle_id (or co_fleet_id), a tip time and tons under one of their usual names. The time is bucketed to
    windows of the pad, so that the join is on vehicle and bucket, and each pair is compared once.
    """
    names = {c.lower(): c for c in tickets.columns}
    pick = lambda options: next((names[o] for o in options if o in names), None)
    vehicle = pick(("vehicle_id", "co_fleet_id"))
    tip = pick(("tip_dt_local", "tip_dt", "datetime_local", "dt_local", "tip_time", "event_dt"))
    tons = pick(("net_tons", "tons", "net_weight_tons", "weight_tons"))
    if not (vehicle and tip and tons):
        return dumps.withColumn("tons", F.lit(None).cast("double"))
    pad = pad_minutes * 60 * 1_000_000
    own = tickets.select(F.col(vehicle).cast("string").alias("_vehicle"), wall_micros(F.col(tip)).alias("_tip"), F.col(tons).cast("double").alias("_tons")).withColumn("_slot", F.floor(F.col("_tip") / pad))
    keyed = dumps.withColumn("_from", wall_micros(F.col("start_dt_local")) - pad).withColumn("_to", wall_micros(F.col("end_dt_local")) + pad)
    # Outer: a load without a dump has no times and stays, without tons.
    slots = keyed.withColumn("_at", F.explode_outer(F.sequence(F.floor(F.col("_from") / pad), F.floor(F.col("_to") / pad))))
    near = (F.col("vehicle_id") == F.col("_vehicle")) & (F.col("_at") == F.col("_slot")) & F.col("_tip").between(F.col("_from"), F.col("_to"))
    summed = slots.join(own, near, "left").groupBy(*dumps.columns).agg(F.sum("_tons").alias("tons"))
    return summed.select(*dumps.columns, "tons")


def load_breakdown(timeline: DataFrame, tickets: DataFrame | None = None) -> DataFrame:
    """A vehicle-day's loads: hours, miles, duration, whether they reached a landfill, and tons of the first dump."""
    dump = F.col("segment_type") == "dump"
    at = F.when(dump, F.col("segment_id"))
    loads = timeline.filter(active() & F.col("load_number").isNotNull()).groupBy("vehicle_id", "day", "load_number").agg(
        F.min("start_dt_local").alias("_from"), F.max("end_dt_local").alias("_to"), F.round(F.sum("miles"), 2).alias("miles"),
        F.min_by("start_dt_local", at).alias("start_dt_local"), F.min_by("end_dt_local", at).alias("end_dt_local"),
    )
    seconds = (wall_micros(F.col("_to")) - wall_micros(F.col("_from"))) / F.lit(1e6)
    rows = loads.select(
        "vehicle_id", "day", "load_number", F.date_format("_from", "HH:mm").alias("start"), F.date_format("_to", "HH:mm").alias("end"), "miles", seconds.alias("duration_seconds"),
        F.when(F.col("start_dt_local").isNotNull(), "Landfill").alias("landfill"), "start_dt_local", "end_dt_local",
    )
    rows = rows.withColumn("tons", F.lit(None).cast("double")) if tickets is None else load_tonnage(rows, tickets)
    return rows.withColumn("tons", F.round("tons", 2)).drop("start_dt_local", "end_dt_local")

"""A vehicle-day's segments, load numbers and violations, in windows over (vehicle_id, day)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.config import EngineConfig
from curbflow.functions.geo import haversine_miles
from curbflow.functions.times import wall_micros
from curbflow.schemas import TIMELINE, VIOLATIONS, names

#: Loads above which a day is an overrun.
MOST_LOADS = 3
DEPOT_TYPES = ("depot_departure", "depot_arrival")


def phase(config: EngineConfig = EngineConfig()) -> Column:
    """Depot before landfill before collection (on a route and slow) before windshield."""
    slow = F.col("route_id").isNotNull() & (F.col("speed_mph") <= config.slow_mph_max)
    return F.when(F.col("at_depot"), "depot").when(F.col("in_landfill"), "landfill").when(slow, "collection").otherwise("windshield")


def phased(enriched: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """enriched with day, phase and segment_id: adjacent pings of one phase (and route, while collecting) share one."""
    day = Window.partitionBy("vehicle_id", "day").orderBy("dt_utc", "route_id", "apn", "lat", "lon")
    key = F.when(F.col("phase") == "collection", F.concat_ws("|", "phase", "route_id")).otherwise(F.col("phase"))
    out = enriched.withColumn("day", F.to_date("dt_local")).withColumn("phase", phase(config)).withColumn("_key", key)
    out = out.withColumn("_new", F.coalesce((F.col("_key") != F.lag("_key").over(day)).cast("int"), F.lit(1)))
    out = out.withColumn("segment_id", F.sum("_new").over(day.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    return out.drop("_key", "_new")


def load_numbers(segments: DataFrame) -> DataFrame:
    """segments (vehicle_id, day, segment_id, segment_type) with load_number, null at the depot.

    A load opens after a dump, if collection or another dump is still to come before the next depot stop.
    """
    day = Window.partitionBy("vehicle_id", "day").orderBy("segment_id")
    so_far = day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depot = F.col("segment_type").isin(*DEPOT_TYPES)
    out = segments.withColumn("_block", F.sum(depot.cast("int")).over(so_far))
    ahead = Window.partitionBy("vehicle_id", "day", "_block").orderBy("segment_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    work = F.max(F.col("segment_type").isin("collection", "dump")).over(ahead)
    out = out.withColumn("_opens", (F.coalesce(F.lag("segment_type").over(day) == "dump", F.lit(False)) & work & ~depot).cast("int"))
    return out.withColumn("load_number", F.when(~depot, F.sum("_opens").over(so_far) + 1).cast("int")).drop("_block", "_opens")


def build_timeline(enriched: DataFrame, config: EngineConfig = EngineConfig(), dedupe_pings: bool = False) -> DataFrame:
    """One row for each segment: TIMELINE's columns and day. dedupe_pings counts a ping once that met several parcels."""
    pings = enriched.dropDuplicates(["vehicle_id", "dt_utc", "lat", "lon", "route_id"]) if dedupe_pings else enriched
    order = ("dt_utc", "route_id", "apn", "lat", "lon")
    inside = Window.partitionBy("vehicle_id", "day", "segment_id").orderBy(*order)
    step = haversine_miles(F.lag("lat").over(inside), F.lag("lon").over(inside), F.col("lat"), F.col("lon"))
    at = F.struct(*order)
    rows = phased(pings, config).withColumn("_miles", F.coalesce(step, F.lit(0.0)))
    segments = rows.groupBy("vehicle_id", "day", "segment_id").agg(
        F.first("phase").alias("_phase"), F.min_by("route_id", at).alias("_route"), F.min_by("dt_local", at).alias("start_dt_local"),
        F.max_by("dt_local", at).alias("end_dt_local"), F.sum("_miles").alias("_sum"), F.count("*").alias("n_pings"),
    )
    kind = (
        F.when((F.col("_phase") == "depot") & (F.col("segment_id") == 1), "depot_departure").when(F.col("_phase") == "depot", "depot_arrival")
        .when(F.col("_phase") == "landfill", "dump").otherwise(F.col("_phase"))
    )
    seconds = (wall_micros(F.col("end_dt_local")) - wall_micros(F.col("start_dt_local"))) / F.lit(1e6)
    out = segments.withColumn("segment_type", kind).withColumn("duration_seconds", seconds).withColumn("miles", F.col("_sum") * (1.0 + config.mileage_inflation_pct))
    out = load_numbers(out.withColumn("route_id", F.when(F.col("_phase") == "collection", F.col("_route"))))
    return out.select(*names(TIMELINE), "day")


def flag_violations(timeline: DataFrame) -> DataFrame:
    """Red flags of every vehicle-day: VIOLATIONS' columns and day. Days without loads have no overrun."""
    keys = ["vehicle_id", "day"]
    active = ~F.col("segment_type").isin(*DEPOT_TYPES)
    segment = F.when(active, F.col("segment_id"))
    days = timeline.groupBy(*keys).agg(
        F.min_by("segment_type", segment).alias("first"), F.min(segment).alias("first_id"), F.max_by("segment_type", segment).alias("last"),
        F.max(segment).alias("last_id"), F.coalesce(F.max("load_number"), F.lit(0)).alias("loads"),
    )
    of = F.sort_array(F.collect_list(F.when(F.col("route_id").isNotNull(), F.struct("segment_id", "route_id"))))
    loads = timeline.filter((F.col("segment_type") == "collection") & F.col("load_number").isNotNull()).groupBy(*keys, "load_number")
    switched = loads.agg(F.min("segment_id").alias("at"), of.alias("of"), F.countDistinct("route_id").alias("n")).filter("n > 1")

    def flag(rows: DataFrame, at: Column, kind: str, severity: str, said: Column) -> DataFrame:
        return rows.select("vehicle_id", at.cast("int").alias("segment_id"), F.lit(kind).alias("violation_type"), F.lit(severity).alias("severity"), said.alias("description"), "day")

    route_list = F.array_join(F.transform("of", lambda s: s["route_id"]), ", ")
    found = [
        flag(days.filter("first = 'dump'"), F.col("first_id"), "loaded_depot_departure", "high", F.lit("First activity is a dump: the truck left the depot loaded.")),
        flag(days.filter("last = 'collection'"), F.col("last_id"), "loaded_depot_return", "high", F.lit("Last activity is a collection: the truck came back loaded.")),
        flag(days.filter(F.col("loads") > MOST_LOADS), F.lit(-1), "overrun_loads", "medium", F.format_string("%d loads in a day, more than %d.", F.col("loads"), F.lit(MOST_LOADS))),
        flag(switched, F.col("at"), "mid_load_route_switch", "low", F.concat(F.lit("Load "), F.col("load_number").cast("string"), F.lit(" served routes "), route_list, F.lit("."))),
    ]
    return reduce(DataFrame.unionByName, found).select(*names(VIOLATIONS), "day")

"""Vehicles by their pings on routes and days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_PINGS, TOP_N = 5, 5


def rank_vehicles(enriched: DataFrame, route_id: str | None = None, day: str | None = None, min_pings: int = MIN_PINGS) -> DataFrame:
    """Vehicles with enough pings on each route and day (or on those given)."""
    rows = enriched.filter(F.col("route_id").isNotNull()).withColumn("day", F.date_format("dt_local", "yyyy-MM-dd"))
    if route_id is not None:
        rows = rows.filter(F.col("route_id") == route_id)
    if day is not None:
        rows = rows.filter(F.col("day") == day)
    counted = rows.groupBy("route_id", "day", "vehicle_id").agg(F.count("*").alias("n_pings"), F.min("dt_local").alias("first_dt_local"), F.max("dt_local").alias("last_dt_local"))
    return counted.filter(F.col("n_pings") >= min_pings).orderBy("route_id", "day", F.desc("n_pings"), "vehicle_id")


def top_vehicle_routes(enriched: DataFrame, day: str, top_n: int = TOP_N, min_pings: int = MIN_PINGS) -> DataFrame:
    """Routes with enough pings of the day's vehicles that have most pings."""
    rows = enriched.filter(F.to_date("dt_local") == F.lit(day).cast("date"))
    top = rows.groupBy("vehicle_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "vehicle_id").limit(top_n)
    routes = rows.filter(F.col("route_id").isNotNull()).join(F.broadcast(top.select("vehicle_id")), "vehicle_id")
    return routes.groupBy("vehicle_id", "route_id").agg(F.count("*").alias("n_pings")).filter(F.col("n_pings") >= min_pings)

"""Indexes of vehicle-days: what each holds, and which routes' boxes it meets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.functions.geo import boxes_meet
from curbflow.operators.tickets import exists
from curbflow.schemas import VEHICLE_DAYS, names


def summarise(pings: DataFrame, file_path: str | None = None) -> DataFrame:
    """VEHICLE_DAYS' columns for every vehicle and local day. file_path: column that names the file of a ping."""
    path = F.min(F.col(file_path)) if file_path else F.lit(None).cast("string")
    rows = pings.filter(F.col("dt_local").isNotNull()).groupBy(F.date_format("dt_local", "yyyy-MM-dd").alias("day"), "vehicle_id")
    return rows.agg(
        F.count("*").alias("rows"), F.min("dt_local").alias("min_local"), F.max("dt_local").alias("max_local"), F.min("lat").alias("lat_min"),
        F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), path.alias("file_path"),
    ).select(*names(VEHICLE_DAYS))


def summarise_new(pings: DataFrame, known_days: DataFrame, overwrite: bool = False, file_path: str | None = None) -> DataFrame:
    """Summaries of the days that known_days (day) doesn't have, or of all."""
    rows = pings if overwrite else pings.withColumn("day", F.date_format("dt_local", "yyyy-MM-dd")).join(known_days.select("day").distinct(), "day", "left_anti")
    return summarise(rows, file_path)


def load_day_indexes(spark: SparkSession, path: str) -> DataFrame:
    """Stored summaries of all days; FileNotFoundError if there are none."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no vehicle-day indexes under {path}")
    rows = spark.read.schema(VEHICLE_DAYS).parquet(path).select(*names(VEHICLE_DAYS))
    if rows.isEmpty():
        raise FileNotFoundError(f"no vehicle-day indexes under {path}")
    return rows


def store_day_indexes(days: DataFrame, path: str) -> None:
    """Writes summaries by day; days that are stored already are replaced."""
    days.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def master_index(days: DataFrame, boxes: DataFrame, cell: float = 0.05) -> DataFrame:
    """Vehicle-days with every route whose box they meet (touching counts).

    Both sides are listed by the grid cells of their boxes; a pair is taken in the first cell that they share, so the
    join is on equal cells and makes every pair once.
    """
    days_box = tuple(F.col(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max"))
    route_box = tuple(F.col(c) for c in ("rte_min_lon", "rte_min_lat", "rte_max_lon", "rte_max_lat"))

    def cells(df: DataFrame, box, x: str, y: str) -> DataFrame:
        across = F.sequence(F.floor(box[0] / cell), F.floor(box[2] / cell))
        down = F.sequence(F.floor(box[1] / cell), F.floor(box[3] / cell))
        return df.withColumn(x, F.explode(across)).withColumn(y, F.explode(down))

    left, right = cells(days, days_box, "_x", "_y"), cells(boxes, route_box, "_rx", "_ry")
    first = (F.col("_x") == F.floor(F.greatest(days_box[0], route_box[0]) / cell)) & (F.col("_y") == F.floor(F.greatest(days_box[1], route_box[1]) / cell))
    met = left.join(right, (left["_x"] == right["_rx"]) & (left["_y"] == right["_ry"]) & boxes_meet(days_box, route_box) & first)
    return met.drop("_x", "_y", "_rx", "_ry")


def files_for_route(index: DataFrame, route_id: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct files of a route's vehicle-days, optionally between two days."""
    rows = index.filter(F.col("route_id") == route_id)
    if start is not None:
        rows = rows.filter(F.col("day") >= start)
    if end is not None:
        rows = rows.filter(F.col("day") <= end)
    return rows.select("file_path").distinct()

"""Pings as a stream: deduplicated by watermark, enriched against static layers, stored by vehicle-day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.config import EngineConfig
from curbflow.functions.times import stop_bin
from curbflow.operators import spatial
from curbflow.schemas import PINGS


def read_pings(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PINGS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicate(pings: DataFrame, late: str = "2 hours") -> DataFrame:
    """One ping for each vehicle and instant, among those that are not later than `late`."""
    return pings.withWatermark("dt_utc", late).dropDuplicatesWithinWatermark(["vehicle_id", "dt_utc"])


def stop_counts(pings: DataFrame, minutes: int = 15, late: str | None = "2 hours") -> DataFrame:
    """Pings of every vehicle and stop bin, emitted once the watermark has passed. late: None if pings have one already."""
    marked = pings.withWatermark("dt_utc", late) if late else pings
    span = F.window("dt_utc", f"{minutes} minutes", startTime=f"{minutes * 30} seconds")
    return marked.groupBy(span, "vehicle_id").agg(F.count("*").alias("hits"), F.min(stop_bin(F.col("dt_local"), minutes)).alias("bin_id"))


def enrich_stream(pings: DataFrame, routes: DataFrame, parcels: DataFrame, landfills: DataFrame, depot: DataFrame, out_path: str, checkpoint: str, config: EngineConfig = EngineConfig(), once: bool = False):
    """Starts the query that enriches each micro-batch and rewrites the vehicle-days it touches.

    A vehicle-day is read back and merged, so that a batch that is run again, or late pings, leave no duplicates.
    """
    from curbflow.operators.tickets import exists

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = spatial.enrich(batch, routes, parcels, landfills, depot, config).withColumn("day", F.date_format("dt_local", "yyyy-MM-dd"))
        # Joined once: the batch is written beside the store, and both uses below read it from there.
        joined = f"{out_path}_joined"
        new.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(joined)
        new = spark.read.schema(new.schema).parquet(joined)
        if exists(spark, out_path):
            touched = new.select("day", "vehicle_id").distinct()
            had = spark.read.schema(new.schema).parquet(out_path).join(touched, ["day", "vehicle_id"], "left_semi").select(new.columns)
            new = had.unionByName(new).dropDuplicates(["vehicle_id", "dt_utc", "route_id", "apn"])
        # The merged days are read from the folder that they replace: they are written beside it first.
        beside = f"{out_path}_batch"
        new.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(beside)
        new = spark.read.schema(new.schema).parquet(beside)
        new.repartition("day", "vehicle_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "vehicle_id").parquet(out_path)

    writer = pings.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

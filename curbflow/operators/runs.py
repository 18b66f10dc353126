"""End-to-end runs that read and write tables: enrichment, segments, patterns and ticket ingest."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.config import EngineConfig, PatternConfig
from curbflow.functions.times import compute_window, window_label
from curbflow.operators import patterns, spatial, tickets, timeline
from curbflow.schemas import PATTERNS
from curbflow.sources.sheets import read_csv, read_xlsx


def _need(spark: SparkSession, path: str) -> str:
    if not tickets.exists(spark, path):
        raise FileNotFoundError(path)
    return path


def _write_days(df: DataFrame, path: str) -> None:
    """Overwrites the partitions (day, vehicle_id) that df has, with each vehicle-day in order."""
    rows = df.repartition("day", "vehicle_id").sortWithinPartitions("day", "vehicle_id", *[c for c in ("dt_utc", "segment_id") if c in df.columns])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "vehicle_id").parquet(path)


def enrich_days(spark: SparkSession, pings_path: str, out_path: str, routes: DataFrame, parcels: DataFrame, landfills: DataFrame, depot: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Enriches all cached vehicle-days in one job and returns the table."""
    pings = spark.read.parquet(_need(spark, pings_path)).withColumn("vehicle_id", F.col("vehicle_id").cast("string"))
    out = spatial.enrich(pings.drop("day"), routes, parcels, landfills, depot, config)
    _write_days(out.withColumn("day", F.date_format("dt_local", "yyyy-MM-dd")), out_path)
    return spark.read.parquet(out_path)


def build_all_segments(spark: SparkSession, enriched_path: str, out_path: str, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """Writes timelines and violations of all vehicle-days; returns both tables."""
    enriched = spark.read.parquet(_need(spark, enriched_path)).drop("day").withColumn("vehicle_id", F.col("vehicle_id").cast("string"))
    _write_days(timeline.build_timeline(enriched, config), f"{out_path}/timeline")
    own = spark.read.parquet(f"{out_path}/timeline").withColumn("vehicle_id", F.col("vehicle_id").cast("string"))
    _write_days(timeline.flag_violations(own), f"{out_path}/violations")
    return own, spark.read.schema(timeline.VIOLATIONS + ", day date").parquet(f"{out_path}/violations")


def run_patterns(spark: SparkSession, enriched_path: str, parcels: DataFrame, out_path: str, period: str = "past_year", start=None, end=None, config: PatternConfig = PatternConfig(), refresh: bool = False, include_unrouted: bool = False) -> DataFrame:
    """Detects patterns for all routes of a window and writes them by route; returns the manifest.

    A route whose patterns are newer than all enriched pings is skipped, unless refresh is given.
    """
    first, last = compute_window(period, start, end)
    label = window_label(first, last)
    target = f"{out_path}/window={label}"
    enriched = spark.read.parquet(_need(spark, enriched_path))
    changed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(enriched_path).agg(F.max("modificationTime")).first()[0]
    routes = parcels.filter(F.col("route_ref").isNotNull() & (F.trim("route_ref") != ""))
    own = parcels if include_unrouted else routes
    had = None
    if tickets.exists(spark, f"{target}/by_route") and not refresh:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{target}/by_route")
        fresh = files.select(F.regexp_extract("path", r"route_key=([^/]*)/", 1).alias("route_key"), "modificationTime").groupBy("route_key").agg(F.min("modificationTime").alias("at")).filter(F.col("at") > F.lit(changed))
        had = fresh.select("route_key")
    key = F.coalesce("route_ref", F.lit("_none"))
    keyed = own.withColumn("route_key", key)
    todo = keyed if had is None else keyed.join(had, "route_key", "left_anti")
    found = patterns.detect_patterns(enriched, todo.drop("route_key"), first, last, config)
    found.withColumn("route_key", key).repartition("route_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("route_key").parquet(f"{target}/by_route")
    ran = todo.select("route_key").distinct().withColumn("ran", F.lit(True))
    manifest = keyed.groupBy("route_key").agg(F.count("*").alias("n_parcels")).join(ran, "route_key", "left").select(
        F.col("route_key").alias("route_id"), F.concat(F.lit(f"{target}/by_route/route_key="), F.col("route_key")).alias("out_path"), "n_parcels", F.coalesce("ran", F.lit(False)).alias("ran"),
        F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).alias("ran_at_utc"), F.lit(first).alias("window_start"), F.lit(last).alias("window_end"), F.lit(hashlib.sha1(repr(config).encode()).hexdigest()).alias("config_hash"),
    )
    manifest.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{target}/manifest")
    return spark.read.parquet(f"{target}/manifest")


def load_patterns(spark: SparkSession, out_path: str, label: str, routes: list[str] | None = None) -> DataFrame:
    """Patterns of a window, of all routes or of some."""
    rows = spark.read.parquet(_need(spark, f"{out_path}/window={label}/by_route"))
    if routes is not None:
        rows = rows.filter(F.col("route_key").cast("string").isin(routes))
    return rows.select(*PATTERNS)


def run_ingest(spark: SparkSession, data_path: str, out_path: str) -> DataFrame:
    """Ingests all SCALE and FIELD exports of a folder; returns the registry.

    A file that cannot be read is recorded as FAIL and the rest go on. Files are few and small; each is one Spark read,
    and the tickets of a source are merged in one job.
    """
    listing = spark.read.format("binaryFile").load(_need(spark, data_path)).select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified_time"))
    files = tickets.registry(listing).collect()
    rows, batches = [], {"SCALE": [], "FIELD": []}
    for f in files:
        try:
            raw = read_csv(spark, f["file_path"]) if f["file_name"].lower().endswith(".csv") else read_xlsx(spark, f["file_path"])
            clean = tickets.add_keys_scale(tickets.clean_scale(raw, f["file_name"])) if f["source"] == "SCALE" else tickets.add_keys_field(tickets.clean_field(raw, f["file_name"]))
            status, read, kept, notes = "OK", raw.count(), clean.count(), ""
            batches[f["source"]].append(clean)
        except Exception as error:  # one bad export must not stop the others
            status, read, kept, notes = "FAIL", 0, 0, str(error).splitlines()[0][:200]
        rows.append((f["file_path"], f["file_name"], f["source"], f["file_date"], f["modified_time"], status, read, kept, notes))
    for source, own in batches.items():
        if own:
            batch = own[0]
            for other in own[1:]:
                batch = batch.unionByName(other, allowMissingColumns=True)
            tickets.upsert(batch.drop("source"), f"{out_path}/tickets", source)
    registry = spark.createDataFrame(rows, "file_path string, file_name string, source string, file_date date, modified_time timestamp, status string, rows_read long, rows_kept long, notes string")
    registry.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out_path}/registry")
    return spark.read.parquet(f"{out_path}/registry")

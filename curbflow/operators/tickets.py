"""Weighbridge tickets: cleaning, stable keys, quality figures and the idempotent store."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow.functions import tickets as rules
from curbflow.functions.ids import OUR_PREFIXES

# Headers of the two kinds of exports.
SCALE_KEEP = ["ROUTE#", "TRANSACTION #", "COLL_DT", "RPT_DT", "LD_DT_TM", "CO_FLEET_ID", "CREW_CNT", "TONS", "TRUCK", "BLUE_ORANGE_WEEK_CD", "DAY_OF_WK", "MATL_TYP_CD", "MATL_TYP_DESC", "CREW NAME", "NBR_LOADS", "DUMP LOCATION"]
FIELD_KEEP = ["TRAN_NUM", "LD_DT_TM", "RPT_DT", "MATL_TYP_CD", "MATL_TYP_DESC", "LANDFILL_DEST_DESC"]
FLEET_HEADERS = ["CO_FLEET_ID", "TRUCK"]
FIELD_TONS_HEADERS = ["TONS", "L.NET_WGT_QTY/2000"]


def raw_name(header: str) -> str:
    """Name here of an export's column: raw_ and its words, so that no two differ in case only."""
    return "raw_" + "_".join(filter(None, "".join(c if c.isalnum() else " " for c in header.lower()).split()))


def _kept(df: DataFrame, wanted: list[str]) -> dict:
    found = {raw_name(w): rules.resolve_column(df.columns, [w]) for w in wanted}
    return {k: F.col(f"`{v}`").cast("string") for k, v in found.items() if v is not None}


def _field(df: DataFrame, wanted: list[str]):
    header = rules.resolve_column(df.columns, wanted)
    return F.lit(None).cast("string") if header is None else F.col(f"`{header}`").cast("string")


def _common(df: DataFrame, source: str, file_name: str, kept: dict, tons, material):
    name = F.lit(file_name)
    return df.select(
        *[c.alias(k) for k, c in kept.items()], F.lit(source).alias("source"), name.alias("file_name"), rules.file_date(name).alias("file_date"),
        rules.moment(_field(df, ["RPT_DT"])).alias("rpt_dt"), rules.moment(_field(df, ["LD_DT_TM"])).alias("ld_dt_tm"),
        rules.fleet_id(_field(df, FLEET_HEADERS)).alias("co_fleet_id"), rules.number(tons).alias("tons"), material.alias("matl_raw"),
    )


def clean_scale(df: DataFrame, file_name: str) -> DataFrame:
    """A scale export, of whatever known columns it has."""
    kept = _kept(df, SCALE_KEEP)
    if "raw_route" in kept:
        kept["raw_route"] = F.trim(kept["raw_route"])
    out = _common(df, "SCALE", file_name, kept, _field(df, ["TONS"]), _field(df, ["MATL_TYP_DESC"]))
    return out.withColumn("matl_norm", rules.material_scale(F.col("matl_raw")))


def clean_field(df: DataFrame, file_name: str, prefixes: tuple[str, ...] = OUR_PREFIXES) -> DataFrame:
    """A field export: tickets of one's own fleet, without demolition."""
    out = _common(df, "FIELD", file_name, _kept(df, FIELD_KEEP), _field(df, FIELD_TONS_HEADERS), _field(df, ["MATL_TYP_DESC"]))
    own = out.filter(rules.starts_with_any(F.col("co_fleet_id"), prefixes)).filter(~rules.is_demo(F.col("matl_raw")))
    return own.withColumn("matl_norm", rules.material_field(F.col("matl_raw")))


def _or_empty(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit("")


def add_keys_scale(df: DataFrame) -> DataFrame:
    event = rules.minute(F.col("rpt_dt"))
    key = rules.key_scale(F.col("rpt_dt"), F.col("co_fleet_id"), _or_empty(df, "raw_route"), _or_empty(df, "raw_nbr_loads"), _or_empty(df, "raw_dump_location"), F.col("matl_norm"), F.col("tons"))
    return df.withColumn("event_dt", event).withColumn("year", F.year(event)).withColumn("record_key", key)


def add_keys_field(df: DataFrame) -> DataFrame:
    event = rules.minute(F.col("ld_dt_tm"))
    transaction = F.col("raw_tran_num") if "raw_tran_num" in df.columns else None
    key = rules.key_field(F.col("ld_dt_tm"), F.col("co_fleet_id"), _or_empty(df, "raw_landfill_dest_desc"), F.col("matl_norm"), F.col("tons"), transaction)
    return df.withColumn("event_dt", event).withColumn("year", F.year(event)).withColumn("record_key", key)


def dedupe(df: DataFrame) -> DataFrame:
    """One row for each record_key: that of the first file by date (undated last) and name.

    The row is the smallest by these and then by its other columns, kept by a partial aggregate, not by sorting all rows.
    """
    dated = [F.col("file_date").isNull().alias("_undated"), F.col("file_date").alias("_dated"), F.col("file_name").alias("_named")] if "file_date" in df.columns else []
    rest = [F.col(c) for c in df.columns if c not in ("record_key", "file_date", "file_name")]
    first = F.min_by(F.struct(*df.columns), F.struct(*dated, *rest))
    return df.groupBy("record_key").agg(first.alias("_row")).select("_row.*")


def new_rows(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows of a batch, once each and with a year, whose key the store doesn't have in that year.

    A key is made from the time that also gives the year, so a stored row of another year has another key.
    """
    for name in ("record_key", "year"):
        if name not in batch.columns:
            raise ValueError(f"the batch has no {name}")
    own = dedupe(batch.filter(F.col("year").isNotNull()))
    return own if stored is None else own.join(stored.select("record_key", "year").distinct(), ["record_key", "year"], "left_anti").select(batch.columns)


def upsert_summary(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows of each year that the batch touches: existing, added and total; and, under a null year, those dropped."""
    return _summary(batch, stored, new_rows(batch, stored))


def _summary(batch: DataFrame, stored: DataFrame | None, new: DataFrame) -> DataFrame:
    added = new.groupBy("year").agg(F.count("*").alias("added"))
    years = batch.filter(F.col("year").isNotNull()).select("year").distinct()
    had = years.limit(0).withColumn("existing", F.lit(0).cast("bigint")) if stored is None else stored.groupBy("year").agg(F.count("*").alias("existing"))
    out = years.join(had, "year", "left").join(added, "year", "left").fillna(0, ["existing", "added"]).withColumn("total", F.col("existing") + F.col("added"))
    lost = batch.filter(F.col("year").isNull()).agg(F.count("*").alias("n")).filter("n > 0")
    return out.withColumn("dropped", F.lit(0).cast("bigint")).unionByName(lost.select(F.lit(None).cast("int").alias("year"), *[F.lit(0).cast("bigint").alias(c) for c in ("existing", "added", "total")], F.col("n").alias("dropped")))


def upsert(batch: DataFrame, path: str, source: str) -> DataFrame:
    """Adds a batch's new rows to the store (partitions of source and year) and returns the summary, of before the write.

    Only new rows are appended, so a second run of a batch adds none. Of the store, only the partitions of the batch's
    years are read, and only their keys. The new rows are worked out once and written beside the store first.
    """
    spark = batch.sparkSession
    years = [r["year"] for r in batch.filter(F.col("year").isNotNull()).select("year").distinct().orderBy("year").collect()]
    stored = None
    if exists(spark, path):
        stored = spark.read.parquet(path).filter((F.col("source") == source) & F.col("year").isin(years))
    beside = f"{path}/_new-{uuid4().hex}"
    new_rows(batch, stored).withColumn("source", F.lit(source)).write.parquet(beside)
    new = spark.read.schema(batch.withColumn("source", F.lit(source)).schema).parquet(beside)
    rows = _summary(batch, stored, new).collect()  # a row for each year
    new.write.mode("append").partitionBy("source", "year").parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return spark.createDataFrame(rows, "year int, existing long, added long, total long, dropped long")


def exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def quality(df: DataFrame, rows_raw: int | None = None) -> DataFrame:
    """One row of figures on a cleaned export: rows, shares of missing values, negative tons, up to fifty raw materials."""
    missing = {f"null_{k}_pct": F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)) for k, c in (("rpt_dt", "rpt_dt"), ("fleet", "co_fleet_id"), ("tons", "tons"))}
    return df.agg(
        F.lit(rows_raw).cast("bigint").alias("rows_raw"), F.count("*").alias("rows_out"), *[c.alias(k) for k, c in missing.items()],
        F.count_if(F.col("tons") < 0).alias("neg_tons_cnt"), F.slice(F.array_sort(F.collect_set("matl_raw")), 1, 50).alias("matl_raw_values"),
    )


def registry(files: DataFrame) -> DataFrame:
    """files (file_path, modified_time) with file_name, source and file_date, ordered; other files go."""
    name = F.element_at(F.split("file_path", "/"), -1)
    out = files.withColumn("file_name", name).withColumn("source", rules.source_of(name)).withColumn("file_date", rules.file_date(name))
    return out.filter(F.col("source").isNotNull()).orderBy("source", F.col("file_date").asc_nulls_last(), "file_name")


def latest(files: DataFrame) -> DataFrame:
    """The last file of each source by date, time of change and name; an undated file counts as last."""
    order = Window.partitionBy("source").orderBy(F.col("file_date").desc_nulls_first(), F.desc("modified_time"), F.desc("file_name"))
    return files.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")

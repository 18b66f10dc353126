"""Service sites: the raw export becomes a clean table with route identifiers, and a file for every valid route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions import sites as rules
from curbflow.operators.layers import need

# The export's headers and their names here.
COLUMN_MAP = {
    "Site: Site ID": "site_id",
    "Site Group": "site_group",
    "Status": "status",
    "Assessor's Parcel Number": "apn",
    "ADA": "ada",
    "Key Stop Indicator": "key_stop",
    "X-Coordinate": "x",
    "Y-Coordinate": "y",
    "Number Of Units On Parcel": "units",
    "Site Address": "site_address",
    "Refuse Route": "ref_route_raw",
    "Refuse Day Of Week From GIS": "ref_day_raw",
    "Recycle Route": "rec_route_raw",
    "Recycle Day Of Week From GIS": "rec_day_raw",
    "Recycle Week": "rec_week_raw",
    "Organics Route": "org_route_raw",
    "Organics Day Of Week From GIS": "org_day_raw",
}
COMMODITIES = ("ref", "rec", "org")


def clean_parts(df: DataFrame) -> DataFrame:
    """df with route4, day and week parts of the raw columns."""
    parts = {f"{k}_route4": rules.route4(F.col(f"{k}_route_raw")) for k in COMMODITIES}
    parts |= {f"{k}_day": rules.day(F.col(f"{k}_day_raw")) for k in COMMODITIES}
    return df.withColumns(parts | {"rec_week": rules.week(F.col("rec_week_raw"))})


def route_ids(df: DataFrame) -> DataFrame:
    """df with route_id_ref, route_id_rec and route_id_org; null where a part is missing."""
    parts = {"ref": ("ref_route4", "ref_day"), "rec": ("rec_route4", "rec_day", "rec_week"), "org": ("org_route4", "org_day")}
    return df.withColumns({f"route_id_{k}": rules.route_id(*map(F.col, v)) for k, v in parts.items()})


def validity(df: DataFrame) -> DataFrame:
    """df with is_ref, is_rec and is_org."""
    c = F.col
    return df.withColumns({"is_ref": rules.valid_ref(c("ref_route4"), c("ref_day")), "is_rec": rules.valid_rec(c("rec_route4"), c("rec_day"), c("rec_week")), "is_org": rules.valid_org(c("org_route4"), c("org_day"))})


def clean_sites(raw: DataFrame, keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """The export's known columns under their names here, parts and route identifiers, within the service region.

    keep_cols: other columns of the export to carry along, such as Longitude and Latitude.
    """
    need(raw, list(COLUMN_MAP), ValueError)
    renamed = raw.select(*[F.col(f"`{k}`").alias(v) for k, v in COLUMN_MAP.items()], *keep_cols)
    return in_region(route_ids(clean_parts(renamed)))


def in_region(df: DataFrame) -> DataFrame:
    """Rows whose coordinates are numbers within the region; the coordinates become numbers."""
    out = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in ("x", "y")})
    return out.filter(rules.in_region(F.col("x"), F.col("y")))


def sites_to_geo(df: DataFrame, lon: str = "Longitude", lat: str = "Latitude") -> DataFrame:
    """Rows with valid coordinates in degrees, as lon and lat."""
    need(df, [lon, lat])
    good = df.filter(rules.valid_lon_lat(F.col(lon), F.col(lat)))
    return good.withColumns({"lon": F.col(lon).try_cast("double"), "lat": F.col(lat).try_cast("double")})


def by_route(df: DataFrame, commodity: str) -> DataFrame:
    """(route_id, site columns) of the sites that are valid for a commodity."""
    return validity(df).filter(f"is_{commodity}").withColumn("route_id", F.col(f"route_id_{commodity}")).filter(F.col("route_id").isNotNull())


def write_routes(df: DataFrame, path: str, commodity: str) -> int:
    """Rewrites a folder with one partition for each valid route; returns how many there are."""
    own = by_route(df, commodity)
    own.repartition("route_id").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("route_id").parquet(path)
    return own.select("route_id").distinct().count()

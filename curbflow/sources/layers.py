"""Vector layers: GeoParquet through Spark's reader; GeoJSON, GeoPackages and ESRI shapefiles through binaryFile.

A layer comes with its coordinate reference system, which loaders need and convert from.
"""

from __future__ import annotations

import json
import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.config import FacilitiesConfig
from curbflow.functions.geo import SEGMENT
from curbflow.operators.layers import build_parcels, clean_polygons, need, reproject, route_boxes, route_index, split_facilities
from curbflow.operators.tickets import exists
from curbflow.sources.wkb import segments_of, with_segments

# Sizes in bytes of the envelopes that a GeoPackage geometry can begin with.
GPKG_ENVELOPES = (0, 32, 48, 48, 64)


def _there(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A FeatureCollection's polygons: one row for each feature, properties as text columns, and segs."""
    raw = spark.read.text(_there(spark, path), wholetext=True)
    point = "array<array<array<double>>>"
    base = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    kind = F.get_json_object("f", "$.geometry.type")
    text = F.get_json_object("f", "$.geometry.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(text, point))).when(kind == "MultiPolygon", F.from_json(text, f"array<{point}>"))
    rings = F.flatten(polygons)

    def sides(ring):
        ends = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
        starts = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))

    rows = base.select(F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("properties"), F.flatten(F.transform(rings, sides)).alias("segs"))
    names = [r["k"] for r in rows.select(F.explode(F.map_keys("properties")).alias("k")).distinct().orderBy("k").collect()]
    return rows.select(*[F.try_element_at("properties", F.lit(n)).alias(n) for n in names], "segs")


def shapes(data: bytes) -> list[list[dict]]:
    """Segments of every polygon record of a .shp file."""
    out, at = [], 100
    while at + 12 <= len(data):
        size = 2 * struct.unpack_from(">i", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        if struct.unpack_from("<i", body, 0)[0] not in (5, 15, 25):
            out.append([])
            continue
        n_parts, n_points = struct.unpack_from("<2i", body, 36)
        starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n_points]
        flat = struct.unpack_from(f"<{2 * n_points}d", body, 44 + 4 * n_parts)
        points = list(zip(flat[::2], flat[1::2], strict=True))
        out.append([{"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1]} for i, j in zip(starts, starts[1:], strict=False) for a, b in zip(points[i:j], points[i + 1 : j], strict=False)])
    return out


def attributes(data: bytes) -> list[dict[str, str]]:
    """Rows of a .dbf file, as text."""
    count, start, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    rows = []
    for k in range(count):
        line, at, row = data[start + k * size : start + (k + 1) * size], 1, {}
        for name, width in fields:
            row[name] = line[at : at + width].decode("utf-8", "replace").strip()
            at += width
        rows.append(row)
    return rows


def _from_properties(rows: DataFrame) -> DataFrame:
    """Rows of (properties map, segs) with a text column for each property."""
    names = [r["k"] for r in rows.select(F.explode(F.map_keys("properties")).alias("k")).distinct().orderBy("k").collect()]
    return rows.select(*[F.try_element_at("properties", F.lit(n)).alias(n) for n in names], "segs")


def _parsed(files: DataFrame, parse) -> DataFrame:
    """Layer of files (path, content) that make one layer together: parse({suffix: bytes}) gives pairs of attributes and segments.

    The files are brought together in one task by their common stem; layers are small and prepared once.
    """

    def run(key, frame):
        import pandas as pd

        contents = {path.rsplit(".", 1)[-1].lower(): bytes(data) for path, data in zip(frame["path"], frame["content"], strict=True)}
        return pd.DataFrame([{"properties": json.dumps(a), "segs": s} for a, s in parse(contents)], columns=["properties", "segs"])

    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    rows = files.groupBy(stem.alias("stem")).applyInPandas(run, f"properties string, segs array<{SEGMENT}>")
    return _from_properties(rows.withColumn("properties", F.from_json("properties", "map<string,string>")))


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """A shapefile's polygons with its attribute table."""
    stem = path.removesuffix(".shp")
    files = spark.read.format("binaryFile").load([_there(spark, stem + s) for s in (".shp", ".dbf")]).select("path", "content")
    return _parsed(files, lambda c: zip(attributes(c["dbf"]), shapes(c["shp"]), strict=False))


def gpkg_table(data: bytes) -> tuple[list[tuple[dict, list[dict] | None]], str | None]:
    """Rows (attributes as text, segments) of a GeoPackage's first feature table, and its reference system."""
    with sqlite3.connect(":memory:") as db:
        db.deserialize(data)
        name, column, srs = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY table_name LIMIT 1").fetchone()
        authority = db.execute("SELECT organization, organization_coordsys_id FROM gpkg_spatial_ref_sys WHERE srs_id = ? AND srs_id > 0", (srs,)).fetchone()
        cursor = db.execute('SELECT * FROM "{}"'.format(name.replace('"', '""')))
        names = [d[0] for d in cursor.description]
        rows = []
        for row in cursor:
            own = dict(zip(names, row, strict=True))
            blob = own.pop(column)
            segs = None
            if blob is not None and not blob[3] & 16:  # the flag of an empty geometry
                segs = segments_of(blob[8 + GPKG_ENVELOPES[blob[3] >> 1 & 7] :])
            rows.append(({k: None if v is None else str(v) for k, v in own.items()}, segs))
        return rows, f"{authority[0].upper()}:{authority[1]}" if authority else None


def read_gpkg(spark: SparkSession, path: str) -> DataFrame:
    """The polygons of a GeoPackage's first feature table, with its columns as text."""
    files = spark.read.format("binaryFile").load(_there(spark, path)).select("path", "content")
    return _parsed(files, lambda c: gpkg_table(c["gpkg"])[0])


def _text(spark: SparkSession, path: str) -> str | None:
    return spark.read.text(path, wholetext=True).first()["value"] if exists(spark, path) else None


def _parquet_crs(spark: SparkSession, path: str) -> str | None:
    """From the footer of one of the files: an authority's code; EPSG:4326 where GeoParquet metadata names none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = spark.read.parquet(path).inputFiles()
    if not files:
        return None
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])), conf))
    try:
        geo = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    if geo is None:
        return None
    column = json.loads(geo)["columns"][json.loads(geo)["primary_column"]]
    if "crs" not in column:
        return "EPSG:4326"
    found = (column["crs"] or {}).get("id")
    return None if not found else "EPSG:4326" if str(found["code"]).upper() == "CRS84" else f"{found['authority']}:{found['code']}"


def layer_crs(spark: SparkSession, path: str) -> str | None:
    """A layer's coordinate reference system as authority and code; None if the file does not tell."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    _there(spark, path)
    if suffix == "parquet":
        return _parquet_crs(spark, path)
    if suffix == "gpkg":
        def run(batches):
            for batch in batches:
                batch["crs"] = [gpkg_table(bytes(data))[1] for data in batch["content"]]
                yield batch[["crs"]]

        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "crs string").first()["crs"]
    if suffix == "shp":
        wkt = _text(spark, path.removesuffix(".shp") + ".prj")
        if wkt is None:
            return None
        flat = wkt.replace(" ", "_").upper()
        return "EPSG:2230" if "CALIFORNIA" in flat and ("ZONE_6" in flat or "_VI_" in flat) and "FOOT" in flat.upper() else "EPSG:4326" if flat.startswith(("GEOGCS", "GEOGCRS")) and "WGS" in flat and "84" in flat else None
    named = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.crs.properties.name").alias("n")).first()["n"]
    return "EPSG:4326" if named is None or "CRS84" in named else "EPSG:" + named.rsplit(":", 1)[-1]


def read_layer(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """A polygon layer by its suffix: .parquet (WKB geometry), .geojson or .json, .gpkg, .shp. Rows without a polygon go."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    readers = {"parquet": lambda s, p: with_segments(s.read.parquet(_there(s, p))), "geojson": read_geojson, "json": read_geojson, "gpkg": read_gpkg, "shp": read_shapefile}
    if suffix not in readers:
        raise ValueError(f"no reader for .{suffix} layers")
    layer = readers[suffix](spark, path)
    need(layer, list(columns))
    return clean_polygons(layer)


def load_layer(spark: SparkSession, path: str, columns: tuple[str, ...], target: str, crs: str | None = None) -> DataFrame:
    """A layer in the target system. crs: for files that do not tell; ValueError if it stays unknown."""
    layer = read_layer(spark, path, columns)
    source = layer_crs(spark, path) or crs
    if source is None:
        raise ValueError(f"the layer {path} has no coordinate reference system")
    return reproject(layer, source, target)


def load_routes(spark: SparkSession, path: str, route_id_col: str, target: str = "EPSG:4326", crs: str | None = None) -> DataFrame:
    """Route polygons (route_id as text, segs)."""
    layer = load_layer(spark, path, (route_id_col,), target, crs)
    return layer.select(F.col(f"`{route_id_col}`").cast("string").alias("route_id"), "segs")


def build_route_index(spark: SparkSession, auto_path: str, manual_path: str | None = None, auto_route_col: str = "ROUTE_ID", manual_route_col: str = "ROUTE_ID", config: FacilitiesConfig = FacilitiesConfig()) -> DataFrame:
    """Boxes of the automatic routes of one layer, and of the manual ones of another that it lacks, widened."""
    auto = load_routes(spark, auto_path, auto_route_col)
    return route_boxes(auto) if manual_path is None else route_index(auto, load_routes(spark, manual_path, manual_route_col), config)


def load_facilities(spark: SparkSession, path: str, config: FacilitiesConfig = FacilitiesConfig(), target: str = "EPSG:2230", crs: str | None = None) -> dict[str, DataFrame]:
    """landfill and depot, each with its segs in the target system and reach_ft; ValueError without a depot."""
    both = split_facilities(load_layer(spark, path, (config.name_col,), target, crs or config.crs), config)
    return {kind: both.filter(F.col("kind") == kind).drop("kind") for kind in ("landfill", "depot")}


def load_parcels(spark: SparkSession, path: str, crs: str | None = None) -> DataFrame:
    """Parcels with bounds, in degrees."""
    return build_parcels(load_layer(spark, path, ("APN", "route_ref", "route_org", "route_rec"), "EPSG:4326", crs))

"""Layer files of all kinds: written by hand, read back, loaded with their reference systems."""

import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from curbflow.config import FacilitiesConfig
from curbflow.functions import geo
from curbflow.operators import layers, spatial, vehicle_days
from curbflow.sources import layers as files
from curbflow.sources import wkb

SQUARE = lambda x, y, a: [(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)]
SHAPES = [("1", "Central Yard", [SQUARE(0, 0, 9), SQUARE(3, 3, 3)[::-1]]), ("2", "West", [SQUARE(20, 0, 2)])]


def write_geojson(path, crs=None):
    features = [{"type": "Feature", "properties": {"ROUTE_ID": k, "Name": n}, "geometry": {"type": "Polygon", "coordinates": rings}} for k, n, rings in SHAPES]
    features.append({"type": "Feature", "properties": {"ROUTE_ID": "3"}, "geometry": None})
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features} | ({"crs": {"properties": {"name": crs}}} if crs else {})))


def write_gpkg(path, srs=4326):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER)")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER, organization TEXT, organization_coordsys_id INTEGER)")
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (4326, 'EPSG', 4326), (2230, 'epsg', 2230), (-1, 'NONE', -1)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('shapes', 'geom', ?)", (srs,))
        db.execute("CREATE TABLE shapes (fid INTEGER, ROUTE_ID TEXT, Name TEXT, geom BLOB)")
        for i, (k, n, rings) in enumerate(SHAPES):
            envelope = (i * 2 & 7) and struct.pack("<4d", 0, 1, 0, 1)
            head = b"GP\0" + bytes([1 | (2 if envelope else 0)]) + struct.pack("<i", srs) + (envelope or b"")
            db.execute("INSERT INTO shapes VALUES (?, ?, ?, ?)", (i, k, n, head + wkb.encode_polygon(*rings)))
        db.execute("INSERT INTO shapes VALUES (9, '9', 'empty', ?)", (b"GP\0\x11" + struct.pack("<i", srs),))
        db.execute("INSERT INTO shapes VALUES (10, '10', 'null', NULL)")
    db.close()


def write_shapefile(stem, prj=None):
    shp, records = b"", []
    for k, n, rings in SHAPES:
        points, starts = [p for r in rings for p in r], [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
        body = struct.pack("<i4d2i", 5, 0, 0, 9, 9, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        shp += struct.pack(">2i", len(records) + 1, len(body) // 2) + body
        records.append(b" " + k.encode().ljust(8) + n.encode().ljust(16))
    stem.with_suffix(".shp").write_bytes(b"\0" * 100 + shp)
    fields = b"".join(name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15 for name, width in (("ROUTE_ID", 8), ("Name", 16)))
    stem.with_suffix(".dbf").write_bytes(struct.pack("<4xIHH", len(records), 32 + len(fields) + 1, 25) + b"\0" * 20 + fields + b"\r" + b"".join(records))
    if prj:
        stem.with_suffix(".prj").write_text(prj)


def write_geoparquet(spark, path, meta):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path.mkdir()
    table = pa.table({"ROUTE_ID": [k for k, _, _ in SHAPES], "Name": [n for _, n, _ in SHAPES], "geometry": [wkb.encode_polygon(*r) for _, _, r in SHAPES]})
    pq.write_table(table.replace_schema_metadata({} if meta is None else {"geo": json.dumps({"primary_column": "geometry", "columns": {"geometry": meta}})}), path / "part-0.parquet")


def check(layer):
    rows = {r.ROUTE_ID: r for r in layer.select("ROUTE_ID", "Name", F.size("segs").alias("n"), geo.within(F.col("segs"), F.lit(4.0), F.lit(4.0)).alias("hole"), geo.within(F.col("segs"), F.lit(1.0), F.lit(1.0)).alias("area")).collect()}
    assert {k: (r.Name, r.n, r.hole, r.area) for k, r in rows.items()} == {"1": ("Central Yard", 8, False, True), "2": ("West", 4, False, False)}


def test_all_kinds_of_files(spark, tmp_path):
    write_geojson(tmp_path / "a.geojson")
    write_gpkg(tmp_path / "a.gpkg")
    write_shapefile(tmp_path / "a", 'GEOGCS["GCS_WGS_1984"]')
    write_geoparquet(spark, tmp_path / "a.parquet", {})
    for suffix in ("geojson", "gpkg", "shp", "parquet"):
        path = str(tmp_path / f"a.{suffix}")
        check(files.read_layer(spark, path, ("ROUTE_ID", "Name")))
        assert files.layer_crs(spark, path) == "EPSG:4326"
        routes = files.load_routes(spark, path, "ROUTE_ID")
        assert routes.columns == ["route_id", "segs"] and {r.route_id for r in routes.collect()} == {"1", "2"}
        with pytest.raises(KeyError):
            files.load_routes(spark, path, "NUMBER")
        with pytest.raises(FileNotFoundError):
            files.load_routes(spark, str(tmp_path / f"none.{suffix}"), "ROUTE_ID")
    with pytest.raises(ValueError):
        files.read_layer(spark, str(tmp_path / "a.kml"))


def test_reference_systems(spark, tmp_path):
    write_gpkg(tmp_path / "feet.gpkg", 2230)
    write_gpkg(tmp_path / "none.gpkg", -1)
    write_shapefile(tmp_path / "none")
    write_shapefile(tmp_path / "feet", 'PROJCS["NAD_1983_StatePlane_California_VI_FIPS_0406_Feet",UNIT["Foot_US",0.3048]]')
    write_geojson(tmp_path / "feet.geojson", "urn:ogc:def:crs:EPSG::2230")
    for name, meta in (("null", {"crs": None}), ("feet", {"crs": {"id": {"authority": "EPSG", "code": 2230}}}), ("plain", None)):
        write_geoparquet(spark, tmp_path / f"{name}.parquet", meta)
    for name in ("feet.gpkg", "feet.shp", "feet.geojson", "feet.parquet"):
        assert files.layer_crs(spark, str(tmp_path / name)) == "EPSG:2230"
    for name in ("none.gpkg", "none.shp", "null.parquet", "plain.parquet"):
        with pytest.raises(ValueError):
            files.load_routes(spark, str(tmp_path / name), "ROUTE_ID")
        assert files.load_routes(spark, str(tmp_path / name), "ROUTE_ID", crs="EPSG:4326").count() == 2
    x, y = geo.project(F.lit(20.0), F.lit(0.0), "EPSG:2230", "EPSG:4326")
    there = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    moved = files.load_routes(spark, str(tmp_path / "feet.gpkg"), "ROUTE_ID").filter("route_id = '2'").first().segs[0]
    assert (moved.x1, moved.y1) == pytest.approx((there.x, there.y))


def test_facilities_and_route_index(spark, tmp_path):
    write_gpkg(tmp_path / "a.gpkg")
    path = str(tmp_path / "a.gpkg")
    found = files.load_facilities(spark, path, target="EPSG:4326")
    assert [r.Name for r in found["depot"].collect()] == ["Central Yard"] and [(r.Name, r.reach_ft) for r in found["landfill"].collect()] == [("West", 50.0)]
    assert files.load_facilities(spark, path)["depot"].first().segs[0].x1 != 0
    with pytest.raises(ValueError):
        files.load_facilities(spark, path, FacilitiesConfig(depot_name="East Yard"))
    with pytest.raises(KeyError):
        files.load_facilities(spark, path, FacilitiesConfig(name_col="Title"))
    assert files.build_route_index(spark, path).count() == 2
    assert files.build_route_index(spark, path, path).count() == 2
    with pytest.raises(KeyError):
        files.load_parcels(spark, path)


def test_geojson_of_rings(spark):
    def multi(*polygons):
        return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(wkb.encode_polygon(*p) for p in polygons)

    outer, hole, island = SQUARE(0, 0, 9), SQUARE(3, 3, 3), SQUARE(4, 4, 1)
    cases = [
        ([outer], ("Polygon", [outer])),
        ([outer, hole], ("Polygon", [outer, hole])),  # holes of either direction
        ([outer, hole[::-1]], ("Polygon", [outer, hole[::-1]])),
        ([outer, SQUARE(0, 0, 2)], ("Polygon", [outer, SQUARE(0, 0, 2)])),  # begins at the same point
        ([[outer, hole], [SQUARE(20, 0, 1)]], ("MultiPolygon", [[outer, hole], [SQUARE(20, 0, 1)]])),
        ([[outer, hole], [island]], ("MultiPolygon", [[outer, hole], [island]])),
        ([[SQUARE(0, 0, 1)], [SQUARE(1, 0, 1)]], ("MultiPolygon", [[SQUARE(0, 0, 1)], [SQUARE(1, 0, 1)]])),
    ]
    data = [(i, bytearray(multi(*c) if isinstance(c[0][0], list) else wkb.encode_polygon(*c))) for i, (c, _) in enumerate(cases)] + [(99, None)]
    layer = wkb.with_segments(spark.createDataFrame(data, "i int, geom_wkb binary"))
    got = {r.i: json.loads(r.j) for r in layer.select("i", geo.geometry_json(F.col("segs")).alias("j")).collect()}
    assert got.pop(99) is None
    listed = lambda x: [listed(y) for y in x] if isinstance(x, (list, tuple)) else float(x)
    assert got == {i: {"type": kind, "coordinates": listed(rings)} for i, (_, (kind, rings)) in enumerate(cases)}


def test_corrupt_polygons(spark):
    world = spark.range(1).select(geo.box(*map(F.lit, (-180.0, -90.0, 180.0, 90.0))).alias("segs"), F.lit("R").alias("route_id"))
    pings = spark.sql("SELECT 1D AS lon, 2D AS lat")
    with pytest.raises(Exception, match="grid cells"):
        spatial.attach_routes(pings, world).collect()
    bow = spark.range(1).select(geo.segments(*[(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 2), (2, 0), (0, 2))]).alias("segs"))
    plain = spark.range(1).select(geo.box(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("segs"))
    assert [r.crosses_itself for r in layers.flag_crossing(bow.unionByName(plain)).collect()] == [True, False]


def test_nearest_keeps_repeated_pings(spark):
    parcels = layers.build_parcels(spark.range(2).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("APN"), *[F.lit("A").alias(c) for c in ("route_ref", "route_org", "route_rec")], geo.box(F.col("id") * 0.001, F.lit(0.0), F.col("id") * 0.001 + 0.001, F.lit(0.001)).alias("segs")))
    pings = spark.sql("SELECT lon, 0.0005D AS lat, 1D AS speed_mph FROM VALUES (0.0009D), (0.0009D), (5D), (5D), (0.0019D) AS v(lon)")
    rows = spatial.attach_parcels(pings, parcels, match="nearest").collect()
    assert sorted((r.lon, r.apn or "") for r in rows) == [(0.0009, "P0"), (0.0009, "P0"), (0.0019, "P1"), (5.0, ""), (5.0, "")]


def test_day_indexes(spark, tmp_path):
    path = str(tmp_path / "indexes")
    with pytest.raises(FileNotFoundError):
        vehicle_days.load_day_indexes(spark, path)
    pings = spark.sql("SELECT 'a' AS vehicle_id, TIMESTAMP_NTZ'2024-01-18 07:00:00' AS dt_local, 1D AS lat, 2D AS lon, 'f' AS file")
    days = vehicle_days.summarise(pings, "file")
    vehicle_days.store_day_indexes(days, path)
    vehicle_days.store_day_indexes(days, path)
    assert vehicle_days.load_day_indexes(spark, path).collect() == days.collect()
    known = vehicle_days.load_day_indexes(spark, path)
    assert vehicle_days.summarise_new(pings, known).count() == 0 and vehicle_days.summarise_new(pings, known, overwrite=True).count() == 1

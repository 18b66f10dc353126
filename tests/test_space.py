import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from curbflow.config import EngineConfig, FacilitiesConfig
from curbflow.functions import geo
from curbflow.operators import layers, spatial
from curbflow.plans import views
from curbflow.sources import wkb

PINGS = "event_id int, vehicle_id string, dt_utc timestamp, dt_local timestamp_ntz, lat double, lon double, speed_mph double"


def ping(spark, lon, lat, speed=5.0):
    return spark.sql(f"SELECT '100001' AS vehicle_id, TIMESTAMP'2024-01-18 15:00:00' AS dt_utc, TIMESTAMP_NTZ'2024-01-18 07:00:00' AS dt_local, {lat}D AS lat, {lon}D AS lon, {speed}D AS speed_mph")


def box(spark, columns, x1, y1, x2, y2):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()], geo.box(*map(F.lit, (x1, y1, x2, y2))).alias("segs"))


@pytest.fixture(scope="module")
def substrate(spark):
    routes = box(spark, {"route_id": "A"}, -117.205, 32.700, -117.195, 32.710).unionByName(box(spark, {"route_id": "B"}, -117.305, 32.595, -117.295, 32.605))
    parcels = layers.build_parcels(box(spark, {"APN": "P1", "route_ref": "A", "route_org": "A", "route_rec": "A"}, -117.2005, 32.7005, -117.1995, 32.7015))
    return routes, parcels, box(spark, {"name": "L"}, -117.05, 32.50, -117.00, 32.55), box(spark, {"name": "Central Yard"}, -117.101, 32.799, -117.099, 32.801)


@pytest.mark.parametrize(
    ("lon", "lat", "speed", "expected"),
    [
        (-117.2, 32.708, 5.0, ("A", None, False, False)),
        (-117.2, 32.701, 5.0, ("A", "P1", False, False)),
        (-117.2, 32.70045, 5.0, ("A", "P1", False, False)),  # within 25 ft of the edge
        (-117.2, 32.701, 35.0, ("A", None, False, False)),
        (-117.02, 32.52, 5.0, (None, None, True, False)),
        (-117.1, 32.8, 5.0, (None, None, False, True)),
        (-122.0, 40.0, 5.0, (None, None, False, False)),
        (-117.205, 32.705, 5.0, (None, None, False, False)),  # on the boundary is not within
    ],
)
def test_enrich(spark, substrate, lon, lat, speed, expected):
    rows = spatial.enrich(ping(spark, lon, lat, speed), *substrate).collect()
    assert [(r.route_id, r.apn, r.in_landfill, r.at_depot) for r in rows] == [expected]


def test_empty_pings(spark, substrate):
    assert spatial.enrich(ping(spark, 0, 0).limit(0), *substrate).count() == 0


def test_all_and_nearest_parcels(spark, substrate):
    routes, parcels, fill, depot = substrate
    two = parcels.unionByName(layers.build_parcels(box(spark, {"APN": "P2", "route_ref": "A", "route_org": "A", "route_rec": "A"}, -117.1995, 32.7005, -117.1985, 32.7015)))
    at = ping(spark, -117.19952, 32.701)
    assert {r.apn for r in spatial.attach_parcels(at, two).collect()} == {"P1", "P2"}
    assert [r.apn for r in spatial.attach_parcels(at, two, match="nearest").collect()] == ["P1"]
    with pytest.raises(ValueError):
        spatial.attach_parcels(at, two, match="some")


def test_grid_join_is_brute_force(spark):
    draw = random.Random(3)
    points = [(i, draw.uniform(0, 0.1), draw.uniform(0, 0.1)) for i in range(400)]
    shapes = []
    for k in range(60):
        cx, cy = draw.uniform(0, 0.1), draw.uniform(0, 0.1)
        shapes.append((k, [(cx + draw.uniform(-0.01, 0.01), cy + draw.uniform(-0.01, 0.01)) for _ in range(5)]))
    segs = [(k, [(*a, *b) for a, b in zip(p, p[1:] + p[:1])]) for k, p in shapes]
    layer = spark.createDataFrame(segs, f"k int, segs array<{geo.SEGMENT}>")
    own = spark.createDataFrame(points, "i int, lon double, lat double")
    found = spatial.grid_join(own, layer, tuple(geo.bounds(F.col("segs")).values()), lambda x, y: geo.covers(F.col("segs"), x, y), how="inner")

    def inside(p, x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    assert sorted((r.i, r.k) for r in found.select("i", "k").collect()) == sorted((i, k) for i, x, y in points for k, p in shapes if inside(p, x, y))


def test_grid_join_plan_has_no_nested_loop(spark):
    plan = spatial.attach_parcels(views.pings(spark, DATA), views.parcels(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_haversine_and_projection(spark):
    row = spark.range(1).select(geo.haversine_miles(F.lit(33.9416), F.lit(-118.4085), F.lit(40.6413), F.lit(-73.7781)).alias("far"), *[c.alias(n) for c, n in zip(geo.Lambert.to_feet(F.lit(-116.25), F.lit(32 + 1 / 6)), "xy")]).first()
    assert 2450 < row.far < 2500
    assert abs(row.x - 6561666.667) < 0.01 and abs(row.y - 1640416.667) < 0.01
    for source in (None, "EPSG:9999"):
        with pytest.raises(ValueError):
            geo.project(F.lit(0.0), F.lit(0.0), source, "EPSG:4326")


def test_wkb_round_trip(spark):
    hole = wkb.encode_polygon([(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 2), (2, 2), (2, 1)])
    layer = wkb.with_segments(spark.createDataFrame([(bytearray(hole),), (None,)], "geom_wkb binary"))
    got = layer.select(*[geo.within(F.col("segs"), F.lit(x), F.lit(y)).alias(n) for n, x, y in (("a", 3.0, 3.0), ("b", 1.5, 1.5), ("c", 4.0, 2.0))]).collect()
    assert tuple(got[0]) == (True, False, False) and got[1].a is None


def test_layers(spark, substrate):
    routes, parcels, fill, depot = substrate
    assert [r.APN for r in layers.bbox_filter(parcels, (-117.2, 32.701, -117.1, 32.8)).collect()] == ["P1"]
    assert layers.bbox_filter(parcels, (0.0, 0.0, 1.0, 1.0)).count() == 0
    assert layers.bbox_of(box(spark, {"k": 1}, 0.0, 0.0, 10.0, 20.0), 5) == (-5.0, -5.0, 15.0, 25.0)
    both = layers.split_facilities(fill.unionByName(depot), name_col="name")
    assert {r.name: r.kind for r in both.collect()} == {"L": "landfill", "Central Yard": "depot"}
    with pytest.raises(ValueError):
        layers.split_facilities(fill, name_col="name")
    with pytest.raises(KeyError):
        layers.split_facilities(fill, FacilitiesConfig(name_col="Title"))
    index = layers.route_index(routes.filter("route_id = 'A'"), routes)
    wide = {r.route_id: r.rte_max_lon - r.rte_min_lon for r in index.collect()}
    assert wide["B"] > wide["A"]


def test_config_is_frozen():
    with pytest.raises(AttributeError):
        EngineConfig().slow_mph_max = 1

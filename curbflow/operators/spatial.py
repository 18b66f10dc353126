"""Spatial joins on a grid, and the enrichment of pings.

A polygon is listed under every grid cell that its box (widened by the tolerance) meets; a point lies in one cell. So an
equi-join on cells finds every candidate pair once, and the exact predicate is part of the join's condition: unmatched
points stay in an outer join without a second pass. Hot cells are split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.config import FEET_PER_DEGREE, EngineConfig
from curbflow.functions import geo
from curbflow.schemas import ENRICHED, names

#: Side of a grid cell in degrees, and the cells that one box may meet: more means a corrupt polygon.
CELL, MOST_CELLS = 0.005, 1_000_000


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def on_grid(layer: DataFrame, box: tuple[Column, Column, Column, Column], size: float = CELL, reach: float | Column = 0.0) -> DataFrame:
    """layer with a row for each cell (cell_x, cell_y) that the box, widened by reach, meets.

    A box of more than MOST_CELLS cells is an error, rather than that many rows.
    """
    min_x, min_y, max_x, max_y = box
    left, right, low, high = (cell_of(c, size) for c in (min_x - reach, max_x + reach, min_y - reach, max_y + reach))
    cells = (right - left + 1).cast("double") * (high - low + 1)
    checked = F.when(cells > MOST_CELLS, F.raise_error(F.concat(F.lit("a polygon's box meets "), cells.cast("string"), F.lit(" grid cells"))).cast("bigint")).otherwise(left)
    return layer.withColumn("cell_x", F.explode(F.sequence(checked, right))).withColumn("cell_y", F.explode(F.sequence(low, high)))


def grid_join(points: DataFrame, layer: DataFrame, box: tuple, match, x: str = "lon", y: str = "lat", how: str = "left", size: float = CELL, reach: float | Column = 0.0) -> DataFrame:
    """points joined with the rows of layer for which match(x, y) holds. Column names of the two must differ."""
    cells = on_grid(layer, box, size, reach)
    own = points.withColumn("at_x", cell_of(F.col(x), size)).withColumn("at_y", cell_of(F.col(y), size))
    condition = (own["at_x"] == cells["cell_x"]) & (own["at_y"] == cells["cell_y"]) & match(F.col(x), F.col(y))
    return own.join(cells, condition, how).drop("at_x", "at_y", "cell_x", "cell_y")


def grid_flag(points: DataFrame, layer: DataFrame, box: tuple, shape: Column, match, name: str, x: str = "lon", y: str = "lat", size: float = CELL, reach: float | Column = 0.0) -> DataFrame:
    """points with a boolean column: whether any row of layer matches. shape: what match(shape, x, y) looks at.

    The layer is gathered by cell, so that a point meets one row at most and never multiplies.
    """
    cells = on_grid(layer.withColumn("_shape", shape), box, size, reach).groupBy("cell_x", "cell_y").agg(F.collect_list("_shape").alias("_shapes"))
    own = points.withColumn("at_x", cell_of(F.col(x), size)).withColumn("at_y", cell_of(F.col(y), size))
    met = own.join(cells, (own["at_x"] == cells["cell_x"]) & (own["at_y"] == cells["cell_y"]), "left")
    flag = F.coalesce(F.exists("_shapes", lambda s: match(s, F.col(x), F.col(y))), F.lit(False))
    return met.withColumn(name, flag).drop("at_x", "at_y", "cell_x", "cell_y", "_shapes")


def attach_routes(pings: DataFrame, routes: DataFrame) -> DataFrame:
    """pings with route_id of every route polygon (route_id, segs) that they lie in; one row each, null if none."""
    layer = routes.select("route_id", F.col("segs").alias("route_segs"), *[c.alias(f"route_{k}") for k, c in geo.bounds(F.col("segs")).items()])
    box = tuple(F.col(f"route_{k}") for k in ("min_x", "min_y", "max_x", "max_y"))
    joined = grid_join(pings, layer, box, lambda x, y: geo.within(F.col("route_segs"), x, y), size=4 * CELL)
    return joined.drop("route_segs", *[f"route_{k}" for k in ("min_x", "min_y", "max_x", "max_y")])


def attach_parcels(pings: DataFrame, parcels: DataFrame, config: EngineConfig = EngineConfig(), match: str = "all") -> DataFrame:
    """pings with apn of every parcel (APN, segs, min_lon ... max_lat) within the tolerance, for slow pings.

    match: "all" gives a row for each parcel; "nearest" the nearest one only, ties by APN.
    """
    reach = config.parcel_edge_ft / FEET_PER_DEGREE
    layer = parcels.select(F.col("APN").alias("apn"), F.col("segs").alias("parcel_segs"), *[F.col(c).alias(f"parcel_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat")])
    box = tuple(F.col(f"parcel_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat"))

    def near(x: Column, y: Column) -> Column:
        inside = x.between(box[0] - reach, box[2] + reach) & y.between(box[1] - reach, box[3] + reach)
        return (F.col("speed_mph") <= config.slow_mph_max) & inside & geo.within_distance(F.col("parcel_segs"), x, y, reach)

    spare = ["parcel_segs", *[f"parcel_{c}" for c in ("min_lon", "min_lat", "max_lon", "max_lat")]]
    if match == "all":
        return grid_join(pings, layer, box, near, reach=reach).drop(*spare)
    if match != "nearest":
        raise ValueError(f"match is all or nearest, not {match!r}")
    # Equal pings are told apart by their number among their likes.
    like = Window.partitionBy(*pings.columns).orderBy(F.lit(1))
    own = pings.withColumn("_like", F.row_number().over(like))
    joined = grid_join(own, layer, box, near, reach=reach).withColumn("_apart", geo.distance(F.col("parcel_segs"), F.col("lon"), F.col("lat"))).drop(*spare)
    first = Window.partitionBy(*pings.columns, "_like").orderBy(F.col("_apart").asc_nulls_last(), "apn")
    return joined.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_like", "_apart")


def flag_landfills(pings: DataFrame, landfills: DataFrame) -> DataFrame:
    """pings with in_landfill: strictly inside a landfill polygon (segs)."""
    box = tuple(geo.bounds(F.col("segs")).values())
    return grid_flag(pings, landfills, box, F.col("segs"), geo.within, "in_landfill", size=4 * CELL)


def flag_depot(pings: DataFrame, depot: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """pings with at_depot: within the radius of a depot polygon's centroid (segs)."""
    radius = config.depot_radius_ft / FEET_PER_DEGREE
    x, y = geo.centroid(F.col("segs"))
    places = depot.select(x.alias("cx"), y.alias("cy"))
    here = (F.col("cx"), F.col("cy"), F.col("cx"), F.col("cy"))

    def near(s: Column, px: Column, py: Column) -> Column:
        dx, dy = px - s["cx"], py - s["cy"]
        return F.sqrt(dx * dx + dy * dy) <= radius

    return grid_flag(pings, places, here, F.struct("cx", "cy"), near, "at_depot", size=4 * CELL, reach=radius)


def enrich(pings: DataFrame, routes: DataFrame, parcels: DataFrame, landfills: DataFrame, depot: DataFrame, config: EngineConfig = EngineConfig(), match: str = "all") -> DataFrame:
    """Canonical pings with route_id, apn, in_landfill and at_depot; extra columns stay. Overlapping polygons give rows each."""
    out = flag_depot(flag_landfills(pings, landfills), depot, config)
    out = attach_parcels(attach_routes(out, routes), parcels, config, match)
    extra = [c for c in pings.columns if c not in names(ENRICHED)]
    return out.select(*names(ENRICHED), *extra)


def attach_apns(sites: DataFrame, parcels: DataFrame) -> DataFrame:
    """Sites (lon, lat) with parcel_apn of every parcel (APN, segs) that they lie in."""
    for column in ("lon", "lat"):
        if column not in sites.columns:
            raise KeyError(column)
    layer = parcels.select(F.col("APN").alias("parcel_apn"), F.col("segs").alias("parcel_segs"))
    return grid_join(sites, layer, tuple(geo.bounds(F.col("parcel_segs")).values()), lambda x, y: geo.within(F.col("parcel_segs"), x, y)).drop("parcel_segs")

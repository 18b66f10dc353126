"""Static layers: parcels, route polygons and boxes, facilities.

Buffers are never drawn: a layer carries reach_ft, by which distance predicates and boxes are widened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.config import FEET_PER_DEGREE, ROUTE_EDGE_DEGREES, FacilitiesConfig
from curbflow.functions import geo


def need(df: DataFrame, columns: list[str], error: type[Exception] = KeyError) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise error(f"missing columns: {', '.join(missing)}")


def clean_polygons(df: DataFrame) -> DataFrame:
    """Rows whose polygon (segs) has at least three segments."""
    return df.filter(F.coalesce(F.size("segs") >= 3, F.lit(False)))


def bbox_filter(parcels: DataFrame, box: tuple[float, float, float, float], exact: bool = True) -> DataFrame:
    """Parcels that meet a box (min_x, min_y, max_x, max_y). The stored bounds prune first; exact looks at the polygon."""
    own = tuple(F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    found = parcels.filter(geo.boxes_meet(own, tuple(map(F.lit, box))))
    if not exact or "segs" not in parcels.columns:
        return found
    x1, y1, x2, y2 = box

    def meets(s: Column) -> Column:
        """Whether a segment has a point in the box, by clipping (Liang and Barsky)."""
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        low, high, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
        for p, q in ((-dx, s["x1"] - x1), (dx, F.lit(x2) - s["x1"]), (-dy, s["y1"] - y1), (dy, F.lit(y2) - s["y1"])):
            r = F.try_divide(q, p)
            low = F.when(p < 0, F.greatest(low, r)).otherwise(low)
            high = F.when(p > 0, F.least(high, r)).otherwise(high)
            outside = outside | ((p == 0) & (q < 0))
        return ~outside & (low <= high)

    return found.filter(F.exists("segs", meets) | geo.covers(F.col("segs"), F.lit((x1 + x2) / 2), F.lit((y1 + y2) / 2)))


def bbox_of(layer: DataFrame, pad: float = 0.0) -> tuple[float, float, float, float]:
    """Padded box of a whole layer (segs)."""
    own = geo.bounds(F.col("segs"))
    row = layer.agg(F.min(own["min_x"]), F.min(own["min_y"]), F.max(own["max_x"]), F.max(own["max_y"])).first()
    return row[0] - pad, row[1] - pad, row[2] + pad, row[3] + pad


def reproject(layer: DataFrame, source: str | None, target: str) -> DataFrame:
    """layer with segs in another reference system; ValueError if either is not known."""
    geo.project(F.lit(0.0), F.lit(0.0), source, target)
    if source == target:
        return layer

    def turned(s: Column) -> Column:
        a, b = geo.project(s["x1"], s["y1"], source, target), geo.project(s["x2"], s["y2"], source, target)
        return F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))

    return layer.withColumn("segs", F.transform("segs", turned))


def flag_crossing(layer: DataFrame) -> DataFrame:
    """layer with crosses_itself: whether two sides of the polygon cross.

    Such a polygon needs no repair here: the even-odd rule takes it for the area that its repair would have.
    """
    return layer.withColumn("crosses_itself", geo.crosses_itself(F.col("segs")))


def build_parcels(parcels: DataFrame, crs: str | None = "EPSG:4326") -> DataFrame:
    """Parcels (APN, route columns, segs in crs) with bounds in degrees."""
    need(parcels, ["APN", "route_ref", "route_org", "route_rec"])
    own = reproject(parcels, crs, "EPSG:4326")
    edges = geo.bounds(F.col("segs"))
    return own.withColumns({"min_lon": edges["min_x"], "min_lat": edges["min_y"], "max_lon": edges["max_x"], "max_lat": edges["max_y"]})


def route_boxes(routes: DataFrame, edge: float = ROUTE_EDGE_DEGREES) -> DataFrame:
    """One widened box for each route_id over all its polygons (segs, optionally reach_ft)."""
    need(routes, ["route_id", "segs"])
    own = geo.bounds(F.col("segs"))
    reach = F.coalesce("reach_ft", F.lit(0.0)) / FEET_PER_DEGREE if "reach_ft" in routes.columns else F.lit(0.0)
    return routes.groupBy("route_id").agg(
        (F.min(own["min_x"] - reach) - edge).alias("rte_min_lon"), (F.min(own["min_y"] - reach) - edge).alias("rte_min_lat"),
        (F.max(own["max_x"] + reach) + edge).alias("rte_max_lon"), (F.max(own["max_y"] + reach) + edge).alias("rte_max_lat"),
    )


def route_index(auto: DataFrame, manual: DataFrame, config: FacilitiesConfig = FacilitiesConfig()) -> DataFrame:
    """Boxes of automatic routes, and of those manual ones, widened, that no automatic route has."""
    only = manual.join(auto.select("route_id").distinct(), "route_id", "left_anti").withColumn("reach_ft", F.lit(config.manual_buffer_ft))
    return route_boxes(auto.select("route_id", "segs").withColumn("reach_ft", F.lit(0.0)).unionByName(only.select("route_id", "segs", "reach_ft")))


def split_facilities(facilities: DataFrame, config: FacilitiesConfig = FacilitiesConfig(), name_col: str | None = None) -> DataFrame:
    """Facilities with kind (depot or landfill) and reach_ft, the landfill's buffer."""
    name = name_col or config.name_col
    need(facilities, [name])
    depot = F.coalesce(F.col(name) == config.depot_name, F.lit(False))
    out = facilities.withColumn("kind", F.when(depot, "depot").otherwise("landfill"))
    if out.filter("kind = 'depot'").isEmpty():
        raise ValueError(f"no facility is called {config.depot_name}")
    return out.withColumn("reach_ft", F.when(F.col("kind") == "landfill", F.lit(config.landfill_buffer_ft)).otherwise(F.lit(0.0)))

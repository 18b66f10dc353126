"""Map reports: one self-contained HTML page for a route, vehicle and day, from JSON payloads."""

from __future__ import annotations

import html
import json
from string import Template
from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow.config import FacilitiesConfig
from curbflow.functions import geo
from curbflow.operators import dayview
from curbflow.operators.ranking import MIN_PINGS, TOP_N, rank_vehicles, top_vehicle_routes

# Letters of commodities in route identifiers.
COMMODITIES = {"R": "Refuse", "O": "Organics", "C": "Recycling"}

PAGE = Template("""<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>$title</title>
<style>
body{margin:0;font:14px system-ui,sans-serif;display:flex;height:100vh}
#side{width:290px;padding:14px;overflow:auto;background:#f6f7f8;border-right:1px solid #d5d8dc}
#map{flex:1;position:relative}
svg{width:100%;height:100%;background:#fbfcfc}
table{border-collapse:collapse;width:100%}
td,th{padding:3px 5px;text-align:left;border-bottom:1px solid #e1e4e8}
#tip{position:absolute;display:none;background:#fff;border:1px solid #888;padding:4px 7px;pointer-events:none}
</style></head><body>
<div id="side"><h2>$title</h2><p>$label</p>
<label><input type="checkbox" checked data-layer="parcels"> Parcels</label>
<label><input type="checkbox" checked data-layer="route"> Route</label>
<label><input type="checkbox" checked data-layer="trail"> Trail</label>
<label><input type="checkbox" checked data-layer="landfills"> Landfills</label>
<label><input type="checkbox" data-layer="sites"> Sites</label>
<p id="notes">$notes</p>
<h3>Shift</h3><table id="shift"></table><h3>Loads</h3><table id="loads"></table><h3>Completion</h3><table id="done"></table></div>
<div id="map"><svg id="canvas"></svg><div id="tip"></div></div>
<script>
const data = $payload;
const svg = document.getElementById("canvas"), tip = document.getElementById("tip");
const lines = [];
const visit = c => typeof c[0] === "number" ? lines.push(c) : c.forEach(visit);
for (const k of ["route", "parcels", "trail"].some(k => data[k].features.length) ? ["route", "parcels", "trail"] : ["sites"]) for (const f of data[k].features) if (f.geometry) visit(f.geometry.coordinates);
const xs = lines.map(p => p[0]), ys = lines.map(p => p[1]);
const low = a => a.reduce((m, v) => Math.min(m, v), Infinity), high = a => a.reduce((m, v) => Math.max(m, v), -Infinity);
const x0 = low(xs), x1 = high(xs), y0 = low(ys), y1 = high(ys), squeeze = Math.cos((y0 + y1) / 2 * Math.PI / 180);
const w = Math.max((x1 - x0) * squeeze, 1e-6), h = Math.max(y1 - y0, 1e-6), pad = 0.05 * Math.max(w, h);
svg.setAttribute("viewBox", [-pad, -pad, w + 2 * pad, h + 2 * pad].join(" "));
const at = p => [(p[0] - x0) * squeeze, y1 - p[1]];
const add = (layer, tag, attrs, text) => {
  const e = document.createElementNS("http://www.w3.org/2000/svg", tag);
  for (const [k, v] of Object.entries(attrs)) e.setAttribute(k, v);
  e.dataset.layer = layer;
  e.onmousemove = m => { tip.style.display = "block"; tip.style.left = m.offsetX + 12 + "px"; tip.style.top = m.offsetY + "px"; tip.textContent = text; };
  e.onmouseleave = () => { tip.style.display = "none"; };
  svg.append(e);
};
const path = c => c.map(r => "M" + r.map(p => at(p).join(" ")).join("L") + "Z").join("");
const areas = f => f.geometry.type === "MultiPolygon" ? f.geometry.coordinates.map(path).join("") : path(f.geometry.coordinates);
for (const f of data.route.features) if (f.geometry) add("route", "path", {d: areas(f), "fill-rule": "evenodd", fill: "none", stroke: "#34495e", "stroke-width": pad / 30}, f.properties.route_id);
for (const [layer, stroke] of [["landfills", "#8e5b2c"], ["sites", "#7d3c98"]]) for (const f of data[layer].features) if (f.geometry) add(layer, "path", {d: areas(f), fill: "none", "fill-rule": "evenodd", stroke, "stroke-width": pad / 30}, f.properties.name);
for (const f of data.parcels.features) if (f.geometry) add("parcels", "path", {d: areas(f), "fill-rule": "evenodd", fill: f.properties.fill_color, "fill-opacity": 0.6}, f.properties.APN + ": " + f.properties.status);
for (const f of data.trail.features) { const p = at(f.geometry.coordinates); add("trail", "circle", {cx: p[0], cy: p[1], r: pad / 25, fill: f.properties.color}, f.properties.dt_local + " " + f.properties.phase); }
const table = (id, rows) => { for (const r of rows) { const tr = document.getElementById(id).insertRow(); for (const c of r) tr.insertCell().textContent = c ?? ""; } };
table("shift", Object.entries(data.summary));
if (!data.loads.length) table("loads", [["No loads"]]);
else table("loads", [["#", "from", "to", "miles", "tons"], ...data.loads.map(l => [l.load_number, l.start, l.end, l.miles, l.tons])]);
const counts = {};
for (const f of data.parcels.features) counts[f.properties.status] = (counts[f.properties.status] || 0) + 1;
table("done", Object.keys(counts).length ? Object.entries(counts) : [["No parcels"]]);
for (const box of document.querySelectorAll("input")) (box.onchange = () => { for (const e of svg.querySelectorAll("[data-layer=" + box.dataset.layer + "]")) e.style.display = box.checked ? "" : "none"; })();
</script></body></html>
""")
EMPTY = '{"type":"FeatureCollection","features":[]}'


def commodity(route_id: str) -> str:
    """Name of a route's commodity by its first letter, if it has one."""
    return COMMODITIES.get(route_id[:1], "")


def render(route_id: str, vehicle_id: str, day: str, *, trail: str = EMPTY, parcels: str = EMPTY, route: str = EMPTY, landfills: str = EMPTY, sites: str = EMPTY, summary: dict | None = None, loads: list[dict] | None = None, label: str = "", notes: tuple[str, ...] = ()) -> str:
    """The page as text. Payloads are JSON; a closing tag inside them cannot end the script."""
    payload = "{" + f'"trail":{trail},"parcels":{parcels},"route":{route},"landfills":{landfills},"sites":{sites},"summary":{json.dumps(summary or {}, default=str)},"loads":{json.dumps(loads or [], default=str)}' + "}"
    title = html.escape(" ".join(filter(None, (commodity(route_id), "route", route_id, "· vehicle", vehicle_id, "·", day))))
    return PAGE.substitute(title=title, label=html.escape(label), notes="<br>".join(map(html.escape, notes)), payload=payload.replace("</", "<\\/"))


def payloads(enriched: DataFrame, timeline: DataFrame, parcels: DataFrame, routes: DataFrame, targets: DataFrame, patterns: DataFrame | None = None, tickets: DataFrame | None = None) -> DataFrame:
    """All JSON of each target (vehicle_id, day, route_id), in one plan."""
    days = targets.select("vehicle_id", "day").distinct()
    own = enriched.withColumn("_d", F.to_date("dt_local")).join(days.withColumnRenamed("day", "_d"), ["vehicle_id", "_d"], "left_semi").drop("_d").select(enriched.columns)
    trails = dayview.trail_geojson(own, timeline).select("vehicle_id", "day", "trail_json")
    status = dayview.parcels_geojson(dayview.parcel_status(parcels, own, targets, patterns)).select("vehicle_id", "day", "route_id", "parcels_json")
    shape = dayview.feature_json(geo.geometry_json(F.col("segs")), F.struct("route_id"))
    shapes = routes.groupBy("route_id").agg(dayview.collection_json(F.collect_list(shape)).alias("route_json"))
    shift = dayview.shift_summary(timeline)
    label = shift.select("vehicle_id", "day", "day_time_label", F.to_json(F.struct(*[c for c in shift.columns if c != "day_time_label"])).alias("summary_json"))
    load = dayview.load_breakdown(timeline, tickets)
    listed = load.groupBy("vehicle_id", "day").agg(F.to_json(F.sort_array(F.collect_list(F.struct("load_number", *[c for c in load.columns if c not in ("vehicle_id", "day", "load_number")])))).alias("loads_json"))
    out = targets.join(trails, ["vehicle_id", "day"], "left").join(status, ["vehicle_id", "day", "route_id"], "left").join(shapes, "route_id", "left")
    return out.join(label, ["vehicle_id", "day"], "left").join(listed, ["vehicle_id", "day"], "left")


def facility_layers(facilities: DataFrame, config: FacilitiesConfig = FacilitiesConfig()) -> dict[str, str]:
    """landfills and sites as text, of a layer (name column, segs in degrees): the few places of one fleet."""
    name = F.col(config.name_col)
    feature = dayview.feature_json(geo.geometry_json(F.col("segs")), F.struct(name.alias("name")))
    depot = F.coalesce(name == config.depot_name, F.lit(False))
    row = facilities.agg(F.sort_array(F.collect_list(F.when(~depot, feature))).alias("landfills"), F.sort_array(F.collect_list(feature)).alias("sites")).select(*[dayview.collection_json(F.col(c)).alias(c) for c in ("landfills", "sites")]).first()
    return row.asDict()


def pages(own: DataFrame, layers: dict[str, str] | None = None, notes: tuple[str, ...] = ()) -> DataFrame:
    """(day, page, html) of each row of payloads. layers: as facility_layers() gives."""
    layers = layers or {}

    def run(batches):
        for batch in batches:
            some = lambda x, other: other if x is None else x
            batch["html"] = [
                render(r.route_id, r.vehicle_id, str(r.day), trail=some(r.trail_json, EMPTY), parcels=some(r.parcels_json, EMPTY), route=some(r.route_json, EMPTY), summary=json.loads(some(r.summary_json, "{}")), loads=json.loads(some(r.loads_json, "[]")), label=some(r.day_time_label, "—"), notes=notes, **layers)
                for r in batch.itertuples()
            ]
            batch["page"] = [f"{r.route_id}__{r.vehicle_id}" for r in batch.itertuples()]
            batch["day"] = batch["day"].astype(str)
            yield batch[["day", "page", "html"]]

    return own.mapInPandas(run, "day string, page string, html string")


def write_pages(own: DataFrame, folder: str, layers: dict[str, str] | None = None, notes: tuple[str, ...] = ()) -> list[str]:
    """Writes the pages as <folder>/<day>/<route>__<vehicle>.html and returns their paths.

    Tasks write them; the driver only gives the files their names.
    """
    spark = own.sparkSession
    jvm = spark.sparkContext._jvm
    path, unescape = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = f"{folder}/_pages-{uuid4().hex}"
    pages(own, layers, notes).repartition("day", "page").write.option("partitionOverwriteMode", "static").partitionBy("day", "page").text(beside)
    written = []
    for status in system.globStatus(path(f"{beside}/day=*/page=*/part-*")) or []:
        file = status.getPath()
        day, page = (unescape(x.getName().split("=", 1)[1]) for x in (file.getParent().getParent(), file.getParent()))
        target = path(path(folder, day), page.replace("/", "_") + ".html")
        system.mkdirs(target.getParent())
        system.delete(target, False)
        if not system.rename(file, target):
            raise OSError(f"{target} could not be written")
        written.append(target.toString())
    system.delete(path(beside), True)
    return sorted(written)


def render_routeview(own: DataFrame, route_id: str, vehicle_id: str, day, layers: dict[str, str] | None = None) -> str:
    """The page of one target; ValueError if it is not among the payloads."""
    row = pages(own.filter((F.col("route_id") == route_id) & (F.col("vehicle_id") == vehicle_id) & (F.col("day").cast("string") == str(day))), layers).first()
    if row is None:
        raise ValueError(f"no route {route_id} of vehicle {vehicle_id} on {day}")
    return row["html"]


def targets_of_day(enriched: DataFrame, day: str, routes: list[str] | None = None, min_pings: int = MIN_PINGS) -> DataFrame:
    """(vehicle_id, day, route_id): for each route of a day the vehicle with most pings, if they are enough."""
    ranked = rank_vehicles(enriched, day=str(day), min_pings=min_pings)
    if routes is not None:
        ranked = ranked.filter(F.col("route_id").isin(routes))
    first = Window.partitionBy("route_id").orderBy(F.desc("n_pings"), "vehicle_id")
    top = ranked.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return top.select("vehicle_id", F.to_date("day").alias("day"), "route_id")


def _of_day(enriched: DataFrame, timeline: DataFrame, day) -> tuple[DataFrame, DataFrame]:
    date = F.lit(str(day)).cast("date")
    return enriched.filter(F.to_date("dt_local") == date), timeline.filter(F.col("day") == date)


def render_all_routes_for_day(enriched: DataFrame, timeline: DataFrame, parcels: DataFrame, routes: DataFrame, folder: str, day, only: list[str] | None = None, patterns: DataFrame | None = None, tickets: DataFrame | None = None, facilities: DataFrame | None = None, min_pings: int = MIN_PINGS) -> list[str]:
    """A page for every route of a day (or those given) and its first vehicle; returns the paths. Routes with too few pings have none."""
    pings, segments = _of_day(enriched, timeline, day)
    targets = targets_of_day(pings, day, only, min_pings).join(routes.select("route_id").distinct(), "route_id", "left_semi")
    return write_pages(payloads(pings, segments, parcels, routes, targets, patterns, tickets), folder, facility_layers(facilities) if facilities is not None else None)


def render_top_n_vehicles(enriched: DataFrame, timeline: DataFrame, parcels: DataFrame, routes: DataFrame, folder: str, day, top_n: int = TOP_N, patterns: DataFrame | None = None, tickets: DataFrame | None = None, facilities: DataFrame | None = None, min_pings: int = MIN_PINGS) -> list[str]:
    """A page for every route with enough pings of the day's busiest vehicles; returns the paths."""
    pings, segments = _of_day(enriched, timeline, day)
    targets = top_vehicle_routes(pings, str(day), top_n, min_pings).select("vehicle_id", F.lit(str(day)).cast("date").alias("day"), "route_id")
    return write_pages(payloads(pings, segments, parcels, routes, targets, patterns, tickets), folder, facility_layers(facilities) if facilities is not None else None)

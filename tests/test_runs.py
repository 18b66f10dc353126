"""Runs that skip what is fresh, upserts that read only the batch's years, pages written by tasks."""

import json
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from curbflow import report
from curbflow.functions import geo
from curbflow.operators import runs, tickets
from curbflow.plans import days, signatures, views


def test_patterns_are_skipped_when_fresh(spark, tmp_path):
    enriched, out = str(tmp_path / "enriched"), str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        runs.run_patterns(spark, enriched, views.visit_parcels(spark, DATA), out)
    views.visit_pings(spark, DATA).write.parquet(enriched)
    run = lambda **more: {r.route_id: r.ran for r in runs.run_patterns(spark, enriched, views.visit_parcels(spark, DATA), out, "custom", signatures.START, signatures.END, signatures.CONFIG, **more).collect()}
    routes = {f"C{k}" for k in range(5)}
    assert run() == dict.fromkeys(routes, True) and run() == dict.fromkeys(routes, False) and run(refresh=True) == dict.fromkeys(routes, True)
    label = "2024-01-01_to_2024-01-30"
    some = runs.load_patterns(spark, out, label, ["C1"])
    assert {r.route_ref for r in some.select("route_ref").collect()} == {"C1"}
    assert runs.load_patterns(spark, out, label).count() == views.visit_parcels(spark, DATA).count()
    with pytest.raises(FileNotFoundError):
        runs.load_patterns(spark, out, "none")
    with pytest.raises(ValueError):
        signatures.patterns.Chain(views.visit_pings(spark, DATA), views.visit_parcels(spark, DATA), "2024-01-02", "2024-01-02")


def test_unknown_files_of_runs(spark, tmp_path):
    nowhere = str(tmp_path / "none")
    for call in (lambda: runs.enrich_days(spark, nowhere, nowhere, None, None, None, None), lambda: runs.build_all_segments(spark, nowhere, nowhere), lambda: runs.run_ingest(spark, nowhere, nowhere)):
        with pytest.raises(FileNotFoundError):
            call()


def batch(spark, rows):
    return spark.createDataFrame(rows, "record_key string, year int, file_date date, file_name string, tons double")


def test_upsert_reads_the_years_of_the_batch(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    first = tickets.upsert(batch(spark, [("a", 2020, None, "f", 1.0), ("b", 2021, None, "f", 2.0), ("b", 2021, None, "e", 3.0), ("x", None, None, "f", 4.0)]), path, "SCALE")
    assert {r.year: (r.existing, r.added, r.total, r.dropped) for r in first.collect()} == {2020: (0, 1, 1, 0), 2021: (0, 1, 1, 0), None: (0, 0, 0, 1)}
    read = []
    exact = tickets._summary
    monkeypatch.setattr(tickets, "_summary", lambda b, stored, new: read.extend(stored.inputFiles()) or exact(b, stored, new))
    plans = []
    found = tickets.new_rows
    monkeypatch.setattr(tickets, "new_rows", lambda b, stored: plans.append(stored._jdf.queryExecution().executedPlan().toString()) or found(b, stored))
    again = tickets.upsert(batch(spark, [("b", 2021, None, "g", 2.0), ("c", 2021, None, "g", 2.0)]), path, "SCALE")
    assert [(r.year, r.existing, r.added, r.total) for r in again.collect()] == [(2021, 1, 1, 2)]
    assert re.search(r"PartitionFilters: \[[^\]]*year[^\]]*2021", plans[0])
    stored = {(r.record_key, r.tons) for r in spark.read.parquet(path).collect()}
    assert stored == {("a", 1.0), ("b", 3.0), ("c", 2.0)}  # of two files of no date the first by name
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("_new")]


def test_dedupe_takes_the_first_file(spark):
    rows = batch(spark, [("k", 2020, None, "a", 1.0), ("k", 2020, None, "b", 2.0)]).withColumn("file_date", F.when(F.col("file_name") == "b", F.lit("2020-01-05").cast("date")))
    assert [r.file_name for r in tickets.dedupe(rows).collect()] == ["b"] and tickets.dedupe(rows).columns == rows.columns


def test_pages(spark, tmp_path):
    enriched, timeline = views.enriched(spark, DATA), days._timeline(spark, DATA)
    parcels, routes = views.parcels(spark, DATA), views.routes(spark, DATA)
    places = views.landfills(spark, DATA).select("name", "segs").unionByName(views.depot(spark)).withColumnRenamed("name", "Name")
    folder = str(tmp_path / "pages")
    paths = report.render_all_routes_for_day(enriched, timeline, parcels, routes, folder, "2024-01-15", only=["R1", "R2", "R99"], facilities=places, min_pings=1)
    assert [re.sub(r".*/(2024-01-15/R\d)__.*", r"\1", p) for p in paths] == ["2024-01-15/R1", "2024-01-15/R2"]
    files = sorted((tmp_path / "pages" / "2024-01-15").glob("*.html"))
    assert len(files) == 2 and not [p for p in (tmp_path / "pages").iterdir() if p.name.startswith("_pages")]
    page = files[0].read_text()
    data = json.loads(re.search(r"const data = (\{.*?\});\n", page, re.S)[1])
    assert data["trail"]["features"] and data["route"]["features"][0]["geometry"]["type"] == "Polygon" and data["summary"] and data["loads"] is not None
    assert len(data["landfills"]["features"]) == len(data["sites"]["features"]) - 1 == 5
    assert {f["properties"]["name"] for f in data["sites"]["features"]} > {"Central Yard"}
    again = report.render_top_n_vehicles(enriched, timeline, parcels, routes, folder, "2024-01-15", 1, min_pings=1)
    assert len({p.rsplit("__")[1] for p in again}) == 1
    assert report.render_all_routes_for_day(enriched, timeline, parcels, routes, folder, "2030-01-01") == []
    with pytest.raises(ValueError):
        report.render_routeview(report.payloads(enriched, timeline, parcels, routes, report.targets_of_day(enriched, "2024-01-15", ["R1"], 1)), "R77", "x", "2024-01-15")
    empty = report.render("R1", "v", "2024-01-15", notes=("no <scale> tickets",))
    assert "No loads" in empty and "No parcels" in empty and "no &lt;scale&gt; tickets" in empty
    assert json.loads(re.search(r"const data = (\{.*?\});\n", empty, re.S)[1])["sites"] == {"type": "FeatureCollection", "features": []}


def test_multipolygon_on_a_page(spark):
    two = spark.range(1).select(F.lit("X").alias("Name"), F.concat(geo.box(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), geo.box(*map(F.lit, (5.0, 5.0, 6.0, 6.0)))).alias("segs"))
    assert json.loads(report.facility_layers(two)["landfills"])["features"][0]["geometry"]["type"] == "MultiPolygon"
    assert json.loads(report.facility_layers(two.limit(0))["sites"])["features"] == []

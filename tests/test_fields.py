import io
import zipfile

import pytest
from pyspark.sql import functions as F

from curbflow import cli, report
from curbflow.functions import ids, sites as rules, tickets as ticket_rules
from curbflow.operators import runs, sites, tickets
from curbflow.sources import gps, sheets


def values(spark, column, texts):
    return [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(F.col("t")).alias("v")).collect()]


def test_vehicle_ids(spark):
    good = values(spark, ids.parse_vehicle, ["100001", "100,001", "100001.0", " 100001 "])
    assert {(v.raw, v.prefix, v.number, v.kind) for v in good} == {("100001", "100", "001", "AUTO")}
    assert values(spark, ids.parse_vehicle, ["", "NA", "nan", None, "abc123", "81", "100"]) == [None] * 7
    assert [v.kind for v in values(spark, ids.parse_vehicle, ["300001", "999001"])] == ["MANUAL", "OTHER"]
    assert values(spark, ids.is_our_fleet, ["100001", "300001", None]) == [True, False, False]


def test_site_cleaners(spark):
    assert values(spark, rules.route4, ["22", "1234567", "  081 ", "abc12", "", None]) == ["0022", "4567", "0081", "0012", None, None]
    assert values(spark, rules.day, ["1", "5.0", "6", "0", "x"]) == ["1", "5", None, None, None]
    assert values(spark, rules.week, ["b", "O", " o ", "x", None]) == ["B", "O", "O", None, None]


def test_site_rules(spark):
    part = lambda t: (F.substring(t, 1, 4), F.substring(t, 5, 1), F.nullif(F.substring(t, 6, 1), F.lit("")))
    assert values(spark, lambda t: rules.valid_ref(*part(t)[:2]), ["62081", "62433", "99081", "62086", None]) == [True, False, False, False, False]
    assert values(spark, lambda t: rules.valid_rec(*part(t)), ["62433O", "51453O", "51653O", "62433"]) == [True, True, False, False]
    assert values(spark, lambda t: rules.valid_org(*part(t)[:2]), ["71052", "51652", "51452", "62052"]) == [True, True, False, False]


def test_clean_sites(spark, tmp_path):
    row = dict.fromkeys(sites.COLUMN_MAP, "x") | {"X-Coordinate": "6000000", "Y-Coordinate": "1800000", "Refuse Route": "6208", "Refuse Day Of Week From GIS": "1"}
    far = row | {"X-Coordinate": "0"}
    raw = spark.createDataFrame([tuple(row.values()), tuple(far.values())], [f"{c}" for c in row])
    clean = sites.clean_sites(raw)
    assert [r.route_id_ref for r in clean.collect()] == ["62081"]
    assert sites.write_routes(clean, str(tmp_path / "ref"), "ref") == 1
    with pytest.raises(ValueError):
        sites.clean_sites(raw.drop("ADA"))
    with pytest.raises(KeyError):
        sites.sites_to_geo(clean)


def test_ticket_fields(spark):
    assert values(spark, ticket_rules.fleet_id, ["811,145", "811145.0", "", "NaN", None]) == ["811145", "811145", None, None, None]
    assert [str(v) for v in values(spark, ticket_rules.file_date, ["SCALE_011824.xlsx", "FIELD_139924.xlsx", "x.xlsx"])] == ["2024-01-18", "None", "None"]
    tons = values(spark, lambda t: ticket_rules.tons_text(t.cast("double")), ["1.23451", "1.23459", "2", None])
    assert tons[0] == tons[1] == "1.235" and tons[3] == ""
    assert values(spark, ticket_rules.material_field, ["refuse ", "Christmas Trees", None, "x"]) == ["REFUSE", "OTHER", "ORGANIC", "ORGANIC"]
    assert values(spark, ticket_rules.moment, ["2024-02-30", "2024-02-29", "1/2/2024 3:04", "soon"])[0] is None


def workbook(rows):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join("<row>" + "".join(cell(v) for v in r) + "</row>" for r in rows)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return data.getvalue()


def test_ingest_twice(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "SCALE_011824.xlsx").write_bytes(workbook([["Route#", "TRANSACTION #", "RPT_DT", "TRUCK", "TONS", "MATL_TYP_DESC", "NBR_LOADS", "DUMP LOCATION"], ["R1", "1", "2024-01-18 07:00:00", "100,001", "1.5", "REFUSE", "1", "West"], ["R1", "2", "2024-01-18 08:00:00", "100001", "2.5", "REFUSE", "2", "West"]]))
    (source / "FIELD_011824.xlsx").write_bytes(workbook([["TRAN_NUM", "LD_DT_TM", "RPT_DT", "TONS", "TRUCK", "MATL_TYP_DESC"], ["7", "2024-01-18 09:00:00", "2024-01-18", "3", "100002", "GREENS"], ["8", "2024-01-18 09:30:00", "2024-01-18", "3", "999002", "GREENS"]]))
    (source / "SCALE_011924.xlsx").write_bytes(b"no workbook")
    for _ in range(2):
        registry = runs.run_ingest(spark, str(source), str(tmp_path / "out"))
        assert sorted(r.status for r in registry.collect()) == ["FAIL", "OK", "OK"]
        stored = spark.read.parquet(str(tmp_path / "out" / "tickets"))
        assert {r["source"]: r["count"] for r in stored.groupBy("source").count().collect()} == {"SCALE": 2, "FIELD": 1}
    with pytest.raises(ValueError):
        tickets.new_rows(stored.drop("record_key"), None)
    with pytest.raises(FileNotFoundError):
        sheets.read_csv(spark, str(tmp_path / "none.csv"))


class Counting:
    def __init__(self, spark):
        self.spark, self.calls = spark, 0

    def fetch(self, vehicle_ids, start, end):
        self.calls += 1
        raw = self.spark.createDataFrame([(v, f"{start}T18:00:00Z", "32.7", "-117.2", "5") for v in vehicle_ids], "vehicle_id string, dt_raw string, lat string, lon string, speed_mph string")
        return gps.normalise_rest(raw, start, end)


def test_cache(spark, tmp_path):
    source = Counting(spark)
    assert isinstance(source, gps.GpsSource)
    cache = gps.GpsCache(spark, str(tmp_path / "cache"), source)
    for refresh, calls in ((False, 1), (False, 1), (True, 2)):
        assert cache.vehicle_day("100001", "2024-01-18", refresh).count() == 1 and source.calls == calls
    assert cache.fleet_day(["100001", "100002", "100003"], "2024-01-18").count() == 3 and source.calls == 3


def test_rest_days_and_source(spark):
    raw = spark.createDataFrame([("v", "2024-01-18T06:00:00Z", "1", "2", "3"), ("v", "2024-01-18T18:00:00Z", "1", "2", "x"), ("v", "bad", "1", "2", "3")], "vehicle_id string, dt_raw string, lat string, lon string, speed_mph string")
    rows = gps.normalise_rest(raw, "2024-01-18", "2024-01-18").collect()
    assert [(str(r.dt_local), r.speed_mph) for r in rows] == [("2024-01-18 10:00:00", None)]

    def call(device, start, end):
        return [{"dateTime": start, "latitude": 1.0, "longitude": 2.0, "speed": 50 if device == "a" else None}]

    got = {(r.vehicle_id, str(r.dt_local)): r.speed_mph for r in gps.RestGps(spark, call).fetch(["a", "b"], "2024-01-18", "2024-01-19").collect()}
    assert got == {("a", "2024-01-18 00:00:00"): 31.0, ("a", "2024-01-19 00:00:00"): 31.0, ("b", "2024-01-18 00:00:00"): 0.0, ("b", "2024-01-19 00:00:00"): 0.0}
    with pytest.raises(ValueError):
        gps.RestGps(spark, call, {"a": "1"}).fetch(["z"], "2024-01-18", "2024-01-18")
    with pytest.raises(ValueError):
        gps.RestGps.credentials()


def test_jdbc_normalise(spark):
    raw = spark.sql("SELECT 'v' AS vehicle_id, TIMESTAMP_NTZ'2024-07-01 12:00:00' AS utc_naive, 1D AS lat, 2D AS lon, 50D AS speed_kmh UNION ALL SELECT 'v', NULL, 1D, 2D, 1D")
    assert [(str(r.dt_local), r.speed_mph) for r in gps.normalise_jdbc(raw).collect()] == [("2024-07-01 05:00:00", 31.0)]


def test_page_and_cli(capsys):
    page = report.render("R1", "100001", "2024-01-18", trail='{"type":"FeatureCollection","features":[],"x":"</script>"}', summary={"n_loads": 2})
    assert "{{" not in page and page.count("</script>") == 1 and '"n_loads": 2' in page
    assert cli.main(["version"]) == 0 and cli.main(["modules"]) == 0 and cli.main(["doctor"]) == 0
    assert "curbflow.functions.geo" in capsys.readouterr().out

"""Spreadsheets (.xlsx) and CSV exports, every cell as text."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators.tickets import exists

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
#: Built-in number formats that show dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def rows_of(data: bytes) -> list[list[str | None]]:
    """Rows of a workbook's first sheet. Dates become ISO text."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        dated: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ET.fromstring(book.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.findall("m:numFmts/m:numFmt", _NS) if re.search(r"[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
            dated = {i for i, x in enumerate(styles.findall("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for row in ET.fromstring(book.read(first)).iter(f"{{{_NS['m']}}}row"):
            cells: dict[int, str | None] = {}
            for i, c in enumerate(row.findall("m:c", _NS)):
                value, kind = c.find("m:v", _NS), c.get("t")
                at = _column(c.get("r")) if c.get("r") else i
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif value is None or value.text is None:
                    cells[at] = None
                elif kind == "s":
                    cells[at] = shared[int(value.text)]
                elif kind is None and int(c.get("s", 0)) in dated:
                    cells[at] = (datetime(1899, 12, 30) + timedelta(seconds=round(float(value.text) * 86400))).isoformat(" ")
                else:
                    cells[at] = value.text
            out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
        return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook; its first row names the columns. A workbook is parsed by one task."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                rows = rows_of(data)
                yield pd.DataFrame({"n": range(len(rows)), "cells": [json.dumps(r) for r in rows]})

    cells = files.mapInPandas(run, "n long, cells string").withColumn("cells", F.from_json("cells", "array<string>"))
    head = cells.filter("n = 0").first()
    header = [h for h in (head["cells"] if head else [])]
    return cells.filter("n > 0").select(*[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(header) if h])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column as text."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')

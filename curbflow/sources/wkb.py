"""Well-known binary: decoded once, when a layer is prepared, into the segments that the predicates use."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.functions.geo import SEGMENT

POLYGON, MULTIPOLYGON, COLLECTION = 3, 6, 7


def rings(data: bytes) -> list[list[tuple[float, float]]]:
    """All rings of a polygon or multipolygon; Z and M values and an EWKB reference id are skipped."""
    found: list[list[tuple[float, float]]] = []

    def read(at: int) -> int:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        extra = bool(kind & 0x80000000) + bool(kind & 0x40000000)
        if kind & 0x20000000:
            at += 4
        kind &= 0x1FFFFFFF
        extra += {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000]
        kind %= 1000
        count = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        if kind in (MULTIPOLYGON, COLLECTION):
            for _ in range(count):
                at = read(at)
            return at
        if kind != POLYGON:
            raise ValueError(f"geometry type {kind} is no polygon")
        width = 2 + extra
        for _ in range(count):
            n = struct.unpack_from(order + "I", data, at)[0]
            values = struct.unpack_from(f"{order}{n * width}d", data, at + 4)
            at += 4 + 8 * n * width
            found.append(list(zip(values[::width], values[1::width], strict=True)))
        return at

    read(0)
    return found


def encode_polygon(*own: list[tuple[float, float]]) -> bytes:
    """WKB of a polygon with these rings, which are closed if they are not."""
    out = struct.pack("<BII", 1, POLYGON, len(own))
    for ring in own:
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        out += struct.pack("<I", len(closed)) + b"".join(struct.pack("<2d", *p) for p in closed)
    return out


def segments_of(data: bytes | None) -> list[dict] | None:
    if data is None:
        return None
    out = []
    for ring in rings(bytes(data)):
        closed = ring if ring and ring[0] == ring[-1] else [*ring, *ring[:1]]
        out += [{"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1]} for a, b in zip(closed, closed[1:], strict=False)]
    return out


def encode(column: Column | str) -> Column:
    """Well-known binary of a column of segments that are one ring; null stays null."""

    @F.pandas_udf("binary")
    def run(segs: pd.Series) -> pd.Series:
        return segs.map(lambda own: None if own is None else encode_polygon([(s["x1"], s["y1"]) for s in own]))

    return run(column)


def decode(column: Column | str) -> Column:
    """Segments of a binary column; null stays null."""

    @F.pandas_udf(f"array<{SEGMENT}>")
    def run(data: pd.Series) -> pd.Series:
        return data.map(segments_of)

    return run(column)


def with_segments(layer: DataFrame, column: str | None = None) -> DataFrame:
    """layer with segs, from the named column or the first there is of geom_wkb, geometry and wkb_2230."""
    column = column or next((c for c in ("geom_wkb", "geometry", "wkb_2230") if c in layer.columns), None)
    if column is None or column not in layer.columns:
        raise KeyError(column or "geom_wkb")
    return layer.withColumn("segs", decode(column))

"""Between GeoJSON text and well-known binary, in Arrow batches."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}


def wkb(g: dict) -> bytes:
    kind = g["type"]
    head = struct.pack("<BI", 1, KINDS[kind])
    line = lambda c: struct.pack(f"<I{2 * len(c)}d", len(c), *(v for p in c for v in p[:2]))
    if kind == "GeometryCollection":
        own = g["geometries"]
        return head + struct.pack("<I", len(own)) + b"".join(map(wkb, own))
    c = g["coordinates"]
    if kind == "Point":
        return head + struct.pack("<2d", *(c[:2] if c else (float("nan"),) * 2))
    if kind == "LineString":
        return head + line(c)
    if kind == "Polygon":
        return head + struct.pack("<I", len(c)) + b"".join(map(line, c))
    return head + struct.pack("<I", len(c)) + b"".join(wkb({"type": kind[5:], "coordinates": x}) for x in c)


def to_wkb(df: DataFrame, column: str = "geometry") -> DataFrame:
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == column else f.dataType) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([None if x is None else wkb(json.loads(x)) for x in b.column(column).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([made if c == column else b.column(c) for c in b.schema.names], b.schema.names)

    return df.mapInArrow(run, schema)


def geojson(b: bytes) -> dict:
    """The geometry of a WKB value: either byte order; further dimensions and reference systems are read over."""
    names, at = {v: k for k, v in KINDS.items()}, 0

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(form, b, at)
        at += struct.calcsize(form)
        return out

    def one() -> dict:
        order = "<" if take("<B")[0] else ">"
        (code,) = take(order + "I")
        wide = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            take(order + "I")
        code &= 0x0FFFFFFF
        wide += (0, 1, 1, 2)[code // 1000]
        kind = names[code % 1000]
        count = lambda: take(order + "I")[0]
        dot = lambda: list(take(f"{order}{wide}d")[:2])
        line = lambda: [dot() for _ in range(count())]
        if kind == "Point":
            own = dot()
            return {"type": kind, "coordinates": [] if own[0] != own[0] else own}
        if kind == "LineString":
            return {"type": kind, "coordinates": line()}
        if kind == "Polygon":
            return {"type": kind, "coordinates": [line() for _ in range(count())]}
        parts = [one() for _ in range(count())]
        return {"type": kind, "geometries": parts} if kind == "GeometryCollection" else {"type": kind, "coordinates": [x["coordinates"] for x in parts]}

    return one()


def from_wkb(df: DataFrame, column: str = "geometry") -> DataFrame:
    """df with a WKB column as GeoJSON text."""
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == column else f.dataType) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([None if x is None else json.dumps(geojson(x)) for x in b.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([made if c == column else b.column(c) for c in b.schema.names], b.schema.names)

    return df.mapInArrow(run, schema)

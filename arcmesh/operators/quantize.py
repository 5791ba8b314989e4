"""Bounding boxes, quantization and delta encoding over tables of points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcmesh.functions import geom


def bbox(*tables: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 over the x and y of all tables; NaN is left out, nothing gives nulls."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    parts = [t.agg(F.min(clean("x")).alias("x0"), F.min(clean("y")).alias("y0"), F.max(clean("x")).alias("x1"), F.max(clean("y")).alias("y1")) for t in tables]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def transform_of(box: DataFrame, q: float) -> DataFrame:
    """x0, y0, kx, ky of a box: a step is the extent over q - 1, or 1 if there is no extent."""
    k = lambda a, b: F.when(F.col(b) - F.col(a) == 0, 1.0).otherwise((F.col(b) - F.col(a)) / (q - 1))
    return box.select("x0", "y0", k("x0", "x1").alias("kx"), k("y0", "y1").alias("ky"))


def quantize(lines: DataFrame, t: tuple[float, float, float, float], pts: str = "pts") -> DataFrame:
    x0, y0, kx, ky = (F.lit(float(v)) for v in t)
    return lines.withColumn(pts, geom.quantize_points(pts, x0, y0, kx, ky))


def quantize_xy(points: DataFrame, t: tuple[float, float, float, float]) -> DataFrame:
    x0, y0, kx, ky = (F.lit(float(v)) for v in t)
    return points.withColumn("x", F.rint((F.col("x") - x0) / kx)).withColumn("y", F.rint((F.col("y") - y0) / ky))


def dequantize(lines: DataFrame, t: tuple[float, float, float, float], pts: str = "pts") -> DataFrame:
    x0, y0, kx, ky = (F.lit(float(v)) for v in t)
    return lines.withColumn(pts, geom.dequantize_points(pts, x0, y0, kx, ky))


def _running(pts: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = pa.array(b.column(pts))
            off, body = column.offsets.to_numpy(), column.values
            own, sums = body.slice(off[0], off[-1] - off[0]), []
            starts = (off[:-1] - off[0])[np.diff(off) > 0]
            for name in ("x", "y"):
                v = own.field(name).to_numpy(zero_copy_only=False)
                # each line alone: sums that run over the lines before would leave rounding in floating-point input
                sums.append(np.concatenate([np.cumsum(x) for x in np.split(v, starts[1:])]) if len(starts) else v)
            new = pa.ListArray.from_arrays(pa.array(off - off[0], pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in sums], ["x", "y"]), mask=column.is_null() if column.null_count else None)
            yield pa.RecordBatch.from_arrays([new if c == pts else b.column(c) for c in b.schema.names], b.schema.names)

    return run


def delta_decode(lines: DataFrame, pts: str = "pts") -> DataFrame:
    """lines with absolute points from delta-encoded ones: running sums, over Arrow batches, as no column
    function sums an array in one pass."""
    return lines.mapInArrow(_running(pts), lines.schema)

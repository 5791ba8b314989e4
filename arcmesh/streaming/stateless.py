"""Stream adapter for the operators that need one line at a time: quantize, simplify and delta encoding.
Topology itself is global and has no streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame

from arcmesh.functions import geom
from arcmesh.operators import quantize, simplify


def encode_stream(lines: DataFrame, grid: tuple[float, float, float, float] | None = None, eps: float = 0.0, algorithm: str = "dp", delta: bool = True) -> DataFrame:
    """A streaming (or plain) table with pts: simplified, put on a fixed grid and delta encoded."""
    out = simplify.simplify(lines, eps, algorithm)
    if grid:
        out = quantize.quantize(out, grid)
        if delta:
            out = out.withColumn("pts", geom.delta_encode("pts"))
    return out

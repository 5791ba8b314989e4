"""Between lines (ring_id, pts) and vertices (ring_id, pos, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vertices(lines: DataFrame) -> DataFrame:
    keep = [c for c in lines.columns if c != "pts"]
    return lines.select(*keep, F.posexplode("pts").alias("pos", "p")).select(*keep, "pos", "p.x", "p.y")


def collected(verts: DataFrame, by: list[str], order: str = "pos") -> DataFrame:
    """Points of each group in order; the order is part of what is sorted, as a shuffle keeps none."""
    own = F.array_sort(F.collect_list(F.struct(order, "x", "y")))
    return verts.groupBy(*by).agg(F.transform(own, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("pts"))

"""Validity of rings: closed, four points, an area, and no segments that cross."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcmesh.functions import geom
from arcmesh.operators.junctions import default_cell, segments, with_cells


def crossings(verts: DataFrame, cell: float) -> DataFrame:
    """ring_id of the rings with two segments that properly cross, found by grid cells."""
    cells = with_cells(segments(verts), cell)
    a = cells.toDF("ring_id", "p", "ax", "ay", "bx", "by", "cx", "cy")
    b = cells.toDF("ring_id", "q", "ux", "uy", "vx", "vy", "cx", "cy")
    side = lambda o, p, q: f"sign(({p}x - {o}x) * ({q}y - {o}y) - ({p}y - {o}y) * ({q}x - {o}x))"
    cross = f"{side('a', 'b', 'u')} * {side('a', 'b', 'v')} < 0 and {side('u', 'v', 'a')} * {side('u', 'v', 'b')} < 0"
    return a.join(b, ["ring_id", "cx", "cy"]).filter(f"p < q and {cross}").select("ring_id").distinct()


def invalid_rings(lines: DataFrame, cell: float | None = None) -> DataFrame:
    """ring_id of the invalid among lines (ring_id, pts, is_ring): rings that are open, short, without area
    or cross themselves; open lines need two distinct points. cell: of the grid by which crossings are
    found, else a few segments wide."""
    from arcmesh.operators.lines import vertices

    ring = (F.size("pts") >= 4) & geom.is_closed("pts") & (geom.signed_area("pts") != 0)
    line = F.size(F.array_distinct("pts")) >= 2
    bad = lines.filter(F.when(F.col("is_ring"), ~ring).otherwise(~line)).select("ring_id")
    verts = vertices(lines.filter("is_ring").select("ring_id", "pts"))
    return bad.union(crossings(verts, cell or default_cell(verts))).distinct()

"""Lines to arcs and references without a facade, for tables that are already points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from arcmesh.operators import cut, dedup, junctions
from arcmesh.operators.tables import settled


@dataclass(frozen=True)
class Encoded:
    junctions: DataFrame
    slots: DataFrame
    arcs: DataFrame
    refs: DataFrame


def encode(lines: DataFrame, cell: float, shared_coords: bool = False, exact: bool = True) -> Encoded:
    """lines: ring_id, pts, is_ring. cell: about the length of a few segments."""
    found = settled(junctions.lines_coords_connected(lines) if shared_coords else junctions.lines_connected(lines, cell, exact))
    slots = cut.cut_lines(lines, found, None if shared_coords else cell, exact)
    return Encoded(found, slots, *dedup.arcs_and_refs(slots))

"""From references back to points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcmesh.functions import geom


def stitched(refs: DataFrame, arcs: DataFrame) -> DataFrame:
    """ring_id, pts: arcs in order, backward ones reversed, without the repeated point where two meet."""
    at = refs.select("ring_id", "seq", F.expr("if(signed_ref < 0, -signed_ref - 1, signed_ref)").alias("arc_id"), F.col("signed_ref") < 0)
    own = at.toDF("ring_id", "seq", "arc_id", "back").join(arcs.select("arc_id", "pts"), "arc_id").withColumn("pts", geom.reverse_if("pts", F.col("back")))
    part = F.array_sort(F.collect_list(F.struct("seq", "pts")))
    rest = lambda v: F.slice(v["pts"], F.lit(2), F.greatest(F.size(v["pts"]) - 1, F.lit(0)))
    return own.groupBy("ring_id").agg(F.flatten(F.transform(part, lambda v, i: F.when(i == 0, v["pts"]).otherwise(rest(v)))).alias("pts"))


def padded(lines: DataFrame) -> DataFrame:
    """Polygon rings of under 3 points and lines of under 2 are filled up with their first point."""
    need = F.expr("if(geom_type in ('Polygon', 'MultiPolygon'), 3, 2)")
    fill = F.array_repeat(F.get("pts", F.lit(0)), F.greatest(need - F.size("pts"), F.lit(0)))
    return lines.withColumn("pts", F.concat("pts", fill))

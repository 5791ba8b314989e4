"""Connected components over link tables; nothing of the graph reaches the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arcmesh.llm.store import forget, written


def components(links: DataFrame) -> DataFrame:
    """v, label (the smallest vertex reachable) for every vertex of links (a, b): labels spread along
    the links and then jump to their label's label, so long chains halve in each round. Labels are
    merged, not broadcast: equal ones make their files, by which the planner goes, far smaller than their rows."""
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("w")).union(links.select("b", "a")).filter("u <> w").distinct(), "edges")
    labels = written(edges.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.hint("merge"), edges.w == labels.v).groupBy("u").agg(F.min("label").alias("m"))
        spread = labels.hint("merge").join(near, labels.v == near.u).select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = spread.select(F.col("v").alias("t"), F.col("label").alias("up"))
        seen = Observation()  # counted while the table is written, not by a job of its own
        jumped = spread.join(up, spread.label == up.t).select("v", "old", F.least("label", "up").alias("label")).observe(seen, F.count_if(F.expr("old <> label")).alias("moved"))
        new = written(jumped.select("v", "label"), "labels")
        forget(labels)
        labels = new
        if not seen.get["moved"]:
            forget(edges)
            return labels

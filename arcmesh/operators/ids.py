"""Dense numbers without an unpartitioned window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense_ids(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """df with 0..n-1 in the given order: range partitions, their sizes, then places within them. Only
    the sizes, a row per partition, come to the driver."""
    from arcmesh.operators.tables import settled
    from arcmesh.sources.features import local

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r.p, total))
        total += r.n
    at = F.broadcast(local(df.sparkSession, starts, "_part long, _start long"))
    return placed.join(at, part == at._part).withColumn(name, (F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_place", "_part", "_start")

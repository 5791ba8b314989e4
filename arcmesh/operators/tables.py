"""Tables written to the folder that driver and executors share, to cut lineage between stages.

A stage is read several times by the next one; written once, it is neither computed nor planned again,
and a lost executor costs only the tasks that it had.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:  # local sessions and tests
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="arcmesh-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/arcmesh-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """df dealt by keys to partitions of about each rows, so that a task's memory doesn't grow with the table:
    partitions of a number that is given are not merged by their compressed size."""
    return df.repartition(max(1, -(-rows // each)), *keys)

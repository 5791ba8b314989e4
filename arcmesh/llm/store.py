"""Row keys, and tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; one of our own only where it is unset in a local session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="arcmesh-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settle(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage: Spark drops shuffle files and broadcasts only when the driver
    finds them unused, and each stage leaves blocks of 4 MB, for which its heap grows rather than being collected."""
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Cut the lineage: write df as a table of the shared folder and read it back. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arcmesh-{name}-{uuid.uuid4().hex}"
    settle(spark)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete written() tables that no later step reads."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles() if "/arcmesh-" in x}:
            with contextlib.suppress(Exception):
                p = sc._jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def keyed(df: DataFrame, key: str = "rk") -> DataFrame:
    """df with a number for each row: its partition and place. Two scans of the same files give the
    same numbers, so rows can be joined on it even where doc_id repeats or is null."""
    return df.withColumn(key, F.monotonically_increasing_id())


def arrow_batches(spark: SparkSession) -> None:
    """Bounds of the batches handed to Python, in rows and in bytes, since texts can be long. Always the
    same ones: plans are lazy, and the session has one setting for all of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def local(spark: SparkSession, rows: Sequence[tuple], schema: pa.Schema) -> DataFrame:
    """Rows that the driver holds, as a relation of the plan: it can be broadcast without a job, which
    rows that go through an RDD need."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))


def give_back() -> None:
    """Freed memory of this Python process goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, giving freed memory back to the system when its task ends: Python workers live on for later
    tasks, and what they keep is missing to the executor meanwhile."""

    def own(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

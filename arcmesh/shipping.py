"""Makes the package importable in executors that do not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        _sent.add(sc.applicationId)
        here = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="arcmesh-ship-")) / "arcmesh.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(archive))
    return spark

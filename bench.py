"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

from arcmesh.queries import QUERIES
from arcmesh.shipping import ship

#: Many small polygons, crossing lines, long trajectories.
HEADLINE = ("topology_encode", "junctions_coords", "signed_refs_bricks", "decode_rings", "cut_lines", "quantize_lines", "delta_encode", "simplify_dp", "simplify_vw")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    QUERIES["signed_area"](spark, sf).count()  # starts the session's threads
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr)
        spark.catalog.clearCache()
    found = re.search(r"sf([\d.]+)", sf)
    print(json.dumps({"metric": "topology_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(found[1]) if found else None}))


if __name__ == "__main__":
    main()

"""Where queries that write put their tables: the folder that the cluster shares, or one of our own on one machine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def root(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or 'file:///tmp/checkpoints'}/quarry-tables"

"""What a session runs on, for results that carry their timing."""

from __future__ import annotations

import platform

from pyspark.sql import SparkSession


def describe(spark: SparkSession) -> dict:
    context = spark.sparkContext
    return {
        "spark": spark.version,
        "python": platform.python_version(),
        "machine": platform.machine(),
        "master": context.master,
        "parallelism": context.defaultParallelism,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }

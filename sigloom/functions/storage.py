"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where none is named, a local session (tests) gets one of its own; on a cluster that
    is an error, since executors elsewhere could not read the driver's folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir has to name a shared folder on {master or 'a cluster'}")
        path = tempfile.mkdtemp(prefix="sigloom-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The table survives the loss of any executor, and the optimizer sees its true
    size, so later joins pick their strategy by measured bytes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``cut``, dealt into ``buckets`` by ``key``: later joins and groupings by ``key`` need no shuffle of this side.

    The table is written where ``cut`` writes and leaves the catalogue once it is read,
    so nothing but its files remain.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out

"""Tables of segments under one folder, laid out so that keyed access and keyed joins are cheap.

Every table of a folder is dealt into the same number of buckets by hash of the key, one
file per bucket and write, sorted by the key within it. Then

- tables joined by the key need no shuffle, whatever their size;
- a lookup of few keys opens the buckets of these keys only, and within them the pages
  whose smallest and largest key admit one of them;
- a scan of a range of keys reads a slice of each bucket.

A table is immutable. Writing it again, or updating some of its columns, makes a new
version in a folder of its own; readers take the newest version that was written to its
end, so a driver lost half way leaves the old one in force. Versions are kept until
``prune``. Keys are not null; a repeated key gives a row each time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = "segment_id"

#: Bytes of a page before compression: the least that a lookup reads of a column.
PAGE_BYTES = 256 * 1024

#: Values that one pushed IN filter holds exactly; Parquet gets longer ones as a range.
PUSHED = 10

_VERSION = re.compile(r"v(\d{6})-b(\d+)-k(\w+)$")


def _versions(spark: SparkSession, root: str, name: str) -> list[tuple[int, int, str, str]]:
    """(version, buckets, key, path) of the complete versions of a table, the oldest first; the folder is listed through Spark's file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    found = []
    for status in store.listStatus(folder):
        at = _VERSION.search(status.getPath().getName())
        if at and store.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append((int(at[1]), int(at[2]), at[3], status.getPath().toString()))
    return sorted(found)


def exists(spark: SparkSession, root: str, name: str) -> bool:
    return bool(_versions(spark, root, name))


def buckets(spark: SparkSession, root: str, name: str) -> int | None:
    """The number of buckets of table ``name``, None if there is none."""
    return (_versions(spark, root, name) or [(0, None)])[-1][1]


def write(df: DataFrame, root: str, name: str, buckets: int, key: str = KEY) -> DataFrame:
    """A new version of table ``name``; tables that are to be joined take the same ``buckets``."""
    spark = df.sparkSession
    version = max((v for v, *_ in _versions(spark, root, name)), default=0) + 1
    path, table = f"{root}/{name}/v{version:06d}-b{buckets}-k{key}", f"store_{uuid.uuid4().hex}"
    # An empty table has no files that could tell its columns.
    spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{name}/v{version:06d}-schema")
    dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
    dealt.option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", 1000).option("path", path).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")
    return read(spark, root, name)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest complete version of table ``name``, with its buckets known to the optimizer; ValueError if there is none."""
    found = _versions(spark, root, name)
    if not found:
        raise ValueError(f"no table {name} under {root}")
    version, buckets, key, path = found[-1]
    table = f"store_{uuid.uuid4().hex}"
    schema = StructType.fromJson(json.loads(spark.read.text(f"{root}/{name}/v{version:06d}-schema").first()[0]))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external table: its files stay
    return out


def lookup(rows: DataFrame, ids: Sequence[int], key: str = KEY) -> DataFrame:
    """The rows of a table with one of ``ids``, a list that the caller holds; for a table of ids, join with it.

    The list is pushed down in parts of ``PUSHED`` neighbours, each of which Parquet takes value by value.
    """
    wanted = sorted(set(ids))
    if not wanted:
        return rows.where(F.lit(False))
    parts = [F.col(key).isin(wanted[at : at + PUSHED]) for at in range(0, len(wanted), PUSHED)]
    while len(parts) > 1:  # a balanced tree, so that long lists don't nest deeply
        parts = [a | b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) - len(parts) % 2 :]
    return rows.where(parts[0])


def between(rows: DataFrame, first: int, last: int, key: str = KEY) -> DataFrame:
    """The rows with a key from ``first`` to ``last``, both included."""
    return rows.where(F.col(key).between(first, last))


def update(spark: SparkSession, root: str, name: str, values: DataFrame) -> DataFrame:
    """A new version of table ``name`` in which rows take the columns of ``values`` (its key and some columns) where it has their key, null values too.

    Only this table is written; others that share its key stay as they are. Of keys that
    ``values`` repeats, the row whose values sort first counts; keys that the table lacks
    are an error, as are columns it lacks.
    """
    _, buckets, key, _ = (_versions(spark, root, name) or [(0, 0, "", "")])[-1]
    old = read(spark, root, name)
    changed = [c for c in values.columns if c != key]
    if unknown := set(changed) - set(old.columns):
        raise ValueError(f"table {name} has no columns {sorted(unknown)}")
    kinds = {f.name: f.dataType for f in old.schema}
    cast = values.select(F.col(key).cast(kinds[key]).alias(key), F.struct(*(F.col(c).cast(kinds[c]).alias(c) for c in changed)).alias("__new"))
    new = cast.groupBy(key).agg(F.min("__new").alias("__new"))
    if stray := new.join(old.select(key), key, "left_anti").select(key).limit(5).collect():
        raise ValueError(f"table {name} has no rows {[r[0] for r in stray]}")
    kept = [F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns]
    return write(old.join(new, key, "left").select(*kept), root, name, buckets, key)


def prune(spark: SparkSession, root: str, name: str) -> int:
    """Delete all versions of table ``name`` but the newest complete one; returns how many went. Nobody may be reading them."""
    jvm = spark.sparkContext._jvm
    older = _versions(spark, root, name)[:-1]
    for *_, path in older:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(older)

"""Versioned training datasets: Parquet by split, with a manifest of counts and digests, and a tree of digests by id."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sigloom import __version__
from sigloom.config import CLASS_GROUPS, DRONES
from sigloom.functions.storage import cut
from sigloom.operators.catalog import class_group, encode_labels, filter_dataset
from sigloom.operators.order import running_sums
from sigloom.sources import merkle

COLUMNS = ("segment_id", "measurement_id", "rd_db", "y_group", "y_label", "y_drone", "paper_split", "split_grouped")

NAMED = 8  # damaged ranges that an error names


def load_specs(spark: SparkSession, path: str) -> list[dict]:
    """Dataset specifications from a YAML or JSON file with a list ``datasets``."""
    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    try:
        import yaml

        return yaml.safe_load(text)["datasets"]
    except ImportError:
        return json.loads(text)["datasets"]


def digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest that does not depend on their order or partitioning.

    Each row's columns are hashed; the hashes are added up as four numbers, so one row per
    partition moves.
    """
    row = F.sha2(F.to_json(F.struct(*COLUMNS)).cast("binary"), 256)
    parts = [F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = rows.select(*(p.alias(f"p{k}") for k, p in enumerate(parts))).agg(F.count("*").alias("n"), *(F.sum(f"p{k}").alias(f"s{k}") for k in range(4))).first()
    return sums["n"], "-".join(f"{int(sums[f's{k}'] or 0):x}" for k in range(4))


def export(segments: DataFrame, spec: dict, path: str, source: str = "", seed: int = 0) -> dict:
    """Write the rows of ``segments`` that ``spec`` selects, and the manifest; returns the manifest."""
    spark = segments.sparkSession
    rows = encode_labels(filter_dataset(segments, spec.get("filters")))
    ordered = rows.select(*COLUMNS, "label").repartitionByRange("split_grouped", "segment_id").sortWithinPartitions("split_grouped", "segment_id")
    ordered.write.mode("overwrite").partitionBy("split_grouped").parquet(f"{path}/data")
    written = _rows(spark, path)
    _index(written).write.mode("overwrite").parquet(f"{path}/index")
    n, total = digest(written)
    merkle.tree(written, "segment_id", COLUMNS).write.mode("overwrite").parquet(f"{path}/tree")
    of_array = merkle.roots(spark.read.parquet(f"{path}/tree"), COLUMNS)[1]
    grouped = written.withColumn("class_group", class_group(F.col("label"))).groupBy("paper_split", "split_grouped", "class_group").count().collect()  # splits by classes
    count = lambda c: {str(s): {g: sum(r["count"] for r in grouped if (r[c], r["class_group"]) == (s, g)) for g in CLASS_GROUPS} for s in (1, 2, 3)}
    labels = [r[0] for r in written.select("label").distinct().orderBy("label").collect()]
    manifest = {
        "dataset": spec["name"],
        "version": str(spec["version"]),
        "description": spec.get("description", ""),
        "engine_version": __version__,
        "source": source,
        "filters": spec.get("filters") or {},
        "n_segments": n,
        "class_maps": {"y_group": list(CLASS_GROUPS), "y_label": labels, "y_drone": list(DRONES)},
        "splits": {"paper_split": "by segment", "split_grouped": f"by linked measurements, seed {seed}"},
        "counts_paper_split": count("paper_split"),
        "counts_grouped_split": count("split_grouped"),
        "digest": total,
        "array_digests": of_array,
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(column, first_id, last_id): ranges of ids whose arrays are not those that were written."""
    return merkle.damage(spark.read.parquet(f"{path}/tree"), merkle.tree(_rows(spark, path), "segment_id", COLUMNS), COLUMNS)


def read(spark: SparkSession, path: str, split_kind: str = "grouped", split: int | None = 1, task: str = "group", verify: bool = False) -> DataFrame:
    """(segment_id, x, y): normalised maps and targets of a split; rows without a target are left out.

    ``verify`` holds the rows against the manifest and raises ValueError if they differ;
    the error names the first damaged arrays and ranges of ids.
    """
    rows = _rows(spark, path)
    if verify:
        said = manifest(spark, path)
        if (said["n_segments"], said["digest"]) != digest(rows):
            wrong = damaged(spark, path).orderBy("first_id", "column").limit(NAMED).collect()
            places = ", ".join(f"{r['column']} at {r['first_id']} to {r['last_id']}" for r in wrong)
            raise ValueError(f"{path} does not match its manifest: {places or 'the manifest or its tree was changed'}")
    return _items(rows, split_kind, split, task)


def _chosen(split_kind: str, split: int | None) -> Column:
    return F.lit(True) if split is None else F.col({"paper": "paper_split", "grouped": "split_grouped"}[split_kind]) == split


def _items(rows: DataFrame, split_kind: str, split: int | None, task: str) -> DataFrame:
    rows = rows.where(_chosen(split_kind, split))
    x = F.transform("rd_db", lambda v: F.least(F.greatest(v, F.lit(-5.0)), F.lit(60.0)) / 30)
    y = F.col("y_group" if task == "group" else "y_drone")
    return rows.where(y >= 0).select("segment_id", x.alias("x"), y.cast("long").alias("y"))


def _index(written: DataFrame) -> DataFrame:
    """Rows of each file by split and task, with the file's first id: a few rows per file, written with the export."""
    file = F.substring_index(F.col("_metadata.file_path"), "/data/", -1)
    with_target = (F.sum((F.col(y) >= 0).cast("long")).alias(n) for y, n in (("y_group", "n_group"), ("y_drone", "n_drone")))
    return written.groupBy(file.alias("file"), "split_grouped", "paper_split").agg(F.min("segment_id").alias("first_id"), *with_target)


class Items:
    """Items of a split by position: ``len(items)`` reads the index alone, ``items[i]`` one file.

    Positions follow the grouped split, then the segment id, of which an export has one row
    each. Rows without a target have no position. Negative positions count from the end;
    others beyond the split raise IndexError. Where the index or a null split leaves no
    rows, the length is zero.
    """

    def __init__(self, spark: SparkSession, path: str, split_kind: str = "grouped", split: int | None = 1, task: str = "group"):
        self.spark, self.path, self.choice = spark, path, (split_kind, split, task)
        rows = spark.read.parquet(f"{path}/index").where(_chosen(split_kind, split))
        files = rows.groupBy("split_grouped", "file").agg(F.min("first_id").alias("first_id"), F.sum("n_group" if task == "group" else "n_drone").alias("n"))
        self.places = cut(running_sums(files.where("n > 0"), ["split_grouped", "first_id", "file"], ["n"]), "places")
        self.length = self.places.agg(F.sum("n")).first()[0] or 0

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, i: int) -> Row:
        """The item (segment_id, x, y) at position ``i``."""
        if not -self.length <= i < self.length:
            raise IndexError(f"position {i} of {self.length}")
        i %= self.length
        at = self.places.where((F.col("before_n") <= i) & (F.col("before_n") + F.col("n") > i)).first()
        rows = _items(self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/{at['file']}"), *self.choice)
        ident = rows.select("segment_id").orderBy("segment_id").offset(i - at["before_n"]).limit(1).first()[0]  # ids alone are put in order
        return rows.where(F.col("segment_id") == ident).first()

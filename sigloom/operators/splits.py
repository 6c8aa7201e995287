"""Leakage-safe splits: measurements that share a segment stay together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.config import Quality
from sigloom.functions.storage import cut
from sigloom.operators.graph import connected_components
from sigloom.operators.order import running_sums

TRAIN, VALIDATION, TEST = 1, 2, 3


def groups_of(measurements: DataFrame, links: DataFrame) -> DataFrame:
    """``measurements`` (measurement_id, label, n_segments) with ``group_id``, the least linked measurement."""
    roots = connected_components(links.select("a", "b"))
    joined = measurements.join(roots.select(F.col("node").alias("measurement_id"), "root"), "measurement_id", "left")
    return joined.withColumn("group_id", F.coalesce("root", "measurement_id")).drop("root")


#: Shares of splits are whole numbers of this part, so that comparing what splits lack is exact.
PARTS = 10_000


def _ahead(lacks: list, j: int, size) -> list:
    """For split j and each other one: how many of its picks come before pick 0 of j, below zero where j is ahead by more.

    Pick i of split k has the place of ``lacks[k] - i * size`` from the top, the lower
    split first among equals.
    """
    ahead = []
    for k in range(3):
        if k < j:
            ahead.append((lacks[k] - lacks[j]) // size + 1)
        elif k > j:
            ahead.append(-((lacks[j] - lacks[k]) // size))
    return ahead


def _taken(lacks: list[int], size: int, picks: int) -> list[int]:
    """How many of the first ``picks`` groups of one size each split gets."""
    if size == 0:
        return [picks if j == lacks.index(max(lacks)) else 0 for j in range(3)]
    taken = []
    for j in range(3):
        ahead, low, high = _ahead(lacks, j, size), 0, picks
        while low < high:
            i = (low + high) // 2
            low, high = (i + 1, high) if i + sum(max(0, a + i) for a in ahead) < picks else (low, i)
        taken.append(low)
    return taken


def _fill(shares: tuple[int, ...]):
    """Sizes of a label from the largest down: what each split lacks, in parts, before groups of that size are placed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lacks = [0, 0, 0]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["seen"] == 0:
                    lacks = [share * r["total"] - PARTS * taken for share, taken in zip(shares, (0, r["second"], r["smallest"]))]
                out.append(r | {"lacks": list(lacks)})
                picks = max(0, min(r["count"], r["n"] - 2 - r["seen"]))
                lacks = [lack - PARTS * r["size"] * k for lack, k in zip(lacks, _taken(lacks, PARTS * r["size"], picks))]
            columns = {c: [r[c] for r in out] for c in ("label", "size", "first", "seen", "n", "lacks")}
            yield pa.RecordBatch.from_arrays([pa.array(v, type=_RUN[c]) for c, v in columns.items()], list(columns))

    return run


_RUN = {"label": pa.string(), "size": pa.int64(), "first": pa.int64(), "seen": pa.int64(), "n": pa.int64(), "lacks": pa.list_(pa.int64())}


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The split of each group by its place among those of its size, as picking one after the other would give it."""
    for batch in batches:
        place = batch["place"].to_numpy()
        lacks = np.stack([batch[f"lacks_{j}"].to_numpy() for j in range(3)])
        found = lacks.argmax(axis=0)  # sizes of zero change nothing
        size = batch["size"].to_numpy() * PARTS
        step = np.maximum(size, 1)
        for j in range(3):
            ahead = _ahead(lacks, j, step)
            for used in ([], ahead[:1], ahead[1:], ahead):  # the splits that have picks before this one
                i = (place - sum(used)) // (len(used) + 1)
                rank = i + sum(np.maximum(0, a + i) for a in ahead)
                found = np.where((size > 0) & (i >= 0) & (rank == place), j, found)
        yield pa.RecordBatch.from_arrays([batch["group_id"], pa.array((found + 1).astype(np.int32))], ["group_id", "split_grouped"])


def grouped_split(measurements: DataFrame, links: DataFrame, seed: int = 0, config: Quality = Quality()) -> DataFrame:
    """(measurement_id, group_id, split_grouped).

    A group has the label of its largest member. Per label: one group trains; of two the
    smaller tests; of more the smallest tests, the second smallest validates, and the
    others go, largest first, where most is lacking. Groups of equal size are ordered by
    a hash of ``seed`` and the group, so a split does not depend on partitioning.

    What is sequential is done per distinct size, of which a label of n segments has at
    most the root of 2 n: those few rows stream through one task. Places among groups of
    one size are running counts over ranges, and each group finds its split by its place
    alone. A null label is a label of its own; a null size counts as zero.
    """
    grouped = groups_of(measurements, links)
    largest = F.struct("n_segments", F.sha1(F.col("measurement_id").cast("string").cast("binary")).alias("h"), F.col("label").cast("string").alias("label"))
    sums = grouped.groupBy("group_id").agg(F.max(largest)["label"].alias("label"), F.coalesce(F.sum("n_segments"), F.lit(0)).cast("long").alias("size"))
    sums = sums.withColumn("tie", F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("group_id").cast("string")).cast("binary"))).withColumn("one", F.lit(1))
    placed = cut(running_sums(sums, ["label", "size", "tie", "group_id"], ["one"]), "placed")
    runs = placed.groupBy("label", "size").agg(F.count("*").alias("count"), F.min("before_one").alias("first"))
    down = Window.partitionBy("label").orderBy(F.desc("size"))  # one row a size
    up = Window.partitionBy("label").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.when(F.first("count").over(up) > 1, F.first("size").over(up)).otherwise(F.nth_value("size", 2).over(up))
    runs = runs.select(
        "*", (F.sum("count").over(down) - F.col("count")).alias("seen"), F.sum("count").over(up).alias("n"), F.sum(F.col("size") * F.col("count")).over(up).alias("total"),
        F.first("size").over(up).alias("smallest"), F.coalesce(second, F.lit(0)).alias("second"),
    )
    parts = int(measurements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = tuple(round(share * PARTS) for share in config.fractions)
    filled = runs.repartition(parts, "label").sortWithinPartitions("label", F.desc("size"))
    filled = filled.mapInArrow(_fill(shares), "r_label string, r_size long, first long, seen long, n long, lacks array<long>")
    rows = placed.join(filled, F.col("label").eqNullSafe(F.col("r_label")) & (F.col("size") == F.col("r_size")))
    place = F.col("before_one") - F.col("first")
    rank = F.col("seen") + place
    rows = rows.withColumn("place", place.cast("long")).withColumn("fixed", (
        F.when(F.col("n") == 1, TRAIN)
        .when(F.col("n") == 2, F.when(rank == 0, TRAIN).otherwise(TEST))
        .when(rank == F.col("n") - 1, TEST)
        .when(rank == F.col("n") - 2, VALIDATION)
    ))
    kind = measurements.schema["measurement_id"].dataType.simpleString()
    free = rows.where("fixed is null").select("group_id", "place", "size", *(F.col("lacks")[j].alias(f"lacks_{j}") for j in range(3)))
    chosen = rows.where("fixed is not null").select("group_id", F.col("fixed").alias("split_grouped"))
    chosen = chosen.union(free.mapInArrow(_pick, f"group_id {kind}, split_grouped int"))
    return grouped.join(chosen, "group_id").select("measurement_id", "group_id", "split_grouped")


def leakage(segments: DataFrame, *columns: str) -> DataFrame:
    """Measurements that are in more than one split, for each split column."""
    out = None
    for name in columns:
        per = segments.groupBy("measurement_id").agg(F.countDistinct(name).alias("k"))
        row = per.agg(F.sum((F.col("k") > 1).cast("bigint")).alias("measurements_in_multiple_splits"), F.count("*").alias("measurements"))
        row = row.select(F.lit(name).alias("split_kind"), "*")
        out = row if out is None else out.unionByName(row)
    return out

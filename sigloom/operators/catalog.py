"""The two-level catalogue: measurements and their segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.config import CLASS_GROUPS, DRONES
from sigloom.functions.storage import cut
from sigloom.operators.order import running_sums

ONE_TASK_ROWS = 1_000_000  # segments of a measurement that one window takes


def class_group(label: Column) -> Column:
    """Class group of a label; what is no drone, human or reflector is a bird."""
    return (
        F.when(label.rlike("^D[0-9]+$"), CLASS_GROUPS[0])
        .when(label.startswith("human"), CLASS_GROUPS[2])
        .when(label == "CR", CLASS_GROUPS[3])
        .otherwise(CLASS_GROUPS[1])
    )


def sequence_segments(raw: DataFrame, most: int = ONE_TASK_ROWS) -> DataFrame:
    """``raw`` with ``idx_in_measurement`` from 0 by time and ``gap_before_s``, null for the first segment.

    A measurement of more than ``most`` segments goes by ranges of the order instead of
    one window, with the same result.
    """
    largest = raw.groupBy("measurement_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        return _sequence_by_range(raw)
    w = Window.partitionBy("measurement_id").orderBy("time_s", "segment_id")
    return raw.withColumn("idx_in_measurement", F.row_number().over(w) - 1).withColumn("gap_before_s", F.col("time_s") - F.lag("time_s").over(w))


def _sequence_by_range(raw: DataFrame) -> DataFrame:
    """Places are running counts less those before the measurement; the first row of a range looks at the last of earlier ranges."""
    spark = raw.sparkSession
    keys = ["measurement_id", "time_s", "segment_id"]
    ranged = cut(raw.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("__range", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("__range").agg(F.count("*").alias("__n"), F.max(F.struct(*keys)).alias("__last"))
    earlier = Window.orderBy("__range")  # one row per range
    ends = ends.select("__range", F.coalesce(F.sum("__n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"), F.lag("__last").over(earlier).alias("__prev"))
    inside = Window.partitionBy("__range").orderBy(*keys)
    here = F.struct("measurement_id", "time_s")
    placed = ranged.join(ends, "__range").withColumn("__at", F.col("__o") + F.row_number().over(inside) - 1)
    before = F.coalesce(F.lag(here).over(inside), F.struct(F.col("__prev.measurement_id").alias("measurement_id"), F.col("__prev.time_s").alias("time_s")))
    placed = cut(placed.withColumn("__before", before), "placed")
    first = placed.groupBy(F.col("measurement_id").alias("__m")).agg(F.min("__at").alias("__first"))
    joined = placed.join(first, F.col("measurement_id").eqNullSafe(F.col("__m")))
    index = (F.col("__at") - F.col("__first")).cast("int")
    gap = F.when(F.col("__at") > F.col("__first"), F.col("time_s") - F.col("__before.time_s"))
    return joined.select(*raw.columns, index.alias("idx_in_measurement"), gap.alias("gap_before_s"))


def summarise_measurements(segments: DataFrame, *more: str) -> DataFrame:
    """One row per measurement: class, size, duration. ``more`` columns are constant within a measurement."""
    sums = segments.groupBy("measurement_id").agg(
        F.min("label").alias("label"),
        F.count("*").alias("n_segments"),
        (F.max("time_s") - F.min("time_s")).alias("duration_s"),
        *(F.min(c).alias(c) for c in more),
    )
    return sums.withColumn("class_group", class_group(F.col("label")))


def mark_repeats(segments: DataFrame) -> DataFrame:
    """``segments`` with ``duplicate``: 1 if an earlier segment has the same hash; null hashes count as one.

    The first segment of each hash comes from a pre-aggregated group-by, so a hash that
    very many segments share is neither sorted nor held in one task.
    """
    first = segments.groupBy(F.col("sha1").alias("first_sha1")).agg(F.min("segment_id").alias("first_segment"))
    marked = segments.join(first, F.col("sha1").eqNullSafe(F.col("first_sha1"))).withColumn("duplicate", (F.col("segment_id") > F.col("first_segment")).cast("int"))
    return marked.select("sha1", *(c for c in segments.columns if c != "sha1"), "duplicate")


def duplicate_links(segments: DataFrame) -> DataFrame:
    """(a, b): each measurement linked to the first one that has one of its hashes."""
    per = segments.select("sha1", "measurement_id").distinct()
    first = per.groupBy("sha1").agg(F.min("measurement_id").alias("a"))
    return per.join(first, "sha1").where(F.col("measurement_id") != F.col("a")).select("a", F.col("measurement_id").alias("b")).distinct()


def duplicate_pairs(segments: DataFrame) -> DataFrame:
    """Pairs of equal segments per ordered pair of measurements, counted without forming them.

    (meas_a, meas_b, duplicate_pairs, pairs_across_paper_splits): meas_a has the segment
    with the smaller id; null hashes are equal to none. Segments of one hash and one measurement that
    follow each other by id are one run with a count per split, and pairs within a
    measurement follow from its counts alone. Only runs are laid beside the other
    measurements of their hash, each with the counts of that measurement before it. Runs
    and running counts go by ranges of the order, so no task holds all rows of a hash; the
    work grows with the runs of a hash times its measurements.
    """
    splits = [r[0] for r in segments.select("paper_split").distinct().collect() if r[0] is not None]  # train, validation and test
    sizes = ["n", *(f"n_{k}" for k in splits)]
    added = [F.count("*").alias("n"), *(F.count(F.when(F.col("paper_split") == k, 1)).alias(f"n_{k}") for k in splits)]
    shared = cut(segments.groupBy("sha1").agg(F.count("*").alias("n")).where("n > 1").select("sha1"), "shared")  # a table of its own lets joins split a hot hash
    rows = segments.join(shared, "sha1", "left_semi").select("sha1", "segment_id", "measurement_id", "paper_split")

    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, "sha1", "segment_id").withColumn("range", F.spark_partition_id()), "ranges")
    place = Window.partitionBy("range").orderBy("sha1", "segment_id")
    last = lambda c: F.lag(c).over(place)
    new = ~(F.col("sha1").eqNullSafe(last("sha1")) & F.col("measurement_id").eqNullSafe(last("measurement_id")))
    marked = ranged.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut(marked.groupBy("range", "run", "sha1", "measurement_id").agg(*added), "runs")  # a run that a range ends is two

    two = lambda n: F.col(n) * (F.col(n) - 1) / 2
    owners = cut(runs.groupBy("sha1", "measurement_id").agg(*(F.sum(c).alias(c) for c in sizes)), "owners")
    alike = sum((two(f"n_{k}") for k in splits), F.lit(0))
    within = owners.select(F.col("measurement_id").alias("meas_a"), F.col("measurement_id").alias("meas_b"), two("n").cast("bigint").alias("all"), alike.cast("bigint").alias("same"))

    several = cut(owners.groupBy("sha1").agg(F.count("*").alias("m")).where("m > 1").select("sha1"), "several")
    beside = runs.join(several, "sha1", "left_semi").join(owners.select("sha1", F.col("measurement_id").alias("meas_a")), "sha1")
    own = beside.select("*", *(F.when(F.col("measurement_id") == F.col("meas_a"), F.col(c)).otherwise(0).alias(f"own_{c}") for c in sizes))
    counted = cut(running_sums(own, ["sha1", "meas_a", "range", "run"], [f"own_{c}" for c in sizes]), "counted")
    base = cut(counted.groupBy("sha1", "meas_a").agg(*(F.min(f"before_own_{c}").alias(f"base_{c}") for c in sizes)), "base")
    before = {c: F.col(f"before_own_{c}") - F.col(f"base_{c}") for c in sizes}
    same = sum((before[f"n_{k}"] * F.col(f"n_{k}") for k in splits), F.lit(0))
    other = counted.where(F.col("measurement_id") != F.col("meas_a")).join(base, ["sha1", "meas_a"])
    between = other.select("meas_a", F.col("measurement_id").alias("meas_b"), (before["n"] * F.col("n")).alias("all"), same.cast("bigint").alias("same"))
    return within.unionByName(between).where(F.col("all") > 0).groupBy("meas_a", "meas_b").agg(
        F.sum("all").alias("duplicate_pairs"), F.sum(F.col("all") - F.col("same")).alias("pairs_across_paper_splits")
    )


def encode_labels(segments: DataFrame) -> DataFrame:
    """``segments`` with y_group, y_label and y_drone: places in the lists of groups, of labels in order, and of drones (-1: none)."""
    place = lambda names: F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))
    vocabulary = segments.select("label").distinct()
    numbered = vocabulary.withColumn("y_label", F.row_number().over(Window.orderBy("label")) - 1)  # one row per label
    out = segments.join(numbered, "label", "left")
    return out.withColumn("y_group", F.try_element_at(place(CLASS_GROUPS), class_group(F.col("label")))).withColumn(
        "y_drone", F.coalesce(F.try_element_at(place(DRONES), F.col("label")), F.lit(-1))
    )


#: Columns that a dataset's filter may name.
FILTER_COLUMNS = frozenset({"edge_flag", "rule_flags", "low_snr", "time_gap", "paper_split", "split_grouped"})


def filter_dataset(segments: DataFrame, filters: dict[str, int] | None) -> DataFrame:
    """Rows that equal ``filters`` in every column named; a column off the list is an error."""
    filters = filters or {}
    if wrong := set(filters) - FILTER_COLUMNS:
        raise ValueError(f"filter columns not allowed: {sorted(wrong)}")
    for name, value in filters.items():
        segments = segments.where(F.col(name) == value)
    return segments

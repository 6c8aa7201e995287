"""Stages of the batch pipeline, each reading and writing tables under one folder.

Tables with a row per segment are laid out by ``sources.store``: bucketed and sorted by
``segment_id`` alike, so joins of the catalogue, features, arrays and scores need no
shuffle, and a column is updated by writing its own table anew.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.config import CLASS_GROUPS, FEATURES, Quality, Radar
from sigloom.functions import signals
from sigloom.operators import catalog, evaluate, rules, splits
from sigloom.sources import store


def _write(df: DataFrame, root: str, name: str) -> DataFrame:
    """Tables of segments in as many buckets as the arrays have, others as plain Parquet."""
    spark = df.sparkSession
    if "segment_id" in df.columns:
        buckets = store.buckets(spark, root, "segments_iq") or int(spark.conf.get("spark.sql.shuffle.partitions"))
        out = store.write(df, root, name, buckets)
        store.prune(spark, root, name)
        return out
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return spark.read.parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return store.read(spark, root, name) if store.exists(spark, root, name) else spark.read.parquet(f"{root}/{name}")


def update_columns(spark: SparkSession, root: str, name: str, values: DataFrame) -> DataFrame:
    """Rows of table ``name`` with the columns of ``values`` by ``segment_id``; no other table is written."""
    return store.update(spark, root, name, values)


def lookup(spark: SparkSession, root: str, name: str, ids: list[int]) -> DataFrame:
    """Segments by id: few buckets and pages are read."""
    return store.lookup(read(spark, root, name), ids)


def scan(spark: SparkSession, root: str, name: str, first: int, last: int) -> DataFrame:
    """Segments of a range of ids, both ends included."""
    return store.between(read(spark, root, name), first, last)


def ingest(raw_segments: DataFrame, root: str, radar: Radar, seed: int = 0, config: Quality = Quality()) -> dict:
    """Write ``segments_iq``, ``segments_base`` and ``measurements``; returns the counts."""
    spark = raw_segments.sparkSession
    iq = _write(raw_segments.select("segment_id", "iq_re", "iq_im"), root, "segments_iq")
    hashed = raw_segments.drop("iq_re", "iq_im").join(signals.measure(iq, radar, ("sha1",)), "segment_id")
    base = _write(catalog.sequence_segments(hashed), root, "segments_sequenced")
    measured = catalog.summarise_measurements(base)
    links = catalog.duplicate_links(base)
    placed = splits.grouped_split(measured.select("measurement_id", "label", "n_segments"), links, seed, config)
    measurements = _write(measured.join(placed.drop("group_id"), "measurement_id"), root, "measurements")
    final = base.join(placed.select("measurement_id", "split_grouped"), "measurement_id")
    segments = _write(catalog.mark_repeats(final), root, "segments_base")
    sums = segments.agg(F.count("*").alias("n"), F.sum("edge_flag").alias("edge"), F.sum("duplicate").alias("dup")).first()
    by_label = measurements.groupBy("label", "class_group", "split_grouped").agg(F.sum("n_segments").alias("n"), F.count("*").alias("m")).collect()  # labels by splits
    total = lambda key, value, what="n": sum(r[what] for r in by_label if r[key] == value)
    return {
        "n_measurements": measurements.count(),
        "n_segments": sums["n"],
        "n_edge_flagged": int(sums["edge"] or 0),
        "n_exact_duplicate_segments": int(sums["dup"] or 0),
        "segments_per_label": {k: total("label", k) for k in sorted({r["label"] for r in by_label})},
        "measurements_per_label": {k: total("label", k, "m") for k in sorted({r["label"] for r in by_label})},
        "segments_per_class_group": {k: total("class_group", k) for k in CLASS_GROUPS},
        "grouped_split_counts": {str(k): total("split_grouped", k) for k in (1, 2, 3)},
        "grouped_split_measurements": {str(k): total("split_grouped", k, "m") for k in (1, 2, 3)},
        "paper_split_counts": {str(r[0]): r[1] for r in segments.groupBy("paper_split").count().collect()},
    }


def process(spark: SparkSession, root: str, radar: Radar) -> DataFrame:
    """Write ``features`` and ``rd_maps``; returns the features."""
    measured = _write(signals.measure(read(spark, root, "segments_iq"), radar, ("features", "map")), root, "measured")
    _write(measured.select("segment_id", "rd_db"), root, "rd_maps")
    return _write(measured.drop("rd_db"), root, "features")


def assess(spark: SparkSession, root: str, radar: Radar, n_per_fault: int = 500, seed: int = 0, config: Quality = Quality(), trees: int = 300, cae_epochs: int = 15) -> DataFrame:
    """Write ``rule_stats``, ``rule_thresholds``, ``quality``, ``anomaly``, ``false_alarms`` and ``fault_table``; returns the fault table."""
    base, features, iq = (read(spark, root, n) for n in ("segments_base", "features", "segments_iq"))
    marks = base.select("segment_id", F.col("duplicate").cast("double").alias("duplicate"))
    stats = _write(signals.rule_table(iq, radar).join(marks, "segment_id"), root, "rule_stats")
    train = base.where("edge_flag = 0 and split_grouped = 1").select("segment_id")
    thresholds = rules.calibrate(stats.join(train, "segment_id", "left_semi"), config)
    spark.createDataFrame(list(thresholds.items()), "rule string, threshold double").write.mode("overwrite").parquet(f"{root}/rule_thresholds")
    segments = base.join(iq, "segment_id")
    found = rules.apply(stats, thresholds).select("segment_id", "rule_flags", "rule_score")
    flagged = rules.quality_flags(base.join(features.select("segment_id", "snr_db"), "segment_id"), config).select("segment_id", "low_snr", "time_gap")
    _write(found.join(flagged, "segment_id"), root, "quality")
    fitted = evaluate.Detectors(segments, radar, config, seed, trees, cae_epochs)
    scores = fitted.scores.select("segment_id", F.col("cae").alias("anomaly_score"), F.col("iforest").alias("anomaly_score_iforest"))
    _write(scores, root, "anomaly")
    _write(evaluate.false_alarms(fitted, segments), root, "false_alarms")
    return _write(evaluate.fault_table(segments, radar, n_per_fault, seed, config, trees, fitted), root, "fault_table")


def segments_view(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue rows with their class group, features, quality and anomaly scores, null where a stage has not run."""
    out = read(spark, root, "segments_base").withColumn("class_group", catalog.class_group(F.col("label")))
    stages = (("features", FEATURES), ("quality", ("rule_flags", "rule_score", "low_snr", "time_gap")), ("anomaly", ("anomaly_score", "anomaly_score_iforest")))
    for name, columns in stages:
        if store.exists(spark, root, name):
            out = out.join(read(spark, root, name), "segment_id", "left")
        else:
            out = out.select("*", *(F.lit(None).cast("double").alias(c) for c in columns))
    return out


def load_json(spark: SparkSession, path: str) -> dict:
    """A result document as ``save_json`` wrote it."""
    return json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", "true").text(path).collect()))  # one small document


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """A result of the batch runner."""
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path)


def save_json(spark: SparkSession, document: dict, path: str) -> None:
    """Write a small result document as one JSON text."""
    spark.createDataFrame([(json.dumps(document, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)

"""The registered queries: operators applied to the given tables through their adapters."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.config import FAULTS, FEATURES, INTEGRITY_RULES, SMALL, STAT_RULES
from sigloom.functions import faults, signals
from sigloom.functions.storage import cut, fresh_path
from sigloom.operators import anomaly, catalog, classify, evaluate, graph, order, rules, splits, training
from sigloom.plans.oracles import MERKLE_COLUMNS, digits
from sigloom.plans.sqlrun import SQL_DIR, run_sql
from sigloom.sources import adapters as A
from sigloom.sources import export, merkle

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = A.order_segments(spark, sf_dir).join(A.customer_labels(spark, sf_dir).drop("class_group"), "measurement_id")
    return catalog.summarise_measurements(labelled, "split_grouped")


def _catalog_sql(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = {"segments": A.order_segments(spark, sf_dir), "measurements": _measurements(spark, sf_dir)}
        return run_sql(spark, SQL_DIR / f"{name}.sql", views)

    run.__name__ = name
    return run


for _name in ("class_balance_per_split", "segments_per_measurement", "split_leakage", "time_gaps"):
    QUERIES[_name] = _catalog_sql(_name)


def _rounded(df: DataFrame, names, places: int | None = None) -> DataFrame:
    return df.select("segment_id", *((F.round(n, places or digits(n)) + 0.0).alias(n) for n in names))  # no negative zeros


def _stats(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Signals' catalogue rows, and their rule statistics with the duplicate mark, measured in one pass with ``more``."""
    measured = cut(signals.measure(A.vector_arrays(spark, sf_dir), SMALL, ("rules", "sha1", *more)), "measured")
    marked = catalog.mark_repeats(measured).withColumn("duplicate", F.col("duplicate").cast("double")).drop("sha1")
    return A.vector_catalog(spark, sf_dir), cut(marked, "stats")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.feature_table(A.vector_arrays(spark, sf_dir), SMALL)


def _thresholds(segments: DataFrame, stats: DataFrame) -> dict[str, float]:
    train = segments.where("edge_flag = 0 and split_grouped = 1").select("segment_id")
    return rules.calibrate(stats.join(train, "segment_id", "left_semi"))


@query
def snr_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = A.vector_catalog(spark, sf_dir).join(_features(spark, sf_dir), "segment_id")
    return run_sql(spark, SQL_DIR / "snr_by_class.sql", {"segments": joined.withColumn("class_group", catalog.class_group(F.col("label")))})


@query
def quality_flags_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, stats = _stats(spark, sf_dir, "features")
    ruled = rules.apply(stats, _thresholds(segments, stats)).select("segment_id", "rule_flags", "snr_db")
    joined = segments.join(ruled, "segment_id")
    return run_sql(spark, SQL_DIR / "quality_flags_per_class.sql", {"segments": rules.quality_flags(joined)})


@query
def duplicate_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.document_segments(spark, sf_dir)
    names = docs.groupBy("measurement_id").agg(F.min("label").alias("label"))
    return run_sql(spark, SQL_DIR / "duplicate_segments.sql", {"duplicate_pairs": catalog.duplicate_pairs(docs), "measurements": names})


@query
def gap_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.order_segments(spark, sf_dir).select("segment_id", "measurement_id", "idx_in_measurement", F.round("gap_before_s", 6).alias("gap_before_s"))


@query
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = cut(A.event_segments(spark, sf_dir), "events")
    found = order.quantiles(events, ["measurement_id"], "gap_before_s", {"gap_median": 0.5, "gap_p10": 0.1, "gap_p90": 0.9})
    sums = events.groupBy("measurement_id").agg(F.count("*").alias("n"), F.sum((F.col("gap_before_s") > 3600).cast("bigint")).alias("long_gaps"))
    return sums.join(found, "measurement_id", "left").select("measurement_id", "n", *(F.round(c, 6).alias(c) for c in ("gap_median", "gap_p10", "gap_p90")), "long_gaps")


@query
def measurement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measurements(spark, sf_dir).select("measurement_id", "label", "class_group", "n_segments", F.round("duration_s", 6).alias("duration_s"), "split_grouped")


@query
def first_seen_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.mark_repeats(A.document_segments(spark, sf_dir)).select("segment_id", "sha1", "duplicate")


@query
def duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicate_links(A.document_segments(spark, sf_dir))


@query
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.document_segments(spark, sf_dir)
    roots = graph.connected_components(catalog.duplicate_links(docs))
    return docs.select("measurement_id").distinct().join(roots, F.col("measurement_id") == F.col("node"), "left").select("measurement_id", F.coalesce("root", "measurement_id").alias("root"))


@query
def segments_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _measurements(spark, sf_dir).groupBy("label")
    return sums.agg(F.sum("n_segments").alias("n_segments"), F.count("*").alias("n_measurements"))


@query
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = A.order_segments(spark, sf_dir)
    count = lambda c: segments.groupBy(F.col(c).alias("split")).agg(F.count("*").alias("n"), F.countDistinct("measurement_id").alias("measurements")).select(F.lit(c).alias("split_kind"), "*")
    return count("paper_split").unionByName(count("split_grouped"))


@query
def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.encode_labels(_measurements(spark, sf_dir)).select("measurement_id", "label", "y_group", "y_label", "y_drone")


@query
def dataset_filter_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.filter_dataset(A.order_segments(spark, sf_dir), {"edge_flag": 0, "split_grouped": 1})
    return rows.select("segment_id", "measurement_id", "paper_split", "split_grouped")


@query
def dataset_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filter_dataset(A.order_segments(spark, sf_dir), {}).select("segment_id", "measurement_id", "paper_split", "split_grouped")


@query
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.filter_dataset(A.order_segments(spark, sf_dir), {"edge_flag": 0})
    labelled = rows.join(A.customer_labels(spark, sf_dir), "measurement_id")
    return labelled.groupBy(F.col("split_grouped").alias("split"), "class_group").agg(F.count("*").alias("n"))


@query
def score_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order.quantiles(A.document_scores(spark, sf_dir), ["label"], "score", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return found.select("label", *(F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")))


@query
def recall_at_fa(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.recall_at(A.document_scores(spark, sf_dir), "score", "positive")
    return found.select(F.round("threshold", 6).alias("threshold"), F.round("recall", 9).alias("recall"))


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order.roc_auc(A.document_scores(spark, sf_dir), "score", "positive")
    return found.select("n_pos", "n_neg", F.round("roc_auc", 9).alias("roc_auc"))


@query
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(A.document_scores(spark, sf_dir), F.col("score"), ["positive"])


@query
def false_alarm_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = A.document_scores(spark, sf_dir).where("clean")
    threshold = order.quantile(clean.where("split_grouped = 1"), "score", 0.99)
    rate = F.round(F.avg((F.col("score") > F.lit(threshold)).cast("double")), 9)
    return clean.groupBy(F.col("split_grouped").alias("split")).agg(F.count("*").alias("n"), rate.alias("false_alarm_rate"))


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = A.document_scores(spark, sf_dir)
    return scores.withColumn("guess", F.col("word_score") > F.lit(order.quantile(scores, "word_score", 0.5)))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_guesses(spark, sf_dir), "positive", "guess")


@query
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.macro_f1(_guesses(spark, sf_dir), "positive", "guess")
    return found.select(F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.class_weights(_measurements(spark, sf_dir), "label")
    return found.select("label", "n", F.round("weight", 9).alias("weight"))


def _spectra(spark: SparkSession, sf_dir: str, kernel, schema: str) -> DataFrame:
    """Rows that ``kernel`` makes of each segment's samples, as columns after the id."""
    return signals.rows_of(A.vector_arrays(spark, sf_dir), kernel, schema, SMALL)


@query
def dft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(x: np.ndarray) -> tuple:
        p = signals.power_spectrum(x)
        cell, at = np.indices(p.shape[1:]).reshape(2, -1)
        hz = signals.doppler_hz(SMALL.n_slow, SMALL)[at]
        return cell, at - SMALL.n_slow // 2, hz, p.reshape(len(p), -1)

    rows = _spectra(spark, sf_dir, kernel, "cell int, bin int, doppler_hz double, power double")
    return rows.select("segment_id", "cell", "bin", F.round("doppler_hz", 6).alias("doppler_hz"), F.round("power", 9).alias("power"))


@query
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = lambda x, radar: {"noise_floor": signals.floor_of(signals.power_spectrum(x))}
    return _rounded(signals.over_segments(A.vector_arrays(spark, sf_dir), kernel, ("noise_floor",), SMALL), ["noise_floor"], 9)


@query
def cfar_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(x: np.ndarray, radar) -> dict[str, np.ndarray]:
        hit, threshold = signals.cfar(signals.power_spectrum(x)[:, radar.centre], radar)
        return {"detections": hit.sum(axis=1).astype(float), "threshold_sum": threshold.sum(axis=1)}

    found = signals.over_segments(A.vector_arrays(spark, sf_dir), kernel, ("detections", "threshold_sum"), SMALL)
    return found.select("segment_id", F.col("detections").cast("bigint").alias("detections"), F.round("threshold_sum", 6).alias("threshold_sum"))


@query
def stft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(x: np.ndarray) -> tuple:
        p = signals.power_spectrum(signals.frames(x[:, SMALL.centre], SMALL))
        frame, at = np.indices(p.shape[1:]).reshape(2, -1)
        return frame, at - SMALL.stft_size // 2, p.reshape(len(p), -1)

    rows = _spectra(spark, sf_dir, kernel, "frame int, bin int, power double")
    return rows.select("segment_id", "frame", "bin", F.round("power", 9).alias("power"))


@query
def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_features(spark, sf_dir), FEATURES)


@query
def feature_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = A.vector_catalog(spark, sf_dir).select("segment_id", catalog.class_group(F.col("label")).alias("class_group"))
    joined = groups.join(_features(spark, sf_dir), "segment_id")
    long = joined.select("class_group", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES))).alias("v"))
    found = order.quantiles(long.select("class_group", "v.feature", "v.value"), ["class_group", "feature"], "value", {"median": 0.5})
    wide = found.groupBy("class_group").pivot("feature", list(FEATURES)).agg(F.first("median"))
    return wide.select("class_group", *((F.round(f, digits(f)) + 0.0).alias(f) for f in FEATURES))


@query
def rd_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(x: np.ndarray, radar) -> dict[str, np.ndarray]:
        p = signals.power_spectrum(x)
        level = signals.normalise(signals.decibel(p) - signals.decibel(signals.floor_of(p))[:, None, None])
        return {"mean_level": level.mean(axis=(1, 2))}

    return _rounded(signals.over_segments(A.vector_arrays(spark, sf_dir), kernel, ("mean_level",), SMALL), ["mean_level"])


@query
def signed_log_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), anomaly.signed_log(F.col("value")).alias("x"))
    sums = rows.groupBy("label").agg(
        F.count("*").alias("n"), F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    return sums.select("label", "n", *(F.round((F.col(c) - F.col("mu")) / F.col("sd"), 6).alias(c) for c in ("low", "high")))


@query
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of consecutive events of a user whose value is large.

    Events with the same number of small ones before them are one run, so no window goes over a user.
    """
    events = A.event_segments(spark, sf_dir).select("measurement_id", "idx_in_measurement", F.coalesce(F.col("value") > 10, F.lit(False)).alias("big"))
    placed = order.running_sums(events.withColumn("small", (~F.col("big")).cast("bigint")), ["measurement_id", "idx_in_measurement"], ["small"])
    runs = placed.groupBy("measurement_id", "before_small").agg(F.count(F.when(F.col("big"), 1)).alias("n"))
    return runs.groupBy("measurement_id").agg(F.max("n").alias("longest_run"))


@query
def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_stats(spark, sf_dir)[1], INTEGRITY_RULES)


@query
def rule_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _thresholds(*_stats(spark, sf_dir))
    return spark.range(1).select(*(F.round(F.lit(found[r]), 6).alias(r) for r in STAT_RULES))


@query
def rule_flags_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, stats = _stats(spark, sf_dir)
    return rules.apply(stats, _thresholds(segments, stats)).select("segment_id", "rule_flags")


@query
def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, stats = _stats(spark, sf_dir)
    return rules.apply(stats, _thresholds(segments, stats)).select("segment_id", F.round("rule_score", 6).alias("rule_score"))


@query
def rule_flags_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, stats = _stats(spark, sf_dir)
    marked = rules.firing(stats.join(segments.select("segment_id", catalog.class_group(F.col("label")).alias("class_group")), "segment_id"), _thresholds(segments, stats))
    return marked.groupBy("rule", "class_group").agg(F.sum(F.col("fired").cast("bigint")).alias("n_flagged"), F.count("*").alias("n"))


@query
def group_exemplar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of each class group whose signal-to-noise ratio is nearest to the group's median."""
    groups = A.vector_catalog(spark, sf_dir).select("segment_id", catalog.class_group(F.col("label")).alias("class_group"))
    table = cut(_features(spark, sf_dir).select("segment_id", "snr_db").join(groups, "segment_id"), "snr")
    medians = order.quantiles(table, ["class_group"], "snr_db", {"median": 0.5})
    off = F.round(F.abs(F.col("snr_db") - F.col("median")), 6)
    return table.join(medians, "class_group").groupBy("class_group").agg(F.min_by("segment_id", F.struct(off, "segment_id")).alias("segment_id"))


@query
def rules_firing_per_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = cut(A.vector_signals(spark, sf_dir), "signals")
    stats = _stats(spark, sf_dir)[1]
    return evaluate.firing_rates(segments.where("edge_flag = 0 and split_grouped = 3"), segments, SMALL, _thresholds(segments, stats))


@query
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    alike = F.sha1(F.concat_ws("|", "sha1", F.floor(F.col("range_m") / 2000)).cast("binary"))  # with the price, so that few customers are linked
    links = A.order_segments(spark, sf_dir).withColumn("sha1", alike)
    return splits.grouped_split(_measurements(spark, sf_dir).select("measurement_id", "label", "n_segments"), catalog.duplicate_links(links))


def _injection(fault: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        segments = A.vector_arrays(spark, sf_dir)
        rows = faults.with_donors(segments, segments) if fault == "duplicate_segment" else segments
        made = faults.inject(rows, fault, SMALL).select("segment_id", F.col("iq_re").alias("f_re"), F.col("iq_im").alias("f_im"))
        both = segments.join(made, "segment_id")
        sample = F.zip_with(F.arrays_zip("iq_re", "iq_im"), F.arrays_zip("f_re", "f_im"), lambda a, b: (a["iq_re"] != b["f_re"]) | (a["iq_im"] != b["f_im"]))
        changed = F.size(F.filter(sample, lambda x: x)).cast("long")
        zero = F.size(F.filter(F.arrays_zip("f_re", "f_im"), lambda x: (x["f_re"] == 0) & (x["f_im"] == 0))).cast("long")
        size = lambda c: F.aggregate(c, F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double") * v.cast("double"))
        peak = F.greatest(F.array_max(F.transform("f_re", lambda v: F.abs(v))), F.array_max(F.transform("f_im", lambda v: F.abs(v))))
        return both.select(
            "segment_id", F.round(size("f_re") + size("f_im"), 3).alias("energy"), changed.alias("n_changed"), zero.alias("n_zero"), F.round(peak.cast("double"), 5).alias("peak")
        )

    run.__name__ = f"inject_{fault}"
    return run


for _fault in FAULTS:
    QUERIES[f"inject_{_fault}"] = _injection(_fault)


@query
def pca_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cut(_features(spark, sf_dir), "features")
    model = anomaly.fit_components(table.select(*FEATURES))
    return anomaly.score_rows(table, "segment_id", "pca_error", model.error)


@query
def iforest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cut(_features(spark, sf_dir), "features")
    model = anomaly.fit_forest(table, "segment_id")
    return anomaly.score_rows(table, "segment_id", "iforest", model.score)


@query
def recon_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = cut(signals.rd_table(A.vector_arrays(spark, sf_dir), SMALL), "maps")
    model = anomaly.fit_components(maps.select("rd_db"), k=32, squeeze=False, scale=False)
    return anomaly.score_rows(maps.select("segment_id", "rd_db"), "segment_id", "recon_error", model.error)


@query
def cae_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = signals.rd_table(A.vector_arrays(spark, sf_dir), SMALL)
    maps = cut(raw.select("segment_id", signals.scaled_map(F.col("rd_db")).alias("rd_norm")), "maps")
    model = training.fit_autoencoder(maps, "segment_id", "rd_norm", SMALL.n_range, SMALL.n_slow)
    return anomaly.score_rows(maps, "segment_id", "cae_error", model.error)


@query
def fault_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = cut(A.vector_signals(spark, sf_dir), "signals")
    return evaluate.fault_table(segments, SMALL, n_per_fault=500)


@query
def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regressions on features, and convolutional networks on maps, in the same experiments."""
    segments, stats = _stats(spark, sf_dir, "features", "map")
    flagged = rules.apply(stats, _thresholds(segments, stats)).select("segment_id", "rule_flags", signals.scaled_map(F.col("rd_db")).alias("rd_norm"), *FEATURES)
    joined = flagged.join(segments.select("segment_id", "label", "edge_flag", "paper_split", "split_grouped"), "segment_id")
    table = cut(joined.withColumn("class_group", catalog.class_group(F.col("label"))), "training")
    with ThreadPool(2) as pool:  # the regressions' many small jobs run beside the networks' steps
        thread = inheritable_thread_target(spark)
        logistic = pool.apply_async(thread(lambda: classify.experiments(table, FEATURES)))
        networks = pool.apply_async(thread(lambda: classify.network_experiments(table, SMALL.n_range)))
        return logistic.get().unionByName(networks.get())


@query
def export_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.vector_catalog(spark, sf_dir).join(signals.rd_table(A.vector_arrays(spark, sf_dir), SMALL), "segment_id")
    spec = {"name": "rd_clean", "version": "1.0", "description": "clean segments", "filters": {"edge_flag": 0}}
    path = fresh_path(spark, "export")
    made = export.export(rows, spec, path, source="embeddings")
    read = export.read(spark, path, split_kind="grouped", split=None, task="group", verify=True)
    sums = read.groupBy("y").agg(F.count("*").alias("n"), F.min("segment_id").alias("first"), F.max("segment_id").alias("last"))
    return sums.withColumn("verified", F.lit(made["n_segments"] == read.count()))


@query
def merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' columns by ranges of ids, of the ranges by ranges, and of the whole."""
    made = merkle.tree(A.table(spark, sf_dir, "documents"), "doc_id", MERKLE_COLUMNS)
    return made.withColumn("node", F.col("node").cast("string"))

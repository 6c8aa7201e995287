"""Detectors held against real and injected faults, and classifier metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.config import FAULTS, FEATURES, Quality, Radar
from sigloom.functions import faults, signals
from sigloom.functions.storage import cut
from sigloom.operators import anomaly, catalog, rules, training
from sigloom.operators.order import quantile, running_sums

LEARNED = ("iforest", "pca", "recon", "cae")
METHODS = ("rules", *LEARNED, "rules_or_recon", "rules_or_cae")


def recall_at(scores: DataFrame, score: str, positive: str, share: float = 0.01) -> DataFrame:
    """(threshold, recall): the quantile of negatives that ``share`` of them exceed, and the share of positives above it."""
    threshold = quantile(scores.where(~F.col(positive)), score, 1 - share)
    above = F.avg((F.col(score) > F.lit(threshold)).cast("double"))
    return scores.where(positive).agg(F.lit(threshold).alias("threshold"), above.alias("recall"))


def histogram(df: DataFrame, value: Column, groups: list[str], bins: int = 40, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(groups, bin, n) of log10 of ``value`` clipped to two quantiles of all rows; the last bin is closed."""
    finite = F.when(F.isnan(value) | (value == float("inf")), 1e30).otherwise(value)
    rows = df.withColumn("__v", F.log10(F.least(F.greatest(finite, F.lit(1e-6)), F.lit(1e30))))
    lo, hi = quantile(rows, "__v", low), quantile(rows, "__v", high)
    if lo is None or lo == hi:
        return rows.groupBy(*groups).agg(F.count("*").alias("n")).withColumn("bin", F.lit(0))
    clipped = F.least(F.greatest(F.col("__v"), F.lit(lo)), F.lit(hi))
    at = F.least(F.floor((clipped - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*groups, at.alias("bin")).agg(F.count("*").alias("n"))


def macro_f1(pairs: DataFrame, label: str, predicted: str, *by: str) -> DataFrame:
    """(accuracy, macro_f1) over the labels that occur, each label counting alike; a row for each ``by``, with the ``n`` pairs."""
    counts = pairs.groupBy(*by, F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    right = F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0))
    by_label = counts.groupBy(*by, "l").agg(F.sum("n").alias("support"), right.alias("hit"))
    by_guess = counts.groupBy(*by, F.col("p").alias("l")).agg(F.sum("n").alias("guessed"))
    each = by_label.join(by_guess, [*by, "l"], "left").withColumn("f1", 2 * F.col("hit") / (F.col("support") + F.coalesce("guessed", F.lit(0))))
    more = [F.sum("support").alias("n")] if by else []
    return each.groupBy(*by).agg((F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), *more)


def confusion(pairs: DataFrame, label: str, predicted: str) -> DataFrame:
    return pairs.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): one over the root of the frequency, with mean one over labels."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    raw = counts.withColumn("raw", 1 / F.sqrt("n"))
    mean = raw.agg(F.avg("raw")).first()[0]
    return raw.select("label", "n", (F.col("raw") / F.lit(mean)).alias("weight"))


def _odd(score: Callable[[np.ndarray], np.ndarray], v: np.ndarray) -> np.ndarray:
    """``score`` of each row; rows that are not finite are infinitely odd."""
    whole = np.isfinite(v).all(axis=1)
    return np.where(whole, score(np.where(whole[:, None], v, 0.0)), np.inf) if len(v) else np.zeros(0)


class Detectors:
    """Rules and detectors fitted on clean training segments, thresholds set on clean validation segments."""

    def __init__(self, segments: DataFrame, radar: Radar, config: Quality = Quality(), seed: int = 0, trees: int = 300, cae_epochs: int = 15):
        self.radar, self.config = radar, config
        self.stats = cut(self.measure(segments), "stats")
        joined = self.stats.join(segments.select("segment_id", "edge_flag", "split_grouped"), "segment_id")
        train = joined.where("edge_flag = 0 and split_grouped = 1")
        self.thresholds = rules.calibrate(train, config)
        self.forest = anomaly.fit_forest(train.select("segment_id", *FEATURES), "segment_id", trees=trees, seed=seed)
        self.pca = anomaly.fit_components(train.select(*FEATURES))
        self.recon = anomaly.fit_components(train.select("rd_norm"), k=32, squeeze=False, scale=False)
        settings = training.Settings(cae_epochs, 512, 128, 1e-3, 0.0, one_cycle=False, seed=seed)
        self.cae = training.fit_autoencoder(train, "segment_id", "rd_norm", radar.n_range, radar.n_slow, settings)
        self.scores = cut(self.score(self.stats), "scores")
        validation = self.scores.join(joined.where("edge_flag = 0 and split_grouped = 2").select("segment_id"), "segment_id", "left_semi")
        found = {m: quantile(validation, m, config.ml_percentile) for m in LEARNED}
        self.limits = {m: float("inf") if v is None else v for m, v in found.items()}  # no validation rows: no alarms

    def measure(self, segments: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Features, rule statistics, map and duplicate mark of ``segments``; ``known`` hashes count as seen."""
        clipped = F.transform("rd_db", lambda v: F.least(F.greatest(v, F.lit(-5.0)), F.lit(60.0)) / 30)
        measured = signals.measure(segments, self.radar).withColumn("rd_norm", clipped).drop("rd_db")
        if known is None:
            return catalog.mark_repeats(measured).withColumn("duplicate", F.col("duplicate").cast("double"))
        marked = known.select("sha1").distinct().withColumn("hit", F.lit(1.0))
        return measured.join(marked, "sha1", "left").withColumn("duplicate", F.coalesce("hit", F.lit(0.0))).drop("hit")

    def score(self, stats: DataFrame) -> DataFrame:
        """(segment_id, rule_flags, rules, iforest, pca, recon, cae), all detectors in one pass over ``stats``."""
        shared = stats.sparkSession.sparkContext.broadcast((self.forest, self.pca, self.recon, self.cae))
        k = len(FEATURES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, pca, recon, cae = shared.value
            for batch in signals.lots(batches, 256):
                v = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(3, 3 + k)], axis=1).reshape(batch.num_rows, k)
                maps = batch.column(3 + k).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                found = [pa.array(_odd(f, x)) for f, x in ((forest.score, v), (pca.error, v), (recon.error, maps), (cae.error, maps))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found], ["segment_id", "rule_flags", "rules", *LEARNED])

        ruled = rules.apply(stats, self.thresholds).select("segment_id", "rule_flags", F.col("rule_score").alias("rules"), *FEATURES, "rd_norm")
        return ruled.mapInArrow(run, "segment_id long, rule_flags long, rules double, iforest double, pca double, recon double, cae double")

    def long(self, scores: DataFrame) -> DataFrame:
        """(segment_id, method, score, alarm): rules alarm at one, the others beyond their limit."""
        alarm = {m: F.col(m) > self.limits[m] for m in self.limits} | {"rules": F.col("rules") >= 1.0}
        value = {m: F.col(m) for m in ("rules", *LEARNED)}
        for m in ("recon", "cae"):
            alarm[f"rules_or_{m}"] = alarm["rules"] | alarm[m]
            value[f"rules_or_{m}"] = F.greatest("rules", F.try_divide(F.col(m), F.lit(self.limits[m])))
        rows = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), value[m].alias("score"), alarm[m].alias("alarm")) for m in METHODS)))
        return scores.select("segment_id", rows.alias("r")).select("segment_id", "r.*")


def firing_rates(clean: DataFrame, known: DataFrame, radar: Radar, thresholds: dict[str, float], n_per_fault: int = 500, seed: int = 0) -> DataFrame:
    """(fault, rule, rate) of the rules that fire on each injected fault; equal arrays in ``known`` count as seen."""
    seen = signals.measure(known, radar, ("sha1",)).select("sha1").distinct().withColumn("duplicate", F.lit(1.0))
    out = []
    for fault in FAULTS:
        picked = faults.pick(clean, fault, n_per_fault, seed)
        picked = faults.with_donors(picked, known) if fault == "duplicate_segment" else picked
        made = signals.measure(faults.inject(picked, fault, radar, seed), radar, ("rules", "sha1"))
        stats = made.join(seen, "sha1", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(0.0)))
        rates = rules.firing(stats, thresholds).groupBy("rule").agg(F.avg(F.col("fired").cast("double")).alias("rate"))
        out.append(rates.where("rate > 0").select(F.lit(fault).alias("fault"), "rule", F.round("rate", 4).alias("rate")))
    return reduce(DataFrame.unionByName, out)


def false_alarms(fitted: Detectors, segments: DataFrame) -> DataFrame:
    """(method, n, false_alarm_rate) of the deployed thresholds on clean test segments."""
    clean = segments.where("edge_flag = 0 and split_grouped = 3").select("segment_id")
    rows = fitted.long(fitted.scores.join(clean, "segment_id", "left_semi"))
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.avg(F.col("alarm").cast("double")).alias("false_alarm_rate"))


def fault_table(
    segments: DataFrame, radar: Radar, n_per_fault: int = 500, seed: int = 0, config: Quality = Quality(), trees: int = 300, fitted: Detectors | None = None, cae_epochs: int = 15
) -> DataFrame:
    """(fault, kind, method, n, recall_deployed, recall_at_1pct_fa, roc_auc): every detector on real and injected faults.

    Negatives are the clean test segments; faults are injected into some of them, chosen
    by hash. All methods and faults are scored in long form and compared in one plan each.
    """
    fitted = fitted or Detectors(segments, radar, config, seed, trees, cae_epochs)
    clean_test = segments.where("edge_flag = 0 and split_grouped = 3")
    negative = fitted.long(fitted.scores.join(clean_test.select("segment_id"), "segment_id", "left_semi"))
    edges = fitted.scores.join(segments.where("edge_flag = 1").select("segment_id"), "segment_id", "left_semi")
    positive = fitted.long(edges).select(F.lit("edge_truncated").alias("fault"), F.lit("real").alias("kind"), "*")
    for fault in FAULTS:
        picked = faults.pick(clean_test, fault, n_per_fault, seed)
        if fault == "duplicate_segment":
            picked = faults.with_donors(picked, segments)
        stats = fitted.measure(faults.inject(picked, fault, radar, seed), known=fitted.stats)
        scored = fitted.long(fitted.score(cut(stats, "injected")))
        positive = positive.unionByName(scored.select(F.lit(fault).alias("fault"), F.lit("injected").alias("kind"), "*"))
    positive = cut(positive, "positive")
    negative = cut(negative, "negative")
    limits = {m: quantile(negative.where(F.col("method") == m), "score", 0.99) for m in METHODS}
    limit = F.create_map(*(F.lit(x) for m, v in limits.items() for x in (m, float("inf") if v is None else v)))
    recalls = positive.groupBy("fault", "kind", "method").agg(
        F.count("*").alias("n"),
        F.avg(F.col("alarm").cast("double")).alias("recall_deployed"),
        F.avg((F.col("score") > F.element_at(limit, F.col("method"))).cast("double")).alias("recall_at_1pct_fa"),
    )
    return recalls.join(areas(positive, negative), ["fault", "method"])


def areas(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """(fault, method, roc_auc) of the positives of each fault against the negatives of the method.

    Negatives are ranked once per method, among the distinct scores of all faults; each
    fault's few scores then read their rank, so negatives are not repeated per fault.
    """
    clean = F.when(F.isnan("score") | (F.col("score") == float("inf")), 1e300).otherwise(F.col("score")).alias("score")
    below = negative.select("method", clean).groupBy("method", "score").agg(F.count("*").alias("neg"))
    above = positive.select("fault", "method", clean).groupBy("fault", "method", "score").agg(F.count("*").alias("pos"))
    places = below.unionByName(above.select("method", "score", F.lit(0).cast("long").alias("neg"))).groupBy("method", "score").agg(F.sum("neg").alias("neg"))
    ranked = running_sums(places, ["method", "score"], ["neg"])
    sizes = ranked.groupBy("method").agg(F.min("before_neg").alias("first"), F.sum("neg").alias("n_neg"))
    won = above.join(ranked, ["method", "score"]).join(sizes, "method")
    sums = won.groupBy("fault", "method").agg(
        F.sum(F.col("pos") * (F.col("before_neg") - F.col("first") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("n_pos"), F.first("n_neg").alias("n_neg")
    )
    return sums.select("fault", "method", (F.col("won") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("roc_auc"))

"""Integrity rules: thresholds, flags, score and bits, as expressions over rule statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.config import HARD_RULES, INTEGRITY_RULES, STAT_RULES, Quality
from sigloom.operators.order import quantiles


def calibrate(clean_train: DataFrame, config: Quality = Quality()) -> dict[str, float]:
    """Thresholds: fixed ones for hard rules, a percentile of clean training rows for the others; without such a row infinity, which no row reaches."""
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("stat")) for r in STAT_RULES))).alias("p")
    long = clean_train.select(pairs).select("p.rule", "p.stat")
    found = {r["rule"]: r["t"] for r in quantiles(long, ["rule"], "stat", {"t": config.rule_percentile}).collect()}  # a row per rule
    return {k: float(v) for k, v in config.hard().items()} | {r: found.get(r, float("inf")) for r in STAT_RULES}


def fired(rule: str, thresholds: dict[str, float]) -> Column:
    return F.col(rule) >= F.lit(thresholds[rule])


def bits(thresholds: dict[str, float]) -> Column:
    """Bit i is the i-th integrity rule."""
    each = (F.shiftleft(F.coalesce(fired(r, thresholds), F.lit(False)).cast("bigint"), i) for i, r in enumerate(INTEGRITY_RULES))
    return reduce(lambda a, b: a.bitwiseOR(b), each)


def score(thresholds: dict[str, float]) -> Column:
    """Largest of the rules' statistics over their thresholds; 1 or more means flagged, a million a broken hard rule."""
    hard = [F.when(fired(r, thresholds), 1e6).otherwise(0.0) for r in HARD_RULES]
    soft = [F.pow(F.lit(10.0), F.col(r) - F.lit(thresholds[r])) if r == "edge_cliff" else F.try_divide(F.col(r), F.lit(thresholds[r])) for r in STAT_RULES]
    return F.greatest(*hard, *soft)


def apply(stats: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``stats`` with ``rule_flags`` and ``rule_score``."""
    return stats.withColumn("rule_flags", bits(thresholds)).withColumn("rule_score", score(thresholds))


def firing(stats: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """A row per row of ``stats`` and rule: whether it fires, and the columns that are no statistics."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.coalesce(fired(r, thresholds), F.lit(False)).alias("fired")) for r in INTEGRITY_RULES))).alias("f")
    return stats.select(*(c for c in stats.columns if c not in INTEGRITY_RULES), each).select("*", "f.rule", "f.fired").drop("f")


def quality_flags(segments: DataFrame, config: Quality = Quality()) -> DataFrame:
    """``segments`` with ``low_snr`` and ``time_gap``, which are flags but no faults."""
    gap = F.coalesce("gap_before_s", F.lit(0.0)) > config.gap_s
    return segments.withColumn("low_snr", (F.col("snr_db") < config.low_snr_db).cast("int")).withColumn("time_gap", gap.cast("int"))

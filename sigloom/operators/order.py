"""Exact ranks, quantiles and ranking metrics without a global sort in one task.

Rows are dealt out by ranges of the sort keys; each range is ranked on its own, and the
ranges' totals (one row each) are added up. No task holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.storage import cut


def running_sums(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """``df`` with ``before_<c>`` for each column of ``sums``: its sum over rows that sort before by ``keys``.

    ``keys`` have to be unique; equal rows are to be aggregated first. Null keys sort first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range").agg(*(F.sum(c).alias(f"__t_{c}") for c in sums))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select("__range", *(F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in sums))
    inside = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(offsets, "__range")
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("__range", *(f"__o_{c}" for c in sums))


def quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of ``value`` per group, linearly interpolated, one column per entry of ``shares``.

    Nulls are left out; a group of nulls only has no row.
    """
    keys = groups or ["__all"]
    df = df if groups else df.withColumn("__all", F.lit(1))
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranked = cut(running_sums(counted, [*keys, "__v"], ["__n"]), "ranked")
    sizes = ranked.groupBy(*keys).agg(F.sum("__n").alias("__size"), F.min("before___n").alias("__first"))
    joined = ranked.join(sizes, keys)
    low = F.col("before___n") - F.col("__first")
    high = low + F.col("__n") - 1
    picked = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("__size") - 1)
        part = place - F.floor(place)
        holds = lambda at: (low <= at) & (high >= at)
        weight = F.when(holds(F.floor(place)), 1 - part).otherwise(0.0) + F.when(holds(F.ceil(place)) & (part > 0), part).otherwise(0.0)
        picked.append(F.sum(F.when(weight > 0, weight * F.col("__v"))).alias(name))
    return joined.groupBy(*keys).agg(*picked).drop("__all")


def quantile(df: DataFrame, value: str, share: float) -> float | None:
    """One exact quantile as a number; None of no rows."""
    row = quantiles(df, [], value, {"q": share}).first()
    return None if row is None else row["q"]


def roc_auc(df: DataFrame, score: str, positive: str, groups: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve per group: the share of (negative, positive) pairs in order, ties counting half.

    NaN and positive infinity count as the largest score there is. Rows of one score are
    aggregated before they are ranked. Without both classes the area is null.
    """
    groups = groups or []
    clean = F.when(F.isnan(score) | (F.col(score) == float("inf")), 1e300).otherwise(F.col(score))
    tied = df.groupBy(*groups, clean.alias("__s")).agg(
        F.sum(F.col(positive).cast("bigint")).alias("__pos"), F.sum((~F.col(positive).cast("boolean")).cast("bigint")).alias("__neg")
    )
    ranked = running_sums(tied, [*groups, "__s"], ["__neg"])
    firsts = ranked.groupBy(*groups).agg(
        F.min("before___neg").alias("__first"), F.sum("__pos").alias("n_pos"), F.sum("__neg").alias("n_neg"),
        F.sum(F.col("__pos") * (F.col("before___neg") + F.col("__neg") / 2)).alias("__won"),
    )
    pairs = F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))
    area = (F.col("__won") - F.col("__first") * F.col("n_pos")) / pairs
    return firsts.select(*groups, "n_pos", "n_neg", area.alias("roc_auc"))

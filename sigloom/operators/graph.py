"""Connected components over an edge table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.storage import cut


def _normal(edges: DataFrame) -> DataFrame:
    """Undirected, without loops, nulls and repeats; ``a`` is the larger end."""
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour that has none itself, so that components are stars around their least node."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("up")).union(edges.select("b", F.lit(None)))
    per = ends.groupBy("node").agg(F.min("up").alias("lo"), F.max("up").alias("hi"), F.max(F.col("up").isNull()).alias("top"))
    return not per.where("lo != hi or (lo is not null and top)").limit(1).count()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node reachable.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Loops, nulls and
    repeated edges have no effect; an empty table gives an empty result. Rounds grow
    with the logarithm of the longest path; edges that are stars already need none. A
    node with very many neighbours is pre-aggregated before the shuffle and its join is
    one that can be split; only a yes or no reaches the driver.
    """
    now = cut(_normal(edges), "cc")
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = cut(_small_star(_large_star(now)), "cc")
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)

"""Digests of a table's columns that depend on the order and the place of every value.

Rows are ordered by an integer id. A leaf covers ``FAN`` consecutive ids, and a node of each
higher level ``FAN`` consecutive nodes below, so the tree of the same rows is the same for any
partitioning, and two trees that differ name the ids that were damaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.storage import cut

FAN = 256  # ids of a leaf, and children of a node


def _text(field: T.StructField) -> Column:
    """The value as text, exact for its type; null is told from every value."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BinaryType):
        text = F.hex(value)
    elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        text = F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))))
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit("-"))


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def tree(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(level, node, n, then one digest per column) for leaves, at level 0, up to the one root, whose node is null.

    Node k of level v covers the ids from k * FAN ** (v + 1) on; rows without an id lie in
    a node of their own, which is null too. Rows that share an id have no order among them:
    their hashes are added up, so one id may have any number of rows, and a repeated row
    counts. Column types enter at the root. An empty table has a root over no rows.

    Sums per id are pre-aggregated; a task holds at most ``FAN`` digests of a node. Values
    are read once, digests move.
    """
    typed = {f.name: f for f in rows.schema.fields}
    row = lambda c: F.sha2(F.concat_ws(":", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), _text(typed[c])), 256)
    hashed = rows.select(F.col(f"`{key}`").cast("bigint").alias("node"), *(row(c).alias(f"h{i}") for i, c in enumerate(columns)))
    part = lambda i, k: F.conv(F.substring(f"h{i}", 1 + 12 * k, 12), 16, 10).cast("decimal(15,0)")
    sums = hashed.groupBy("node").agg(F.count("*").alias("n"), *(F.sum(part(i, k)).alias(f"s{i}_{k}") for i in range(len(columns)) for k in range(4)))
    total = lambda i: _hash(F.col("n").cast("string"), *(F.col(f"s{i}_{k}").cast("string") for k in range(4)))
    below = sums.select("node", "n", *(total(i).alias(f"h{i}") for i in range(len(columns))))
    levels, level, whole = [], 0, None
    while whole is None:
        now = cut(_combine(below, len(columns), F.expr(f"(node - pmod(node, {FAN})) div {FAN}")), "merkle")
        levels.append(now.select(F.lit(level).alias("level"), "*"))
        below, level = now, level + 1
        if now.where("node not in (-1, 0)").isEmpty():
            whole = _combine(now, len(columns), F.lit(None).cast("bigint"))
    n = len(columns)
    sealed = [_hash(F.lit(typed[c].dataType.simpleString()), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.coalesce(f"h{i}", F.lit(""))).alias(f"h{i}") for i, c in enumerate(columns)]
    one = rows.sparkSession.range(1).join(whole, F.lit(True), "left")  # one row each
    levels.append(one.select(F.lit(level).alias("level"), F.lit(None).cast("bigint").alias("node"), F.coalesce("n", F.lit(0)).alias("n"), *sealed))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("level", "node", "n", *(F.col(f"h{i}").alias(c) for i, c in zip(range(n), columns)))


def _combine(below: DataFrame, n: int, parent: Column) -> DataFrame:
    """Nodes over ``below``: their children's names and digests in order, hashed."""
    children = below.groupBy(parent.alias("parent")).agg(
        F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct(F.coalesce("node", F.lit(-(2**63))).alias("at"), *(f"h{i}" for i in range(n))))).alias("c")
    )
    joined = lambda i: F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["at"].cast("string"), x[f"h{i}"])), ",")
    return children.select(F.col("parent").alias("node"), F.col("total").alias("n"), *(F.sha2(joined(i), 256).alias(f"h{i}") for i in range(n)))


def roots(made: DataFrame, columns: tuple[str, ...]) -> tuple[int, dict[str, str]]:
    """Number of rows and digest of every column, from the root."""
    top = made.orderBy(F.desc("level")).first()
    return top["n"], {c: top[c] for c in columns}


def damage(said: DataFrame, found: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column, first_id, last_id): leaves whose digests differ between two trees; both ids are null for rows without an id."""
    a, b = (t.where("level = 0").drop("level").withColumn("there", F.lit(True)) for t in (said, found))
    both = a.alias("a").join(b.alias("b"), F.col("a.node").eqNullSafe(F.col("b.node")) & F.col("a.there") & F.col("b.there"), "full")
    wrong = F.filter(F.array(*(F.when(~F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    at = F.coalesce("a.node", "b.node")
    return both.select(F.explode(wrong).alias("column"), (at * FAN).alias("first_id"), (at * FAN + FAN - 1).alias("last_id"))

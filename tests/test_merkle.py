"""Digests by order and place: independent of partitioning, changed by every damage, and naming its place."""

import pytest
from pyspark.sql import functions as F

from sigloom.sources import merkle

COLUMNS = ("x", "y")


@pytest.fixture(scope="module")
def rows(spark):
    x = F.when(F.col("id") % 7 != 3, F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.sin(F.col("id") * k)).cast("float")))
    return spark.range(-300, 700).select("id", x.alias("x"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("y"))


def root(df):
    return merkle.roots(merkle.tree(df, "id", COLUMNS), COLUMNS)


def places(spark, a, b):
    found = merkle.damage(merkle.tree(a, "id", COLUMNS), merkle.tree(b, "id", COLUMNS), COLUMNS)
    return {tuple(r) for r in found.collect()}


def test_any_partitioning_gives_one_tree(spark, rows):
    trees = [sorted(map(repr, merkle.tree(df, "id", COLUMNS).collect())) for df in (rows, rows.repartition(7), rows.orderBy(F.desc("id")).coalesce(1))]
    assert trees[0] == trees[1] == trees[2]
    assert root(rows)[0] == 1000


def test_a_swap_names_its_column_and_range(spark, rows):
    a, b = rows.where("id = 4").first(), rows.where("id = 600").first()
    moved = F.when(F.col("id") == 4, F.array(*(F.lit(v).cast("float") for v in b["x"]))).when(F.col("id") == 600, F.array(*(F.lit(v).cast("float") for v in a["x"])))
    swapped = rows.withColumn("x", F.coalesce(moved, F.col("x")))
    assert places(spark, rows, swapped) == {("x", 0, 255), ("x", 512, 767)}
    assert root(swapped)[1]["y"] == root(rows)[1]["y"] and root(swapped)[1]["x"] != root(rows)[1]["x"]
    turned = rows.withColumn("x", F.when(F.col("id") == 4, F.reverse("x")).otherwise(F.col("x")))
    assert places(spark, rows, turned) == {("x", 0, 255)}


def test_removed_and_repeated_rows(spark, rows):
    assert places(spark, rows, rows.where("id != -1")) == {("x", -256, -1), ("y", -256, -1)}
    assert places(spark, rows, rows.union(rows.where("id = 699"))) == {("x", 512, 767), ("y", 512, 767)}
    nowhere = rows.union(rows.where("id = 1").withColumn("id", F.lit(None).cast("long")))
    assert places(spark, rows, nowhere) == {("x", None, None), ("y", None, None)}
    null = rows.withColumn("y", F.when(F.col("id") == 8, F.lit(None)).otherwise(F.col("y")))
    assert places(spark, rows, null) == {("y", 0, 255)}


def test_types_empty_tables_and_large_ids(spark, rows):
    none = rows.limit(0)
    assert root(none)[0] == 0 and root(none) == root(none.repartition(3))
    assert root(rows.withColumn("y", F.col("id")))[1]["y"] != root(rows.withColumn("y", F.col("id").cast("string")))[1]["y"]
    far = rows.withColumn("id", F.col("id") + F.lit(2**62))
    made = merkle.tree(far, "id", COLUMNS)
    assert made.agg(F.max("level")).first()[0] == 8 and made.where("level = 0").agg(F.sum("n")).first()[0] == 1000
    assert places(spark, far, far.where(F.col("id") != 2**62)) == {("x", 2**62, 2**62 + 255), ("y", 2**62, 2**62 + 255)}


def test_one_id_with_most_rows(spark, rows):
    hot = rows.withColumn("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")))
    assert root(hot) == root(hot.repartition(5))
    assert places(spark, hot, hot.where("not (id = 5 and y = '6')")) == {("x", 0, 255), ("y", 0, 255)}

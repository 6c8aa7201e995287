"""Bucketed tables: joins without a shuffle, lookups that read few rows, updates of one table."""

import os

import pytest
from pyspark.sql import functions as F

from sigloom.sources import store

N, BUCKETS = 40_000, 8


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    rows = spark.range(N).select(F.col("id").alias("segment_id"), F.expr("transform(sequence(1, 20), k -> cast(sin(id * k) as float))").alias("iq"))
    store.write(rows, path, "arrays", BUCKETS)
    store.write(rows.select("segment_id", (F.col("segment_id") % 7).alias("a"), F.lit("x").alias("b")), path, "base", BUCKETS)
    store.write(rows.select("segment_id", F.col("segment_id").cast("double").alias("c")), path, "scores", BUCKETS)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df):
    """Rows that the scan of an unshuffled plan hands on, after row groups and pages were left out."""
    executed = df.select("*")._jdf.queryExecution().executedPlan()  # metrics add up over runs of one plan
    executed.executeCollectPublic()
    return executed.collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_joins_by_the_key_need_no_shuffle(spark, root):
    base, arrays, scores = (store.read(spark, root, n) for n in ("base", "arrays", "scores"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = base.join(scores, "segment_id", "left").join(arrays, "segment_id")
        assert "Exchange" not in plan(joined) and joined.where("a = segment_id % 7 and c = segment_id").count() == N
        assert "Exchange" not in plan(base.groupBy("segment_id").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_lookup_reads_few_rows(spark, root):
    arrays = store.read(spark, root, "arrays")
    one = store.lookup(arrays, [12345])
    assert [r["segment_id"] for r in one.collect()] == [12345] and rows_scanned(one) <= 1000  # a page of one bucket
    ids = list(range(100, 140)) + [39_999, 7, 7, -1, N + 5]
    many = store.lookup(arrays, ids)
    assert sorted(r["segment_id"] for r in many.collect()) == sorted(set(ids) - {-1, N + 5}) and rows_scanned(many) <= N / 4
    assert store.lookup(arrays, []).count() == 0


def test_a_hundred_ids_of_a_long_table(spark, root):
    ids = [k * 397 for k in range(100)]
    found = store.lookup(store.read(spark, root, "arrays").select("segment_id", "iq"), ids)
    assert found.count() == 100 and "PushedFilters: [Or" in plan(found)


def test_a_range_reads_a_slice_of_each_bucket(spark, root):
    found = store.between(store.read(spark, root, "arrays"), 20_000, 20_999)
    assert found.count() == 1000 and rows_scanned(found) <= BUCKETS * 2 * 1000


def files(root, name):
    return {f"{d}/{f}" for d, _, names in os.walk(f"{root}/{name}") for f in names}


def test_an_update_writes_one_table(spark, root):
    others, before = {n: files(root, n) for n in ("base", "arrays")}, files(root, "scores")
    new = spark.createDataFrame([(3, -1.0), (5, None), (3, 9.0)], "segment_id long, c double")
    out = store.update(spark, root, "scores", new)
    assert {r["segment_id"]: r["c"] for r in out.where("segment_id < 7").collect()} == {0: 0.0, 1: 1.0, 2: 2.0, 3: -1.0, 4: 4.0, 5: None, 6: 6.0}
    assert out.count() == N and {n: files(root, n) for n in others} == others and before < files(root, "scores")
    for wrong in (new.withColumnRenamed("c", "d"), new.withColumn("segment_id", F.lit(-1))):
        with pytest.raises(ValueError):
            store.update(spark, root, "scores", wrong)


def test_an_unfinished_version_does_not_count(spark, root):
    was = store.read(spark, root, "base").count()
    os.makedirs(f"{root}/base/v000009-b8-ksegment_id")
    assert store.read(spark, root, "base").count() == was
    store.write(spark.range(4).select(F.col("id").alias("segment_id")), root, "short", 3)
    store.write(spark.range(0).select(F.col("id").alias("segment_id")), root, "short", 3)
    assert store.read(spark, root, "short").count() == 0 and store.prune(spark, root, "short") == 1 and store.read(spark, root, "short").count() == 0
    with pytest.raises(ValueError):
        store.read(spark, root, "none")

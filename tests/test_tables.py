"""Splits, components, order statistics, export and the staged pipeline."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.config import INTEGRITY_RULES, SMALL
from sigloom.operators import anomaly, catalog, classify, evaluate, graph, ingest, order, rules, splits
from sigloom.sources import export, raw


def split_of(spark, sizes, links=()):
    rows = [(i, label, n) for i, (label, n) in enumerate(sizes)]
    m = spark.createDataFrame(rows, "measurement_id long, label string, n_segments long")
    e = spark.createDataFrame(list(links), "a long, b long")
    return {r["measurement_id"]: r["split_grouped"] for r in splits.grouped_split(m, e).collect()}


def test_split_contract(spark):
    sizes = [("a", 50), ("a", 40), ("a", 30), ("a", 20), ("a", 10), ("b", 9), ("b", 8), ("b", 7), ("c", 5), ("c", 4), ("d", 3)]
    s = split_of(spark, sizes)
    assert {s[i] for i in range(5)} == {1, 2, 3} == {s[i] for i in range(5, 8)}
    assert (s[4], s[3]) == (3, 2) and s[0] == 1
    assert (s[8], s[9]) == (1, 3) and s[10] == 1
    assert s == split_of(spark, sizes)


def plain_split(groups, shares):
    """Splits of (id, size) in order of placing, one after the other."""
    n, total = len(groups), sum(size for _, size in groups)
    if n < 3:
        return dict(zip([g for g, _ in groups], [1, 3]))
    lacks = [share * total for share in shares]
    lacks[2] -= 10_000 * groups[-1][1]
    lacks[1] -= 10_000 * groups[-2][1]
    out = {groups[-1][0]: 3, groups[-2][0]: 2}
    for g, size in groups[:-2]:
        at = lacks.index(max(lacks))
        lacks[at] -= 10_000 * size
        out[g] = at + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_split_against_picking_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [(label, int(n)) for label, most in (("a", 3), ("b", 40), ("c", 1), ("d", 400)) for n in rng.integers(0, most + 1, 60)] + [(None, 4), (None, 4), (None, 1)]
    s = split_of(spark, sizes)
    tie = lambda i: hashlib.sha1(f"0:{i}".encode()).hexdigest()
    for label in {label for label, _ in sizes}:
        groups = sorted(((i, n) for i, (x, n) in enumerate(sizes) if x == label), key=lambda g: (-g[1], tie(g[0])))
        assert {i: s[i] for i, _ in groups} == plain_split(groups, (6000, 2000, 2000))


def test_split_of_no_measurements(spark):
    assert split_of(spark, []) == {}


def test_linked_measurements_stay_together(spark):
    s = split_of(spark, [("a", 10)] * 6, [(0, 5), (5, 3)])
    assert s[0] == s[5] == s[3]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51)], [(5, 3), (3, 5), (9, 8), (8, 3)]])
def test_components_against_union_find(spark, edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    found = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}


def test_components_take_nulls_and_strings(spark):
    e = spark.createDataFrame([("x", "y"), (None, "z"), ("y", None), ("w", "x")], "a string, b string")
    assert {r["node"]: r["root"] for r in graph.connected_components(e).collect()} == {"x": "w", "y": "w", "w": "w"}


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(v)) for g in "ab" for v in rng.integers(0, 30, 101)] + [("a", None), ("c", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: r for r in order.quantiles(df, ["g"], "v", {"p1": 0.01, "p50": 0.5, "p999": 0.999}).collect()}
    assert set(found) == {"a", "b", "c"}
    for g, r in found.items():
        v = [x for k, x in rows if k == g and x is not None]
        assert [r["p1"], r["p50"], r["p999"]] == pytest.approx(np.quantile(v, [0.01, 0.5, 0.999]).tolist())
    assert order.quantile(df, "v", 0.25) == pytest.approx(np.quantile([x for _, x in rows if x is not None], 0.25))
    assert order.quantile(df.limit(0), "v", 0.5) is None


def test_roc_auc_against_pairs(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 20, 200).astype(float), rng.random(200) < 0.3
    s[:2] = np.nan, np.inf
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "s double, y boolean")
    t = np.where(np.isfinite(s), s, 1e300)
    d = t[y][:, None] - t[~y][None]
    assert order.roc_auc(df, "s", "y").first()["roc_auc"] == pytest.approx(((d > 0) + (d == 0) / 2).mean())
    assert order.roc_auc(df.where("y"), "s", "y").first()["roc_auc"] is None


def test_duplicate_pairs_against_join(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 4)), int(rng.integers(1, 4)), f"h{rng.integers(0, 12)}") for i in range(120)]
    df = spark.createDataFrame(rows, "segment_id long, measurement_id long, paper_split int, sha1 string")
    want = {}
    for i, a, p, h in rows:
        for j, b, q, k in rows:
            if i < j and h == k:
                n, m = want.get((a, b), (0, 0))
                want[a, b] = (n + 1, m + (p != q))
    got = {(r[0], r[1]): (r[2], r[3]) for r in catalog.duplicate_pairs(df).collect()}
    assert got == want


def test_duplicate_pairs_of_a_hot_hash(spark, monkeypatch):
    """A third of all rows have one hash and one measurement: they become few runs, in ranges of like size, and the pairs stay exact."""
    n = 6000
    df = spark.range(n).select(
        F.col("id").alias("segment_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.floor(F.col("id") / 500) % 5).cast("long").alias("measurement_id"),
        F.when(F.col("id") > 5990, None).otherwise(1 + F.col("id") % 2).cast("int").alias("paper_split"),
        F.when(F.col("id") < n / 2, F.lit("hot")).when(F.col("id") % 10 == 9, None).otherwise(F.concat(F.lit("h"), F.floor(F.col("id") / 4))).alias("sha1"),
    )
    tables = {}
    monkeypatch.setattr(catalog, "cut", lambda d, name: tables.setdefault(name, order.cut(d, name)))
    got = {tuple(r) for r in catalog.duplicate_pairs(df).collect()}
    a, b = df.alias("a"), df.alias("b")
    across = F.sum((~F.coalesce(F.col("a.paper_split") == F.col("b.paper_split"), F.lit(False))).cast("bigint"))
    pairs = a.join(b, (F.col("a.sha1") == F.col("b.sha1")) & (F.col("a.segment_id") < F.col("b.segment_id"))).groupBy("a.measurement_id", "b.measurement_id")
    assert got == {tuple(r) for r in pairs.agg(F.count("*"), across).collect()}
    parts = [r["count"] for r in tables["ranges"].groupBy("range").count().collect()]
    assert max(parts) < 3 * np.median(parts)


@pytest.mark.parametrize("most", [10**6, 10])
def test_sequence_by_window_and_by_range(spark, most):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 50 == 49 else int(rng.choice([0, 0, 0, 1, 2, 3])), float(rng.integers(0, 90)) if i % 40 else None, i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "segment_id long, measurement_id long, time_s double, more int")
    found = {r["segment_id"]: r for r in catalog.sequence_segments(df.repartition(3), most).collect()}
    for m in {r[1] for r in rows}:
        last = None
        for k, (i, _, t, more) in enumerate(sorted((r for r in rows if r[1] == m), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))):
            gap = None if k == 0 or t is None or last is None else t - last
            assert (found[i]["idx_in_measurement"], found[i]["gap_before_s"], found[i]["more"]) == (k, gap, more)
            last = t
    assert len(found) == 400 and catalog.sequence_segments(df.limit(0), most).count() == 0


def test_filter_columns(spark):
    df = spark.createDataFrame([(0, 1)], "edge_flag int, other int")
    assert catalog.filter_dataset(df, None).count() == 1
    with pytest.raises(ValueError):
        catalog.filter_dataset(df, {"other": 1})


def test_components_of_variance(spark):
    v = np.random.default_rng(3).normal(size=(300, 5)) @ np.diag([5, 3, 1, 0.1, 0.1])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], ["k", "a", "b", "c", "d", "e"])
    model = anomaly.fit_components(df.drop("k"), k=3, squeeze=False, scale=False)
    w = v - v.mean(axis=0)
    u = np.linalg.svd(w, full_matrices=False)[2][:3]
    got = np.array([r[1] for r in anomaly.score_rows(df, "k", "s", model.error).orderBy("k").collect()])
    assert got == pytest.approx(((w - w @ u.T @ u) ** 2).sum(axis=1), abs=1e-8)


def test_forest_sets_outliers_apart(spark):
    v = np.random.default_rng(4).normal(size=(400, 3))
    v[:5] += 12
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], ["k", "a", "b", "c"])
    model = anomaly.fit_forest(df, "k", trees=50)
    s = {r[0]: r[1] for r in anomaly.score_rows(df, "k", "s", model.score).collect()}
    assert min(s[i] for i in range(5)) > np.quantile([s[i] for i in range(5, 400)], 0.99)
    assert all(0 <= x <= 1 for x in s.values())


def test_fits_on_no_rows_and_odd_rows(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    odd = df.union(spark.createDataFrame([(100, float("nan"), 1.0), (101, None, 1.0), (102, float("inf"), 1.0)], df.schema))
    for fit in (lambda d: anomaly.fit_components(d.drop("k"), k=1).error, lambda d: anomaly.fit_forest(d, "k", trees=20).score):
        good, same = ({r[0]: r[1] for r in anomaly.score_rows(odd, "k", "s", fit(d.repartition(3))).collect()} for d in (df, odd))
        assert all(good[i] == pytest.approx(same[i]) for i in range(60)) and {same[i] for i in (100, 101, 102)} == {float("inf")}
        none = {r[1] for r in anomaly.score_rows(df, "k", "s", fit(df.limit(0))).collect()}
        assert all(np.isfinite(x) for x in none) and anomaly.score_rows(df.limit(0), "k", "s", fit(df)).count() == 0
    n, mean, covariance = anomaly.moments(df.drop("k").repartition(40), squeeze=False)
    v = np.array(rows)[:, 1:]
    assert n == 60 and mean == pytest.approx(v.mean(axis=0)) and covariance == pytest.approx(np.cov(v.T, bias=True))


def test_no_clean_rows_and_no_experiment(spark):
    stats = spark.createDataFrame([], ", ".join(f"{r} double" for r in INTEGRITY_RULES))
    assert rules.calibrate(stats)["spike"] == float("inf")
    table = spark.createDataFrame([("D1", "drone", 1, 1, 1.0)], "label string, class_group string, paper_split int, split_grouped int, a double")
    assert classify.experiments(table, ("a",)).count() == 0


def test_areas_rank_negatives_once(spark):
    rng = np.random.default_rng(6)
    rows = [(f, m, float(rng.integers(0, 9)), f != "") for f in ("", "x", "y") for m in ("p", "q") for _ in range(40)]
    df = spark.createDataFrame(rows, "fault string, method string, score double, positive boolean")
    found = {(r["fault"], r["method"]): r["roc_auc"] for r in evaluate.areas(df.where("positive"), df.where("not positive")).collect()}
    assert len(found) == 4
    for (fault, method), area in found.items():
        one = order.roc_auc(df.where(f"method = '{method}' and fault in ('', '{fault}')"), "score", "positive").first()
        assert area == pytest.approx(one["roc_auc"])


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "l string, p string")
    r = evaluate.macro_f1(df, "l", "p").first()
    assert r["accuracy"] == 0.5 and r["macro_f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    assert sum(x["weight"] for x in evaluate.class_weights(df, "l").collect()) == pytest.approx(3)


def test_null_hashes_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "x"), (4, None)], "segment_id long, sha1 string")
    assert {r["segment_id"]: r["duplicate"] for r in catalog.mark_repeats(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_all_rows_are_scored(spark):
    """Labels that no training row has and rows without whole features count, and count as wrong."""
    rng = np.random.default_rng(5)
    rows = [(f"D{1 + i % 2}", "drone" if i % 4 < 2 else "bird", 1, float(i % 2 * 9 + rng.normal()), float(i % 4 // 2 * 9 + rng.normal())) for i in range(80)]
    rows += [("D1", "drone", 2, 0.0, 0.0), ("D7", "reflector", 2, 0.0, 0.0)]
    rows += [("D1", "drone", 3, 0.0, 0.0), ("D7", "reflector", 3, 9.0, 9.0), ("D2", "drone", 3, None, 0.0), ("D2", "drone", 3, float("nan"), 0.0)]
    table = spark.createDataFrame(rows, "label string, class_group string, split_grouped int, a double, b double").withColumn("paper_split", F.col("split_grouped"))
    found = classify.experiments(table, ("a", "b"), grid=(0.1,)).collect()
    assert {(r["target"], r["n"], r["accuracy"]) for r in found} == {("class_group", 4, 0.25), ("label", 3, 1 / 3)}
    unseen = table.where("split_grouped < 3 or class_group = 'reflector'")
    assert {(r["n"], r["accuracy"], r["macro_f1"]) for r in classify.experiments(unseen, ("a", "b"), grid=(0.1,)).where("target = 'class_group'").collect()} == {(1, 0.0, 0.0)}


def test_regressions_are_fitted_side_by_side(spark, monkeypatch):
    rows = [(f"D{1 + i % 2}", "drone" if i % 4 < 2 else "bird", 1 + i // 4 % 3, float(i % 2), float(i % 4 // 2)) for i in range(48)]
    table = spark.createDataFrame(rows, "label string, class_group string, split_grouped int, a double, b double").withColumn("paper_split", F.col("split_grouped"))
    now, most, fit = [], [], classify.train_one

    def counted(*a):
        now.append(1)
        most.append(len(now))
        try:
            return fit(*a)
        finally:
            now.pop()

    monkeypatch.setattr(classify, "train_one", counted)
    found = classify.experiments(table, ("a", "b"), grid=(0.001, 0.1), seeds=(0,)).collect()
    assert max(most) > 1 and len(most) == 12
    assert len(found) == 12 and {(r["n"], r["seeds"], r["accuracy"], r["macro_f1"]) for r in found} == {(16, 1, 1.0, 1.0), (8, 1, 1.0, 1.0)}


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("engine"))
    counts = ingest.ingest(raw.synthetic(spark, radar=SMALL), root, SMALL)
    ingest.process(spark, root, SMALL)
    table = ingest.assess(spark, root, SMALL, n_per_fault=20, trees=40)
    return root, counts, table


def test_stages(spark, staged):
    root, counts, table = staged
    assert (counts["n_measurements"], counts["n_segments"], counts["n_edge_flagged"], counts["n_exact_duplicate_segments"]) == (15, 600, 3, 1)
    assert set(counts["segments_per_class_group"]) == {"drone", "bird", "human", "reflector"}
    segments = ingest.segments_view(spark, root)
    assert segments.where("rule_score is null or snr_db is null").count() == 0
    assert segments.where("(rule_flags > 0) != (rule_score >= 1)").count() == 0
    assert segments.where("anomaly_score is null or anomaly_score_iforest is null or class_group is null").count() == 0
    rates = {r["method"]: r for r in ingest.read(spark, root, "false_alarms").collect()}
    assert set(rates) == set(evaluate.METHODS) and all(0 <= r["false_alarm_rate"] <= 1 and r["n"] > 0 for r in rates.values())
    ingest.save_json(spark, {"a": [1, {"b": "x"}]}, f"{root}/results/x")
    assert ingest.load_json(spark, f"{root}/results/x") == {"a": [1, {"b": "x"}]}
    assert splits.leakage(segments, "split_grouped").first()["measurements_in_multiple_splits"] == 0
    hard = {r["fault"]: r["recall_deployed"] for r in table.where("method = 'rules'").collect()}
    assert hard["dropped_block"] == hard["frozen_block"] == hard["duplicate_segment"] == 1.0


def test_catalogue_joins_without_a_shuffle(spark, staged):
    """The view's joins and those with arrays need no Exchange; a rewritten column leaves the other tables alone."""
    root = staged[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = ingest.segments_view(spark, root).join(ingest.read(spark, root, "segments_iq"), "segment_id")
        assert "Exchange" not in view._jdf.queryExecution().executedPlan().toString() and view.count() == 600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    was = {r["segment_id"]: r["anomaly_score"] for r in ingest.read(spark, root, "anomaly").collect()}
    ingest.update_columns(spark, root, "anomaly", spark.createDataFrame([(7, 0.125)], "segment_id long, anomaly_score double"))
    now = {r["segment_id"]: r["anomaly_score"] for r in ingest.segments_view(spark, root).collect()}
    assert now == was | {7: 0.125}
    assert [r["segment_id"] for r in ingest.lookup(spark, root, "rd_maps", [9]).collect()] == [9]
    assert ingest.scan(spark, root, "segments_iq", 10, 19).count() == 10


def test_export(spark, staged, tmp_path):
    root = staged[0]
    rows = ingest.segments_view(spark, root).join(ingest.read(spark, root, "rd_maps"), "segment_id")
    spec = {"name": "x", "version": 1, "filters": {"edge_flag": 0}}
    one = export.export(rows, spec, f"{tmp_path}/a")
    two = export.export(rows.repartition(7), spec, f"{tmp_path}/b")
    assert one["digest"] == two["digest"] and one["n_segments"] == 597
    assert sum(sum(v.values()) for v in one["counts_grouped_split"].values()) == 597
    got = export.read(spark, f"{tmp_path}/a", split=None, task="drone", verify=True)
    assert got.count() == 240 and {r["y"] for r in got.select("y").distinct().collect()} == {0, 1}
    spark.read.parquet(f"{tmp_path}/a/data").limit(1).drop("split_grouped").write.mode("append").parquet(f"{tmp_path}/a/data/split_grouped=1")
    assert one["array_digests"] == two["array_digests"] and set(one["array_digests"]) == set(export.COLUMNS)
    with pytest.raises(ValueError, match=r"measurement_id at (0 to 255|256 to 511|512 to 767), paper_split"):
        export.read(spark, f"{tmp_path}/a", verify=True)


def test_cell_matrix_source(spark, tmp_path):
    cells = np.empty((2, 6), dtype=object)
    for m in range(2):
        x = (np.arange(320 * 3).reshape(320, 3) + 1j * m).astype(complex)
        for k, v in enumerate(([f"D{m + 1}"], x, np.full((3, 1), 50.0), np.arange(3.0)[:, None], np.ones((3, 1)), np.zeros((3, 1)))):
            cells[m, k] = np.array(v)
    np.save(tmp_path / "a.npy", cells, allow_pickle=True)
    rows = raw.load(spark, str(tmp_path)).orderBy("segment_id").collect()
    assert [r["segment_id"] for r in rows] == list(range(6)) and [r["measurement_id"] for r in rows] == [0, 0, 0, 1, 1, 1]
    assert rows[4]["iq_re"][:2] == [1.0, 4.0] and rows[4]["iq_im"][0] == 1.0


def test_streams(spark, sf, tmp_path):
    from sigloom.streaming import monitor

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = monitor.rates(stream, "ts", "event_type", "1 hour", "1 hour").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from rates").first()[0] == events.count()


def test_forest_draws_by_count(spark):
    """A row's number of trees follows the binomial law, trees are full, and the forest does not depend on partitions."""
    chances = anomaly._at_most(300, 0.01)
    assert chances[0] == pytest.approx(0.99**300) and chances[1] == pytest.approx(0.99**300 * (1 + 300 * 0.01 / 0.99)) and chances[40] == pytest.approx(1)
    df = spark.range(20000).select(F.col("id").alias("k"), F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"))
    one, two = (anomaly.fit_forest(df.repartition(n), "k", trees=60, sample=64) for n in (2, 5))
    assert (one.threshold == two.threshold).all() and (one.column == two.column).all() and len(one.column) == 60 and one.size == 64
    assert (one.column[:, 0] >= 0).all() and len(np.unique(one.threshold[:, 0])) == 60


def test_trees_set_rows_apart():
    """Each leaf's depth is its level plus the mean depth of its rows; cuts lie between the ends of what they cut."""
    rng = np.random.default_rng(1)
    v, tree = rng.normal(size=(90, 2)), np.repeat([0, 1, 2], 30)
    v[60:] = 1.0  # the third tree can't be cut
    column, threshold, depth = anomaly._trees(v, tree, rng.random((3, 31, 2)), 4)
    assert column[2, 0] == -1 and depth[2, 0] == pytest.approx(float(anomaly._path_norm(30)))
    for t in (0, 1):
        waiting = [(0, 0, v[tree == t])]
        while waiting:
            node, level, rows = waiting.pop()
            c = column[t, node]
            if c < 0:
                assert depth[t, node] == pytest.approx(level + float(anomaly._path_norm(len(rows)))) and (level == 4 or len(rows) <= 1)
                continue
            assert rows[:, c].min() <= threshold[t, node] < rows[:, c].max()
            right = rows[:, c] >= threshold[t, node]
            waiting += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]

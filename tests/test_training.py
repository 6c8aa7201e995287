"""Networks, their gradients, and data-parallel training."""

import numpy as np
import pytest

from sigloom.functions.networks import Mode, autoencoder, classifier
from sigloom.operators import classify, training


@pytest.mark.parametrize("network,shape", [(autoencoder(5, 16, 4), (3, 5, 16)), (classifier(5, 3, 4), (6, 5, 35))])
def test_gradients_against_finite_differences(network, shape):
    rng = np.random.default_rng(0)
    x, vector = rng.normal(size=shape), network.init(1)
    mode = Mode(True, np.arange(len(x)), 2, 7)
    y, kept = network.forward(vector, x, mode)
    pull = rng.normal(size=y.shape)
    found = network.backward(vector, kept, pull)
    for i in rng.integers(0, network.size, 200):
        step = np.zeros(network.size)
        step[i] = 1e-6
        slope = ((network.forward(vector + step, x, mode)[0] - network.forward(vector - step, x, mode)[0]) * pull).sum() / 2e-6
        assert found[i] == pytest.approx(slope, rel=1e-5, abs=1e-6)


def test_dropout_goes_by_row_and_epoch():
    network, x = classifier(5, 3, 4), np.random.default_rng(1).normal(size=(4, 5, 32))
    vector, moments = network.init(0), network.first_moments()
    one = network.forward(vector, x, Mode(True, np.array([1, 2, 3, 4]), 0))[0]
    assert np.allclose(one, network.forward(vector, x[::-1], Mode(True, np.array([4, 3, 2, 1]), 0))[0][::-1])
    assert not np.allclose(one, network.forward(vector, x, Mode(True, np.array([1, 2, 3, 4]), 1))[0])
    assert np.allclose(*(network.forward(vector, x, Mode(moments=moments))[0] for _ in range(2)))


def maps(spark, n=70, cells=2, bins=16):
    rng = np.random.default_rng(3)
    labels = ["D1", "human_walk", "seagull"]
    rows = []
    for i in range(n):
        x = rng.normal(scale=0.2, size=(cells, bins))
        x[:, 4 * (i % 3) + 1 : 4 * (i % 3) + 4] += 1.5
        rows.append((i, labels[i % 3], ("drone", "human", "bird")[i % 3], x.ravel().tolist(), 1 + (i // 3) % 3, 1 + (i // 3) % 3, 0))
    return spark.createDataFrame(rows, "segment_id long, label string, class_group string, rd_norm array<double>, paper_split int, split_grouped int, edge_flag int")


SMALL = training.Settings(epochs=3, batch_rows=32, chunk_rows=8, rate=3e-3)


def fitted(table, settings=SMALL, folder=None, after=None):
    network = autoencoder(2, 16, 4)
    chunks, batches = training.packed(table, "segment_id", "rd_norm", {}, settings)
    return training.fit(training.Reconstruction(network, 2), chunks, batches, settings, folder, after)


def test_same_weights_for_any_partitioning(spark):
    table = maps(spark).unionByName(maps(spark).limit(3))  # some rows twice
    one, two = fitted(table.coalesce(1)), fitted(table.repartition(9, "rd_norm"))
    assert (one.vector == two.vector).all() and one.losses == two.losses


def test_loss_falls_and_odd_maps_score_high(spark):
    settings = training.Settings(epochs=40, batch_rows=64, chunk_rows=32, rate=3e-3, decay=0.0, one_cycle=False)
    model = training.fit_autoencoder(maps(spark), "segment_id", "rd_norm", 2, 16, settings)
    assert model.losses[-1] < 0.5 * model.losses[0]
    normal = np.array([r["rd_norm"] for r in maps(spark).collect()])
    assert model.error(-normal).mean() > 2 * model.error(normal).mean()


def test_a_stopped_run_goes_on_to_the_same_weights(spark, tmp_path):
    whole = fitted(maps(spark))
    folder = f"file://{tmp_path}/checkpoints"

    def stop(state):
        if state.epoch == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        fitted(maps(spark), folder=folder, after=stop)
    seen = []
    resumed = fitted(maps(spark).repartition(5), folder=folder, after=lambda s: seen.append(s.epoch))
    assert seen == [2, 3] and (resumed.vector == whole.vector).all() and resumed.losses == whole.losses
    assert fitted(maps(spark), folder=folder, after=lambda s: seen.append(s.epoch)).epoch == 3 and seen == [2, 3]
    other = training.Settings(**{**SMALL.__dict__, "seed": 5})  # other settings do not go on from these
    assert (fitted(maps(spark), other, folder).vector != whole.vector).any()


def test_many_chunks_are_added_up_in_a_tree(spark):
    rows = spark.range(200).selectExpr("id", "array(cast(id as double), 1.0D) as x")
    settings = training.Settings(batch_rows=200, chunk_rows=2)
    chunks, batches = training.packed(rows, "id", "x", {}, settings)
    n = chunks.agg({"chunk": "max"}).first()[0] + 1
    assert batches == 1 and n > training.FAN_IN**1.5
    found = training.summed(chunks, n, 1, lambda c: np.array([len(c.keys), c.x.astype(float).sum()]))
    assert found.tolist() == [200, 200 * 199 / 2 + 200]


def test_rows_that_are_not_whole_take_no_part(spark):
    table = maps(spark)
    odd = spark.createDataFrame([(None, [1.0] * 32), (900, None), (901, [float("nan")] * 32), (902, [None] * 32)], "segment_id long, rd_norm array<double>")
    one = fitted(table.select("segment_id", "rd_norm").unionByName(odd))
    assert (one.vector == fitted(table).vector).all()
    empty = fitted(table.limit(0))
    assert (empty.vector == autoencoder(2, 16, 4).init(0)).all() and empty.epoch == 0


def test_networks_tell_separable_maps_apart(spark):
    settings = training.Settings(epochs=12, batch_rows=16, chunk_rows=16)
    table = maps(spark, 90)
    found = classify.network_experiments(table, 2, (0, 1), settings, width=8).collect()
    groups = [r for r in found if r["target"] == "class_group"]
    assert len(groups) == 8 and all(r["model"] == "cnn" and r["n"] == 30 and r["seeds"] == 2 and r["macro_f1"] == 1.0 for r in groups)
    lost = spark.createDataFrame([(500, "D1", "drone", None, 3, 3, 0)], table.schema)
    worse = classify.network_experiments(table.unionByName(lost), 2, (0,), settings, width=8).where("target = 'class_group'").collect()
    assert all(r["n"] == 31 and r["accuracy"] == pytest.approx(30 / 31) for r in worse)
    assert classify.network_experiments(table.limit(0), 2).count() == 0
    assert classify.network_experiments(table.where("label = 'D1'"), 2).count() == 0


@pytest.mark.parametrize("rows", [2, 32])  # a batch is one chunk, which its part's task reads, or many
def test_what_reaches_the_driver_does_not_grow_with_steps(spark, monkeypatch, rows):
    table, sent = maps(spark), []
    kind = type(table)

    def collect(df, real=kind.collect):
        found = real(df)
        sent.append(sum(len(v) for r in found for v in r if isinstance(v, bytearray | bytes)))
        return found

    monkeypatch.setattr(kind, "collect", collect)
    totals = []
    for epochs in (1, 2):
        sent.clear()
        fitted(table, training.Settings(epochs=epochs, batch_rows=32, chunk_rows=32 // rows))
        totals.append(sum(sent))
    size = autoencoder(2, 16, 4).size * 8
    assert size < totals[0] < 1.1 * size + 4096 and totals[1] - totals[0] < 100

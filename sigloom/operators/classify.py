"""Supervised experiments: training sets by split and filter, evaluated on clean and all test rows.

``experiments`` fits logistic regressions on features, ``network_experiments`` convolutional
networks on maps. The networks of all experiments and seeds learn together: a step reads a
batch once for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.networks import classifier
from sigloom.operators import training
from sigloom.operators.evaluate import class_weights, macro_f1

#: (target, split column, only clean rows train).
EXPERIMENTS = (
    ("class_group", "paper_split", True),
    ("class_group", "paper_split", False),
    ("class_group", "split_grouped", True),
    ("class_group", "split_grouped", False),
    ("label", "paper_split", True),
    ("label", "split_grouped", True),
)


def train_one(train: DataFrame, target: str, features: tuple[str, ...], regularisation: float):
    """A weighted multinomial logistic regression on scaled features, fitted by Spark."""
    weighted = train.join(class_weights(train, target).select(F.col("label").alias(target), "weight"), target)
    stages = [
        StringIndexer(inputCol=target, outputCol="y", handleInvalid="skip", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip"),
        StandardScaler(inputCol="raw", outputCol="x", withMean=True),
        LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=regularisation, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(weighted)


def _guess(model, rows: DataFrame, target: str, *more: str) -> DataFrame:
    """(label, guess, more) of every row of ``rows``, by the features alone; a row whose features are not whole has no guess."""
    names = F.array(*(F.lit(x) for x in model.stages[0].labels))
    features = model.stages[1].getInputCols()
    whole = reduce(Column.__and__, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features))
    out = rows.where(whole)
    for stage in model.stages[1:]:  # the first one looks at the label
        out = stage.transform(out)
    guessed = out.select(F.col(target).alias("label"), F.get(names, F.col("prediction").cast("int")).alias("guess"), *more)
    return guessed.union(rows.where(~whole).select(F.col(target), F.lit(None).cast("string"), *more))


COLUMNS = "model string, target string, split string, trained_on string, tested_on string, n bigint, seeds bigint, accuracy double, macro_f1 double, accuracy_std double, macro_f1_std double"


def experiments(rows: DataFrame, features: tuple[str, ...], grid: tuple[float, ...] = (0.001, 0.1), seeds: tuple[int, ...] = (0, 1, 2), bag: float = 0.9) -> DataFrame:
    """Mean and deviation (population) over ``seeds`` of accuracy and macro F1 for every experiment, with the ``n`` rows tested.

    Clean rows are those without ``edge_flag`` and ``rule_flags``. A seed trains on a share
    ``bag`` of the training rows, chosen by hash. Of the models of ``grid`` the one with the
    best macro F1 of the first seed on validation rows counts. Drone types are told apart
    among drones only. All rows count; those of labels that no training row has, or
    without whole features, are wrong. Experiments whose training rows have fewer than
    two classes are left out; if all are, the result is empty.
    """
    flags = [c for c in ("edge_flag", "rule_flags") if c in rows.columns]
    clean_ = reduce(Column.__and__, (F.coalesce(F.col(c), F.lit(0)) == 0 for c in flags), F.lit(True))
    thread = inheritable_thread_target(rows.sparkSession)
    table = rows.select("class_group", "label", "paper_split", "split_grouped", clean_.alias("clean"), *features).cache()

    def run(experiment: tuple[str, str, bool]) -> list[tuple]:
        target, split, clean = experiment
        known = table.where("class_group = 'drone'") if target == "label" else table
        chosen = known.where("clean") if clean else known
        train, check = chosen.where(F.col(split) == 1), chosen.where(F.col(split) == 2)
        bags = {s: train.where(F.pmod(F.xxhash64(F.lit(s), *features), F.lit(1000)) < int(1000 * bag)) for s in seeds}
        bags = {s: b for s, b in bags.items() if b.select(target).distinct().limit(2).count() > 1}
        if not bags:
            return []
        fit = lambda s, r: train_one(bags[s], target, features, r)
        first, *others = bags
        with ThreadPool(max(len(grid), len(bags))) as pool:
            models = dict(zip(grid, pool.map(thread(lambda r: fit(first, r)), grid)))
            points = macro_f1(reduce(DataFrame.union, (_guess(m, check.withColumn("r", F.lit(r)), target, "r") for r, m in models.items())), "label", "guess", "r")
            found = {p["r"]: p["macro_f1"] for p in points.collect()}  # a row for each of the grid
            best = max(grid, key=lambda r: found.get(r) or 0.0)
            fitted = dict(zip(others, pool.map(thread(lambda s: fit(s, best)), others))) | {first: models[best]}
        tested = F.explode(F.when(F.col("clean"), F.array(F.lit("all"), F.lit("clean"))).otherwise(F.array(F.lit("all")))).alias("tested_on")
        held = known.where(F.col(split) == 3).select("*", tested)
        guesses = reduce(DataFrame.union, (_guess(m, held.withColumn("seed", F.lit(s)), target, "seed", "tested_on") for s, m in fitted.items()))
        marks = macro_f1(guesses, "label", "guess", "seed", "tested_on").groupBy("tested_on")
        spread = [f(c).alias(c + end) for c in ("accuracy", "macro_f1") for f, end in ((F.avg, ""), (F.stddev_pop, "_std"))]
        sums = {r["tested_on"]: r for r in marks.agg(F.max("n").alias("n"), *spread).collect()}  # two rows
        tags = ("logistic", target, split, "clean" if clean else "all")
        marked = ("accuracy", "macro_f1", "accuracy_std", "macro_f1_std")
        return [(*tags, t, sums[t]["n"] if t in sums else 0, len(fitted), *((sums[t][c] if t in sums else None) for c in marked)) for t in ("all", "clean")]

    with ThreadPool(len(EXPERIMENTS)) as pool:  # a fit is a row of small jobs, which wait for each other
        out = [row for rows_ in pool.map(thread(run), EXPERIMENTS) for row in rows_]
    table.unpersist()
    return rows.sparkSession.createDataFrame(out, COLUMNS)


def _counts(grid: training.Grid, chunks: DataFrame, state_vector: np.ndarray, moments: np.ndarray, role: int) -> np.ndarray:
    """Rows (classifier, clean, class, guess, n) over the rows that have ``role`` for a classifier; guess -1 for rows without a map."""
    shared = chunks.sparkSession.sparkContext.broadcast((state_vector, moments))
    names = ["model", "clean", "y", "guess", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, seen = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                chunk = training.Chunk(row, grid.cells)
                found = []
                for i, (target, column) in enumerate(zip(grid.targets, grid.weights)):
                    rows = np.flatnonzero(chunk.more["role"][:, column] == role)
                    guess = np.where(chunk.more["whole"][rows, 0] > 0, grid.guesses(vector, seen, chunk.x[rows], i), -1)
                    found.append(np.stack([np.full(len(rows), i), chunk.more["clean"][rows, 0], chunk.more["y"][rows, target], guess], axis=1))
                each, n = np.unique(np.concatenate(found).astype(np.int64), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(each[:, k]) for k in range(4)), pa.array(n)], names)

    rows = chunks.mapInArrow(run, ", ".join(f"{x} long" for x in names)).groupBy(*names[:4]).agg(F.sum("n").alias("n"))
    found = np.array([tuple(r) for r in rows.collect()], np.int64).reshape(-1, 5)  # classes squared for each classifier
    shared.unpersist()
    return found


def _marks(counts: np.ndarray) -> tuple[int, float, float]:
    """(n, accuracy, macro F1 over the classes that occur) of rows (.., class, guess, n)."""
    y, guess, n = counts[:, -3], counts[:, -2], counts[:, -1]
    total = int(n.sum())
    if not total:
        return 0, 0.0, 0.0
    each = [2 * n[(y == c) & (guess == c)].sum() / (n[y == c].sum() + n[guess == c].sum()) for c in np.unique(y)]
    return total, float(n[y == guess].sum() / total), float(np.mean(each))


def network_experiments(
    rows: DataFrame, cells: int, seeds: tuple[int, ...] = (0, 1, 2), settings: training.Settings = training.Settings(), width: int = 32, folder: str | None = None
) -> DataFrame:
    """As ``experiments``, of convolutional networks on the column ``rd_norm`` of ``rows``, which have segment_id, class_group and label too.

    Each network keeps the weights of its epoch of best macro F1 on validation rows (the
    first of several). Rows without a whole map take no part in training and count as
    wrong. ``folder`` keeps checkpoints, from which a run that was stopped goes on.
    """
    spark = rows.sparkSession
    flags = [c for c in ("edge_flag", "rule_flags") if c in rows.columns]
    clean = reduce(Column.__and__, (F.coalesce(F.col(c), F.lit(0)) == 0 for c in flags), F.lit(True))
    drone = F.coalesce(F.col("class_group") == "drone", F.lit(False))
    known = {"class_group": F.col("class_group").isNotNull(), "label": drone & F.col("label").isNotNull()}
    roles = []
    for target, split, only in EXPERIMENTS:
        mine = known[target]
        learns = mine & clean if only else mine
        roles.append(F.when(mine & (F.col(split) == 3), 3).when(learns & F.col(split).isin(1, 2), F.col(split)).otherwise(0))
    tagged = rows.select("segment_id", "class_group", "label", "rd_norm", clean.cast("int").alias("clean"), *(r.alias(f"role{e}") for e, r in enumerate(roles)))

    names, weights = {}, [dict() for _ in EXPERIMENTS]
    train = [F.sum((F.col(f"role{e}") == 1).cast("long")).alias(f"n{e}") for e in range(len(EXPERIMENTS))]
    for target in known:  # a row per class
        found = tagged.where(known[target]).groupBy(target).agg(*train).orderBy(target).collect()
        names[target] = [r[target] for r in found]
        for e, (t, _, _) in enumerate(EXPERIMENTS):
            if t == target:
                raw = {r[target]: r[f"n{e}"] ** -0.5 for r in found if r[f"n{e}"]}
                weights[e] = {k: v * len(raw) / sum(raw.values()) for k, v in raw.items()}
    usable = [e for e, w in enumerate(weights) if len(w) > 1]
    if not usable:
        return spark.createDataFrame([], COLUMNS)

    look = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(c)), F.lit(0.0)) if table else F.lit(0.0)
    numbers = {t: {name: float(i) for i, name in enumerate(names[t])} for t in names}
    y = [F.when(known[t], look(numbers[t], t)).otherwise(-1.0).alias(f"y{i}") for i, t in enumerate(names)]
    w = [F.when(F.col(f"role{e}") == 1, look(weights[e], EXPERIMENTS[e][0])).otherwise(0.0).alias(f"w{e}") for e in range(len(EXPERIMENTS))]
    table = tagged.select("*", *y, *w)
    columns = {"y": ["y0", "y1"], "w": [f"w{e}" for e in range(len(EXPERIMENTS))], "role": [f"role{e}" for e in range(len(EXPERIMENTS))], "clean": ["clean"], "whole": ["whole"]}
    whole = F.coalesce(F.forall("rd_norm", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    sizes = table.where(whole).agg(F.max(F.size("rd_norm"))).first()[0] or 0
    filled = table.withColumn("whole", whole.cast("int")).withColumn("rd_norm", F.when(whole, F.col("rd_norm")).otherwise(F.array_repeat(F.lit(0.0), sizes)))
    learning = reduce(Column.__or__, (F.col(f"w{e}") > 0 for e in usable))
    held = reduce(Column.__or__, (F.col(f"role{e}") > 1 for e in usable))
    chunks, batches = training.packed(filled.where(learning & (F.col("whole") == 1)), "segment_id", "rd_norm", columns, settings)
    rest, _ = training.packed(filled.where(held), "segment_id", "rd_norm", columns, settings)

    place = {t: i for i, t in enumerate(names)}
    models = [(e, s) for e in usable for s in seeds]
    networks = [classifier(cells, len(names[EXPERIMENTS[e][0]]), width) for e, _ in models]
    grid = training.Grid(networks, [place[EXPERIMENTS[e][0]] for e, _ in models], [e for e, _ in models], [s for _, s in models], cells)

    def keep_best(state: training.State) -> None:
        counts = _counts(grid, rest, state.vector, state.moments, 2)
        best, vector, moments = (x.copy() for x in state.best) if state.best else (np.full(len(models), -1.0), state.vector.copy(), state.moments.copy())
        for i in range(len(models)):
            mark = _marks(counts[counts[:, 0] == i])[2]
            if mark > best[i]:
                best[i] = mark
                for kept, now, ends in ((vector, state.vector, grid.ends), (moments, state.moments, grid.moment_ends)):
                    kept[ends[i] : ends[i + 1]] = now[ends[i] : ends[i + 1]]
        state.best = (best, vector, moments)

    state = training.fit(grid, chunks, batches, settings, folder, keep_best)
    _, vector, moments = state.best or (None, state.vector, state.moments)
    counts = _counts(grid, rest, vector, moments, 3)
    out = []
    for e in usable:
        target, split, only = EXPERIMENTS[e]
        for tested in ("all", "clean"):
            own = [counts[(counts[:, 0] == i) & ((counts[:, 1] == 1) | (tested == "all"))] for i, (x, _) in enumerate(models) if x == e]
            marks = [_marks(c) for c in own]
            if not marks[0][0]:
                continue
            values = np.array([m[1:] for m in marks])
            tags = ("cnn", target, split, "clean" if only else "all", tested, marks[0][0], len(marks))
            out.append((*tags, *map(float, values.mean(axis=0)), *map(float, values.std(axis=0))))
    return spark.createDataFrame(out, COLUMNS)

"""Unsupervised detectors over numeric columns: scaling, principal components, isolation forest.

Moments are summed per partition and the sums are added up in a tree of tasks, so that
one small table reaches the driver whatever the number of partitions. Each tree of the
forest draws its rows from all rows. Every row is scored. Models are small arrays that
do not grow with the data.

Rows with a null, NaN or infinite value have no part in a fit and score infinity. Models
fitted on no rows at all score by the squares of the values (components) or 0.5 (forest).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.draws import uniforms
from sigloom.functions.signals import lots

#: Partial sums that one task adds up.
FAN_IN = 16


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _squeeze(v: np.ndarray) -> np.ndarray:
    return np.sign(v) * np.log1p(np.abs(v))


def _matrix(batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
    columns = [batch.column(i) for i in range(first, batch.num_columns)]
    if len(columns) == 1 and pa.types.is_list(columns[0].type):
        width = len(columns[0][0]) if len(columns[0]) else 0
        return columns[0].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(columns[0]), width)
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)


@dataclass(frozen=True)
class Components:
    """Means, deviations and leading directions of scaled columns."""

    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    squeeze: bool

    def scaled(self, v: np.ndarray) -> np.ndarray:
        return ((_squeeze(v) if self.squeeze else v) - self.mean) / self.deviation

    def error(self, v: np.ndarray) -> np.ndarray:
        """Squared distance of each scaled row from the space of the directions."""
        z = self.scaled(v)
        whole = (z**2).sum(axis=1)
        return whole - ((z @ self.directions) ** 2).sum(axis=1) if self.directions.size else whole


def _finite(v: np.ndarray) -> np.ndarray:
    return v[np.isfinite(v).all(axis=1)]


def moments(rows: DataFrame, squeeze: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (population) of the columns of ``rows``; of no rows zero, and a mean and covariance of width zero."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, 0.0, 0.0
        for batch in batches:
            v = _finite(_matrix(batch))
            if len(v):
                v = _squeeze(v) if squeeze else v
                n, total, square = n + len(v), total + v.sum(axis=0), square + v.T @ v
        if n:
            yield pa.RecordBatch.from_pydict({"sums": [np.concatenate([[n], total, square.ravel()]).tobytes()]}, schema=pa.schema([("sums", pa.binary())]))

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                one = np.frombuffer(x.as_buffer())
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]}, schema=pa.schema([("sums", pa.binary())]))

    sums, parts = rows.mapInArrow(first, "sums binary"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        sums = sums.repartition(parts).mapInArrow(more, "sums binary")
        if parts == 1:
            break
        parts = -(-parts // FAN_IN)
    row = sums.first()
    if row is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    summed = np.frombuffer(row[0])
    width = int((-1 + np.sqrt(1 + 4 * (len(summed) - 1))) / 2)
    n = int(summed[0])
    mean = summed[1 : 1 + width] / n
    return n, mean, summed[1 + width :].reshape(width, width) / n - np.outer(mean, mean)


def fit_components(rows: DataFrame, k: int = 4, squeeze: bool = True, scale: bool = True) -> Components:
    """Scaling by population deviation, then the ``k`` directions of most variance."""
    n, mean, covariance = moments(rows, squeeze)
    if not n:
        return Components(np.zeros(1), np.ones(1), np.zeros((0, 0)), squeeze)
    deviation = np.sqrt(np.maximum(np.diag(covariance), 0)) if scale else np.ones(len(mean))
    deviation = np.where(deviation > 0, deviation, 1.0)
    values, vectors = np.linalg.eigh(covariance / np.outer(deviation, deviation))
    return Components(mean, deviation, vectors[:, np.argsort(values)[::-1][:k]], squeeze)


def _path_norm(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Complete binary trees as arrays [tree, node]: column (-1 at leaves), threshold, depth to add."""

    column: np.ndarray
    threshold: np.ndarray
    depth: np.ndarray
    size: int

    def score(self, v: np.ndarray) -> np.ndarray:
        """Between 0 and 1; rows that are easily set apart score high."""
        norm = float(_path_norm(self.size))
        if not len(self.column) or not norm:
            return np.full(len(v), 0.5)
        total = np.zeros(len(v))
        rows = np.arange(len(v))
        for column, threshold, depth in zip(self.column, self.threshold, self.depth):
            at = np.zeros(len(v), np.int64)
            while (inner := column[at] >= 0).any():
                right = v[rows, np.maximum(column[at], 0)] >= threshold[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += depth[at]
        return 2.0 ** (-total / len(self.column) / norm)


#: Trees that one task grows together.
TREES_A_TASK = 50


def fit_forest(rows: DataFrame, key: str, trees: int = 300, sample: int = 256, seed: int = 0) -> Forest:
    """An isolation forest, each tree of which is fitted on ``sample`` rows drawn from all rows by the hash of ``key``.

    A tree's rows are those of least hash. Only rows under a bound are proposed, which
    leaves a tree short of rows once in ten million; of few rows all are proposed. A row
    draws once how many trees it is proposed to, and only rows of at least one tree draw
    which, so the cost of a row does not depend on the number of trees.
    """
    columns = [c for c in rows.columns if c != key]
    n = rows.count()
    bound = min(1.0, (sample + 6 * np.sqrt(sample)) / max(n, 1))
    chances = _at_most(trees, bound)
    levels = max(1, int(np.ceil(np.log2(max(sample, 2)))))
    nodes = 2 ** (levels + 1) - 1

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            keys, v = batch.column(0).to_numpy(), _matrix(batch, 1)
            wanted = np.searchsorted(chances, uniforms(keys, 1, seed)[:, 0], side="right")
            drawn = np.flatnonzero((wanted > 0) & np.isfinite(v).all(axis=1))
            each = uniforms(keys[drawn], trees, seed, 1)
            row, tree = np.nonzero(each <= np.sort(each, axis=1)[np.arange(len(drawn)), wanted[drawn] - 1][:, None])  # each row's trees of least draw
            draws = uniforms(keys[drawn][row] + tree, 1, seed, 2)[:, 0]
            ends = pa.array(np.arange(len(row) + 1, dtype=np.int32) * len(columns))
            values = pa.ListArray.from_arrays(ends, pa.array(v[drawn][row].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array((tree // TREES_A_TASK).astype(np.int32)), pa.array(tree.astype(np.int32)), pa.array(draws), values], ["lot", "tree", "draw", "v"])

    def grow(table: pa.Table) -> pa.Table:
        tree, draw = (table.column(c).to_numpy() for c in ("tree", "draw"))
        order = np.lexsort((draw, tree))
        tree = tree[order]
        first = np.searchsorted(tree, tree)  # where each row's tree begins
        kept = np.arange(len(tree)) - first < sample
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(tree), len(columns))[order[kept]]
        names, at = np.unique(tree[kept], return_inverse=True)
        found = _trees(v, at, np.stack([np.random.default_rng([seed, t]).random((nodes, 2)) for t in names]), levels)
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), nodes).cast(pa.list_(pa.from_numpy_dtype(x.dtype)))
        return pa.table([pa.array(names), pa.array(np.bincount(at)), *map(lists, found)], names=["tree", "size", "col", "threshold", "depth"])

    hashed = rows.select(F.xxhash64(key).alias("key"), *columns)
    drawn = hashed.mapInArrow(propose, "lot int, tree int, draw double, v array<double>")
    grown = drawn.groupBy("lot").applyInArrow(grow, "tree int, size bigint, col array<bigint>, threshold array<double>, depth array<double>").toArrow().sort_by("tree")
    stack = lambda c, kind: np.array(grown.column(c).to_pylist(), kind).reshape(grown.num_rows, nodes)
    return Forest(stack("col", np.int64), stack("threshold", float), stack("depth", float), max(grown.column("size").to_pylist(), default=0))


def _at_most(trees: int, chance: float) -> np.ndarray:
    """Probabilities that a row is proposed to at most 0, 1, ... trees, each with ``chance``."""
    if chance >= 1:
        return np.zeros(trees)
    k = np.arange(1, trees + 1)
    steps = np.log(trees - k + 1) - np.log(k) + np.log(chance) - np.log1p(-chance)
    return np.cumsum(np.exp(trees * np.log1p(-chance) + np.concatenate([[0.0], np.cumsum(steps)])))[:-1]


def _trees(v: np.ndarray, tree: np.ndarray, draws: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees grown level by level, all at once: at each node a random column is cut at a random place between its ends.

    Row i of ``v`` belongs to ``tree[i]``; ``draws`` [tree, node, 2] choose the column and the place.
    """
    count, nodes = draws.shape[:2]
    column = np.full((count, nodes), -1, np.int64)
    threshold, level_of = np.zeros((count, nodes)), np.floor(np.log2(np.arange(nodes) + 1))
    depth = np.tile(level_of, (count, 1))
    node = np.zeros(len(v), np.int64)
    for level in range(levels + 1):
        if not len(v):
            break
        order = np.argsort(tree * nodes + node, kind="stable")
        v, tree, node = v[order], tree[order], node[order]
        starts = np.flatnonzero(np.diff(tree * nodes + node, prepend=-1))
        sizes = np.diff(starts, append=len(v))
        t, k = tree[starts], node[starts]
        low, high = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
        spread = high > low
        choices = spread.sum(axis=1)
        cut = (choices > 0) & (level < levels)
        depth[t[~cut], k[~cut]] = level + _path_norm(sizes[~cut])
        pick = np.floor(draws[t, k, 0] * choices).astype(int)  # the pick-th of the columns that differ
        c = (np.cumsum(spread, axis=1) > pick[:, None]).argmax(axis=1)
        at = np.arange(len(t))
        place = low[at, c] + draws[t, k, 1] * (high[at, c] - low[at, c])
        column[t[cut], k[cut]], threshold[t[cut], k[cut]] = c[cut], place[cut]
        of = np.repeat(at, sizes)
        live = cut[of]
        v, tree, of = v[live], tree[live], of[live]
        node = 2 * node[live] + 1 + (v[np.arange(len(v)), c[of]] >= place[of])
    return column, threshold, depth


def score_rows(rows: DataFrame, key: str, name: str, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, name): ``function`` of the other columns of ``rows``; the model travels as a broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(function)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch, 1)
                whole = np.isfinite(v).all(axis=1)
                scores = np.where(whole, shared.value(np.where(whole[:, None], v, 0.0)), np.inf)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], [key, name])

    others = [c for c in rows.columns if c != key]
    return rows.select(key, *others).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {name} double")

"""Data-parallel training of small networks: tasks compute gradients, add them up and take the steps.

Rows are dealt by the hash of their key to batches and, within a batch, to chunks, and a
chunk's rows are ordered by key: each chunk is one packed row of a table partitioned by
batch. What is learned has parts that do not know of each other (the classifiers of a
grid); the state of each part is a row of a table in shared storage. A step reads that
table and one batch: the gradients of the batch's chunks are added up in the order of the
chunks, in a tree where there are many, and a task for each part takes a step of AdamW
under a one-cycle schedule and writes the part's next state. Where there are at least as
many parts as chunks, a task goes through the chunks of a batch for its part, and through
``LOT`` batches before it writes; otherwise each chunk of each part is a task.
No gradient reaches the driver, nor does the state before the end, unless epochs are
looked at. What a step adds up does not depend on how rows or chunks lie in partitions,
so the same rows give the same weights, bit by bit. Batches keep their rows; an epoch
draws their order.

After each epoch a checkpoint is appended to a folder in shared storage, if one is
given: the state of each part, and what was kept as best. A run that finds
checkpoints of the same settings goes on after the last of them, and ends with the same
weights as a run that was never stopped.

Rows without a key or with values that are null or not finite take no part. Rows of
equal key are all used. A run over no rows returns the first weights.
"""

from __future__ import annotations

import io
import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.networks import Mode, Network, autoencoder
from sigloom.functions.storage import fresh_path

#: Gradients that one task adds up.
FAN_IN = 16

#: Batches that a task goes through for its part before it writes the part's state.
LOT = 8

STATE = "part int, vector binary, more binary"
SUMS = "part int, batch int, chunk int, sums binary"


@dataclass(frozen=True)
class Settings:
    epochs: int = 12
    batch_rows: int = 256
    chunk_rows: int = 64
    rate: float = 2e-3
    decay: float = 1e-4
    one_cycle: bool = True
    momentum: float = 0.1
    seed: int = 0


class Chunk:
    """Rows of a chunk: ``keys``, maps ``x`` [rows, cells, bins], and further columns by name."""

    def __init__(self, row: dict, cells: int):
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.x = np.frombuffer(row["x"], np.float32).reshape(len(self.keys), cells, -1)
        self.more = {k[2:]: np.frombuffer(v, float).reshape(len(self.keys), -1) for k, v in row.items() if k.startswith("m_")}


def packed(rows: DataFrame, key: str, x: str, more: dict[str, list[str]], settings: Settings) -> tuple[DataFrame, int]:
    """The table of chunks of ``rows`` and its number of batches; ``more`` names matrices and their columns."""
    spark = rows.sparkSession
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = rows.where(F.col(key).isNotNull() & F.col(x).isNotNull() & finite)
    n = usable.count()
    batches = max(1, -(-n // settings.batch_rows))
    chunks = max(1, -(-min(n, settings.batch_rows) // settings.chunk_rows))
    dealt = usable.select(
        F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(batches)).cast("int").alias("batch"), F.pmod(F.xxhash64(F.col(key), F.lit(2)), F.lit(chunks)).cast("int").alias("chunk"),
        F.xxhash64(F.col(key)).alias("key"), F.xxhash64(x).alias("tie"), F.transform(x, lambda v: v.cast("float")).alias("x"),
        *(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)).alias(f"m_{name}") for name, columns in more.items()),
    )
    names = [f"m_{name}" for name in more]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("tie", "ascending")])
        flat = lambda c, kind: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
        out = {"batch": [table.column("batch")[0].as_py()], "chunk": [table.column("chunk")[0].as_py()], "keys": [table.column("key").to_numpy().tobytes()], "x": [flat("x", np.float32)]}
        return pa.table(out | {c: [flat(c, float)] for c in names}, schema=pa.schema([("batch", pa.int32()), ("chunk", pa.int32())] + [(c, pa.binary()) for c in ("keys", "x", *names)]))

    schema = ", ".join(["batch int", "chunk int", "keys binary", "x binary", *(f"{c} binary" for c in names)])
    path = fresh_path(spark, "chunks")
    dealt.groupBy("batch", "chunk").applyInArrow(pack, schema).write.partitionBy("batch").parquet(path)
    return spark.read.schema(schema).parquet(path), batches if n else 0


def _batch(schema: str, *rows: tuple) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[kind]) for v, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def _added(sums: DataFrame, n: int) -> DataFrame:
    """``sums`` of chunks numbered below ``n``, added up in their order until a part has at most ``FAN_IN``."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
        part, batch, chunk = (table.column(c)[0].as_py() for c in ("part", "batch", "chunk"))
        return pa.Table.from_batches([_batch(SUMS, (part, batch, chunk // FAN_IN, total.tobytes()))])

    while n > FAN_IN:
        sums = sums.groupBy("part", F.expr(f"chunk div {FAN_IN}")).applyInArrow(add, SUMS)
        n = -(-n // FAN_IN)
    return sums


def summed(chunks: DataFrame, n: int, cells: int, compute: Callable[[Chunk], np.ndarray]) -> np.ndarray | None:
    """The sum of ``compute`` over the chunks of a batch, numbered below ``n``, added up in their order; None of no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch(SUMS, (0, row["batch"], row["chunk"], compute(Chunk(row, cells)).tobytes()))

    rows = _added(chunks.mapInArrow(run, SUMS), n).orderBy("chunk").collect()  # at most FAN_IN
    return sum(np.frombuffer(r["sums"]) for r in rows) if rows else None


class Task:
    """What is learned: ``gradient`` gives what a chunk adds, ``step`` splits the sum up into gradient and moments."""

    cells: int
    size: int
    n_moments: int = 0

    def parts(self) -> list[Task]:
        """Tasks that learn on their own, whose vectors and moments make up this one's, in order."""
        return [self]

    def init(self, seed: int) -> np.ndarray:
        raise NotImplementedError

    def first_moments(self) -> np.ndarray:
        return np.zeros(self.n_moments)

    def gradient(self, vector: np.ndarray, chunk: Chunk, epoch: int) -> np.ndarray:
        raise NotImplementedError

    def split(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, float]:
        """(gradient, moments or None, loss) of the sums over a batch."""
        raise NotImplementedError


@dataclass
class State:
    vector: np.ndarray
    first: np.ndarray
    second: np.ndarray
    moments: np.ndarray
    steps: int = 0
    epoch: int = 0
    loss: float = 0.0
    losses: tuple[float, ...] = ()
    best: tuple[np.ndarray, ...] = ()

    def dumped(self) -> tuple[bytes, bytes]:
        """The vector, and what a gradient does not need."""
        more = _saved(first=self.first, second=self.second, moments=self.moments, counts=[self.steps, self.epoch], loss=self.loss, losses=self.losses)
        return self.vector.tobytes(), more

    @staticmethod
    def of(vector: bytes, more: bytes) -> State:
        with np.load(io.BytesIO(more)) as f:
            return State(np.frombuffer(vector), f["first"], f["second"], f["moments"], *map(int, f["counts"]), float(f["loss"]), tuple(f["losses"].tolist()))


def _saved(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _rate(settings: Settings, step: int, total: int) -> float:
    """One cycle: from a 25th of the rate up over three tenths of the steps, then down to almost nothing, by cosine."""
    if not settings.one_cycle:
        return settings.rate
    low, end, peak = settings.rate / 25, settings.rate / 25e4, max(0.3 * total - 1, 1e-9)
    a, b, share = (low, settings.rate, step / peak) if step <= peak else (settings.rate, end, (step - peak) / max(total - 1 - peak, 1e-9))
    return b + (a - b) * (1 + np.cos(np.pi * min(share, 1.0))) / 2


def advance(state: State, grad: np.ndarray, settings: Settings, total: int) -> None:
    """One step of AdamW."""
    rate = _rate(settings, state.steps, total)
    state.steps += 1
    state.first = 0.9 * state.first + 0.1 * grad
    state.second = 0.999 * state.second + 0.001 * grad**2
    ahead = state.first / (1 - 0.9**state.steps) / (np.sqrt(state.second / (1 - 0.999**state.steps)) + 1e-8)
    state.vector = state.vector * (1 - rate * settings.decay) - rate * ahead


def step(task: Task, state: State, sums: np.ndarray, settings: Settings, batches: int) -> None:
    grad, moments, one = task.split(sums)
    advance(state, grad, settings, settings.epochs * batches)
    if moments is not None:
        known = ~np.isnan(moments)
        state.moments = np.where(known, (1 - settings.momentum) * state.moments + settings.momentum * np.where(known, moments, 0), state.moments)
    state.loss += one / batches


def _dealt(rows: DataFrame, states: DataFrame, slot: Column, n: int) -> DataFrame:
    """``rows`` beside the states they need: a slot below ``n`` is a task."""
    return rows.unionByName(states, allowMissingColumns=True).repartitionById(n, slot.cast("int"))


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[dict[int, dict], dict[tuple[int, int], list[dict]]]:
    """What ``_dealt`` has brought to a task: the state of each part, and its rows of each batch."""
    states, rows = {}, defaultdict(list)
    for batch in batches:
        for row in batch.to_pylist():
            if row["vector"] is not None:
                states[row["part"]] = row
            else:
                rows[row["part"], row["batch"]].append(row)
    return states, rows


def _gradients(parts: list[Task], states: DataFrame, chunks: DataFrame, epoch: int) -> DataFrame:
    """``SUMS`` of every chunk for every part; tasks read chunks and states where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = parts[row["part"]]
                yield _batch(SUMS, (row["part"], row["batch"], row["chunk"], own.gradient(np.frombuffer(row["vector"]), Chunk(row, own.cells), epoch).tobytes()))

    return chunks.crossJoin(states.select("part", "vector").hint("shuffle_replicate_nl")).mapInArrow(run, SUMS)  # a broadcast would pass the driver


def _stepped(parts: list[Task], states: DataFrame, rows: DataFrame, settings: Settings, batches: int, order: list[int], epoch: int, ends: bool) -> DataFrame:
    """The states after a step for each batch of ``order``, of which ``rows`` has the chunks or their sums; ``ends`` closes the epoch."""

    def run(lots: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, found = _read(lots)
        for part, row in before.items():
            own, state = parts[part], State.of(row["vector"], row["more"])
            for b in order:
                if here := sorted(found[part, b], key=lambda r: r["chunk"]):
                    each = (np.frombuffer(r["sums"]) if "sums" in r else own.gradient(state.vector, Chunk(r, own.cells), epoch) for r in here)
                    step(own, state, sum(each), settings, batches)
            if ends:
                state.epoch, state.losses, state.loss = epoch + 1, (*state.losses, state.loss), 0.0
            yield _batch(STATE, (part, *state.dumped()))

    return _dealt(rows, states, F.col("part"), len(parts)).mapInArrow(run, STATE)


def _first(spark: SparkSession, parts: list[Task], seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                zero = np.zeros(parts[part].size)
                yield _batch(STATE, (part, *State(parts[part].init(seed), zero, zero, parts[part].first_moments()).dumped()))

    return spark.range(0, len(parts), numPartitions=len(parts)).mapInArrow(run, STATE)


def _gathered(states: DataFrame, vector: np.dtype = np.dtype(float)) -> State:
    """The parts' vectors, as numbers of a kind, and moments, one after the other, with the mean of the losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                state = State.of(row["vector"], row["more"])
                more = _saved(moments=state.moments, counts=[state.steps, state.epoch], losses=state.losses)
                yield _batch(STATE, (row["part"], state.vector.astype(vector).tobytes(), more))

    vectors, moments, losses = [], [], []
    for row in states.mapInArrow(run, STATE).orderBy("part").collect():  # of the size of the model
        with np.load(io.BytesIO(row["more"])) as f:
            vectors.append(np.frombuffer(row["vector"], vector))
            moments.append(f["moments"])
            losses.append(f["losses"])
            steps, epoch = map(int, f["counts"])
    zero = np.zeros(0)
    return State(np.concatenate(vectors), zero, zero, np.concatenate(moments), steps, epoch, 0.0, tuple(np.mean(losses, axis=0).tolist()))


def _restored(spark: SparkSession, folder: str | None, mark: str) -> tuple[DataFrame, int, tuple[np.ndarray, ...]] | None:
    """States of the last epoch that ``folder`` has under ``mark``, that epoch, and what was best."""
    if folder is None:
        return None
    try:
        found = spark.read.schema(f"mark string, epoch int, {STATE}").parquet(folder).where(F.col("mark") == mark)
        epoch = found.agg(F.max("epoch")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    if epoch is None:
        return None
    last = found.where(F.col("epoch") == epoch).dropDuplicates(["part"])
    row = last.where("part < 0").first()
    with np.load(io.BytesIO(row["more"])) as f:
        best = tuple(f[f"best{i}"] for i in range(len(f.files)))
    return last.where("part >= 0").select("part", "vector", "more"), epoch, best


def fit(
    task: Task, chunks: DataFrame, batches: int, settings: Settings, folder: str | None = None, after_epoch: Callable[[State], None] | None = None
) -> State:
    """The state after ``settings.epochs`` epochs; ``after_epoch`` may look at each and keep what is best in ``state.best``.

    Networks see maps as numbers of 32 bits, and their weights alike: ``after_epoch`` gets the weights so.
    """
    spark, parts = chunks.sparkSession, task.parts()
    mark = json.dumps({**asdict(settings), "batches": batches, "size": task.size, "parts": len(parts)}, sort_keys=True)
    paths, turn = [fresh_path(spark, "states"), fresh_path(spark, "states")], 0  # the state, and the one before it

    def kept(states: DataFrame) -> DataFrame:
        nonlocal turn
        turn = 1 - turn
        states.write.mode("overwrite").parquet(paths[turn])
        return spark.read.schema(STATE).parquet(paths[turn])

    start, epoch, best = _restored(spark, folder, mark) or (_first(spark, parts, settings.seed), 0, ())
    states = kept(start)
    most = (chunks.agg(F.max("chunk")).first()[0] or 0) + 1 if batches else 0
    by_part = len(parts) >= most
    while epoch < settings.epochs and batches:
        order = np.random.default_rng([settings.seed, epoch]).permutation(batches).tolist()
        size = LOT if by_part else 1
        for at in range(0, batches, size):
            lot = order[at : at + size]
            rows = chunks.where(F.col("batch").isin(lot))
            if by_part:
                rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))))
            else:
                rows = _added(_gradients(parts, states, rows, epoch), most)
            states = kept(_stepped(parts, states, rows, settings, batches, lot, epoch, at + size >= batches))
        epoch += 1
        if after_epoch:
            state = _gathered(states, np.dtype(np.float32))
            state.best = best
            after_epoch(state)
            best = state.best
        if folder is not None:
            row = [(-1, None, bytearray(_saved(**{f"best{i}": b for i, b in enumerate(best)})))]
            written = states.unionByName(spark.createDataFrame(row, STATE))
            written.select(F.lit(mark).alias("mark"), F.lit(epoch).alias("epoch"), "*").write.mode("append").parquet(folder)
    state = _gathered(states)
    state.best = best
    return state


@dataclass
class Reconstruction(Task):
    """Mean squared error of maps sent through a network and back."""

    network: Network
    cells: int

    @property
    def size(self):
        return self.network.size

    def init(self, seed):
        return self.network.init(seed)

    def gradient(self, vector, chunk, epoch):
        y, kept = self.network.forward(vector, chunk.x, Mode(True, chunk.keys, epoch))
        miss = y - chunk.x
        each = miss[0].size
        return np.concatenate([[len(miss), float((miss.astype(float) ** 2).sum()) / each], self.network.backward(vector, kept, 2 * miss / each)])

    def split(self, sums):
        return sums[2:] / sums[0], None, sums[1] / sums[0]


@dataclass(frozen=True)
class Autoencoder:
    """A fitted autoencoder; ``error`` is the mean squared error of each row."""

    network: Network
    vector: np.ndarray
    cells: int
    losses: tuple[float, ...] = ()

    def error(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float32).reshape(len(v), self.cells, -1)
        return ((self.network.forward(self.vector, x)[0] - x).astype(float) ** 2).mean(axis=(1, 2)) if len(v) else np.zeros(0)


def fit_autoencoder(rows: DataFrame, key: str, x: str, cells: int, bins: int, settings: Settings | None = None, folder: str | None = None) -> Autoencoder:
    """An autoencoder of the maps ``x`` (arrays of cells times bins numbers) of ``rows``."""
    settings = settings or Settings(epochs=15, batch_rows=512, chunk_rows=128, rate=1e-3, decay=0.0, one_cycle=False)
    network = autoencoder(cells, bins)
    chunks, batches = packed(rows, key, x, {}, settings)
    state = fit(Reconstruction(network, cells), chunks, batches, settings, folder)
    return Autoencoder(network, state.vector, cells, state.losses)


@dataclass
class Grid(Task):
    """Several classifiers at once, each with a target and row weights of its own, by class-weighted cross-entropy.

    Matrices of a chunk: ``y`` (a class number per target, negative for none) and ``w``
    (weights, zero for rows that are not trained on); ``targets`` and ``weights`` say which
    columns of them a classifier takes.
    """

    networks: list[Network]
    targets: list[int]
    weights: list[int]
    seeds: list[int]
    cells: int

    def __post_init__(self):
        self.ends = np.cumsum([0, *(n.size for n in self.networks)]).tolist()
        self.moment_ends = np.cumsum([0, *(n.n_moments for n in self.networks)]).tolist()
        self.size, self.n_moments = self.ends[-1], self.moment_ends[-1]

    def parts(self):
        return [Grid([n], [t], [w], [s], self.cells) for n, t, w, s in zip(self.networks, self.targets, self.weights, self.seeds)]

    def init(self, seed):
        return np.concatenate([n.init(s) for n, s in zip(self.networks, self.seeds)])

    def first_moments(self):
        return np.concatenate([n.first_moments() for n in self.networks])

    def gradient(self, vector, chunk, epoch):
        """For each classifier: weights, loss, chunks that have rows for it, gradient, moments."""
        out = []
        for i, (network, target, column, seed) in enumerate(zip(self.networks, self.targets, self.weights, self.seeds)):
            rows = np.flatnonzero((chunk.more["w"][:, column] > 0) & (chunk.more["y"][:, target] >= 0))
            if not len(rows):
                out.append(np.zeros(3 + network.size + network.n_moments))
                continue
            own, w, y = vector[self.ends[i] : self.ends[i + 1]], chunk.more["w"][rows, column], chunk.more["y"][rows, target].astype(int)
            scores, kept = network.forward(own, chunk.x[rows], Mode(True, chunk.keys[rows], epoch, seed))
            shares = np.exp(scores - scores.max(axis=1, keepdims=True))
            shares /= shares.sum(axis=1, keepdims=True)
            loss = -(w * np.log(np.maximum(shares[np.arange(len(y)), y], 1e-30))).sum()
            shares[np.arange(len(y)), y] -= 1
            grad = network.backward(own, kept, (shares * w[:, None]).astype(chunk.x.dtype))
            out.append(np.concatenate([[w.sum(), loss, 1.0], grad, network.seen_moments(kept)]))
        return np.concatenate(out)

    def split(self, sums):
        grads, moments, loss, at = [], [], 0.0, 0
        for network in self.networks:
            weight, lost, chunks = sums[at : at + 3]
            grad = sums[at + 3 : at + 3 + network.size]
            seen = sums[at + 3 + network.size : at + 3 + network.size + network.n_moments]
            at += 3 + network.size + network.n_moments
            grads.append(grad / weight if weight else grad)
            moments.append(seen / chunks if chunks else np.full(len(seen), np.nan))
            loss += lost / weight / len(self.networks) if weight else 0.0
        return np.concatenate(grads), np.concatenate(moments), loss

    def guesses(self, vector: np.ndarray, moments: np.ndarray, x: np.ndarray, i: int) -> np.ndarray:
        own, seen = vector[self.ends[i] : self.ends[i + 1]], moments[self.moment_ends[i] : self.moment_ends[i + 1]]
        return self.networks[i].forward(own, x, Mode(moments=seen))[0].argmax(axis=1) if len(x) else np.zeros(0, int)

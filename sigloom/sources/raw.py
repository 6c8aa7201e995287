"""Raw measurements: a Spark data source for pickled cell matrices, and synthetic segments made in Spark.

A cell matrix file is a pickled object array with a row per measurement and six cells:
label, samples [cells x samples, segments], range, time, split and edge flag. The source
``cellmatrix`` reads one file per partition (a file is one object and cannot be cut), so
large collections are kept as many files; a row of its output is a segment.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sigloom.config import Radar
from sigloom.functions.draws import normals, uniforms
from sigloom.functions.signals import lots
from sigloom.operators.order import running_sums
from sigloom.sources import mirror

#: Segments that the reader hands on at once.
LOT = 1024

SCHEMA = (
    "file string, measurement_in_file int, label string, idx int, range_m double, time_s double, paper_split int, edge_flag int, "
    "iq_re array<float>, iq_im array<float>"
)

#: Labels of the synthetic fixture.
LABELS = ("D1", "D2", "seagull", "human_walk", "CR")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["files"].split("\n") if options.get("files") else _under(options["path"])

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with fs.FileSystem.from_uri(partition.path)[0].open_input_file(_plain(partition.path)) as f:
            cells = np.load(f, allow_pickle=True)  # the format is pickled: read only files that are trusted
        for m, (label, samples, range_m, time_s, split, edge) in enumerate(cells):
            x = np.asarray(samples).astype(np.complex64).T
            columns = [np.asarray(v, float).ravel() for v in (range_m, time_s, split, edge)]
            for at in range(0, len(x), LOT):
                lot = x[at : at + LOT]
                k = len(lot)
                numbers = [pa.array(c[at : at + k].astype(kind)) for c, kind in zip(columns, (float, float, np.int32, np.int32))]
                names = [pa.array([partition.path] * k), pa.array(np.full(k, m, np.int32)), pa.array([str(np.ravel(label)[0])] * k), pa.array(np.arange(at, at + k, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*names, *numbers, *flat_arrays(lot)], [f.split()[0] for f in SCHEMA.split(", ")])


def _plain(path: str) -> str:
    return fs.FileSystem.from_uri(path)[1]


def _under(path: str) -> list[str]:
    """The cell matrices at comma-separated paths of any storage that Arrow reads (local, hdfs, s3 and gs), as uris."""
    found = []
    for part in path.split(","):
        store, plain = fs.FileSystem.from_uri(part if "://" in part else os.path.abspath(part))
        scheme = part.split("://")[0] if "://" in part else "file"
        info = store.get_file_info(plain)
        files = store.get_file_info(fs.FileSelector(plain)) if info.type == fs.FileType.Directory else [info]
        found += [f"{scheme}://{f.path}" for f in files if f.path == plain or f.path.endswith(".npy")]
    return sorted(found)


def flat_arrays(x: np.ndarray) -> list[pa.Array]:
    """Real and imaginary parts of segments as columns of flat lists of 32-bit numbers."""
    x = x.reshape(len(x), -1).astype(np.complex64)
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).ravel())) for v in (x.real, x.imag)]


class CellMatrix(DataSource):
    """``spark.read.format("cellmatrix").load(path)`` after ``spark.dataSource.register(CellMatrix)``."""

    @classmethod
    def name(cls) -> str:
        return "cellmatrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all cell matrices under ``path``, with global ids in order of file, measurement and place.

    Ids come from running counts over ranges of measurements, so no task sees them all.
    """
    spark.dataSource.register(CellMatrix)
    rows = spark.read.format("cellmatrix").load(path)
    sizes = rows.groupBy("file", "measurement_in_file").agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("one"))
    starts = running_sums(sizes, ["file", "measurement_in_file"], ["n", "one"])
    starts = starts.select("file", "measurement_in_file", F.col("before_one").alias("measurement_id"), F.col("before_n").alias("first"))
    return rows.join(starts, ["file", "measurement_in_file"]).select(
        (F.col("first") + F.col("idx")).alias("segment_id"), "measurement_id", "label", "range_m", "time_s", "paper_split", "edge_flag", "iq_re", "iq_im"
    )


def file_md5(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of every file under ``path``, computed in chunks where the files are read."""
    return mirror.digests(spark, path).select("path", "md5")


@dataclass(frozen=True)
class Target:
    """Return of a target: a line of random frequency, swinging in phase and amplitude."""

    from_hz: float = 0.0
    to_hz: float = 0.0
    swing: float = 0.0  # radians
    swing_hz: float = 0.0
    beat: float = 0.0
    beat_hz: float = 0.0
    level: float = 1.0
    spread: float = 0.0


#: Rotor blades, limbs, a still reflector; wing beats for any other label.
TARGETS = {
    "D1": Target(-1500, 1500, swing=2500 / 900, swing_hz=900, spread=0.5),
    "D2": Target(-1500, 1500, swing=4000 / 900, swing_hz=900, spread=0.5),
    "human_walk": Target(-700, -300, beat=0.6, beat_hz=400),
    "CR": Target(level=3.0),
}
BIRD = Target(500, 2000, swing=3.0, swing_hz=60, level=0.6)


def synthetic_batch(labels: list[str], keys: np.ndarray, edge: np.ndarray | None = None, radar: Radar = Radar(), noise: float = 0.05, seed: int = 0) -> np.ndarray:
    """Segments [batch, cells, samples]: beam-shaped returns leaking into neighbouring cells, clutter, noise; ``edge`` ones end in noise only.

    A segment depends on seed, label and key alone.
    """
    of = lambda name: np.array([getattr(TARGETS.get(x, BIRD), name) for x in labels], float)[:, None]
    n, cells = radar.n_slow, radar.n_range
    at, t = np.arange(n), np.arange(n) / radar.prf_hz
    u = uniforms(keys, 4 + cells, seed, 2)
    normal = normals(keys, 1, seed, 3).real
    line = of("from_hz") + (of("to_hz") - of("from_hz")) * u[:, :1]
    phase = 2 * np.pi * (line * t + u[:, 1:2]) + of("swing") * np.sin(2 * np.pi * (of("swing_hz") * t + u[:, 2:3]))
    level = of("level") * (1 + of("spread") * normal) * (1 + of("beat") * np.cos(2 * np.pi * of("beat_hz") * t))
    far = np.abs(np.arange(cells) - radar.centre)
    gain = 10 * np.select([far == 0, far == 1], [1.0, 0.3], 0.03)
    clutter = 0.2 * np.exp(2j * np.pi * u[:, 4:])
    beam = np.exp(-0.5 * ((at - n / 2) / (35 * n / 256)) ** 2)
    clean = (gain[:, None] * (level * np.exp(1j * phase))[:, None] + clutter[:, :, None]) * beam
    if edge is not None:
        stop = np.floor((150 + 50 * u[:, 3]) * n / 256)
        clean[np.broadcast_to((np.asarray(edge, bool)[:, None] & (at >= stop[:, None]))[:, None], clean.shape)] = 0
    return clean + noise * normals(keys, cells * n, seed, 4).reshape(clean.shape) / np.sqrt(2)


def synthetic(spark: SparkSession, measurements_per_label: int = 3, segments: int = 40, seed: int = 0, radar: Radar = Radar()) -> DataFrame:
    """Synthetic segments, each seeded by its id: one planted copy, an edge segment per gull, a gap per measurement."""
    total = len(LABELS) * measurements_per_label * segments
    m, j = (F.col("id") / segments).cast("long"), F.col("id") % segments
    label = F.get(F.array(*(F.lit(x) for x in LABELS)), (m / measurements_per_label).cast("int"))
    rows = spark.range(total).select(
        F.col("id").alias("segment_id"),
        m.alias("measurement_id"),
        label.alias("label"),
        F.lit(50.0).alias("range_m"),
        (0.1 * (j + 1) + 0.01 * F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 + F.when(j >= segments // 2, 2.0).otherwise(0.0)).alias("time_s"),
        (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(3)) + 1).cast("int").alias("paper_split"),
        ((label == "seagull") & (j == 5)).cast("int").alias("edge_flag"),
        F.when(F.col("id") == segments + 3, F.col("id") - 1).otherwise(F.col("id")).alias("of"),
    )
    names = ["segment_id", "measurement_id", "label", "range_m", "time_s", "paper_split", "edge_flag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            x = synthetic_batch(batch.column(2).to_pylist(), batch.column(7).to_numpy(), batch.column(6).to_numpy(), radar, seed=seed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *flat_arrays(x)], [*names, "iq_re", "iq_im"])

    kinds = "segment_id long, measurement_id long, label string, range_m double, time_s double, paper_split int, edge_flag int, iq_re array<float>, iq_im array<float>"
    return rows.mapInArrow(run, kinds)

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts hashed n-grams on a bounded, hash-chosen sample of labelled rows in one
distributed pass; the table of log probabilities (languages x buckets, a size that does
not depend on the data) is broadcast, and every whole text is scored in numpy, many
texts at a time.

Edge cases: a null text or one without a letter is ``und`` with score 0. Rows with a
null or repeated id are scored like any other. With no labelled row at all, every text
is ``und``. Of more than ``MOST_LANGUAGES`` distinct labels the most frequent are learned.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.batches import lots

UNKNOWN = "und"
#: Labelled rows per language that the model is fitted on, in the mean; fewer labelled rows are all used.
SAMPLE_PER_LANGUAGE = 2000
#: Labels that are learned, the most frequent ones; the table of log probabilities has so many columns at most.
MOST_LANGUAGES = 256
ORDERS = (1, 2, 3)
BUCKET_BITS = 15
SMOOTHING = 0.5
#: Characters scored at once.
PIECE = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # buckets x languages, float32
    log_prior: np.ndarray


def held_out(id_col: str = "doc_id"):
    """True for the fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``texts``, and for each the text it stems from."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    buckets, owners = [], []
    mixed = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            break
        mixed = mixed[:m] + points[n - 1 :] * _MIX[n - 1] + np.uint32(n)
        hashed = mixed * np.uint32(2654435761)
        hashed ^= hashed >> np.uint32(15)
        inside = owner[:m] == owner[n - 1 :]
        buckets.append((hashed * np.uint32(2246822519))[inside] >> np.uint32(32 - BUCKET_BITS))
        owners.append(owner[:m][inside])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.zeros(0, np.uint32), np.zeros(0, np.int32))


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``PIECE`` characters; a longer text comes in overlapping pieces of its own."""
    lot, size, first = [], 0, 0
    for i, text in enumerate(texts):
        if len(text) > PIECE:
            if lot:
                yield first, lot
            for at in range(0, len(text), PIECE):
                yield i, [text[at : at + PIECE + max(ORDERS) - 1]]
            lot, size, first = [], 0, i + 1
            continue
        lot.append(text)
        size += len(text)
        if size >= PIECE:
            yield first, lot
            lot, size, first = [], 0, i + 1
    if lot:
        yield first, lot


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in lots(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            for _, lot in _pieces([text.lower()]):
                total += np.bincount(_grams(lot)[0], minlength=1 << BUCKET_BITS)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of the rows (doc_id, text, lang) of ``labelled``, none of whose texts and langs are null."""
    most = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    sizes = {r["lang"]: r["count"] for r in most.collect()}
    languages = tuple(sorted(sizes))
    counts = np.zeros((1 << BUCKET_BITS, len(languages)))
    if languages:
        rate = F.create_map(*(F.lit(x) for k in languages for x in (k, int(min(1.0, sample / sizes[k]) * (1 << 30)))))
        chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")))
        sums = chosen.select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long")
        table = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        column = np.array([languages.index(x) for x in table.column("lang").to_pylist()], dtype=np.int64)
        counts[table.column("bucket").to_numpy(), column] = table.column("n").to_numpy()
    smooth = counts + SMOOTHING
    prior = np.array([sizes[k] for k in languages], dtype=float)
    return Model(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()))


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The most probable language of each text and its posterior probability."""
    total = np.tile(model.log_prior, (len(texts), 1))
    for first, lot in _pieces([(t or "").lower() for t in texts]):
        buckets, owner = _grams(lot)
        for k in range(len(model.languages)):
            total[first : first + len(lot), k] += np.bincount(owner, model.log_prob[:, k][buckets], len(lot))
    names, scores = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not model.languages or not text or not _LETTER.search(text):
            names.append(UNKNOWN)
            continue
        best = int(total[i].argmax())
        names.append(model.languages[best])
        scores[i] = 1.0 / np.exp(total[i] - total[i, best]).sum()
    return names, scores


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            names, scores = score_texts(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Fit on the labelled rows of ``docs`` outside the held-out fold, then predict all of its rows."""
    labelled = docs.where(~held_out()).select("doc_id", "text", "lang").where("text is not null and lang is not null")
    return predict(docs, fit(labelled, sample))


def keep_identified(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """The rows of ``docs`` that have a language of posterior probability ``least_score`` or more.

    The decision is made on each row's own text, so rows with null or repeated ids are
    judged one by one.
    """
    labelled = docs.where(~held_out()).select("doc_id", "text", "lang").where("text is not null and lang is not null")
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            names, scores = score_texts(batch.column(at).to_pylist(), model.value)
            yield batch.filter(pa.array((scores >= least_score) & (np.array(names) != UNKNOWN), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

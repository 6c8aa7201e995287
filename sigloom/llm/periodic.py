"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of words with smallest period q (words q apart are equal) and at least
``max(6, 4 q)`` words, as long as it can be. Each of its words occurs at least four times
in it. So a word that occurs less often within a segment is in no run there and splits
the segment; parts of fewer than six words hold no run. This recurses until no segment
splits any more. What survives is scanned lag by lag.

Rounds count the words of all segments of a text at once. A text that keeps splitting
bit by bit is split further one segment at a time, where the largest part inherits the
counts of the whole less those of the rest, so that no word is counted more often than
the logarithm of their number.

The scan of lag q compares blocks of q words that begin at multiples of q, by their hash
values: a run with period q covers three such blocks. Matches are extended word by word,
so equal hash values are never taken for equal words. A match inside a run whose period
divides q is passed over, as its stretch has that smaller period. A segment of m words
takes m log m steps.

Edge cases: a null or empty text has no runs and collapses to an empty text. Words that
one run drops and another keeps are dropped. Rows with null or repeated ids are worked off one
by one; extra columns are left out. A text of any length is searched whole, in memory.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.batches import lots
from sigloom.llm.packed import Slots

#: Periods that a run has at least, and words.
TIMES, SHORTEST = 4, 6
#: Rounds over all segments of a text before segments are split one at a time.
ROUNDS = 8
#: Words up to which all pairs of a lag are compared at once.
SMALL = 192
_PRIME, _BASE = 2_147_483_647, 1_103_515_245


def _between(cuts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[2, k]: the stretches of at least ``SHORTEST`` words that ``cuts``, in order, leave of [low, high)."""
    edges = np.concatenate([low - 1, cuts, high])
    kind = np.concatenate([np.zeros(len(low), int), np.ones(len(cuts), int), np.full(len(high), 2)])
    order = np.lexsort((-kind, edges))  # an end before the start that follows it
    edges, kind = edges[order], kind[order]
    ok = (kind[:-1] != 2) & (kind[1:] != 0) & (np.diff(edges) > SHORTEST)
    return np.stack([edges[:-1][ok] + 1, edges[1:][ok]])


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """The stretches [low, high) in which every word occurs at least ``TIMES`` times, in order."""
    if len(ids) < SHORTEST:
        return []
    rare = np.bincount(ids)[ids] < TIMES
    if not rare.any():
        return [(0, len(ids))]
    open_ = _between(np.flatnonzero(rare), np.array([0]), np.array([len(ids)]))
    stable: list[tuple[int, int]] = []
    width = int(ids.max()) + 1
    for _ in range(ROUNDS):
        if not open_.shape[1]:
            break
        low, high = open_
        size = high - low
        ends = np.cumsum(size)
        where = np.arange(ends[-1]) + np.repeat(low - (ends - size), size)
        owner = np.repeat(np.arange(len(low)), size)
        _, inverse, counts = np.unique(owner * width + ids[where], return_inverse=True, return_counts=True)
        rare = counts[inverse] < TIMES
        split = np.bincount(owner[rare], minlength=len(low)) > 0
        stable += zip(low[~split].tolist(), high[~split].tolist())
        open_ = _between(where[rare], low[split], high[split])
    for low, high in open_.T.tolist():
        stable += _settled(ids, low, high)
    return sorted(stable)


def _settled(ids: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """``segments`` of one stretch, part by part; the largest part takes over the counts."""
    words = ids[low:high].tolist()
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    out, waiting = [], [(0, len(words), Counter(words), None)]
    while waiting:
        a, b, count, changed = waiting.pop()
        rare = [w for w in (count if changed is None else changed) if 0 < count[w] < TIMES]
        if not rare:
            out.append((low + a, low + b))
            continue
        cuts = sorted(p for w in rare for p in places[w][bisect_left(places[w], a) : bisect_left(places[w], b)])
        edges = [a - 1, *cuts, b]
        parts = [(x + 1, y) for x, y in zip(edges, edges[1:]) if y - x > SHORTEST]
        if not parts:
            continue
        largest = max(parts, key=lambda p: p[1] - p[0])
        gone = words[a : largest[0]] + words[largest[1] : b]
        for w in gone:
            count[w] -= 1
        waiting.append((*largest, count, set(gone)))
        waiting += [(x, y, Counter(words[x:y]), None) for x, y in parts if (x, y) != largest]
    return out


def _stretches(equal: np.ndarray) -> np.ndarray:
    """[k, 2]: where ``equal`` is true, as stretches [a, b)."""
    return np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8))).reshape(-1, 2)


def _extended(w: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The largest [a, b) around ``at`` with w[i] == w[i + q] inside; a == b where that fails at once."""
    b, step = at, 64
    while b < len(w) - q:
        stop = min(b + step, len(w) - q)
        wrong = np.flatnonzero(w[b:stop] != w[b + q : stop + q])
        if len(wrong):
            b += int(wrong[0])
            break
        b, step = stop, 2 * step
    a, step = at, 64
    while a > 0:
        stop = max(a - step, 0)
        wrong = np.flatnonzero(w[stop:a] != w[stop + q : a + q])
        if len(wrong):
            a = stop + int(wrong[-1]) + 1
            break
        a, step = stop, 2 * step
    return a, b


def _powers(n: int) -> np.ndarray:
    """Powers of the base from 0 to n - 1."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * ((out[-1] * np.uint64(_BASE)) % np.uint64(_PRIME)) % np.uint64(_PRIME)])
    return out[:n]


def lag_scan(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in the words ``w``."""
    m, found = len(w), []
    if m <= SMALL:
        seen = set()
        for q in range(1, m // TIMES + 1):
            equal = w[:-q] == w[q:]
            if not equal.any():
                continue
            for a, b in _stretches(equal).tolist():
                if b + q - a >= max(SHORTEST, TIMES * q) and (a, b + q) not in seen:  # else it has a smaller period
                    seen.add((a, b + q))
                    found.append((a, b + q - a, q))
        return found
    prime = np.uint64(_PRIME)
    power = _powers(m)
    mixed = (w.astype(np.uint64) * np.uint64(2_654_435_761) + np.uint64(40_503)) % prime
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power % prime)])
    by_period: dict[int, tuple[list[int], list[int]]] = {}
    for q in range(1, m // TIMES + 1):
        value = np.diff(before[::q]) % prime
        equal = value[:-1] * power[q] % prime == value[1:]
        if not (twice := equal[:-1] & equal[1:]).any():
            continue
        shorter = [p for p in by_period if q % p == 0]
        mine = by_period.setdefault(q, ([], []))
        for first, last in _stretches(twice).tolist():
            at, stop = first * q, (last + 1) * q
            while at < stop:
                if end := max((_covering(by_period[p], at, at + 2 * q) for p in (*shorter, q)), default=0):
                    at = max(at + q, -(-(end - q) // q) * q)
                    continue
                a, b = _extended(w, at, q)
                if b > a and b + q - a >= max(SHORTEST, TIMES * q):
                    place = bisect_left(mine[0], a)
                    mine[0].insert(place, a)
                    mine[1].insert(place, b + q)
                    found.append((a, b + q - a, q))
                at = max(at + q, -(-b // q) * q)
        if not mine[0]:
            del by_period[q]
    return found


def _covering(runs: tuple[list[int], list[int]], a: int, b: int) -> int:
    """End of the run that covers [a, b), or 0. Runs of one period overlap by less than it, so the last one that starts by ``a`` decides."""
    i = bisect_right(runs[0], a) - 1
    return runs[1][i] if i >= 0 and runs[1][i] >= b else 0


def find(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    slots = Slots()
    ids = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
    return sorted(((low + s, n, q) for low, high in segments(ids) for s, n, q in lag_scan(ids[low:high])), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by spaces, without those that a run has after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed) of every row, in one pass without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(batches):
            each, texts = [], []
            for text in lot.column(1):
                words = (text.as_py() or "").encode().split()  # of bytes: at ASCII white space only
                each.append(find(words))
                texts.append(collapsed(words, each[-1]))
            flat = np.array([r for x in each for r in x], np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32))
            columns = [lot.column(0), pa.ListArray.from_arrays(offsets, struct), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """``text``, or for a tenth of all ids, by hash, its words with a periodic tail; a row without an id keeps its text.

    Of such a text's n words those from a on repeat the p words from there.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        turned = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise("")

    changed = F.transform(F.array(split), tail)[0]  # the words are split off once
    return F.when(h % 10 == 0, changed).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: number of runs, the run of greatest exponent (of several the first), digests of all runs and of the collapsed text."""
    found = runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda x, y: F.when(x.isNull() | (y["length"] * x["period"] > x["length"] * y["period"]), y).otherwise(x)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("*", F.aggregate("runs", none, better).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

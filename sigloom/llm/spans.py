"""Places of regular-expression matches as Spark expressions, and their digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches of ``pattern``, which has to match at least one character."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def gaps(text: Column, pattern: str) -> Column:
    """Code points before each match since the match before it; one more entry for the rest."""
    return F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))


#: Matches whose places are added up one after the other; many more are added up in lots of this size.
LOT = 256


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def places(found: Column, between: Column) -> Column:
    """array<struct<start, end, value>> from ``matches`` and ``gaps`` of one text, in code points, end exclusive.

    Lengths are summed within lots and then over the lots, so a text with very many
    matches does not cost the square of their number.
    """
    kind = "array<struct<start:int,end:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        at = acc["at"] + pair["gap"]
        end = at + F.char_length(pair["value"])
        span = F.struct(at.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def offsets(lots: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, lot: F.struct((acc["at"] + lot["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(lots, none, step, lambda acc: acc["out"])

    def moved(lots: Column, by: Column) -> Column:
        def of(lot: Column, i: Column) -> Column:
            d = F.element_at(by, i + 1)
            return F.transform(lot["out"], lambda s: F.struct((s["start"] + d).alias("start"), (s["end"] + d).alias("end"), s["value"].alias("value")))

        return F.flatten(F.transform(lots, of))

    pairs = F.transform(found, lambda v, i: F.struct(F.element_at(between, i + 1).alias("gap"), v.alias("value")))
    numbers = F.sequence(F.lit(0), ((F.size(found) - 1) / LOT).cast("int"))
    lots = _bind(pairs, lambda all_: F.transform(numbers, lambda k: F.aggregate(F.slice(all_, k * LOT + 1, F.lit(LOT)), start, add)))
    return _bind(lots, lambda x: _bind(offsets(x), lambda by: moved(x, by)))


#: Code points of a chunk.
CHUNK = 128


def chunks(text: Column) -> Column:
    """``text`` in pieces of ``CHUNK`` code points, so that many parts of it can be read without a walk from its start for each."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end``, exclusive, of a text in ``chunks``; empty where there are none."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor(F.greatest(end - 1, start) / CHUNK).cast("int")
    one = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    joined = F.when(last <= first + 1, F.concat(one(first), F.when(last > first, one(last)).otherwise(""))).otherwise(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""))
    return F.when(end > start, F.substring(joined, start - first * CHUNK + 1, end - start)).otherwise("")


def running_max(values: Column) -> Column:
    """For each of an array's numbers from 0 the largest one before it, 0 at first, and one more entry for the end; in lots as ``places``."""
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, v: F.struct(F.greatest(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    numbers = F.sequence(F.lit(0), (F.size(values) / LOT).cast("int"))
    some = lambda k: F.slice(values, k * LOT + 1, F.lit(LOT))
    zero = F.lit(0)
    tops = F.transform(numbers, lambda k: F.coalesce(F.array_max(some(k)), zero))
    inside = lambda before: F.transform(numbers, lambda k: F.aggregate(F.concat(some(k), F.when(F.size(some(k)) < LOT, F.array(zero)).otherwise(F.array().cast("array<int>"))), start(F.element_at(before, k + 1)), step, lambda acc: acc["out"]))
    return _bind(F.aggregate(tops, start(zero), step, lambda acc: acc["out"]), lambda before: F.flatten(inside(before)))


def digest_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

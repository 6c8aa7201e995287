"""Structured Streaming: calibrated rules applied to arriving segments, and gaps in event streams.

An extension of the batch engine: thresholds are fixed before a stream starts, so every
micro-batch is judged alike. What a stream has seen before is kept in keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigloom.config import Radar
from sigloom.functions import signals
from sigloom.operators import rules


def flag_stream(segments: DataFrame, thresholds: dict[str, float], radar: Radar) -> DataFrame:
    """(segment_id, rule_flags, rule_score) of a stream of segments; stateless, so duplicates are not judged."""
    stats = signals.rule_table(segments, radar).withColumn("duplicate", F.lit(0.0))
    return rules.apply(stats, thresholds).select("segment_id", "rule_flags", "rule_score")


def flag_arrivals(segments: DataFrame, thresholds: dict[str, float], radar: Radar) -> DataFrame:
    """(segment_id, rule_flags, rule_score) of a stream of segments, duplicates of any earlier batch included.

    The state of a hash is the id of its first segment: the least id of the batch in which
    it came first. Where ids arrive in order, batches are judged as one table would be. A
    segment that is delivered again is judged as before. State lies in the stream's
    checkpoint, eight bytes a hash, and survives restarts. Of one hash, a micro-batch's rows
    (rule statistics, no arrays) meet in one task, so the trigger's size bounds its memory.
    """
    stats = signals.measure(segments, radar, ("rules", "sha1"))
    numbers = [c for c in stats.columns if c not in ("segment_id", "sha1")]

    def judge(key: tuple, lots: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(lots))
        if not state.exists:
            state.update((int(rows["segment_id"].min()),))
        first = state.get[0]
        yield rows[["segment_id", *numbers]].assign(duplicate=(rows["segment_id"] != first).astype(float))

    out = ", ".join(["segment_id long", *(f"{c} double" for c in numbers), "duplicate double"])
    judged = stats.groupBy("sha1").applyInPandasWithState(judge, out, "first long", "append", GroupStateTimeout.NoTimeout)
    return rules.apply(judged, thresholds).select("segment_id", "rule_flags", "rule_score")


def repeats(segments: DataFrame, ts: str, late: str) -> DataFrame:
    """First segment of each hash within the watermark ``late``."""
    return segments.withWatermark(ts, late).dropDuplicatesWithinWatermark(["sha1"])


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): runs of events of a key without a pause of ``gap``, closed by the watermark."""
    found = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def rates(events: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """(kind, start, n): events per tumbling window."""
    found = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return found.select(kind, F.col("w.start").alias("start"), "n")

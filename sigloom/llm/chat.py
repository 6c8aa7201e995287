r"""Chat formatting by prefix-target expansion.

Every assistant turn is exploded into an example of its own: all turns before it are its
context and only its reply is trainable. Written out, the contexts of a conversation of
n turns hold n squared turns, so examples share their prefixes: a conversation's
formatted text is stored once, turn by turn, and an example is a row of ranges over it,
``[0, context_end)`` for the context and ``[target_start, target_end)`` for the loss
mask. ``read_back`` takes turns, loss text and loss length from the written examples and
the text that they point into; ``materialise`` writes whole examples out.

A template marks turns with control strings. In texts, a backslash follows every
backslash, and every ``<`` or ``[`` that would begin a control string or stands before a
backslash; so no text can hold a control string and unescaping gives the text back.

Places in a conversation's text are running sums over ranges of the sort order, so a
conversation of any length is formatted by many tasks. Only the digests of ``read_back``
are sequential: there a conversation's rows stream through one task, a batch at a time,
and only running totals are kept.

Edge cases: a null text is empty and a null role is the empty role. Turns are ordered by
turn, then role and text, so ties and repeated rows have a fixed place and all count. A
conversation without an assistant turn has no example but is formatted all the same.
Rows with a null conversation id are one conversation. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.storage import cut
from sigloom.operators.order import running_sums

# The template's control strings, and what opens and closes a turn of a role.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
TURNS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("[ROLE]", "[/ROLE] ", " </s>")

_ESCAPE = re.compile(r"\\|[<\[](?=\\)|<(?=/?s>|</?SYS>>|/SYS>>|SYS>>)|\[(?=/?(?:INST|ROLE)\])")
_UNESCAPE = re.compile(r"([\\<\[])\\")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn, and where its escaped text begins."""
    if role in TURNS:
        before, after = TURNS[role]
    else:
        before, after = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
    return f"{before}{escape(text)}{after}", len(before)


def parse_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    for role, (before, after) in TURNS.items():
        if role != "assistant" and segment.startswith(before) and segment.endswith(after):
            return role, unescape(segment[len(before) : len(segment) - len(after)])
    if segment.startswith(OTHER[0]):
        role, _, rest = segment[len(OTHER[0]) :].partition(OTHER[1])
        return unescape(role), unescape(rest[: len(rest) - len(OTHER[2])])
    before, after = TURNS["assistant"]
    return "assistant", unescape(segment[len(before) : len(segment) - len(after)])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _streamed(df: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation one after the other in one task, in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "conv_id").sortWithinPartitions("conv_id", *order)


def _hidden(text: Column) -> Column:
    """``escape`` as an expression."""
    return F.regexp_replace(text, _ESCAPE.pattern, r"$0\\")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per turn: its formatted segment, its place in the conversation's text, and the example it belongs to.

    (conv_id, seq, example, segment, start, end, target_start, target_end). ``example``
    counts the assistant turns before; the turns of one number are what its example adds
    to the prefix it shares with the example before. ``target_*`` enclose the reply of an
    assistant turn. Equal turns are placed together and numbered afterwards.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    each = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), said("role"), said("text"))
    each = each.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    role = F.col("role")
    before, after = F.concat(F.lit(OTHER[0]), _hidden(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (opens, closes) in TURNS.items():
        before, after = F.when(role == name, F.lit(opens)).otherwise(before), F.when(role == name, F.lit(closes)).otherwise(after)
    segment = F.concat(before, _hidden(F.col("text")), after)
    each = each.withColumn("all_chars", F.char_length(segment).cast("long") * F.col("n"))  # the segment itself is made again where it is placed
    each = each.withColumn("replies", F.when(role == "assistant", F.col("n")).otherwise(F.lit(0).cast("long")))
    placed = running_sums(each, ["conv_id", "turn", "role", "text"], ["n", "all_chars", "replies"])
    sums = ("before_n", "before_all_chars", "before_replies")
    firsts = placed.groupBy(F.col("conv_id").alias("of")).agg(*(F.min(c).alias(f"first_{c}") for c in sums))
    placed = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("hidden", _hidden(F.col("text"))).withColumn("before", before)
    placed = placed.withColumn("segment", F.concat("before", "hidden", after)).withColumn("chars", F.char_length("segment").cast("long"))
    at = {c: F.col(c) - F.col(f"first_{c}") for c in sums}
    rows = placed.select(
        "conv_id", F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("k", "_"), "segment", "role", "chars", F.char_length("before").alias("skip"),
        F.char_length("hidden").alias("inner"), *(at[c].alias(c) for c in sums),
    )
    start = F.col("before_all_chars") + F.col("k") * F.col("chars")
    reply = F.col("role") == "assistant"
    return rows.select(
        "conv_id",
        (F.col("before_n") + F.col("k")).alias("seq"),
        (F.col("before_replies") + F.when(reply, F.col("k")).otherwise(0)).alias("example"),
        "segment",
        start.alias("start"),
        (start + F.col("chars")).alias("end"),
        F.when(reply, start + F.col("skip")).alias("target_start"),
        F.when(reply, start + F.col("skip") + F.col("inner")).alias("target_end"),
    )


def examples(segments: DataFrame) -> DataFrame:
    """One row per assistant turn: (conv_id, example, seq, context_end, target_start, target_end), ranges of the conversation's text."""
    replies = segments.where("target_start is not null")
    return replies.select("conv_id", "example", "seq", F.col("start").alias("context_end"), "target_start", "target_end")


def materialise(segments: DataFrame) -> DataFrame:
    """The examples with their whole text: (conv_id, example, text, target_start, target_end).

    Contexts are repeated for every reply, so this is for conversations of ordinary length.
    """
    wanted = examples(segments).drop("seq")
    parts = segments.select("conv_id", F.col("example").alias("of"), "seq", "segment")
    joined = wanted.join(parts, "conv_id").where(F.col("of") <= F.col("example"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "segment"))), lambda x: x["segment"]), "")
    return joined.groupBy("conv_id", "example", "target_start", "target_end").agg(text.alias("text"))


DIGEST = "conv_id long, n_turns long, n_examples long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, mask = None, None, None

    def row() -> tuple:
        n, k, turns, chars, loss, total = state
        return conv, n, k, turns.hexdigest(), chars, loss.hexdigest(), total

    for batch in batches:
        out = []
        for c, segment, start, context_end, first, last in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if state is None or c != conv:
                if state is not None:
                    out.append(row())
                conv, state, mask = c, [0, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], None
            if segment is None:  # an example, before the turn that it trains on
                if context_end != state[5] or not context_end <= first <= last:
                    raise ValueError(f"an example of conversation {c} does not have the turns before it as its context")
                mask = first, last
                continue
            role, text = parse_turn(segment)
            state[0] += 1
            state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[5] += len(segment)
            if mask is not None:
                trained = unescape(segment[mask[0] - start : mask[1] - start])
                state[1] += 1
                state[3] += len(trained)
                state[4].update(trained.encode("utf-8", "surrogatepass"))
                mask = None
        yield _batch(out, DIGEST)
    if state is not None:
        yield _batch([row()], DIGEST)


def read_back(segments: DataFrame, made: DataFrame) -> DataFrame:
    """Per conversation, the turns parsed out of its text and what the masks of its examples ``made`` let train."""
    none = lambda kind: F.lit(None).cast(kind)
    text = segments.select("conv_id", "seq", F.lit(1).alias("kind"), "segment", "start", *(none("long").alias(c) for c in ("context_end", "target_start", "target_end")))
    masks = made.select("conv_id", "seq", F.lit(0).alias("kind"), none("string").alias("segment"), none("long").alias("start"), "context_end", "target_start", "target_end")
    return _streamed(text.unionByName(masks), "seq", "kind").drop("seq", "kind").mapInArrow(_digest, DIGEST)


def report(turns: DataFrame) -> DataFrame:
    """Format, explode into examples, write both, read them again, and digest what was read."""
    segments = cut(format_conversations(turns), "chat-text")
    return read_back(segments, cut(examples(segments), "chat-examples"))

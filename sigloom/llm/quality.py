"""Quality by weak supervision, in DataFrame operations only.

Rules look at text statistics and vote good (1), bad (-1) or abstain (0). A one-coin
model per rule says how often its votes are right; expectation-maximisation estimates
these accuracies and the share of good documents from the counts of vote patterns alone
(at most 3 ** rules rows, whatever the data), each step being one aggregation of that
table. The posterior probability of being good then decides, row by row.

Edge cases: a null or empty text has no words and fails. Rows with null or repeated ids
are judged one by one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.storage import cut

LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

# Where rules begin to vote bad and good. Between the two a rule abstains.
RULES = {
    "length": ("n_words", 15, 40, 1_000_000, 2_000_000),
    "symbols": ("try_divide(100D * n_symbols, n_words)", None, None, 3, 15),
    "repeats": ("try_divide(100D * n_repeat_words, n_words)", None, None, 2, 15),
    "lines": ("try_divide(100D * n_dup_lines, n_lines)", None, None, 5, 30),
    "word_length": ("try_divide(1D * word_chars, n_words)", 2, 3, 9, 12),
    "shouting": ("try_divide(100D * n_upper, word_chars)", None, None, 15, 60),
}
ROUNDS = 25
START_ACCURACY, START_GOOD = 0.85, 0.8


def _repeat_words(found: Column, n: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words which the text has twice or more."""
    none = F.lit(0)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(found, i + k) for k in range(WINDOW))))

    def spread(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.transform(F.array(ordered), lambda s: _covered(F.array_sort(_twice(s))))[0]

    def worked(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(spread(h))

    return F.when(n < WINDOW + 1, none).otherwise(F.transform(F.array(hashes), worked)[0])


def _twice(ordered: Column) -> Column:
    """Positions of windows that stand beside an equal one in hash order."""
    marked = F.transform(
        ordered,
        lambda x, k: F.when((x["x"] == F.get(ordered, k - 1)["x"]) | (x["x"] == F.get(ordered, k + 1)["x"]), x["i"]),
    )
    return F.array_compact(marked)


def _covered(positions: Column) -> Column:
    """Words covered by windows that begin at the sorted ``positions``."""
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("n"), (p + WINDOW).alias("end"))
    return F.aggregate(positions, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(
        "doc_id",
        split.alias("w"),
        lines.alias("lines"),
        F.char_length(F.translate(text, SPACES, "")).alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))).alias("n_upper"),
    )
    return one.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w"), F.size("w")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.col("n_upper").cast("long").alias("n_upper"),
    )


def vote(rule: str) -> Column:
    """1, -1 or 0 of a rule, from the statistics; a text without words gets -1."""
    expression, bad_below, good_from, good_to, bad_above = RULES[rule]
    value = F.expr(expression)
    bad = value.isNull() | (value > bad_above)
    good = value <= good_to
    if bad_below is not None:
        bad, good = bad | (value < bad_below), good & (value >= good_from)
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _log_odds(accuracies: dict[str, float], good: float) -> Column:
    """Log odds of a row being good, from its votes."""
    total = F.lit(math.log(good / (1 - good)))
    for rule, a in accuracies.items():
        total = total + F.col(f"vote_{rule}") * F.lit(math.log(a / (1 - a)))
    return total


def posterior(accuracies: dict[str, float], good: float) -> Column:
    return 1 / (1 + F.exp(-_log_odds(accuracies, good)))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
    """Accuracies of the rules and the share of good rows, from columns vote_* and ``n``.

    Shares are kept within 0.05 and 0.95 of certainty and accuracies above one half, so
    that "good" keeps its meaning and no rule becomes absolute.
    """
    accuracies, good = {r: START_ACCURACY for r in RULES}, START_GOOD
    for _ in range(rounds):
        p = posterior(accuracies, good)
        right = lambda r: F.when(F.col(f"vote_{r}") == 1, p).when(F.col(f"vote_{r}") == -1, 1 - p).otherwise(0.0)
        sums = patterns.agg(
            F.sum(p * F.col("n")).alias("good"),
            F.sum("n").alias("n"),
            *(F.sum(right(r) * F.col("n")).alias(f"right_{r}") for r in RULES),
            *(F.sum(F.abs(f"vote_{r}") * F.col("n")).alias(f"cast_{r}") for r in RULES),
        ).first()
        if not sums["n"]:
            break
        new = {r: min(0.95, max(0.55, (sums[f"right_{r}"] + 8.5) / (sums[f"cast_{r}"] + 10))) for r in RULES}
        share = min(0.95, max(0.05, sums["good"] / sums["n"]))
        moved = max(abs(share - good), *(abs(new[r] - accuracies[r]) for r in RULES))
        accuracies, good = new, share
        if moved < 1e-6:
            break
    return accuracies, good


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, votes, ``quality`` (posterior), ``base_failed`` and ``kept`` of every row.

    The statistics are worked out once and kept as a table of numbers in the shared
    folder; the vote patterns and the verdicts both come from it.
    """
    stats = cut(statistics(docs.select("doc_id", "text")), "quality")
    voted = stats.select("*", *(vote(r).alias(f"vote_{r}") for r in RULES))
    patterns = cut(voted.groupBy(*(f"vote_{r}" for r in RULES)).agg(F.count("*").alias("n")), "votes")
    accuracies, good = estimate(patterns.coalesce(1))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    out = voted.withColumn("quality", F.round(posterior(accuracies, good), 6)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def report(docs: DataFrame) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")
    return judge(docs).select(*names)

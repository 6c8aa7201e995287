"""Phrase collocations by multikey quicksort of suffix pointers, routed by leading words.

Texts are lower-cased (A to Z), cut into pieces at punctuation and line ends and into
words, and gathered into blocks of one language. All blocks' copies of a word meet in a
bucket by hash, where it gets a number; the numbers return to the blocks. At every word a
suffix begins: up to ``longest`` words, ending with its piece. Equal suffixes of a block
are added up, so that a phrase that all texts share leaves a block once. Suffixes
are routed globally by their leading words to ranges of (first word, second word, ...) of
one language, which a sample of them cuts to about ``RANGE_WORDS`` each: no leading word, or
pair of them, is too much for a task, and counts do not depend on where the cuts lie.
Within a range, three-way quicksort works on pointers to suffixes, word by word: the
part equal to the pivot is a phrase whose count is the part's weight, and goes on to the
next word; a part of less than ``least`` is abandoned. A phrase at either end of a range may
continue in the next one, so its partial counts are kept and all are added up.

A candidate is scored at its weakest cut: floor(1000 a n / (l r)), with a, l and r the
occurrences of the candidate and its two parts and n the words of the language, in
decimals of 38 digits. Those products pass 64 bits from about 10**8 words on; 38 digits
last to 10**17. Candidates contained in a longer one of equal count are dropped: counts
fall with length, so it is enough to look at candidates one word longer.

Words and suffixes travel packed, a row for each block and bucket or range. A task holds
one block, the distinct words of one bucket, or one range, of which there is one for each
``RANGE_WORDS`` words; the sample that cuts them, all that reaches the driver, has ``PER_RANGE`` suffixes for each
range, and one for each block at least.

Edge cases: a null text is empty; a null language counts as ``und``, as one; ids play no
part, so null and repeated ids are rows like others, and extra columns are left out.
Empty tables give no rows. Texts are read whole, of any length, in memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.storage import bucketed, cut
from sigloom.llm.batches import lots
from sigloom.llm.packed import Slots, dealt, pack, pack_wide, pack_words, unpack, unpack_wide, unpack_words
from sigloom.operators.order import running_sums

LONGEST, LEAST, TOP = 5, 100, 2000
#: Words of a block, suffixes of a range, and sampled suffixes for each range.
BLOCK_WORDS, RANGE_WORDS, PER_RANGE = 1_000_000, 1_000_000, 32
#: Words of a row of the table of words.
LOT_WORDS = 50_000
_END = b"\xff"  # no byte of UTF-8
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + _END * 10 + b" ")


def _blocks(docs: DataFrame, text_col: str, lang_col: str, buckets: int, block_words: int) -> DataFrame:
    """(lang, slots, held, block): words of texts of one language by number, frequent ones low, 0 between pieces; and the words by bucket."""
    held_type = pa.list_(pa.struct([("bucket", pa.int32()), ("slots", pa.binary()), ("words", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[Slots, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def close(lang: str) -> pa.RecordBatch:
            known, parts = open_.pop(lang)
            del sizes[lang]
            slots = np.concatenate(parts)
            order = 1 + np.argsort(-np.bincount(slots, minlength=len(known))[1:], kind="stable")
            number = np.zeros(len(known), np.uint32)
            number[order] = np.arange(1, len(known))
            words = list(known)
            held = dealt([words[i] for i in order.tolist()], 1, buckets)
            arrays = [pa.array([lang]), pa.array([pack(number[slots])], pa.binary()), pa.array([held], held_type)]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "slots", "held"])

        for lot in lots(batches):
            for text, lang in zip(lot.column(0), lot.column(1)):
                lang = lang.as_py()
                words = text.as_py().encode().translate(_TABLE).replace(_END, b" \xff ").split()
                if lang not in open_:
                    open_[lang], sizes[lang] = (Slots({_END: 0}), []), 0
                known, parts = open_[lang]
                parts += [np.fromiter(map(known.__getitem__, words), np.uint32, len(words)), np.zeros(1, np.uint32)]
                sizes[lang] += len(words)
                if sizes[lang] >= block_words:
                    yield close(lang)
                elif sum(sizes.values()) >= 4 * block_words:  # many languages
                    yield close(max(sizes, key=sizes.get))
        for lang in list(open_):
            yield close(lang)

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    schema = "lang string, slots binary, held array<struct<bucket:int,slots:binary,words:binary>>"
    return rows.where("text is not null").mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


def _numbers(held: DataFrame, buckets: int) -> DataFrame:
    """Rows (home, slots, ids) for the words of each block, and (ids, words) for the words of each bucket, in lots."""
    names, kinds = ["home", "slots", "ids", "words"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Slots] = defaultdict(Slots)
        for batch in lots(batches, 64):
            ids = []
            for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                words = unpack_words(packed)
                ids.append(pack_wide(np.fromiter(map(known[bucket].__getitem__, words), np.int64, len(words)) * buckets + bucket + 1))
            columns = [batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
        for bucket, slots in known.items():
            words = list(slots)
            for at in range(0, len(words), LOT_WORDS):
                some = words[at : at + LOT_WORDS]
                row = [None, None, pack_wide((at + np.arange(len(some))) * buckets + bucket + 1), pack_words(some)]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return held.select("block", "bucket", "slots", "words").mapInArrow(run, "home long, slots binary, ids binary, words binary")


def _words(numbers: DataFrame) -> DataFrame:
    """(id, word) of every different word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, 1):
            words = pa.array(unpack_words(batch.column(1)[0].as_py()), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(unpack_wide(batch.column(0)[0].as_py())), words], ["id", "word"])

    return numbers.where("words is not null").select("ids", "words").mapInArrow(run, "id long, word string")


def _suffixes(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """Columns of the words of the suffix at every word, 0 beyond its end."""
    n = len(ids)
    ids = np.concatenate([ids, np.zeros(longest - 1, np.int64)])
    at = np.flatnonzero(ids[:n])
    columns = [ids[at]]
    for k in range(1, longest):
        columns.append(np.where(columns[-1] > 0, ids[at + k], 0))
    return columns


def _summed(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Suffixes in order, equal ones once with their weights added up."""
    order = np.lexsort(columns[::-1])
    columns, weights = [c[order] for c in columns], weights[order]
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    firsts = np.flatnonzero(fresh)
    return [c[firsts] for c in columns], np.add.reduceat(weights, firsts) if len(firsts) else weights


def _numbered(longest: int, every: int):
    """One block in global numbers, with how many words it has and a sample of its suffixes."""
    schema = pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("n", pa.int64()), ("sample", pa.list_(pa.list_(pa.int64())))])

    def of(block: pa.Table, numbers: pa.Table) -> pa.Table:
        slots = unpack(block.column("slots")[0].as_py())
        number = np.zeros(int(slots.max(initial=0)) + 1, np.int64)
        for some, ids in zip(numbers.column("slots").to_pylist(), numbers.column("ids").to_pylist()):
            number[unpack(some)] = unpack_wide(ids)
        ids = number[slots]
        columns = _suffixes(ids, longest)
        n = len(columns[0])
        rng = np.random.default_rng(block.column("block")[0].as_py())
        sample = np.stack(columns, axis=1)[rng.integers(0, n, -(-n // every))].tolist() if n else []
        return pa.Table.from_pydict({"lang": [block.column("lang")[0].as_py()], "ids": [pack_wide(ids)], "n": [n], "sample": [sample]}, schema=schema)

    return of


def _place(columns: list[np.ndarray], bound: tuple[int, ...]) -> int:
    """How many of the suffixes, which are in order, come before ``bound``."""
    low, high = 0, len(columns[0])
    for c, w in zip(columns, bound):
        low, high = low + int(np.searchsorted(c[low:high], w, "left")), low + int(np.searchsorted(c[low:high], w, "right"))
    return low


def _routed(numbered: DataFrame, bounds: dict[str, list[tuple[int, ...]]], longest: int) -> DataFrame:
    """(lang, part, columns, weights) of each block and range that has suffixes of it."""
    shared = numbered.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, 1):
            lang = batch.column(0)[0].as_py()
            columns = _suffixes(unpack_wide(batch.column(1)[0].as_py()), longest)
            columns, weights = _summed(columns, np.ones(len(columns[0]), np.int64))
            stops = [0, *(_place(columns, b) for b in shared.value.get(lang, [])), len(weights)]
            rows = [(i, a, b) for i, (a, b) in enumerate(zip(stops, stops[1:])) if b > a]
            packed = [[pack_wide(c[a:b]) for c in columns] for _, a, b in rows]
            arrays = [pa.array([lang] * len(rows), pa.string()), pa.array([i for i, _, _ in rows], pa.int32()), pa.array(packed, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([pack_wide(weights[a:b]) for _, a, b in rows], pa.binary())], ["lang", "part", "columns", "weights"])

    return numbered.select("lang", "ids").mapInArrow(run, "lang string, part int, columns array<binary>, weights binary")


def quicksort_counts(columns: list[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(pointer, depth, count): a suffix that begins with each prefix of at least ``least``, how many words the prefix has, and its weight.

    Word 0 stands for the end of a suffix and is counted nowhere.
    """
    rng = np.random.default_rng(0)
    waiting = [(np.arange(len(weights)), 0, int(weights.sum()))]
    while waiting:
        pointers, depth, total = waiting.pop()
        if total < least:
            continue  # abandoned
        words = columns[depth][pointers]
        pivot = int(np.median(words[rng.integers(0, len(words), 9)])) if len(words) > 1 else int(words[0])
        below, above = words < pivot, words > pivot
        equal = ~(below | above)
        for part in (below, above):
            if part.any():
                some = pointers[part]
                waiting.append((some, depth, int(weights[some].sum())))
        same = pointers[equal]
        if pivot == 0 or not len(same):
            continue
        count = int(weights[same].sum())
        if count >= least:
            yield int(same[0]), depth + 1, count
            if depth + 1 < len(columns):
                waiting.append((same, depth + 1, count))


def _gathered(table: pa.Table, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """All suffixes of a range; equal ones are added up whenever more than ``most`` have come together."""
    kept: list[tuple[list[np.ndarray], np.ndarray]] = []
    rows = 0
    join = lambda: ([np.concatenate(c) for c in zip(*(x[0] for x in kept))], np.concatenate([x[1] for x in kept]))
    for packed, weights in zip(table.column("columns"), table.column("weights")):
        kept.append(([unpack_wide(c) for c in packed.as_py()], unpack_wide(weights.as_py())))
        rows += len(kept[-1][1])
        if rows > most:
            kept = [_summed(*join())]
            rows = len(kept[0][1])
            most = max(most, 2 * rows)
    return join()


def _prefixes(longest: int, least: int, most: int):
    """(lang, ids, a) of a range's prefixes: frequent ones, and partial counts of those at its ends."""

    def run(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        columns, weights = _gathered(table, most)
        found: dict[tuple[int, ...], int] = {}
        for pointer, depth, count in quicksort_counts(columns, weights, least):
            found[tuple(int(c[pointer]) for c in columns[:depth])] = count
        for end in (np.min, np.max):
            rows, key = np.arange(len(weights)), ()
            for c in columns:
                word = int(end(c[rows]))
                rows = rows[c[rows] == word]
                key += (word,)
                if word == 0:
                    break
                found.setdefault(key, int(weights[rows].sum()))
        return pa.table([pa.array([lang] * len(found), pa.string()), pa.array([list(k) for k in found], pa.list_(pa.int64())), pa.array(list(found.values()), pa.int64())], ["lang", "ids", "a"])

    return run


def counted(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS, range_words: int = RANGE_WORDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of phrases of 1 to ``longest`` words (lang, ids, a) of at least ``least``, of words (id, word), and of words in all (lang, n)."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(_blocks(docs, text_col, lang_col, buckets, block_words), "pieces", "block", buckets)
    held = blocks.select("block", F.explode("held").alias("w")).select("block", "w.*").repartition(buckets, "bucket")
    numbers = cut(_numbers(held, buckets), "numbers")
    back = numbers.where("home is not null").select("home", "slots", "ids")
    of = _numbered(longest, max(1, range_words // PER_RANGE))
    both = blocks.select("block", "lang", "slots").groupBy("block").cogroup(back.groupBy("home"))
    numbered = cut(both.applyInArrow(of, "lang string, ids binary, n long, sample array<array<long>>"), "numbered")
    totals = numbered.groupBy("lang").agg(F.sum("n").alias("n"))

    samples: dict[str, list[tuple[int, ...]]] = defaultdict(list)
    for lang, suffix in numbered.select("lang", F.explode("sample")).toLocalIterator():  # PER_RANGE for each range
        samples[lang].append(tuple(suffix))
    bounds = {lang: sorted(x)[PER_RANGE::PER_RANGE] for lang, x in samples.items()}
    routed = _routed(numbered, {lang: sorted(set(x)) for lang, x in bounds.items()}, longest)
    partial = routed.groupBy("lang", "part").applyInArrow(_prefixes(longest, least, 2 * range_words), "lang string, ids array<long>, a long")
    phrases = cut(partial.groupBy("lang", "ids").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases")
    return phrases, _words(numbers), totals


def _scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, n, score) of the candidates that are in no longer one of equal count."""
    size = F.size("ids")
    phrases = counts.where(size > 1)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right"))
    of = lambda part, name: counts.select("lang", F.col("ids").alias(part), F.col("a").alias(name))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    top = (exact("a") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(22,0)")
    score = F.call_function("div", (top * exact("n")).cast("decimal(38,0)"), (exact("l") * exact("r")).cast("decimal(38,0)"))
    weakest = both.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r", "n")).groupBy("lang", "ids", "a").agg(F.min("cut").alias("cut"))
    inner = phrases.where(size >= 3).select("lang", F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "a")
    longer = inner.groupBy("lang", "ids").agg(F.max("a").alias("longer"))
    kept = weakest.join(longer, ["lang", "ids"], "left").where(F.coalesce("longer", F.lit(0)) < F.col("a"))
    return kept.select("lang", "ids", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def _ranked(df: DataFrame, keys: list[Column], per: str) -> DataFrame:
    """``df`` with ``before``: how many rows of its ``per`` sort before it by ``keys``, which are unique within it."""
    named = df.withColumns({f"__k{i}": k for i, k in enumerate(keys)}).withColumn("__one", F.lit(1).cast("long"))
    sums = cut(running_sums(named, [per, *(f"__k{i}" for i in range(len(keys)))], ["__one"]), "ranked")
    firsts = sums.groupBy(per).agg(F.min("before___one").alias("__first"))
    return sums.join(firsts, per).withColumn("before", F.col("before___one") - F.col("__first")).select(*df.columns, "before")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, **columns) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` candidates by score, count, phrase."""
    phrases, words, totals = counted(docs, longest, least, **columns)
    scored = cut(_scored(phrases, totals), "scored")
    groups = scored.groupBy("lang", "score", "a").agg(F.count("*").alias("members")).withColumns({"s": -F.col("score"), "c": -F.col("a")})
    before = cut(running_sums(cut(groups, "groups"), ["lang", "s", "c"], ["members"]), "before")
    firsts = before.groupBy("lang").agg(F.min("before_members").alias("first"))
    near = before.join(firsts, "lang").where(F.col("before_members") - F.col("first") < top).select("lang", "score", "a")
    chosen = cut(scored.join(near, ["lang", "score", "a"]), "chosen")
    spelled = chosen.select("lang", "ids", F.posexplode("ids").alias("at", "id")).join(words, "id")
    texts = spelled.groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = cut(chosen.join(texts, ["lang", "ids"]).select("lang", "phrase", "a", "l", "r", "n", "score"), "named")
    ranked = _ranked(named, [-F.col("score"), -F.col("a"), F.col("phrase")], "lang").where(F.col("before") < top)
    return ranked.select("lang", (F.col("before") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")

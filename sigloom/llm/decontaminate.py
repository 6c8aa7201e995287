"""Benchmark items inside documents: size-partitioned MinHash containment, in DataFrame operations only.

An item is contained in a document if at least ``threshold`` of its distinct word
shingles occur there. Items are partitioned by size class, a power of two of their
shingle count, and each class is searched on its own. It has a sketch length of its own:
each item keeps its k shingles of least hash (bottom-k MinHash), k being one more than
what an item of the class may lack. And it has a bound, the largest hash in its sketches:
a document's sketch for the class is its hashes up to that bound. A document that
contains an item of n shingles lacks at most ``(1 - threshold) n`` of them, so at least k
less that many of the item's sketch are in the document's: the search misses nothing.
That holds for any k of an item's shingles, so those that more than ``COMMON`` items own
enter a sketch after all others: a passage that very many items and documents share makes
no candidates of their pairs, unless an item has little else. Every candidate is then
verified by the exact shingles. Equal items are searched for once.

The documents are hashed in one pass over whole texts, for all widths and classes at
once, and probe the index, which is broadcast if its counted bytes are at most
``BROADCAST_BYTES`` and joined by shuffle otherwise. Only candidate documents are shingled
a second time, in one pass again.

Words are runs of characters other than ASCII white space, letters lower-cased. Items
shorter than a shingle count as one shingle of all their words, looked for as such.
Edge cases: null and empty texts and items contain nothing and are contained nowhere.
Repeated item ids are separate items per text. Each document is judged by its own text,
for which 128 hash bits stand while it is searched, so that equal texts are searched as
one; equal rows are reported once, and texts that share an id each for itself. Rows
without an id are not reported, as the result is ids; but they are removed if they contain an item, and an item
without an id removes the documents that contain it. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.storage import cut

WORDS_PER_SHINGLE = 5
THRESHOLD = 0.8
#: Bytes of a side that is broadcast, strings and 64 for each row; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Items that may own a shingle before sketches take rarer ones first.
COMMON = 16


def words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(found: Column, width: int) -> Column:
    """Hash of each run of ``width`` words; empty for a shorter text."""
    n = F.size(found) - width + 1
    at = lambda i, k: F.get(found, i + k)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(at(i, k) for k in range(width))))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(found: Column, width: int) -> Column:
    """Each run of ``width`` words, joined by spaces; empty for a shorter text."""
    n = F.size(found) - width + 1
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(found, i, F.lit(width)), " "))
    return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))


def _sized(df: DataFrame) -> DataFrame:
    """``df``, a table written before, marked for broadcast if its counted bytes are few enough."""
    texts = [F.octet_length(f.name) for f in df.schema if f.dataType.simpleString() == "string"]
    each = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(64))
    size = df.agg(F.sum(each.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def sketches(items: DataFrame, threshold: float = THRESHOLD, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(item, width, n, shingles, class, least, sketch) of every different item with a word.

    ``item`` stands for the item's words; ``class`` is the size class, and ``least`` how
    many hashes of the sketch any document that contains the item has.
    """
    split = items.select(words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    split = split.withColumn("item", F.xxhash64("w")).withColumn("width", F.least(F.size("w"), F.lit(width)))
    texts = F.lit(None).cast("array<string>")
    for k in range(width, 0, -1):
        texts = F.when(F.col("width") == k, shingle_texts(F.col("w"), k)).otherwise(texts)
    out = split.select("item", "width", F.array_distinct(texts).alias("shingles")).withColumn("n", F.size("shingles"))
    out = cut(out.withColumn("h", F.transform("shingles", lambda s: F.xxhash64(*_split(s, width)))), "items")
    owned = out.select("item", "width", F.explode("h").alias("h"))
    common = owned.groupBy("width", "h").agg(F.count("*").alias("owners")).where(F.col("owners") > COMMON)
    late = owned.join(common, ["width", "h"]).groupBy("item").agg(F.collect_set("h").alias("late"))  # of one item's own
    out = out.join(late, "item", "left").withColumn("late", F.coalesce("late", F.array().cast("array<bigint>")))
    out = out.withColumn("class", F.ceil(F.log2(F.col("n") + 1)).cast("int"))
    top = F.call_function("shiftleft", F.lit(1), F.col("class")) - 1  # the most shingles of the class
    lacks = lambda n: F.floor((1 - F.lit(threshold)) * n + 1e-9).cast("int")
    k = F.least(lacks(top) + 1, F.col("n"))
    out = out.withColumn("least", F.greatest(k - lacks(F.col("n")), F.lit(1)))
    ordered = F.concat(F.array_sort(F.array_except("h", "late")), F.array_sort("late"))
    return out.withColumn("sketch", F.slice(ordered, F.lit(1), k)).drop("h", "late")


def _split(shingle: Column, width: int) -> list[Column]:
    """The words of a joined shingle; those it lacks are null, and a null leaves a hash as it is."""
    parts = F.split(shingle, " ")
    return [F.get(parts, F.lit(k)) for k in range(width)]


def _exploded(by_width: dict[int, Column], name: str) -> Column:
    """One row (width, name) for each value of each array."""
    tag = lambda k: lambda v: F.struct(F.lit(k).alias("width"), v.alias(name))
    tagged = [F.transform(values, tag(k)) for k, values in by_width.items()]
    return F.inline(F.concat(*tagged) if len(tagged) > 1 else tagged[0])


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the 128 hash bits of each text, which stand for it: equal texts are one, whatever their ids."""
    return docs.withColumns({"__t": F.xxhash64("text"), "__u": F.xxhash64(F.lit(1), "text")})


_KEY = ["__t", "__u"]


def _pairs(docs: DataFrame, items: DataFrame, threshold: float, width: int) -> DataFrame | None:
    """(text key, item, n, n_shared) of every different item contained in a different text; None if no item has a word."""
    known = cut(sketches(items, threshold, width), "sketch")
    bounds = known.groupBy("width", "class").agg(F.max(F.array_max("sketch")).alias("bound")).orderBy("width", "class").collect()  # a row per size class
    if not bounds:
        return None
    texts = _keyed(docs.select(F.col("text").cast("string").alias("text")).where("text is not null"))
    widths = sorted({r["width"] for r in bounds})
    split = texts.select(*_KEY, words(F.col("text")).alias("w"))
    hashed = split.select(*_KEY, _exploded({k: shingle_hashes(F.col("w"), k) for k in widths}, "h"))
    within = [F.when((F.col("width") == r["width"]) & (F.col("h") <= r["bound"]), r["class"]) for r in bounds]
    hashed = hashed.where(" or ".join(f"(width = {w} and h <= {max(r['bound'] for r in bounds if r['width'] == w)})" for w in widths))
    sketched = hashed.select(*_KEY, "width", "h", F.explode(F.array_compact(F.array(*within))).alias("class"))

    owners = known.select("class", "width", "item", "least", F.explode("sketch").alias("h"))
    index = cut(owners.select("class", "width", "h").distinct(), "index")
    hits = cut(sketched.join(_sized(index), ["class", "width", "h"]).distinct(), "hits")
    met = hits.join(owners, ["class", "width", "h"]).groupBy(*_KEY, "item", "least").agg(F.count("*").alias("hits"))
    pairs = cut(met.where("hits >= least").select(*_KEY, "item"), "pairs")

    return verified(texts, pairs, known, widths).where(F.col("n_shared") >= F.lit(threshold) * F.col("n") - 1e-9)


def verified(texts: DataFrame, pairs: DataFrame, known: DataFrame, widths: list[int]) -> DataFrame:
    """(text key, item, n, n_shared) of the candidate ``pairs`` that share a shingle.

    Shingles of candidate texts are kept where any item has them, then meet the shingles
    of the text's own candidates: a row for each pair and shared shingle, however many
    other items own the shingle.
    """
    full = known.select("item", "width", "n", F.explode("shingles").alias("s"))
    again = texts.join(_sized(cut(pairs.select(*_KEY).distinct(), "candidates")), _KEY, "left_semi").select(*_KEY, words(F.col("text")).alias("w"))
    exact = again.select(*_KEY, _exploded({k: F.array_distinct(shingle_texts(F.col("w"), k)) for k in widths}, "s"))
    owned = exact.join(_sized(cut(full.select("width", "s").distinct(), "shingles")), ["width", "s"], "left_semi").distinct()
    wanted = pairs.join(full, "item")
    shared = owned.join(wanted, [*_KEY, "width", "s"])
    return shared.groupBy(*_KEY, "item", "n").agg(F.count("*").alias("n_shared"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every item contained in a document."""
    found = _pairs(docs, items, threshold, width)
    if found is None:
        none = docs.select("doc_id", "text").limit(0)
        return none.selectExpr("doc_id", "cast(null as bigint) as item_id", "0L as n_shingles", "0L as n_shared", "0D as containment")
    ids = items.where("item_id is not null").select("item_id", F.xxhash64(words(F.col("text"))).alias("item")).distinct()
    named = _sized(cut(found.join(ids, "item"), "contained"))
    rows = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")).select("doc_id", *_KEY)
    return rows.join(named, _KEY).select(
        "doc_id",
        "item_id",
        F.col("n").cast("long").alias("n_shingles"),
        "n_shared",
        F.round(F.col("n_shared") / F.col("n"), 6).alias("containment"),
    ).distinct()


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, each judged by its own text; rows without a text stay."""
    pairs = _pairs(docs, items, THRESHOLD, WORDS_PER_SHINGLE)
    if pairs is None:
        return docs
    own = docs.columns
    inner = [f"__own{i}" for i in range(len(own))]  # so that no name of a table can clash
    text = F.col(inner[own.index("text")]).cast("string")
    keyed = docs.toDF(*inner).withColumns({"__t": F.xxhash64(text), "__u": F.xxhash64(F.lit(1), text)})
    found = cut(pairs.select(*_KEY).distinct(), "contaminated")
    judged = keyed.join(_sized(found).withColumn("__hit", F.lit(True)), _KEY, "left")
    return judged.where(F.col("__hit").isNull() | text.isNull()).select(*inner).toDF(*own)

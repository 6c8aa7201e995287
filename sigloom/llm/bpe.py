"""Byte-level BPE by a global shuffle of distinct words, for vocabularies of ranks.

Texts are gathered into blocks. A block's pre-tokens are exploded once per distinct word:
the block keeps the word's number at every position, and the words go, with their
numbers, to buckets by hash. All blocks' copies of a word meet in one bucket, where the
word is merged once. The ids return to their blocks, whose texts are reassembled by
position. Words come to a bucket once per block, so a word that all texts share is no hot
key. Blocks lie in a table bucketed by block and are not shuffled at all. Decoding joins
ids with the table of token bytes, which has a row for each id of the vocabulary.

A block's words and ids are packed into one row for each bucket. A task holds one block
(``BLOCK_CHARS`` characters, or one longer text) and remembers ``REMEMBERED`` words of a
bucket; of more words, later ones may be merged again, with the same result.

Pre-tokens are those of the pattern, with the letters, numbers and white space that the
tiktoken library's regular expressions know, whatever Unicode version Python has. A
pre-token that is in the vocabulary is one id; others are merged by least rank, leftmost
first. Merging takes time in proportion to the length times its logarithm.

Edge cases: a null text is empty and has no ids; so has an empty text. Rows with null or
repeated ids are encoded one for one; extra columns are left out. Texts hold no unpaired
surrogates, as Spark strings have none. A pre-token of any length is merged whole. A
vocabulary without a single byte that a text has is an error, as is an id to be decoded
beyond the vocabulary.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.storage import bucketed
from sigloom.llm.batches import lots
from sigloom.llm.packed import Slots, pack, pack_words, unpack, unpack_words

#: The vocabulary of the registered query, a setting; a parameter everywhere else.
RANKS = os.environ.get("SIGLOOM_BPE_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: what splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BLOCK_CHARS = 8_000_000
REMEMBERED = 1_000_000
#: Bytes of a word beyond which pairs wait in a heap.
SHORT = 100
NEVER = 1 << 62


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and their ids, read by Spark, as the file may be in a remote store."""
    row = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").first()
    pairs = (line.split() for line in bytes(row[0]).splitlines())
    return {base64.b64decode(p[0]): int(p[1]) for p in pairs if p}


@functools.cache
def _class(name: str) -> str:
    """The inside of a character class for ``\\p{L}``, ``\\p{N}`` or ``\\s`` as the library has it."""
    import tiktoken

    one = tiktoken.Encoding(f"class {name}", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    codes = np.array([ord(c) for c in one.decode(one.encode_ordinary(every))])
    firsts = codes[np.diff(codes, prepend=-2) != 1]
    lasts = codes[np.diff(codes, append=0x110001) != 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(firsts, lasts))


@functools.cache
def plain_pattern(pattern: str = PATTERN) -> str:
    """``pattern`` with its Unicode classes written out, for Python's own regular expressions."""
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\[sS]|\\.|.", pattern, re.S):
        if part in (r"\p{L}", r"\p{N}", r"\s"):
            part = _class(part) if inside else f"[{_class(part)}]"
        elif part == r"\S":
            part = f"[^{_class(chr(92) + 's')}]"
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return "".join(out)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT:
        return _merge_long(word, ranks)
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    waiting = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while waiting and (best := min(waiting)) < NEVER:
        at = waiting.index(best)
        joined = parts[at] = parts[at] + parts.pop(at + 1)
        del waiting[at]
        if at:
            waiting[at - 1] = get(parts[at - 1] + joined, NEVER)
        if at < len(waiting):
            waiting[at] = get(joined + parts[at + 1], NEVER)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """``merge`` with a heap of (rank, place) and links between neighbours; outdated entries are passed over."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Block:
    """Texts gathered until they make a block."""

    def __init__(self) -> None:
        self.slots, self.parts, self.ids, self.chars = Slots(), [], [], 0

    def add(self, words: list[str], chars: int) -> None:
        self.parts.append(np.fromiter(map(self.slots.__getitem__, words), np.uint32, len(words)))
        self.chars += chars + 64  # an empty text is a row too

    def row(self, buckets: int) -> list:
        """Ids, pre-tokens of each text, word numbers by position (frequent words low), and words by bucket."""
        slots = np.concatenate(self.parts)
        order = np.argsort(-np.bincount(slots, minlength=len(self.slots)), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        words = [w.encode() for w in self.slots]
        words = [words[i] for i in order.tolist()]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        by = np.argsort(bucket, kind="stable")
        held = []
        for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
            held.append({"bucket": int(bucket[part[0]]), "slots": pack(part), "words": pack_words([words[i] for i in part.tolist()])})
        return [pack(np.array([len(p) for p in self.parts])), pack(number[slots]), held]


def _blocks(docs: DataFrame, id_col: str, text_col: str, pattern: str, buckets: int, block_chars: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"ids array<{kind}>, lengths binary, slots binary, held array<struct<bucket:int,slots:binary,words:binary>>"
    held_type = pa.list_(pa.struct([("bucket", pa.int32()), ("slots", pa.binary()), ("words", pa.binary())]))
    written = plain_pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(written).findall
        block = _Block()

        def close() -> pa.RecordBatch:
            ids = pa.concat_arrays(block.ids)
            lengths, slots, held = block.row(buckets)
            columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([lengths], pa.binary()), pa.array([slots], pa.binary()), pa.array([held], held_type)]
            return pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "slots", "held"])

        for lot in lots(batches):
            first = 0
            for i, text in enumerate(lot.column(1)):
                text = text.as_py() or ""
                block.add(split(text), len(text))
                if block.chars >= block_chars:
                    block.ids.append(lot.column(0).slice(first, i + 1 - first))
                    yield close()
                    block, first = _Block(), i + 1
            if first < lot.num_rows:
                block.ids.append(lot.column(0).slice(first))
        if block.parts:
            yield close()

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


def _encoded_words(words: DataFrame, ranks: dict[bytes, int], remembered: int) -> DataFrame:
    """(block, slots, counts, ids) of rows (block, bucket, slots, words), which come bucket by bucket."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shared.value, {}
        for batch in lots(batches, 64):
            counts, ids = [], []
            for packed in batch.column(2).to_pylist():
                found = []
                for word in unpack_words(packed):
                    if (one := known.get(word)) is None:
                        if len(known) >= remembered:
                            known.clear()
                        one = known[word] = merge(word, table)
                    found.append(one)
                counts.append(pack(np.fromiter(map(len, found), np.uint32, len(found))))
                ids.append(pack(np.fromiter((i for one in found for i in one), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], ["block", "slots", "counts", "ids"])

    return words.select("block", "slots", "words").mapInArrow(run, "block long, slots binary, counts binary, ids binary")


def _reassemble(block: pa.Table, coded: pa.Table) -> pa.Table:
    """(doc_id, n_tokens, ids) of the texts of one block, by position."""
    lengths, slots = unpack(block.column("lengths")[0].as_py()).astype(np.int64), unpack(block.column("slots")[0].as_py())
    parts = [[unpack(x) for x in coded.column(c).to_pylist()] for c in ("slots", "counts", "ids")]
    where, counts, ids = (np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts)
    first, size = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
    size[where] = counts
    first[where] = np.cumsum(counts, dtype=np.int64) - counts
    each = size[slots]
    ends = np.cumsum(each)
    at = np.repeat(first[slots] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
    stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
    data = pa.py_buffer(np.ascontiguousarray(ids[at], "<u4"))
    found = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((4 * stops).astype(np.int32)), data])
    return pa.table([block.column("ids").combine_chunks().flatten(), pa.array(np.diff(stops), pa.int64()), found], ["doc_id", "n_tokens", "ids"])


def encode_documents(
    docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, block_chars: int = BLOCK_CHARS, remembered: int = REMEMBERED
) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ``ids`` are little-endian unsigned 32-bit integers."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(_blocks(docs, id_col, text_col, pattern, buckets, block_chars), "blocks", "block", buckets)
    words = blocks.select("block", F.explode("held").alias("w")).select("block", "w.*").repartition(buckets, "bucket")
    coded = _encoded_words(words, ranks, remembered)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = blocks.select("block", "ids", "lengths", "slots").groupBy("block")
    return texts.cogroup(coded.groupBy("block")).applyInArrow(_reassemble, f"doc_id {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of the tokens of ``ids``, null for null ids.

    The table of token bytes has as many rows as the vocabulary and goes to every task.
    """
    by_id: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    shared = encoded.sparkSession.sparkContext.broadcast(by_id)
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.large_binary())
        for lot in lots(batches):
            texts = []
            for raw in lot.column(at):
                if (raw := raw.as_py()) is None:
                    texts.append(None)
                    continue
                tokens = pc.take(table, pa.array(np.frombuffer(raw, "<u4")))
                if tokens.null_count:
                    raise ValueError("an id has no token")
                texts.append(b"".join(tokens.to_pylist()) if tokens.offset else bytes(tokens.buffers()[2] or b"")[: pc.sum(pc.binary_length(tokens)).as_py() or 0])
            yield pa.RecordBatch.from_arrays([*lot.columns, pa.array(texts, pa.binary())], [*lot.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def report(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    both = decode_documents(encode_documents(docs, ranks), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

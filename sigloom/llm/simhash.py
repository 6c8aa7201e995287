"""SimHash near-duplicate groups by bit-sliced comparison.

Plan: one Arrow pass turns each whole text into 64 bits; equal fingerprints become one
class by a pre-aggregated group-by; classes meet in tables keyed by two equal blocks of
bits (two fingerprints at most ``radius`` bits apart agree in at least two of
``radius + 2`` blocks, so no link is lost); within a bucket the fingerprints are
compared as bit planes; the links found are contracted to components.

``near_copies`` widens this to texts whose sets of 5-word shingles are 0.8 alike, which
lie further apart than a block table of 64 bits can reach. Distinct texts meet in buckets
of MinHash bands. There the same bit planes, over a second SimHash of ``WIDE`` bits of
the set, propose pairs within ``WIDE_RADII``, and the exact sets, which come with them,
verify each proposal on the spot. Only verified links join texts, so a false proposal
takes no true one's place. Texts of fewer than ``BRIEF`` shingles need not lie within a
radius.

Buckets are worked off twice (``settled``). First each is cut into parts of bounded size,
and a part is compared on its own: work and copies are linear in the rows, and a dense
group of whatever size becomes one root. Then only buckets that were cut and still hold
several roots are compared whole: every pair of parts meets, but for parts of the
bucket's commonest root, which need not meet each other.

Edge cases: null and empty texts, and texts of white space, have fingerprint zero and
link like any other. Texts with fewer words than a shingle count as one shingle.
Repeated rows stay repeated and share a component. A null id keeps its row; it never is
a component id unless all ids of the component are null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.storage import cut
from sigloom.llm.batches import lots
from sigloom.operators.graph import connected_components

SEED = 42
#: Rows of a bucket that one task compares at once: fingerprints, and texts with their sets.
PART, WIDE_PART = 1024, 256
#: Words of a shingle and bits of the second fingerprint.
WIDE_WORDS = 5
WIDE = 512
#: Radii of proposal, nearer pairs first. Of sets 0.8 alike with ``BRIEF`` or more shingles, one pair in 700,000 lies beyond the last
#: (at worst 15.6 % of the bits differ in the mean), which is less than bands miss.
WIDE_RADII = (64, 120)
SIMILARITY = 0.8
#: Texts of fewer shingles are verified whatever their bits, which are a matter of chance.
BRIEF = 8
#: MinHash bands and hashes a band: all bands of two texts 0.8 alike differ once in 96,000 pairs.
BANDS = 16
ROWS = 3
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, width: int) -> int:
    """64 bits of one text: a bit is 1 if it is set in over half of the shingle hashes."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    if len(words) < width:
        shingles = iter((b" ".join(words),))
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        n = len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), ">u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(x.as_py(), width) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _planes(values: np.ndarray) -> np.ndarray:
    """One row per bit of a value (of one or more words); lane i of each row, at bit i % 64 of word i // 64, is that bit of value i."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(len(values), -1), axis=1)
    bits = np.vstack([bits, np.zeros((-len(values) % 64, bits.shape[1]), np.uint8)])
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _tally(planes: np.ndarray) -> list[np.ndarray]:
    """Binary digits, least first, of the number of planes set in each lane, by carry-save adders."""
    digits = []
    while len(planes):
        carries = []
        while len(planes) > 2:
            m = len(planes) // 3
            x, y, z = planes[:m], planes[m : 2 * m], planes[2 * m : 3 * m]
            odd = x ^ y
            carries.append((x & y) | (odd & z))
            planes = np.concatenate([odd ^ z, planes[3 * m :]])
        if len(planes) == 2:
            carries.append(planes[:1] & planes[1:])
            planes = planes[:1] ^ planes[1:]
        digits.append(planes[0])
        planes = np.concatenate(carries) if carries else planes[:0]
    return digits


def _lanes(flags: np.ndarray) -> np.ndarray:
    padded = np.concatenate([flags, np.zeros(-len(flags) % 64, bool)])
    return np.packbits(padded, bitorder="little").view("<u8")


def _close(planes: np.ndarray, near: np.ndarray, radius: int, d: int) -> np.ndarray:
    """Positions i of ``near`` whose value lies within ``radius`` bits of value i + d; ``planes`` end in a word of zeros."""
    digits = max(1, radius.bit_length())
    start = (1 << digits) - 1 - radius  # so that the counter overflows just beyond the radius
    wanted = _lanes(near)
    at = np.flatnonzero(wanted)
    if not len(at):
        return at
    step = max(8, -(-len(planes) // min(16, max(2, len(at) // 32))))  # planes added up before lanes beyond the radius are left out
    words, bits = divmod(d, 64)
    end = planes.shape[1] - 1

    def differing(lo: int, hi: int, at: np.ndarray) -> np.ndarray:
        there = planes[lo:hi, np.minimum(at + words, end)]
        if bits:
            there = (there >> np.uint64(bits)) | (planes[lo:hi, np.minimum(at + words + 1, end)] << np.uint64(64 - bits))
        return planes[lo:hi, at] ^ there

    beyond = ~wanted[at]
    count = [np.full(len(at), _FULL if start >> k & 1 else np.uint64(0)) for k in range(digits)]
    for b in range(0, len(planes), step):
        more = _tally(differing(b, b + step, at))
        carry = np.zeros(len(at), np.uint64)
        for k in range(digits):
            add = more[k] if k < len(more) else np.uint64(0)
            odd = count[k] ^ add
            count[k], carry = odd ^ carry, (count[k] & add) | (odd & carry)
        for high in more[digits:]:
            carry = carry | high
        beyond |= carry
        if b + step < len(planes):
            alive = beyond != _FULL
            if not alive.any():
                return at[:0]
            if alive.mean() < 0.7:
                at, beyond = at[alive], beyond[alive]
                count = [c[alive] for c in count]
    bits_ = np.unpackbits((~beyond).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    word, bit = np.nonzero(bits_)
    return at[word] * 64 + bit


def links_within(
    values: np.ndarray, runs: np.ndarray, radii: tuple[int, ...], roots: np.ndarray | None = None, sides: np.ndarray | None = None,
    brief: np.ndarray | None = None, alike: Callable[[int, int], bool] | None = None, met: Callable[[np.ndarray, int], np.ndarray] | None = None,
) -> list[tuple[int, int]]:
    """Position pairs that join all values of a run linked at the last of ``radii`` bits.

    ``values`` have one or more words each and are sorted by ``runs``. For each shift d
    the lanes hold the pairs (i, i + d); carry-save counters add up the differing planes,
    and words whose lanes have all passed the radius are left out of the remaining planes.
    Each pair given lies within a radius and joins what was apart: pairs within an earlier
    radius come first, and values of a run with equal ``roots`` count as joined. With
    ``sides``, only values of different sides are compared. Two ``brief`` values come last
    and need not lie within a radius. A pair for which ``alike`` is false is none, and of
    the positions that ``met`` says have met their partner d further elsewhere none is tried.
    """
    n = len(values)
    planes = np.hstack([_planes(values), np.zeros((values.shape[1] * 64, 1), np.uint64)])
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    longest = int(np.diff(np.r_[starts, n]).max(initial=1))
    parent, found = np.arange(n), []
    if roots is not None:
        _, first, place = np.unique(np.stack([runs, roots], axis=1), axis=0, return_index=True, return_inverse=True)
        parent = first[place.ravel()]
    up = parent.copy()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for radius in radii if brief is None or brief.sum() < 2 else (*radii, None):
        for d in range(1, longest):
            near = np.zeros(n, bool)
            near[: n - d] = (runs[: n - d] == runs[d:]) & (up[: n - d] != up[d:])
            if sides is not None:
                near[: n - d] &= sides[: n - d] != sides[d:]
            if radius is None:
                near[: n - d] &= brief[: n - d] & brief[d:]
                left = np.flatnonzero(near)
            else:
                left = _close(planes, near, radius, d)
            if met is not None and len(left):
                left = left[~met(left, d)]
            joined = len(found)
            for i in left.tolist():
                a, b = root(i), root(i + d)
                if a != b and (alike is None or alike(i, i + d)):
                    parent[max(a, b)] = min(a, b)
                    found.append((i, i + d))
            if len(found) > joined:
                up = parent
                while (flat := up[up]).tobytes() != up.tobytes():
                    up = flat
                parent = up.copy()
    return found


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first four columns, in tables of whole buckets."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
        if not table.num_rows:
            continue
        same = np.ones(table.num_rows, bool)
        for c in table.columns[:4]:
            values = c.to_numpy()
            same &= values == values[-1]
        done = table.num_rows - int(same.sum())  # the last bucket may go on in the next batch
        if done:
            yield table.slice(0, done)
        kept = table.slice(done)
    if kept is not None and kept.num_rows:
        yield kept


def _link_stream(radii: tuple[int, ...], threshold: float = SIMILARITY):
    """From rows (t, k, i, j, own, whole, root, value[, shingles, bands]) sorted by the first four: links (a, b) between roots of a bucket.

    Where i and j differ, only rows of different ``own`` are compared. ``value`` is the
    fingerprint as bytes; ``shingles``, if there, the sorted set that verifies a pair. In
    buckets compared ``whole``, a pair that shares a band before ``t`` is left to that one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buckets(batches):
            if table.num_rows < 2:
                continue
            keys = np.stack([c.to_numpy() for c in table.columns[:4]])
            runs = np.cumsum(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            own, whole, roots = (table.column(c).to_numpy() for c in (4, 5, 6))
            sides = np.where(keys[2] == keys[3], np.arange(len(own)), -1 - own.astype(np.int64))
            values = _words(table.column(7))
            brief = alike = met = None
            if table.num_columns > 8:
                sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column(8)]
                brief = np.fromiter(map(len, sets), np.int64, len(sets)) < BRIEF
                alike = lambda i, j, sets=sets: similar(sets[i], sets[j], threshold)
                earlier = _words(table.column(9))
                earlier[np.arange(earlier.shape[1]) >= np.where(whole, keys[0], 0)[:, None]] = 0
                met = lambda at, d, e=earlier: ((e[at] == e[at + d]) & (e[at] != 0)).any(axis=1)
            found = links_within(values, runs, radii, roots, sides, brief, alike, met)
            yield pa.RecordBatch.from_pydict(_stars([(int(roots[i]), int(roots[j])) for i, j in found]), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Byte strings of one length as rows of big-endian words."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(len(column), -1)


def _stars(found: list[tuple[int, int]]) -> dict[str, list[int]]:
    """The same components as the links ``found`` have, each as links to its least member, so that they are joined in few rounds."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for x, y in found:
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    nodes = [x for x in up if root(x) != x]
    return {"a": nodes, "b": [root(x) for x in nodes]}


def similar(one: np.ndarray, two: np.ndarray, threshold: float = SIMILARITY) -> bool:
    """Whether two sorted sets are at least ``threshold`` alike (Jaccard)."""
    one, two = (one, two) if len(one) <= len(two) else (two, one)
    if len(one) < threshold * len(two) - 1e-9 or not len(one):
        return False
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    shared = int(np.count_nonzero(two[at] == one))
    return shared >= threshold * (len(one) + len(two) - shared) - 1e-9


def _compared(dealt: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """Distinct links (a, b) between roots of rows as ``_link_stream`` takes them."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.repartition(n, "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return rows.mapInArrow(_link_stream(radii), "a long, b long").distinct()


def settled(keyed: DataFrame, valued: Callable[[DataFrame], DataFrame], radii: tuple[int, ...], part: int) -> DataFrame:
    """(node, root): what the roots of ``keyed`` (t, k, node, root) that have a link become.

    Rows with equal t and k meet. ``valued`` takes rows (t, k, i, j, own, whole, node,
    root) and returns them as ``_link_stream`` takes them. Each bucket is cut into parts of about
    ``part`` rows by a hash, each compared on its own. Buckets of more rows whose roots
    are not one by then are compared whole.
    """
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    met = cut(keyed.join(sizes.select("t", "k", "n"), ["t", "k"]), "simhash-met")
    own = F.pmod(F.xxhash64("node", "t"), F.ceil(F.col("n") / part)).cast("int").alias("own")
    once = met.select("t", "k", own, (F.col("n") <= part).alias("whole"), "node", "root")
    once = once.select("t", "k", F.col("own").alias("i"), F.col("own").alias("j"), "own", "whole", "node", "root")
    moved = connected_components(_compared(valued(once), radii))

    large = met.where(F.col("n") > part).join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    large = large.select("t", "k", "node", F.coalesce("to", "root").alias("root"))
    per = large.groupBy("t", "k", "root").agg(F.count("*").alias("c")).groupBy("t", "k")
    per = per.agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("top"))
    again = cut(large.join(per.where("most < n"), ["t", "k"]), "simhash-again")
    if not again.limit(1).count():
        return moved
    half = max(1, part // 2)
    tops, others = (F.ceil(x / half).cast("int") for x in (F.col("most"), F.col("n") - F.col("most")))
    is_top, h = F.col("root") == F.col("top"), F.xxhash64("node")
    placed = again.withColumn("own", F.when(is_top, F.pmod(h, tops)).otherwise(tops + F.pmod(h, others)).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.when(is_top, tops).otherwise(0), tops + others - 1)))
    whole = placed.select("t", "k", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", F.lit(True).alias("whole"), "node", "root")
    return chained(moved, connected_components(_compared(valued(whole), radii)))


def chained(roots: DataFrame, moved: DataFrame) -> DataFrame:
    """``roots`` (node, root) after ``moved`` (node, root) took some roots elsewhere; nodes of ``moved`` alone are kept too."""
    again = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    again = again.select("node", F.coalesce("to", "root").alias("root"))
    return cut(again.union(moved.join(roots.select("node"), "node", "left_anti")), "simhash-roots")


def links(classes: DataFrame, radius: int = 3, part: int = PART) -> DataFrame:
    """(node, root) of the distinct fingerprints in column ``fp`` that have another within ``radius`` bits; the root is one of them."""
    blocks = radius + 2
    edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    cut_out = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    tables = [
        F.struct(F.lit(i * blocks + j).alias("t"), F.shiftleft(cut_out[i], 32).bitwiseOR(cut_out[j]).alias("k"))
        for i in range(blocks)
        for j in range(i + 1, blocks)
    ]
    keyed = classes.select("fp", F.explode(F.array(*tables)).alias("e")).select("e.t", "e.k", F.col("fp").alias("node"), F.col("fp").alias("root"))
    value = F.to_binary(F.lpad(F.hex("node"), 16, "0"), F.lit("hex")).alias("value")
    return settled(keyed, lambda rows: rows.select("t", "k", "i", "j", "own", "whole", "root", value), (radius,), part)


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 bits of each hash."""
    x = hashes + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mixed(np.arange(BANDS * ROWS, dtype=np.uint64), 1) | np.uint64(1)


def shingle_set(text: bytes | None) -> tuple[int, np.ndarray]:
    """(hash of the words, hashes of the distinct shingles, sorted) of one text; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) < WIDE_WORDS:
        shingles = iter((joined,) if words else ())
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(WIDE_WORDS))))
    return xxhash.xxh64_intdigest(joined, SEED), np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def bands_of(found: np.ndarray) -> list[int]:
    """MinHash band keys of a set of shingles; none of an empty set."""
    if not len(found):
        return []
    least = np.array([(found * f).min() for f in _FACTORS]).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), SEED) for row in least]


def wide_print(found: np.ndarray) -> bytes:
    """SimHash of ``WIDE`` bits of a set of shingles."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(found), 1 << 12):
        lot = np.stack([_mixed(found[at : at + (1 << 12)], k) for k in range(WIDE // 64)], axis=1)
        ones += np.unpackbits(lot.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(found)).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, tid, bands): the fingerprint, the hash of the words, and the band keys that near copies share."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, tid long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            texts = [x.as_py() for x in batch.column(1).cast(pa.binary())]
            prints = np.fromiter((fingerprint(x, 3) for x in texts), np.uint64, len(texts)).view(np.int64)
            made = [(tid, bands_of(found)) for tid, found in map(shingle_set, texts)]
            tids = np.array([t for t, _ in made], np.uint64).view(np.int64)
            offsets = np.cumsum([0, *(len(b) for _, b in made)]).astype(np.int32)
            bands = np.array([k for _, b in made for k in b], np.uint64).view(np.int64)
            columns = [pa.array(prints), pa.array(tids), pa.ListArray.from_arrays(offsets, pa.array(bands))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "fp", "tid", "bands"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lots(batches, 64):
        made = [shingle_set(x.as_py()) for x in batch.column(0).cast(pa.binary())]
        tids = np.array([t for t, _ in made], np.uint64).view(np.int64)
        bands = [np.array(bands_of(x), ">u8").tobytes() for _, x in made]
        columns = [pa.array(x, pa.binary()) for x in ([wide_print(x) for _, x in made], [x.astype("<u8").tobytes() for _, x in made], bands)]
        yield pa.RecordBatch.from_arrays([pa.array(tids), *columns], ["tid", "value", "shingles", "bands"])


def shingle_sets(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(tid, value, shingles, bands): second fingerprints, sets of shingles and band keys of the texts ``named`` (tid, rep); only these are read again."""
    wanted = cut(named.select(F.col("rep").alias("doc_id")).distinct(), "simhash-named")
    again = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(wanted, "doc_id", "left_semi")
    sets = again.select("text").mapInArrow(_sets, "tid long, value binary, shingles binary, bands binary")
    return cut(sets.join(named, "tid", "left_semi").dropDuplicates(["tid"]), "simhash-sets")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, part: int = PART
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``radius``
    differing bits, itself included.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = _classes(prints)
    return _grouped(prints, classes, links(classes, radius, part))


def near_copies(docs: DataFrame, part: int = PART, wide_part: int = WIDE_PART) -> DataFrame:
    """As ``near_duplicates``, with links too between texts whose sets of 5-word shingles are ``SIMILARITY`` alike.

    Rows without an id have no part in the wider links.
    """
    prints = cut(sketches(docs), "simhash")
    classes = _classes(prints)
    roots = cut(links(classes, part=part), "simhash-roots")
    once = [F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.first("bands").alias("bands")]
    texts = prints.where("doc_id is not null").groupBy("tid").agg(*once)
    rooted = texts.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    texts = cut(rooted.select("tid", "rep", "root", "bands"), "simhash-texts")
    keyed = texts.select(F.col("tid").alias("node"), "root", F.posexplode("bands").alias("t", "k"))
    sets = None

    def valued(rows: DataFrame) -> DataFrame:
        nonlocal sets
        if sets is None:  # the texts of the second comparison are among those of the first
            sets = shingle_sets(docs, texts.join(rows.select(F.col("node").alias("tid")).distinct(), "tid", "left_semi").select("tid", "rep"))
        return rows.join(sets.withColumnRenamed("tid", "node"), "node").select("t", "k", "i", "j", "own", "whole", "root", "value", "shingles", "bands")

    return _grouped(prints, classes, chained(roots, settled(keyed, valued, WIDE_RADII, wide_part)))


def _classes(prints: DataFrame) -> DataFrame:
    return cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")


def _grouped(prints: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``prints`` with the least id of the component that ``roots`` (node, root) puts their fingerprint in."""
    rooted = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    rooted = rooted.select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    hex_ = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", hex_, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is its group's component id; of repeated ids one row.

    Rows without an id have no name to be grouped under and stay.
    """
    found = cut(near_copies(docs), "simhash-kept")
    kept = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("copies"))
    out = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    again = kept.where("copies > 1").select("doc_id")
    if again.limit(1).count():
        single = out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        out = out.join(again, "doc_id", "left_anti").unionByName(single)
    return out.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)

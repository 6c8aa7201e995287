r"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice of a text has a node for each boundary between characters and an edge for
each piece. For a unigram model the best path is the one of the highest score. For a BPE
model it is the one that merging yields: a path is that one if and only if each two
neighbouring pieces are what merging makes of them together, so each boundary keeps one
surviving edge, the piece whose left neighbour on its own survivor's path is compatible,
and the survivors' path through the last boundary is the encoding. Compatibility of two
pieces is decided once, by merging, and remembered.

Only a window is retained: where no edge crosses a boundary all paths meet there and
their ids are committed at once; in a run without such a boundary the backpointers of
the last ``longest`` boundaries are followed from time to time, and everything before
the boundary where they meet is committed. What was committed between two meeting points
is remembered for spans that come again (a bounded table).

Normalisation is what the model asks for, of which the dummy prefix and the removal of
extra spaces are supported, but no table of character rules. Characters outside the
vocabulary become byte pieces; where the model has none, a run of them is one unknown
piece. In a unigram model such a character costs ``UNKNOWN_PENALTY`` more than the worst
piece.

Edge cases: a null text has null ids and decodes to null; an empty text has none.
U+2581 in a text decodes to a space, as the format has it. Unpaired surrogates cannot
occur in Spark strings. Rows with null or repeated ids are encoded one for one; extra
columns are ignored or kept as the function says. Long texts stream.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.batches import lots

SPACE = "▁"
#: The model of the registered query, a setting; a parameter everywhere else.
MODEL = os.environ.get("SIGLOOM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Spans that a worker remembers in each of two generations (about 150 bytes each), and pairs of pieces.
REMEMBERED, PAIRS = 250_000, 500_000
#: Spans of at most so many characters fit into one window.
SHORT = 64
#: How much below the worst piece an unknown character scores in a unigram model.
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    is_bpe: bool
    dummy_prefix: bool
    squeeze: bool = False
    ids: dict[str, int] = field(default_factory=dict)
    prefixes: set[str] = field(default_factory=set)
    bytes: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    longest: int = 1
    unknown: int = 0
    has_bytes: bool = False
    worst: float = 0.0

    def __post_init__(self) -> None:
        of_byte = {}
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind in (NORMAL, USER):
                self.ids[piece] = i
            elif kind == BYTE:
                of_byte[int(piece[1:-1], 16)] = i
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.has_bytes = len(of_byte) == 256
        self.bytes = [of_byte.get(b, self.unknown) for b in range(256)]
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.prefixes = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.longest = max(map(len, self.ids), default=1)
        one = {i: chr(b) if 0 < b < 128 else "\x00" for b, i in of_byte.items()}
        self.texts = [one.get(i) or (p if k in (NORMAL, USER) else "") for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def parse_model(data: bytes) -> Model:
    pieces, scores, kinds, is_bpe, dummy, squeeze = [], [], [], False, True, True
    for n, value in _fields(data):
        if n == 1:
            f = dict(_fields(value))
            pieces.append(f.get(1, b"").decode())
            scores.append(float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]))
            kinds.append(f.get(3, NORMAL))
        elif n == 2:
            is_bpe = dict(_fields(value)).get(3, 1) == 2
        elif n == 3:
            f = dict(_fields(value))
            if f.get(2):
                raise ValueError("only models without character rules of their own are supported")
            dummy, squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
    return Model(pieces, scores, kinds, is_bpe, dummy, squeeze)


def load_model(spark: SparkSession, path: str) -> Model:
    """The model at ``path``, read by Spark where Spark can, as it may be in a remote store."""
    row = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").first()
    return parse_model(bytes(row[0]))


def merged(model: Model, text: str) -> list[str]:
    """``text`` in pieces as merging makes them: the best adjacent pair first, the leftmost of equals."""
    parts = list(text)
    ids, scores = model.ids, model.scores
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            k = ids.get(parts[i] + parts[i + 1])
            if k is not None and (best is None or scores[k] > best):
                best, at = scores[k], i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Spans(dict):
    """Ids of spans seen before, as bytes. A span not asked for while a generation fills is forgotten."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.older = encoder, {}

    def __missing__(self, span: str) -> bytes:
        if (ids := self.older.get(span)) is None:
            inner = self.encoder.inner
            cuts = [i for i in range(1, len(span)) if span[i - 1 : i + 1] not in inner] if len(span) <= SHORT else []
            if cuts:
                ids = b"".join([self[span[a:b]] for a, b in zip([0, *cuts], [*cuts, len(span)])])
            else:
                ids = np.array(self.encoder.span(span), "<i4").tobytes()
            if len(span) > SHORT:
                return ids
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[span] = ids
        return ids


class Encoder:
    """Streaming encoder of one worker."""

    def __init__(self, model: Model):
        self.model = model
        #: For the id of a piece, or -1 where none stands before, whether a piece may follow.
        self.fits: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.spans = Spans(self)
        #: Beginnings of pieces, with the id of the piece that they are, or -1; pieces that merging never makes are none.
        whole = (lambda p: merged(model, p) == [p]) if model.is_bpe else (lambda p: True)
        self.begins = {p: model.ids[p] if p in model.ids and whole(p) else -1 for p in model.prefixes}
        #: Neighbours inside pieces; between any others all paths meet.
        self.inner = {p[i : i + 2] for p in model.ids for i in range(len(p) - 1)}
        inside = {c for p in model.ids for c in p}
        #: Where a space begins a piece and never stands inside one after another character, every path meets before it.
        self.space_meets = not any(SPACE in p.lstrip(SPACE) for p in model.ids)
        self.newline_meets = "\n" not in inside

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves these two pieces as they are when they stand together."""
        row = self.fits.get(left)
        if row is None:
            row = self.fits[left] = {}
        if (known := row.get(right)) is None:
            if self.pairs >= PAIRS:
                self.fits, self.pairs = {}, 0
            a, b = self.model.pieces[left], self.model.pieces[right]
            known = row[right] = merged(self.model, a + b) == [a, b]
            self.pairs += 1
        return known

    def span(self, text: str) -> list[int]:
        """Ids of a piece of text at whose ends all paths meet, found with a bounded window."""
        if len(text) <= SHORT and self.model.is_bpe:
            return self._short(text)
        model, out = self.model, []
        begins = self.begins
        n, first = len(text), 0  # all before ``first`` is committed
        back: dict[int, tuple[int, int, float]] = {0: (-1, -1, 0.0)}  # boundary -> (boundary before, id, score)
        pending: dict[int, list[tuple[int, int]]] = {}  # boundary -> edges that end there
        reach, before = 0, -1  # the furthest end of an edge; the last committed id, -1 after a character outside the vocabulary
        for j in range(n):
            alive = j in back
            k = j + 1
            while k <= n and (piece := begins.get(text[j:k])) is not None:
                if piece >= 0:
                    pending.setdefault(k, []).append((j, piece))
                    reach = max(reach, k)
                k += 1
            if text[j] not in model.ids:  # no edge: bytes of the character, as a break that no piece crosses
                pending.setdefault(j + 1, []).append((j, -2))
                reach = max(reach, j + 1)
            self._settle(j + 1, pending.pop(j + 1, ()), back)
            meets = reach <= j + 1
            if not meets and (j + 1 - first) >= 8 * model.longest and (j + 1 - first) % (4 * model.longest) == 0:
                if (common := self._meeting(back, first, range(max(first, j + 2 - model.longest), j + 2))) > first:
                    before = self._commit(text, back, first, common, out)
                    first = common
                    for old in [x for x in back if x < first]:
                        del back[old]
                    back[first] = (-1, before, back[first][2])
            if meets and alive is not None and j + 1 in back and j + 1 - first:
                before = self._commit(text, back, first, j + 1, out)
                first = j + 1
                back = {first: (-1, before, back[first][2])}
        if first < n:
            raise ValueError("no path through the lattice")
        return out

    def _short(self, text: str) -> list[int]:
        """``span`` for a BPE text that is one window: all survivors are kept, and the path is read at the end."""
        begins, fits, n = self.begins.get, self.fits, len(text)
        last, start = [-3] * (n + 1), [0] * (n + 1)  # id of the surviving edge (-3 none yet, -1 none needed), where it begins
        last[0] = -1
        for i in range(n):
            left = last[i]
            if left == -3:
                continue
            known = fits.get(left, _NOTHING).get
            for k in range(i + 1, n + 1):
                if (piece := begins(text[i:k])) is None:
                    break
                if piece >= 0 and last[k] == -3:
                    if left < 0 or (fit if (fit := known(piece)) is not None else self.compatible(left, piece)):
                        last[k], start[k] = piece, i
            if last[i + 1] == -3 and text[i] not in self.model.ids:
                last[i + 1], start[i + 1] = -2, i  # bytes: no piece crosses this character
        path, end = [], n
        if last[n] == -3:
            raise ValueError("no path through the lattice")
        while end:
            path.append((start[end], end, last[end]))
            end = start[end]
        out: list[int] = []
        for i, k, piece in reversed(path):
            if piece >= 0:
                out.append(piece)
            else:
                self._outside(text[i:k], out)
        return out

    def _outside(self, chars: str, out: list[int]) -> None:
        """Append the ids of what no piece covers."""
        if self.model.has_bytes:
            out.extend(self.model.bytes[b] for b in chars.encode("utf-8", "surrogatepass"))
        elif not out or out[-1] != self.model.unknown:
            out.append(self.model.unknown)

    def _settle(self, j: int, edges, back: dict) -> None:
        """Keep the surviving edge among those that end at boundary ``j``."""
        best = None
        for i, piece in edges:
            if (here := back.get(i)) is None:
                continue
            if piece == -2:
                total = here[2] + (0.0 if self.model.is_bpe else self.model.worst)
                if best is None or (not self.model.is_bpe and total > best[2]):
                    best = (i, -2, total)
            elif self.model.is_bpe:
                left = here[1]
                if left < 0 or self.compatible(left, piece):
                    best = (i, piece, 0.0)
                    break
            else:
                total = here[2] + self.model.scores[piece]
                if best is None or total > best[2]:
                    best = (i, piece, total)
        if best is not None:
            back[j] = best

    @staticmethod
    def _meeting(back: dict, first: int, ends) -> int:
        """The last boundary through which the paths to all of ``ends`` lead."""
        common = None
        for end in ends:
            if end not in back:
                continue
            path = set()
            while end > first:
                path.add(end)
                end = back[end][0]
            common = path if common is None else common & path
        return max(common, default=first) if common else first

    def _commit(self, text: str, back: dict, first: int, end: int, out: list[int]) -> int:
        """Append the ids of the path from ``first`` to ``end``; the last one tells what may follow."""
        path = []
        while end > first:
            start, piece, _ = back[end]
            path.append((start, end, piece))
            end = start
        for start, stop, piece in reversed(path):
            if piece >= 0:
                out.append(piece)
            else:
                self._outside(text[start:stop], out)
        return path[0][2]

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if self.model.squeeze:
            text = _BLANKS.sub(" ", text).strip(" ")
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        text = SPACE + text if self.model.dummy_prefix else text
        if not self.space_meets:
            return np.array(self.span(text), "<i4").tobytes()
        pattern = _AT_SPACE_OR_LINE if self.newline_meets else _AT_SPACE
        found = b"".join(map(self.spans.__getitem__, pattern.findall(text)))
        return found if self.model.has_bytes else self._one_of_a_run(found)

    def _one_of_a_run(self, found: bytes) -> bytes:
        """Ids of spans joined: unknown pieces that meet are one."""
        ids = np.frombuffer(found, "<i4")
        unknown = ids == self.model.unknown
        return ids[~np.r_[False, unknown[1:] & unknown[:-1]]].tobytes()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()


_NOTHING: dict = {}
_BLANKS = re.compile(" +")
_AT_SPACE = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_AT_SPACE_OR_LINE = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def decode(model: Model, ids: list[int]) -> str:
    """Text of ``ids``; bytes that are no UTF-8 become replacement characters."""
    text = "".join(map(model.texts.__getitem__, ids))
    if "\x00" in text:  # marks bytes
        text = _with_bytes(model, ids)
    text = text[1:] if model.dummy_prefix and text.startswith(SPACE) else text
    return text.replace(SPACE, " ")


def _with_bytes(model: Model, ids: list[int]) -> str:
    out, raw = [], bytearray()
    for i in ids:
        kind = model.kinds[i]
        if kind == BYTE:
            raw.append(int(model.pieces[i][1:-1], 16))
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw = bytearray()
        if kind in (NORMAL, USER):
            out.append(model.pieces[i])
    if raw:
        out.append(raw.decode("utf-8", "replace"))
    return "".join(out)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker and broadcast model, so that what it remembers outlives a task."""
    if shared.value is not getattr(_ENCODERS.get(0), "model", None):
        _ENCODERS[0] = Encoder(shared.value)
    return _ENCODERS[0]


def encode_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_ids, ids_sha256, round_trip) of every row.

    ``ids_sha256`` is over the ids as little-endian 32-bit integers; ``round_trip`` says
    whether decoding gives the text back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, n_ids long, ids_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared)
        for lot in lots(batches):
            texts = lot.column(1).to_pylist()
            raw = [None if t is None else coder.encode_bytes(t) for t in texts]
            found = [None if r is None else np.frombuffer(r, "<i4") for r in raw]
            same = [None if t is None else decode(coder.model, f.tolist()) == t for t, f in zip(texts, found)]
            hashes = [None if r is None else hashlib.sha256(r).hexdigest() for r in raw]
            sizes = [None if f is None else len(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [lot.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "ids", "n_ids", "ids_sha256", "round_trip"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) of rows with ``doc_id`` and ``ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            texts = [None if x is None else decode(shared.value, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)

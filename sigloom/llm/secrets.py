r"""Secret scans by assignment-aware lexing.

Three base patterns find credentials by their looks (assign, access, hex). Beyond them
the text is lexed into name-value pairs by the rules of several syntaxes: code (a name,
``=`` or ``:``, and terms joined by ``+``, each a literal with its prefix, quotes and
escapes, or a name), settings (``NAME=value`` to the end of a line), ``#define``, XML
elements, and YAML blocks. Names with constant values are propagated through the text in
order, so that a secret put together from parts, or handed on under another name, is
seen whole; a name that is given anything else is no constant any more. Scopes are not
told apart. Pairs whose target
name is sensitive are scored by the words of the name and the shape of the value; those
of ``THRESHOLD`` or more add a span of kind ``pair`` over the value as written, unless a
base span overlaps it.

All base spans stay, as the patterns give them: leftmost, not overlapping within a kind,
failing matches dropped without another try.

Edge cases: a null text is empty and has no spans. Overlapping spans of different base
kinds are all reported. Rows with null or repeated ids are scanned one by one. Extra
columns are ignored. Long texts are scanned whole; only assignments are kept in memory.
Values of any length are scored whole: beyond ``LONGEST_VALUE`` characters what the score
needs is kept instead of the value.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "pair")

# The base patterns. Runs too short to count are left out where that moves no other match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN = 12

# Weights of words in a target name, and words that mark a value as no secret.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0, "api": 0.3, "key": 0.5,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "private": 0.5, "access": 0.4, "bearer": 0.8, "session": 0.4, "signature": 0.4, "salt": 0.4,
}
HARMLESS = ("example", "changeme", "placeholder", "your", "xxxx+", "todo", "none", "null", "true", "false", "test", "dummy", "redacted")
THRESHOLD = 1.3
LEAST_NAME_SCORE, LEAST_VALUE_SCORE = 0.5, 0.35
LEAST_VALUE = 8

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*"
_ASSIGNED = re.compile(rf"""(?<![A-Za-z0-9_$.-])(["']?)({_NAME})\1[\x20\t]*(?::=|=>|==?|:)[\x20\t]*(?=["'`A-Za-z0-9_$+/])""")
_DEFINED = re.compile(rf"""^[\x20\t]*\#[\x20\t]*define[\x20\t]+({_NAME})[\x20\t]+(?=\S)""", re.M)
_ELEMENT = re.compile(rf"""<(?:[A-Za-z0-9_]+:)?({_NAME})(?:\s[^<>]*)?>([^<>]+)</""")
_BLOCK = re.compile(rf"""^([\x20\t]*)({_NAME}):[\x20\t]*[|>][+-]?[\x20\t]*\n((?:\1[\x20\t]+\S.*(?:\n|$))+)""", re.M)
_SETTING = re.compile(rf"""^[\x20\t]*(?:export[\x20\t]+)?({_NAME})[\x20\t]*[=:][\x20\t]*(?=[A-Za-z0-9+/_.=$-]*[^\sA-Za-z0-9+/_.=$"'`()\[\]{{}};,<>-])([^\s"'`()\[\]{{}};,<>]+)[\x20\t]*\r?$""", re.M)
_TERM = re.compile(
    rf"""([A-Za-z]{{0,2}})(?:\"\"\"((?:[^"\\]|\\.|"(?!""))*)\"\"\"|'''((?:[^'\\]|\\.|'(?!''))*)'''|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`)"""
    rf"""|({_NAME})(?![A-Za-z0-9+/=_-])|([A-Za-z0-9+/_.=$-]+)""", re.S,
)
_PLUS = re.compile(r"[\x20\t]*\+[\x20\t]*")
_ESCAPED = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|(.))", re.S)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HARMLESS = re.compile(rf"(?<![a-z])(?:{'|'.join(HARMLESS)})(?![a-z])")
_CLASSES = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
#: Characters of a value that is kept as it is; of a longer one (a name joined to itself doubles) a ``Long`` is kept, of equal score.
LONGEST_VALUE = 4096
#: Characters at either end of a long value that may belong to a word across a join; no harmless word is as long.
EDGE = 32


@dataclass(frozen=True)
class Long:
    """What the score of a long value needs: its length, its characters, harmless words and blanks inside, and its two ends."""

    length: int
    counts: Counter
    harmless: bool
    first: str
    last: str

    def __len__(self) -> int:
        return min(self.length, sys.maxsize)


def _long(value: str) -> Long:
    found = _HARMLESS.finditer(value.lower())
    return Long(len(value), Counter(value), any(m.start() > 0 and m.end() < len(value) for m in found), value[:EDGE], value[-EDGE:])


def join(one: str | Long, two: str | Long) -> str | Long:
    """Two values one after the other, in space that does not grow with their length."""
    if isinstance(one, str) and isinstance(two, str) and len(one) + len(two) <= LONGEST_VALUE:
        return one + two
    a, b = (x if isinstance(x, Long) else _long(x) for x in (one, two))
    if not a.length or not b.length:
        return a if a.length else b
    seam = a.last + b.first
    inside = any(m.start() > 0 and m.end() < len(seam) for m in _HARMLESS.finditer(seam.lower()))
    return Long(a.length + b.length, a.counts + b.counts, a.harmless or b.harmless or inside, (a.first + b.first)[:EDGE], (a.last + b.last)[-EDGE:])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    """How sensitive a target name is, by its words in camel, snake or kebab case."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return sum(NAME_WEIGHTS.get(w, 0.0) for w in words) + (0.4 if "apikey" in "".join(words) and "apikey" not in words else 0.0)


def value_score(value: str | Long) -> float:
    """How much a value looks like a secret: entropy per character, classes of characters, length."""
    if isinstance(value, str):
        if len(value) < LEAST_VALUE or _HARMLESS.search(value.lower()) or " " in value.strip():
            return 0.0
        n, counts = len(value), Counter(value)
        classes = sum(p.search(value) is not None for p in _CLASSES)
    else:
        ends = any(m.start() == 0 for m in _HARMLESS.finditer(value.first.lower())) or any(m.end() == len(value.last) for m in _HARMLESS.finditer(value.last.lower()))
        blanks = sum(len(x) - len(y) for x, y in ((value.first, value.first.lstrip()), (value.last, value.last.rstrip())))
        if value.harmless or ends or value.counts[" "] > blanks:
            return 0.0
        n, counts = value.length, value.counts
        classes = sum(any(p.search(c) for c in counts) for p in _CLASSES)
    shares = (c / n for c in counts.values())
    entropy = -sum(x * math.log2(x) for x in shares if x)
    return min(1.0, entropy / 4) * 0.6 + 0.15 * max(0, classes - 1) + (0.1 if n >= 16 else 0.0)


def unescaped(literal: str) -> str:
    """The characters that a literal with backslash escapes stands for."""
    if "\\" not in literal:
        return literal
    plain = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\n": ""}
    return _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else plain.get(m[3], m[3]), literal)


def _assigned(text: str) -> Iterator[tuple[int, str, re.Match]]:
    """Place, syntax and match of what may be an assignment, in order of place."""
    patterns = [("code", _ASSIGNED), ("define", _DEFINED), ("setting", _SETTING)]
    patterns = [p for p in patterns if p[0] != "define" or "define" in text]
    patterns += [("element", _ELEMENT)] * ("</" in text) + [("block", _BLOCK)] * (":" in text and ("|" in text or ">" in text))
    return heapq.merge(*([(m.start(), kind, m) for m in p.finditer(text)] for kind, p in patterns), key=lambda x: x[:2])


def pairs(text: str) -> Iterator[tuple[str, str | Long, int, int]]:
    """(name, constant value, start, end) of every assignment of a constant, in order.

    ``start`` and ``end`` enclose the value as written, quotes left out where it is one literal.
    """
    if "=" not in text and ":" not in text and "</" not in text and "define" not in text:
        return
    known: dict[str, str | Long] = {}
    settings: set[int] = set()
    for _, kind, m in _assigned(text):
        if kind in ("element", "setting", "block"):
            name, group = (m[2], 3) if kind == "block" else (m[1], 2)
            lines = [x.strip() for x in m[group].split("\n")] if kind == "block" else [m[group].strip()]
            known[name] = "\n".join(x for x in lines if x)
            first = m.start(group) + len(m[group]) - len(m[group].lstrip())
            settings.add(m.start(1) if kind == "setting" else -1)
            if known[name]:
                yield name, known[name], first, m.start(group) + len(m[group].rstrip())
            continue
        name = m[1] if kind == "define" else m[2]
        if kind == "code" and m.start(2) in settings:  # the same line, read as a setting already
            continue
        at, value, first, last, terms, constant = m.end(), "", m.end(), m.end(), 0, True
        begin = at
        while (t := _TERM.match(text, at)) is not None:
            group = t.lastindex or 1
            if group == 7:
                constant = constant and (t[7] in known or any(c.isdigit() for c in t[7]))  # a bare word without a digit names something
                value = join(value, known.get(t[7], t[7]))
            elif group == 8:
                value = join(value, t[8])
            else:
                prefix = t[1].lower()
                constant = constant and not ("f" in prefix and "{" in t[group]) and not (group == 6 and "${" in t[group])
                value = join(value, t[group] if "r" in prefix else unescaped(t[group]))
            terms += 1
            first = t.start(group) if terms == 1 else begin
            last = t.end(group) if terms == 1 else t.end()
            plus = _PLUS.match(text, t.end())
            if not plus:
                constant = constant and text[t.end() : t.end() + 1] not in ("(", "[")  # a call or an element
                break
            at = plus.end()
        else:
            constant = False
        if terms and constant:
            known[name] = value
            yield name, value, first, last
        else:
            known.pop(name, None)


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed."""
    text = text or ""
    found = base_spans(text)
    taken = _joined(found)
    end = -1
    for name, value, a, b in pairs(text):
        if b <= end:  # inside a value already reported
            continue
        weight = name_score(name)
        if weight < LEAST_NAME_SCORE:
            continue
        looks = value_score(value)
        if looks > LEAST_VALUE_SCORE and weight + looks >= THRESHOLD and not _overlaps(taken, a, b):
            found.append(("pair", a, b))
            end = b
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(found: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The ranges that spans cover, overlapping ones joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    at = bisect.bisect_left(taken, (b,))
    return at > 0 and taken[at - 1][1] > a


def _text_of(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_pair, base_sha256, spans) of every row, in one pass without a shuffle."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {counts}, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t.as_py()) for t in batch.column(1)]
            sums = [pa.array([sum(s[0] == k for s in x) for x in found], pa.int64()) for k in KINDS]
            base = [hashlib.sha256(_text_of([s for s in x if s[0] != "pair"]).encode()).hexdigest() for x in found]
            columns = [batch.column(0), *sums, pa.array(base, pa.string()), pa.array([_text_of(x) for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

"""Personal data by pattern, checksum and context, in Spark expressions only.

Patterns propose spans, validators (octet range, Luhn, mod 97, digit counts) confirm or
drop them, and context words near a span move its score. Kinds: email, ip, card, phone,
and iban, which the mod-97 validator adds to the others. The patterns start a match only
where one can begin and use possessive repeats, so their time is linear in the text. A
run of digits too short for a card is no match to begin with: runs are disjoint, so
leaving it out moves no other match.

Edge cases: a null text counts as empty and has no spans. Overlapping spans of different
kinds are all reported. Rows with null or repeated ids are kept one for one; extra
columns are ignored. Very long texts are scanned whole, in time linear in their length:
contexts and redacted texts are cut from chunks of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm import spans as S

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

# The patterns of the kinds, with a hint that a text must contain for the pattern to match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
}
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}

# A part of an address of four numbers, at most 255.
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# Words that make a span of the kind likelier, and words that make any span doubtful.
CONTEXT = {
    "email": "mail|e-mail|contact|write|courriel|correo|kontakt",
    "ip": "ip|host|server|address|adresse|login",
    "card": "card|visa|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
DOUBT = "example|sample|test|dummy|fake|version|isbn"

# Score of a confirmed span, what near words add or take, and how many code points count as near.
START = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.9}
HELPS, HURTS, NEAR = 0.15, 0.3, 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0)


def mod97(value: Column) -> Column:
    """Whether an account number, blanks aside, leaves remainder 1 (letters count from 10)."""
    bare = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.length(bare).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), add) == 1)


def confirmed(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern passes the kind's validator."""
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return mod97(value) if kind == "iban" else F.lit(True)


def _score(kind: str, pieces: Column, span: Column) -> Column:
    """Score of a span by the words near it; ``pieces`` are the text's chunks."""
    first = F.greatest(span["start"] - NEAR, F.lit(0))
    around = F.lower(F.concat(S.part(pieces, first, span["start"]), F.lit(" "), S.part(pieces, span["end"], span["end"] + NEAR)))
    helps = F.when(around.rlike(rf"(?<!\p{{L}})(?:{CONTEXT[kind]})(?!\p{{L}})"), HELPS).otherwise(0.0)
    hurts = F.when(around.rlike(rf"(?<!\p{{L}})(?:{DOUBT})(?!\p{{L}})"), HURTS).otherwise(0.0)
    return F.round(F.least(F.lit(START[kind]) + helps - hurts, F.lit(1.0)), 2)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array<struct<kind, start, end, value, score>> by kind as listed, then start."""
    return _found(docs, text_col).drop("__chunks")


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """``find`` with the text's chunks, null of a text without a match."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    temp = [f"__{part}_{kind}" for kind in KINDS for part in ("m", "g")]
    own = [F.col(f"`{c}`") for c in docs.columns]
    hinted = {k: F.when(text.rlike(HINTS[k]), text).otherwise("") for k in KINDS}
    one = docs.select(*own, *(S.matches(hinted[k], PATTERNS[k]).alias(f"__m_{k}") for k in KINDS))
    some = F.greatest(*(F.size(f"__m_{k}") for k in KINDS)) > 0
    two = one.select("*", F.when(some, S.chunks(text)).alias("__chunks"), *(F.when(F.size(f"__m_{k}") > 0, S.gaps(text, PATTERNS[k])).alias(f"__g_{k}") for k in KINDS))

    def of(kind: str) -> Column:
        placed = S.places(F.col(f"__m_{kind}"), F.col(f"__g_{kind}"))
        good = F.filter(placed, lambda s: confirmed(kind, s["value"]))
        scored = F.transform(
            good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _score(kind, F.col("__chunks"), s).alias("score"))
        )
        none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")
        return F.when(F.size(f"__m_{kind}") > 0, scored).otherwise(none)

    return two.withColumn("pii", F.concat(*(of(k) for k in KINDS))).drop(*temp)


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every row: doc_id, n_*, base_sha256, spans, pii_score."""
    found = find(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(S.digest_text(base).cast("binary"), 256).alias("base_sha256"),
        S.digest_text(F.col("pii")).alias("spans"),
        F.round(F.aggregate("pii", F.lit(0.0).cast("double"), lambda t, s: t + s["score"]), 2).alias("pii_score"),
    )


def redact(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """``docs`` with every span of ``least_score`` or more replaced by ``<KIND>`` in ``text``, and ``n_chars`` to match.

    Overlapping spans are replaced as one, named after the one that begins first. A null
    text stays null. Texts without spans stay as they are.
    """
    own = docs.columns
    inner = [f"__own{i}" for i in range(len(own))]  # so that no name of a table can clash
    text = inner[own.index("text")]
    found = _found(docs.toDF(*inner), text)
    chosen = F.array_sort(
        F.transform(F.filter("pii", lambda s: s["score"] >= least_score), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))
    )
    found = found.withColumn("__chosen", chosen)
    found = found.withColumn("__covered", S.running_max(F.transform("__chosen", lambda s: -s["back"])))
    pieces = F.col("__chunks")

    def fresh(s: Column, i: Column) -> Column:
        at = F.element_at("__covered", i + 1)
        return F.when(s["start"] >= at, F.concat(S.part(pieces, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")

    last = S.part(pieces, F.element_at("__covered", -1), F.size(pieces) * S.CHUNK)
    redacted = F.concat(F.array_join(F.transform("__chosen", fresh), ""), last)
    hit = F.size("__chosen") > 0
    hidden = found.withColumn(text, F.when(hit, redacted).otherwise(F.col(text)))
    if "n_chars" in own:
        n = inner[own.index("n_chars")]
        hidden = hidden.withColumn(n, F.when(hit, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return hidden.select(*inner).toDF(*own)

"""Time and rows on hostile texts grow with their length, and results stay those of the plain definitions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sigloom.llm import decontaminate, pii, secrets, spans, urls

DOCS = "doc_id long, text string"


def seconds(run):
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def grows_linearly(make, run, n):
    """Whether ``run`` of 4 n takes less than 6 times as long as of n, or of what takes a second."""
    small, large = make(n), make(4 * n)
    run(make(n // 10))  # plans and code are there
    return seconds(lambda: run(large)) < 6 * max(seconds(lambda: run(small)), 1.0)


@pytest.mark.parametrize("word", ["1.1.1.1.", "a@b.c ", "4111 1111 1111 1111, "])
def test_personal_data_in_one_long_text(spark, word):
    run = lambda text: pii.redact(spark.createDataFrame([(1, text)], DOCS)).agg(F.sum(F.length("text"))).collect()
    assert grows_linearly(lambda n: word * (n // len(word)), run, 100_000)
    began = time.perf_counter()
    pii.report(spark.createDataFrame([(1, word * (1_000_000 // len(word)))], DOCS)).collect()
    assert time.perf_counter() - began < 120


@pytest.mark.parametrize("text", ["X=" + "!" * 1000 + "(", "a: |\n" * 300, "<a " * 400, 'a="""' + "\\" * 900, "k = 'v' + " * 100, "x=" * 500 + "\n"])
def test_settings_in_one_long_text(text):
    if text.startswith("X="):
        make = lambda n: "X=" + "!" * n + "("
    else:
        make = lambda n: text * (n // len(text))
    assert grows_linearly(make, secrets.spans, 250_000)


@pytest.mark.parametrize("word", ["<link ", "rel=canonical ", "<meta http-equiv=refresh ", "<link rel=canonical href=/a>", "url=x "])
def test_links_in_one_long_page(spark, word):
    run = lambda html: spark.createDataFrame([(html,)], "html string").select(F.size(urls.link_targets(F.col("html")))).collect()
    assert grows_linearly(lambda n: "<link <meta " + word * (n // len(word)), run, 250_000)


def test_links_are_those_of_whole_patterns(spark):
    canonical = re.compile(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""")
    href = re.compile(r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""")
    refresh = re.compile(r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?refresh\b[^>]*?url\s*=\s*["']?([^"'\s>]+)""")
    rng = random.Random(4)
    bits = ["<link ", "<LINK\n", "<meta ", "rel=canonical ", "rel = 'canonical' ", "href=/a ", 'href="b?c" ', ">", ">", "http-equiv=refresh ", "content='0;url=/r' ", "<p>", "x", "<", "é"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(500)] + ["", ">", None]
    found = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").select("i", urls.link_targets(F.col("html")).alias("t")).collect()
    for r in found:
        page = pages[r["i"]] or ""
        want = [m[1] for tag in canonical.findall(page) if (m := href.search(tag))] + refresh.findall(page)
        assert (r["t"] or []) == want, page


def test_parts_of_chunked_texts(spark, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 4)
    text = "aé😀b\ncdefghijk"
    cuts = [(a, b) for a in range(len(text) + 1) for b in range(a, len(text) + 3)]
    row = spark.createDataFrame([(text,)], "t string").select(F.array(*(spans.part(spans.chunks(F.col("t")), F.lit(a), F.lit(b)) for a, b in cuts))).first()[0]
    assert row == [text[a:b] for a, b in cuts]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 8, 23])
def test_running_maximum(spark, monkeypatch, n):
    monkeypatch.setattr(spans, "LOT", 4)
    rng = random.Random(n)
    values = [rng.randrange(50) for _ in range(n)]
    found = spark.createDataFrame([(values,)], "v array<int>").select(spans.running_max(F.col("v"))).first()[0]
    assert found == [max([0, *values[:i]]) for i in range(n + 1)]


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioustrn") for _ in range(6)) for _ in range(n))


def test_verification_makes_a_row_for_each_pair_and_shingle(spark, monkeypatch):
    """n items and n documents share a passage; each document has one item: n pairs, not n by n rows."""
    rng = random.Random(1)
    passage = prose(rng, 30)
    items = [f"{prose(rng, 30)} {passage}" for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = spark.createDataFrame([(i, f"{prose(rng, 5)} {t}") for i, t in enumerate(items)], DOCS)
    seen = {}

    def watched(texts, pairs, known, widths):
        seen["pairs"] = pairs.count()
        out = plain(texts, pairs, known, widths)
        seen["rows"] = out.agg(F.sum("n_shared")).first()[0]
        return out

    plain = decontaminate.verified
    monkeypatch.setattr(decontaminate, "verified", watched)
    assert decontaminate.contained(rows, table).count() == 60
    assert seen["pairs"] <= 62 and seen["rows"] <= 62 * 56


def test_documents_are_judged_by_row(spark):
    rng = random.Random(2)
    item = prose(rng, 40)
    half = item.split()
    rows = spark.createDataFrame(
        [(1, " ".join(half[:22])), (1, " ".join(half[18:])), (2, item), (2, prose(rng, 30)), (None, item), (3, None), (4, ""), (5, item), (5, item)], DOCS
    )
    table = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.contained(rows, table).collect()) == [2, 5]
    left = decontaminate.remove_contaminated(rows, table)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(((a, b) for a, b in map(tuple, rows.collect()) if b != item), key=str)

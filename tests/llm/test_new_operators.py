"""Byte-level BPE, periodic runs and phrases."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import regex
import tiktoken

from sigloom.llm import bpe, oracles, periodic, phrases, registry
from sigloom.llm.packed import pack, pack_words, unpack, unpack_words
from tests.oracle import connect, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t", "é́ 日本語 😀", "x" * 50_000, "a b " * 3000, "1 " * 500, "\\", "\x00", "same", "same", "\x85\xa0 a  b", "don't 'S 's\x1c\x1d x", "ՠ࢏ \U0001f9ff"]


def docs(spark, texts, langs=("en",)):
    rows = [(i, t, langs[i % len(langs)], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_packing_round_trip():
    for n in (0, 1, 7, 5000):
        numbers = np.random.default_rng(n).integers(0, 2**32, n).astype("<u4")
        assert (unpack(pack(numbers)) == numbers).all()
        words = [bytes([i % 256]) * (i % 9) for i in range(n)]
        assert unpack_words(pack_words(words)) == words


# --- byte-level BPE


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.load_ranks(spark, bpe.RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_librarys(spark, ranks, library):
    rng = random.Random(3)
    bits = ["the", " ", "  ", "\n", "don't", "'ll", "über", "123", "!?", "日本", "　", "😀", "x" * 130, "0" * 120, "=" * 300, "\x1c"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(60)) for _ in range(200)]
    table = docs(spark, texts).repartition(5)
    for block_chars, remembered in ((bpe.BLOCK_CHARS, bpe.REMEMBERED), (500, 3)):
        coded = bpe.encode_documents(table, ranks, block_chars=block_chars, remembered=remembered)
        found = {r["doc_id"]: r for r in bpe.decode_documents(coded, ranks).collect()}
        assert len(found) == len(texts)
        for i, t in enumerate(texts):
            ids = np.array(library.encode_ordinary(t or ""), "<u4")
            assert bytes(found[i]["ids"]) == ids.tobytes() and found[i]["n_tokens"] == len(ids), (t or "")[:50]
            assert bytes(found[i]["decoded"]) == (t or "").encode()


def test_every_character_splits_as_in_the_library(ranks, library):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rng = random.Random(0)
    rng.shuffle(every)
    split = regex.compile(bpe.plain_pattern()).findall
    for i in range(0, len(every), 50_000):
        text = "".join(c + rng.choice(["a", "1", " ", "!", ""]) for c in every[i : i + 50_000])
        assert [x for w in split(text) for x in bpe.merge(w.encode(), ranks)] == library.encode_ordinary(text)


def test_long_words_merge_alike(ranks, monkeypatch):
    rng = random.Random(5)
    for _ in range(300):
        word = bytes(rng.choice(b"abeinrst\xc3\xa9") for _ in range(rng.randrange(2, 90)))
        short = bpe.merge(word, ranks)
        assert bpe._merge_long(word, ranks) == ([ranks[word]] if word in ranks else short) or word in ranks


def test_rows_stay_one_for_one(spark, ranks):
    table = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (4, "b c", 3), (4, "b c", 3)], "doc_id long, text string, ids int")
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in bpe.report(table, ranks).collect()) == [("4", 2), ("4", 2), ("None", 1), ("None", 1)]
    assert bpe.report(table.limit(0), ranks).count() == 0


def test_unknown_ids_are_an_error(spark, ranks):
    table = spark.createDataFrame([(1, b"\xff\xff\xff\x00")], "doc_id long, ids binary")
    with pytest.raises(Exception):
        bpe.decode_documents(table, ranks).collect()


def test_a_word_reaches_its_bucket_once_a_block(spark, ranks):
    table = docs(spark, ["the the the cat"] * 400).coalesce(1)
    blocks = bpe._blocks(table, "doc_id", "text", bpe.PATTERN, 4, 8_000_000).collect()
    assert len(blocks) == 1 and sum(len(unpack_words(h["words"])) for h in blocks[0]["held"]) == 3


# --- periodic runs


def brute_runs(w):
    out, seen, n = [], set(), len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    return (doc_id, len(found), *row, sha(lines.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_against_brute_force(spark):
    rng = random.Random(2)
    texts = [t for t in ODD if t is None or len(t) < 20_000]
    for _ in range(250):
        k = rng.choice([1, 2, 3, 40])
        texts.append(" ".join(str(rng.randrange(k)) for _ in range(rng.randrange(90))))
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a " * 9, 0)] * 2, "doc_id long, text string, length int").repartition(3)
    found = sorted(map(tuple, periodic.report(rows).collect()), key=str)
    assert found == sorted([brute_row(i, t) for i, t in enumerate(texts)] + [brute_row(None, "a " * 9)] * 2, key=str)
    assert periodic.report(rows.limit(0)).count() == 0


@pytest.mark.parametrize("small", [0, 192])
def test_runs_of_planted_words(small, monkeypatch):
    monkeypatch.setattr(periodic, "SMALL", small)
    rng = random.Random(small)
    for _ in range(400):
        n, k = rng.randrange(110), rng.choice([1, 2, 4, 30])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 10:
                a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // 5))
                w[a:] = (w[a : a + p] * n)[: n - a]
                b = rng.randrange(n)
                w[b : b + 1] = [b"odd"]
        assert periodic.find(w) == brute_runs(w)


def test_splitting_part_by_part_gives_the_same_segments(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(100):
        ids = rng.integers(0, 50, 300)
        monkeypatch.setattr(periodic, "ROUNDS", 8)
        one = periodic.segments(ids)
        monkeypatch.setattr(periodic, "ROUNDS", 0)
        assert periodic.segments(ids) == one


def test_long_texts_take_about_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        assert len(periodic.find([b"a"] * n)) == 1
        return time.perf_counter() - began

    assert seconds(160_000) < 6.5 * seconds(40_000)


# --- phrases


def brute_phrases(rows, least, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in regex.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in regex.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    inside = Counter()
    for (lang, p), a in f.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside[lang, p[i:j]], a)
    for (lang, p), a in f.items():
        if len(p) < 2 or 100 * inside[lang, p] >= 100 * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("block_words,range_words", [(1_000_000, 1_000_000), (60, 25)])
def test_phrases_against_brute_force(spark, block_words, range_words):
    rng = random.Random(7)
    bits = ["a", "b", "C", "of", "the", "The end", "x\x85y", "é", ".", ",", "\n", "\t", "z\x01", "z", "ab c"]
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choice(bits) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, "und", "x y"])) for i in range(300)]
    rows += [(None, "hot pair hot pair hot pair", "en")] * 60
    table = spark.createDataFrame(rows, "word long, text string, lang string").repartition(6)
    for least, top in ((10, 2000), (4, 15)):
        found = phrases.mine(table, least=least, top=top, block_words=block_words, range_words=range_words).collect()
        assert sorted(map(tuple, found)) == brute_phrases(rows, least, top)
    assert phrases.mine(table.limit(0), least=2).count() == 0
    assert phrases.mine(docs(spark, ODD), least=1000).count() > 0


def test_equal_suffixes_are_added_up_on_the_way():
    import pyarrow as pa
    from sigloom.llm.packed import pack_wide

    row = ([pack_wide(np.array(c)) for c in ([1, 1, 2], [0, 7, 2**40])], pack_wide(np.array([5, 6, 7])))
    table = pa.table({"columns": [row[0]] * 50, "weights": [row[1]] * 50})
    columns, weights = phrases._gathered(table, 10)
    assert len(weights) <= 13 and weights.sum() == 50 * 18 and columns[1].max() == 2**40


def test_phrase_scores_pass_64_bits(spark):
    big = 3 * 10**14
    f = spark.createDataFrame([("en", [1, 2], big), ("en", [1], big + 1), ("en", [2], big + 2)], "lang string, ids array<long>, a long")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    assert phrases._scored(f, totals).first()["score"] == 1000 * big * 9 * big // ((big + 1) * (big + 2))


def test_phrases_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(registry.QUERIES["op13_phrases"](spark, sf), connect(sf), oracles.PHRASES)


def test_queries_over_the_table(spark, sf, library):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    for r in registry.QUERIES["op11_bpe"](spark, sf).collect():
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert (r["ids_sha256"], r["decoded_sha256"]) == (sha(ids), sha(texts[r["doc_id"]].encode()))
    short = {i for i, t in texts.items() if len(t) < 6000}
    for r in registry.QUERIES["op12_periodic_runs"](spark, sf).collect():
        if r["doc_id"] in short:
            assert tuple(r) == brute_row(r["doc_id"], texts[r["doc_id"]])

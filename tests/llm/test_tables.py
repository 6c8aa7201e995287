"""Operators that compare rows: near duplicates, decontamination, quality, urls, archives, and the pipeline."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sigloom.llm import decontaminate, oracles, quality, registry, simhash, urls, warc
from tests.oracle import connect, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t", "é́ 日本語 😀", "x" * 100_000, "w " * 20_000, "same text here", "same text here"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n))


# --- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    return [find(i) for i in range(n)]


def plain_links(prints, radius=3):
    return [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]


def plain_components(prints, radius=3):
    return joined(len(prints), plain_links(prints, radius))


def alike(texts):
    """Pairs whose sets of 5-word shingles are 0.8 alike."""
    sets = [shingles("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))[1] for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def near_copies(rng):
    long = prose(rng, 900)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(60)] + ODD
    for _ in range(60):
        words = long.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return texts + texts[:9] + ["A B C D", "a b c d", "a\vb c\fd", "ab", "AB"]


@pytest.mark.parametrize("part", [simhash.PART, 4])
def test_near_duplicates_against_all_pairs(spark, part):
    texts = near_copies(random.Random(0))
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts).repartition(5), part=part).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [found[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in prints]
    assert [found[i]["component_id"] for i in range(len(texts))] == plain_components(prints)


@pytest.mark.parametrize("words", [1, 3])
@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_bit_planes_against_popcounts(radius, words):
    rng = np.random.default_rng(radius)
    base = [int.from_bytes(rng.bytes(8 * words), "big") for _ in range(12)]
    values = [base[i % 12] ^ sum(1 << int(b) for b in rng.choice(64 * words, rng.integers(0, 7), replace=False)) for i in range(200)]
    table = np.array([list(np.frombuffer(v.to_bytes(8 * words, "big"), ">u8")) for v in values], np.uint64)
    runs = np.sort(rng.integers(0, 5, 200))
    want = [(i, j) for i, j in plain_links(values, radius) if runs[i] == runs[j]]
    for radii in ((radius,), (radius // 2, radius)):
        pairs = links_of(table, runs, radii)
        assert set(pairs) <= set(want) and joined(200, pairs) == joined(200, want)
        assert len(pairs) == 200 - len(set(joined(200, want)))
    roots = np.arange(200) // 3
    known = [(i, j) for i in range(200) for j in range(i) if runs[i] == runs[j] and roots[i] == roots[j]]
    pairs = links_of(table, runs, (radius,), roots=roots)
    assert joined(200, pairs + known) == joined(200, want + known)
    sides = rng.integers(0, 2, 200)
    across = [(i, j) for i, j in want if sides[i] != sides[j]]
    assert joined(200, links_of(table, runs, (radius,), sides=sides)) == joined(200, across)
    odd = [(i, j) for i, j in want if (i + j) % 2]
    assert joined(200, links_of(table, runs, (radius,), alike=lambda i, j: (i + j) % 2 == 1)) == joined(200, odd)


def links_of(table, runs, radii, **more):
    return [(b, a) for a, b in simhash.links_within(table, runs, radii, **more)]


def test_links_are_found_through_any_two_blocks(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    values = {base ^ sum(1 << b for b in rng.sample(range(63), 3)) for _ in range(300)}
    classes = spark.createDataFrame([(v,) for v in values | {base}], "fp long")
    for part in (2, 16, simhash.PART):
        found = simhash.links(classes, 3, part).collect()
        assert len({r["root"] for r in found}) == 1 and {r["node"] for r in found} == values | {base}


def test_buckets_larger_than_a_part_are_compared_whole(spark):
    """Values all in one bucket whose only links are between a few, in whatever parts they lie."""
    rng = np.random.default_rng(3)
    values = [int.from_bytes(rng.bytes(8), "big", signed=True) for _ in range(400)]
    values += [v ^ 5 for v in values[::40]] + [values[0] ^ 1 << k for k in range(60)]
    rows = spark.createDataFrame([(1, 1, v, v) for v in values], "t int, k long, node long, root long")
    value = F.to_binary(F.lpad(F.hex("node"), 16, "0"), F.lit("hex")).alias("value")
    found = simhash.settled(rows, lambda r: r.select("t", "k", "i", "j", "own", "whole", "root", value), (2,), 16).collect()
    want = joined(len(values), plain_links([v & (1 << 64) - 1 for v in values], 2))
    groups = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["node"])
    expected = {}
    for v, root in zip(values, want):
        expected.setdefault(root, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_one_of_each_group_stays(spark):
    rng = random.Random(2)
    texts = near_copies(rng)
    wider = prose(rng, 80).split()
    texts += [" ".join(wider), " ".join(wider[:20] + ["other"] + wider[21:]), " ".join(wider[3:]), " ".join(wider[40:])]
    rows = docs(spark, texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    kept = simhash.keep_one(rows.unionByName(rows.where("doc_id = 3")).unionByName(rows.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))))
    assert kept.columns == rows.columns
    links = plain_links([plain_fingerprint(t) for t in texts])
    want = sorted(set(joined(len(texts), links + alike(texts))))
    assert len(want) < len(set(joined(len(texts), links)))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == want
    assert kept.where("doc_id is null").count() == 1
    assert simhash.keep_one(docs(spark, [])).count() == 0 == simhash.near_duplicates(docs(spark, [])).count()


@pytest.mark.parametrize("part", [simhash.WIDE_PART, 6])
def test_near_copies_against_all_pairs(spark, part):
    """Texts of 8 words and up, edited; no more and no less is linked than shingle sets and fingerprints say."""
    rng = random.Random(7)
    texts = list(ODD)
    for n in (8, 12, 30, 100, 400):
        for _ in range(6):
            first = prose(rng, n).split()
            texts.append(" ".join(first))
            for edits in (1, max(1, n // 40), max(1, n // 15), n // 6):
                words = list(first)
                for _ in range(edits):
                    words[rng.randrange(n)] = rng.choice(["other", "Words", "here"])
                texts.append(" ".join(words))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, texts).repartition(5), part, part).collect()}
    want = joined(len(texts), plain_links([plain_fingerprint(t) for t in texts]) + alike(texts))
    assert [found[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("part", [simhash.WIDE_PART, 16])
def test_false_proposals_use_up_no_join(spark, part):
    """Large families whose outsider is 0.8 alike to three members and slightly less to all others."""
    rng = random.Random(11)
    texts = []
    for f in range(5):
        first = prose(rng, 200).split()
        edited = lambda *places, first=first: " ".join(f"e{f}x{i}" if i in places else w for i, w in enumerate(first))
        texts += [edited(20 + 4 * i) for i in range(40)] + [edited(0), edited(199), edited(0, 199), edited(10, 50, 90, 130)]
    rng.shuffle(texts)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, texts).repartition(3), part, part).collect()}
    want = joined(len(texts), plain_links([plain_fingerprint(t) for t in texts]) + alike(texts))
    assert [found[i] for i in range(len(texts))] == want and len(set(want)) == 5


def test_short_texts_meet_whatever_their_bits(spark):
    rng = random.Random(12)
    texts = []
    for n in (8, 9, 10, 12, 19):
        for _ in range(30):
            first = prose(rng, n)
            texts += [first, first + " more"]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, texts).repartition(3)).collect()}
    assert [found[i] for i in range(len(texts))] == [i // 2 * 2 for i in range(len(texts))]


@pytest.mark.parametrize("words", [8, 12, 20, 60, 300])
def test_every_pair_at_the_threshold_is_found(spark, words):
    """Recall by length of text: pairs made to be just 0.8 alike."""
    rng, texts = random.Random(words), []
    n = words - 4
    for _ in range(60):
        first = prose(rng, words).split()
        more = [f"z{k}" for k in range(n // 4)]  # n of n + n // 4 shingles are shared
        texts += [" ".join(first), " ".join(first + more)]
    assert len(alike(texts)) == 60
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, texts).repartition(3)).collect()}
    assert [found[i] for i in range(len(texts))] == [i // 2 * 2 for i in range(len(texts))]


# --- decontamination


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    n = min(n, len(words))
    return (n, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) if n else (0, set())


def contained(texts, items):
    out = set()
    for k, item in items:
        n, wanted = shingles(item)
        for i, t in enumerate(texts):
            words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
            have = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if n else set()
            if wanted and len(wanted & have) >= 0.8 * len(wanted):
                out.add((i, k, round(len(wanted & have) / len(wanted), 6)))
    return out


def test_containment_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, prose(rng, n)) for k, n in enumerate([1, 3, 4, 5, 6, 9, 12, 30, 40, 64, 65, 130])]
    items += [(90, None), (91, ""), (92, "x " * 40), (5, items[5][1].upper()), (93, items[8][1])]
    texts = list(ODD)
    for _ in range(80):
        words = items[rng.randrange(12)][1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "other"
        texts.append(f"{prose(rng, 200)} {' '.join(words)} {prose(rng, 150)}")
    table = spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string")
    rows = docs(spark, texts)
    want = contained(texts, items)
    assert len(want) > 30
    for most in (decontaminate.BROADCAST_BYTES, 0):  # by broadcast and by shuffle
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
        got = [(r["doc_id"], r["item_id"], r["containment"]) for r in decontaminate.contained(rows, table).collect()]
        assert set(got) == want
    kept = decontaminate.remove_contaminated(rows.withColumn("item", F.lit(1)).withColumn("w", F.lit(2)).withColumn("class", F.lit(3)), table.withColumn("n", F.lit(4)))
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _, _ in want}
    assert decontaminate.contained(rows, table.limit(0)).count() == 0
    assert decontaminate.contained(rows.limit(0), table).count() == 0


def test_a_passage_of_many_items_makes_few_candidates(spark, monkeypatch):
    rng = random.Random(8)
    passage = prose(rng, 30)
    items = [(k, f"{prose(rng, 40)} {passage}") for k in range(40)] + [(50, passage), (51, passage), (None, unnamed := prose(rng, 20))]
    texts = [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(60)] + [items[3][1], f"{items[7][1]} {prose(rng, 9)}", unnamed]
    table, written = spark.createDataFrame(items, "item_id long, text string"), {}

    def keep(df, name):
        written[name] = df.count()
        return cut(df, name)

    cut = decontaminate.cut
    monkeypatch.setattr(decontaminate, "cut", keep)
    rows = docs(spark, texts)
    want = {x for x in contained(texts, items) if x[1] is not None}
    assert {(r["doc_id"], r["item_id"], r["containment"]) for r in decontaminate.contained(rows, table).collect()} == want
    assert len(want) == 62 * 2 + 2 and written["pairs"] <= 62 + 3  # not 62 documents by 41 items
    assert decontaminate.remove_contaminated(rows, table).count() == 0


# --- quality


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(windows) < 3000 else set(range(len(words)))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def quality_texts():
    rng = random.Random(4)
    texts = list(ODD) + [prose(rng, n) for n in (1, 4, 5, 6, 9, 10, 11, 50, 300)]
    for _ in range(60):
        part = prose(rng, rng.randint(1, 12))
        texts.append("\n".join(rng.choice([part, prose(rng, rng.randint(0, 9)), "", "# * $", "A B C D E F"]) for _ in range(rng.randint(1, 12))))
    return texts


def test_quality_statistics(spark):
    texts = quality_texts()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = {r["doc_id"]: r for r in quality.report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_statistics(t)
        assert tuple(found[i][n] for n in names) == want, (t or "")[:80]
        assert found[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (found[i]["kept"] and found[i]["base_failed"])
    assert quality.report(docs(spark, [])).count() == 0


def test_expectation_maximisation_against_numpy(spark):
    rng = np.random.default_rng(5)
    names, truth = list(quality.RULES), rng.random(5000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.55])
    right = rng.random((5000, 6)) < accuracy
    votes = np.where(rng.random((5000, 6)) < 0.2, 0, np.where(right, 2 * truth[:, None] - 1, 1 - 2 * truth[:, None]))
    df = spark.createDataFrame([tuple(map(int, v)) for v in votes], [f"vote_{n}" for n in names])
    found, good = quality.estimate(df.groupBy(*df.columns).count().withColumnRenamed("count", "n"))
    a, share = np.full(6, quality.START_ACCURACY), quality.START_GOOD
    for _ in range(quality.ROUNDS):
        p = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + votes @ np.log(a / (1 - a)))))
        hit = np.where(votes == 1, p[:, None], np.where(votes == -1, 1 - p[:, None], 0)).sum(axis=0)
        a, share, old = np.clip((hit + 8.5) / (np.abs(votes).sum(axis=0) + 10), 0.55, 0.95), np.clip(p.mean(), 0.05, 0.95), (a, share)
        if max(abs(a - old[0]).max(), abs(share - old[1])) < 1e-6:
            break
    assert [found[n] for n in names] == pytest.approx(a.tolist(), abs=1e-6) and good == pytest.approx(share, abs=1e-6)
    assert a[:3] == pytest.approx(accuracy[:3], abs=0.05) and share == pytest.approx(0.7, abs=0.05)


# --- urls

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y", "http://example.net/en", "http://example.net/en/", "http://myexample.net/en/", "http://net/", "http://net",
    "ftp://x.example.com/de/a#b", "http://x.example.com/fr/", "http://a.org/fr/1", "http://a.org/en/1", "http://a://b.net/c", "http://Ünï.NET/é", "x\ny://q.net/z", "http://u?://net/",
]


def plain_judgement(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules_without_links(spark):
    found = {r["page_id"]: r for r in urls.judge(pages(spark, [(i, u, None) for i, u in enumerate(URLS)])).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_judgement(u)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) == (host, path, rule, verdict or "allow")


def linked_pages():
    link = lambda u: f'<html><link href="{u}" rel=canonical ></html>'
    move = lambda u: f"<META http-equiv='refresh' content='0; url={u}'>"
    rows = [(0, "http://a.com/1", link("http://b.com/1")), (1, "http://b.com/1?x", move("http://bad.net/9")), (2, "http://bad.net/9", "")]
    rows += [(3, "http://c.com/1", link("http://bad.net/8")), (4, "http://bad.net/8", link("http://z.org/fr/1")), (5, "http://z.org/fr/1", "<b>")]
    rows += [(6, "http://d.com/1", link("/2")), (7, "http://d.com/2", link("//x.example.com/de/1")), (8, "http://e.com/", link("mailto:x")), (9, None, link("http://bad.net/7"))]
    return rows + [(20 + i, f"http://chain.com/{i}", link(f"http://chain.com/{i + 1}")) for i in range(25)] + [(50, "http://chain.com/25", move("http://bad.net/1")), (51, "http://a.com/1#again", "")]


def test_block_decisions_reach_aliases(spark):
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages(spark, linked_pages())).collect()}
    assert found[0] == found[1] == found[51] == (None, "block") and found[2] == ("net/", "block")
    assert found[3] == (None, "allow") and found[4] == ("net/", "block") and found[5] == ("org/fr/", "allow")
    assert found[6] == found[7] == (None, "block") and found[8] == (None, "allow") == found[9]
    assert {found[i] for i in (*range(20, 45), 50)} == {(None, "block")}


def test_canonical_and_refresh_are_edges_of_their_own(spark):
    both = '<link rel="canonical" href="http://a.com/1"><meta http-equiv="refresh" content="0; url=http://bad.net/1">'
    found = {r["page_id"]: r["verdict"] for r in urls.judge(pages(spark, [(0, "http://a.com/1", both), (1, "http://a.com/2", both.replace("bad.net", "fine.com"))])).collect()}
    assert found == {0: "block", 1: "block"}
    alone = urls.judge(pages(spark, [(0, "http://a.com/1", both), (1, "http://c.com/1", None)]))
    assert {r["page_id"]: r["verdict"] for r in alone.collect()} == {0: "block", 1: "allow"}


RELATIVE = [
    ("b.html", "h.com/x/y/b.html"), ("../b", "h.com/x/b"), ("../../../b", "h.com/b"), ("./b/../c/", "h.com/x/y/c/"), (".", "h.com/x/y/"), ("..", "h.com/x/"), ("/q/../r", "h.com/r"), ("/r", "h.com/r"),
    ("b?u=http://o.net/", "h.com/x/y/b"), ("?q=1", "h.com/x/y/a"), ("#top", "h.com/x/y/a"), ("//o.net/p", "o.net/p"), ("HTTPS://O.net/p", "o.net/p"), ("mailto:x", None), (None, None),
]


def test_relative_targets_are_read_against_the_page(spark):
    rows = spark.createDataFrame([(t, w) for t, w in RELATIVE], "t string, w string")
    for r in rows.select("t", "w", urls.resolved(F.col("t"), F.lit("http://H.com/x/y/a?z=1/2")).alias("found")).collect():
        assert r["found"] == r["w"], r["t"]
    assert rows.where("t = 'b.html'").select(urls.resolved(F.col("t"), F.lit("http://h.com"))).first()[0] == "h.com/b.html"
    assert rows.where("t = 'b.html'").select(urls.resolved(F.col("t"), F.lit("no url"))).first()[0] is None
    found = urls.judge(pages(spark, [(0, "http://k.com/x/a", '<link rel=canonical href="../m">'), (1, "http://k.com/m", '<meta http-equiv=refresh content="0; url=http://bad.net/2">')]))
    assert {r["verdict"] for r in found.collect()} == {"block"}


def test_urls_and_chat_against_sql(spark, tmp_path):
    import duckdb

    rows = linked_pages() + [(100 + i, u, None) for i, u in enumerate(URLS)]
    move = lambda t: f'<link rel=canonical href="http://h.com/x/y/own"><meta http-equiv=refresh content="0; url={t}">'
    rows += [(200 + i, f"http://H.com/x/y/{i}?z=1/2", move(t)) for i, (t, _) in enumerate(RELATIVE) if t]
    rows += [(300 + i, f"http://{w}", move("http://bad.net/a&amp;b") if i % 3 else None) for i, (_, w) in enumerate(RELATIVE) if w]
    rows += [(400, "http://two.com/1", '<link rel=canonical href="http://fine.com/"><link rel=canonical href="b//../../c"><x'), (400, "http://two.com/c", '<meta http-equiv=refresh content="0; url=//bad.net/a&b">')]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    table = spark.read.parquet(f"{tmp_path}/pages.parquet")
    same(urls.judge(table), con, oracles.URLS)
    clash = table.withColumn("host", F.lit("x")).withColumn("node", F.lit(1)).withColumn("fit", F.lit(2)).withColumn("target", F.lit(3))
    same(urls.judge(clash), con, oracles.URLS)
    found = urls.judge(table).where("page_id = 400").collect()
    assert [r["verdict"] for r in found] == ["block", "block"]


def test_more_redirects_may_be_given(spark):
    more = spark.createDataFrame([("http://q.com/1", "http://bad.net/"), (None, "x")], "a string, b string")
    assert urls.judge(pages(spark, [(1, "http://q.com/1", None)]), more).first()["verdict"] == "block"
    assert urls.judge(pages(spark, [])).count() == 0


# --- archives


def archive_pages():
    big = "<html>" + "x" * 2000
    trap = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nxxxxx" * 30
    rows = [(i, f"http://a.com/{i}", big if i % 3 == 0 else f"<p>{i}" * (1 + 300 * (i % 2))) for i in range(40)]
    return rows + [(100, None, None), (101, "no\r\nscheme", ""), (102, "http://t.com/\r\nX: y", trap), (103, "http://t.com/é", trap), (104, "http://s.com", "é" * 500), (105, "http://s.com", "é" * 500)]


def test_archive_round_trip(spark):
    rows = archive_pages()
    found = {r["page_id"]: r for r in warc.captures(pages(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        most = max(k for k, _, h in rows if (h or "") == (html or ""))
        again = len(data) >= 1000 and most != i
        r = found[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", most) if again else ("response", None))


def test_one_nested_row_per_capture(spark, tmp_path):
    rows = archive_pages()
    warc.write(pages(spark, rows), f"{tmp_path}/w")
    made = warc.assemble(warc.read(spark, f"{tmp_path}/w")).collect()
    assert len(made) == len(rows)
    by_id = {r["response"]["record_id"]: r for r in made}
    for r in made:
        assert r["request"] and len(r["metadata"]) == 1
        if r["response"]["type"] == "revisit":
            first = by_id[r["response"]["refers_to"]]["response"]
            assert first["type"] == "response" and first["payload_digest"] == r["response"]["payload_digest"]
    payloads = sorted(bytes(r["response"]["payload"]) for r in made if r["response"]["type"] == "response")
    assert set(payloads) == {(h or "").encode() for _, _, h in rows}


def test_repeated_and_missing_ids_are_captures_of_their_own(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "v", "b"), (None, "w", "c"), (None, None, None)]
    assert sorted((str(r["page_id"]), r["payload_bytes"]) for r in warc.captures(pages(spark, rows)).collect()) == [("1", 1), ("1", 1), ("1", 1), ("None", 0), ("None", 1)]
    assert warc.captures(pages(spark, [])).count() == 0


def test_ids_missing_among_equal_payloads(spark):
    html = "x" * 2000
    rows = [(7, "u", html), (None, "v", html), (None, "v", html), (3, "w", html), (7, "u", html), (None, "y", html + "z"), (None, "y", html + "z")]
    found = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.captures(pages(spark, rows)).collect())
    assert found == [("3", 2000, "revisit", 7), ("7", 2000, "response", None), ("7", 2000, "response", None)] + [("None", 2000, "revisit", 7)] * 2 + [("None", 2001, "response", None)] * 2


def test_size_classes_and_large_joins(spark, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", ((0, 5), (100, 2), (1500, 1)))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    test_archive_round_trip(spark)


def test_links_of_either_side(spark, tmp_path):
    """Concurrent-to is read in both directions, repeated, and through other records; orphans stay."""
    make = lambda kind, rid, *to: "\r\n".join([f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}", *(f"WARC-Concurrent-To: {t}" for t in to), "Content-Length: 0\r\n\r\n\r\n\r\n"])
    text = make("response", "r1", "q1") + make("request", "q1") + make("metadata", "m1", "q1")
    text += make("metadata", "m2", "q2", "r2") + make("request", "q2") + make("response", "r2")
    text += make("request", "q3") + make("metadata", "m4", "gone") + make("response", "r5") + make("warcinfo", "w", "r5")
    text += make("request", "q6", "r6", "r7") + make("response", "r6") + make("revisit", "r7")
    (tmp_path / "a.warc").write_bytes(text.encode())
    found = {r["capture_id"]: (r["response"] and r["response"]["record_id"], r["request"] and r["request"]["record_id"], [m["record_id"] for m in r["metadata"]]) for r in warc.assemble(warc.read(spark, str(tmp_path))).collect()}
    assert found == {
        "r1": ("r1", "q1", ["m1"]), "r2": ("r2", "q2", ["m2"]), "q3": (None, "q3", []), "m4": (None, None, ["m4"]), "r5": ("r5", None, []),
        "r6": ("r6", "q6", []), "r7": ("r7", "q6", []),
    }


def test_members_and_damage(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    good = hashlib.sha1(b"hello").hexdigest().encode()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record % (i, good, len(block), block)) for i in range(3)))
    (tmp_path / "b.warc").write_bytes(record % (9, good, len(block), block))
    assert [r["payload_bytes"] for r in warc.read(spark, str(tmp_path)).collect()] == [5] * 4
    (tmp_path / "b.warc").write_bytes(record % (9, b"0" * 40, len(block), block))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, str(tmp_path)).collect()


# --- queries


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_against_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), connect(sf), registry.ORACLE[name])


def test_native_queries_run_no_python(spark, sf):
    for name in ("op6_decontamination", "op7_quality", "op8_url_filter", "op9_pii"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    table = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    extra = docs(spark, ["12345 678", None, "", benchmark[0][1] + " and more"]).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    rows, columns = table.unionByName(extra), table.columns
    one = p.language_id(spark, rows, sf)
    left = {r["doc_id"]: r["text"] for r in one.collect()}
    assert one.columns == columns and {r["doc_id"] for r in rows.collect()} - set(left) == {1_000_000, 1_000_001, 1_000_002}
    two = p.near_dedup(spark, one, sf)
    ids = sorted(left)
    kept = {ids[r] for r in joined(len(ids), plain_links([plain_fingerprint(left[i]) for i in ids]) + alike([left[i] for i in ids]))}
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == kept
    three = p.decontamination(spark, two, sf)
    order = sorted(kept)
    dirty = {order[i] for i, _, _ in contained([left[i] for i in order], benchmark)}
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == kept - dirty and 1_000_003 in dirty
    four = p.personal_data(spark, three, sf)
    assert four.columns == columns and four.dtypes == table.dtypes
    assert {r["doc_id"] for r in four.collect()} == kept - dirty and four.where("text rlike '[a-z0-9]@[a-z]' or n_chars != char_length(text)").count() == 0
    five = p.encoding(spark, four, sf)
    assert five.where("round_trip").count() == four.count()
    assert p.run(spark, sf).count() > 0

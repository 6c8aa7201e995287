"""Archives of other writers: revisits resolved by record id, all requests of a capture, archives inflated in pieces."""

import gzip
import hashlib
import random

from sigloom.llm import warc


def record(kind, rid, block=b"", **headers):
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + rid.encode()]
    lines += [k.replace("_", "-").encode() + b": " + v.encode() for k, v in headers.items()]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_revisits_follow_record_ids(spark, tmp_path):
    """Revisits lie in another archive, before their response; one names a response that is not there, and one another revisit."""
    note = lambda of, page: record("metadata", f"m{of}", b"page-id: %d\r\nrefers-to-page: 99\r\n" % page, WARC_Concurrent_To=of)
    moved = record("revisit", "v1", WARC_Refers_To="r1") + note("v1", 1) + record("revisit", "v2", WARC_Refers_To="gone") + note("v2", 2)
    moved += record("revisit", "v3", WARC_Refers_To="v1") + note("v3", 3) + record("revisit", "v4") + note("v4", 4)
    (tmp_path / "a.warc").write_bytes(moved)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\nhello")) + gzip.compress(note("r1", 7)))
    made = warc.assemble(warc.read(spark, str(tmp_path)))
    answers = made.selectExpr("cast(regexp_extract(metadata[0].fields, 'page-id: ([0-9]+)', 1) as long) as page_id", "response.record_id", "response.type", "response.refers_to")
    found = {r["page_id"]: r["refers_page"] for r in warc.resolve(answers).collect()}
    assert found == {7: None, 1: 7, 2: None, 3: None, 4: None}


def test_shuffled_and_broadcast_revisits_agree(spark, monkeypatch):
    rows = [(f"v{i}", "revisit", "r0" if i % 3 else f"r{i}", i) for i in range(200)] + [(f"r{i}", "response", None, 1000 + i) for i in range(0, 200, 6)]
    df = spark.createDataFrame(rows, "record_id string, type string, refers_to string, page_id long")
    want = {(i, 1000 if i % 3 else 1000 + i if i % 6 == 0 else None) for i in range(200)} | {(1000 + i, None) for i in range(0, 200, 6)}
    assert {(r["page_id"], r["refers_page"]) for r in warc.resolve(df).collect()} == want
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 3)
    assert {(r["page_id"], r["refers_page"]) for r in warc.resolve(df).collect()} == want


def test_every_request_is_kept(spark, tmp_path):
    text = record("response", "r", b"HTTP/1.1 200 OK\r\n\r\n") + b"".join(record("request", f"q{i}", WARC_Concurrent_To="r") for i in (3, 1, 2))
    (tmp_path / "a.warc").write_bytes(text + record("request", "q9"))
    made = {r["capture_id"]: [q["record_id"] for q in r["requests"]] for r in warc.assemble(warc.read(spark, str(tmp_path))).collect()}
    assert made == {"r": ["q1", "q2", "q3"], "q9": ["q9"]}


def test_pieces_of_any_size(monkeypatch):
    """Records, markers and members that lie across pieces; padding between members; blocks that hold the marker."""
    draw = random.Random(0)
    blocks = [draw.randbytes(draw.choice((0, 1, 7, 300, 5000))) + b"WARC/1.1\r\n\r\n" * (i % 3) for i in range(40)]
    records = [record("resource", str(i), b) for i, b in enumerate(blocks)]
    plain, members = b"".join(records), b"\0\0".join(gzip.compress(r) for r in records)
    for size in (1, 2, 5, 64, 1 << 16):
        monkeypatch.setattr(warc, "CHUNK", size)
        for content in (plain, members, gzip.compress(plain)):
            assert [(h["warc-record-id"], b) for h, b in warc.parse(content)] == [(str(i), b) for i, b in enumerate(blocks)]
    assert list(warc.parse(b"")) == [] and hashlib.sha1(b"".join(warc._pieces(members))).digest() == hashlib.sha1(plain).digest()

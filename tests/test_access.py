"""Items by position, verified copies, and repeats that a stream has seen before."""

import hashlib
import http.server
import threading

import pytest
from pyspark.sql import functions as F

from sigloom.config import INTEGRITY_RULES, SMALL
from sigloom.functions import signals
from sigloom.operators import catalog, rules
from sigloom.sources import export, mirror, raw
from sigloom.streaming import monitor


@pytest.fixture(scope="module")
def exported(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("items"))
    label = F.element_at(F.array(*(F.lit(x) for x in ("D1", "seagull", "D2", "CR"))), (F.col("segment_id") % 4 + 1).cast("int"))
    rows = spark.range(500).select((F.col("id") * 3).alias("segment_id"), F.col("id").alias("measurement_id"))
    rows = rows.select("*", label.alias("label"), F.array(F.col("segment_id").cast("float")).alias("rd_db"))
    rows = rows.select("*", (F.col("measurement_id") % 3 + 1).cast("int").alias("paper_split"), (F.col("measurement_id") % 5 % 3 + 1).cast("int").alias("split_grouped"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many files of few rows
    export.export(rows.repartition(3), {"name": "i", "version": 1}, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path


@pytest.mark.parametrize("choice", [("grouped", 1, "group"), ("paper", 2, "drone"), ("grouped", None, "drone"), ("grouped", 9, "group")])
def test_items_by_position(spark, exported, choice):
    items = export.Items(spark, exported, *choice)
    of = {r["segment_id"]: r["split_grouped"] for r in spark.read.parquet(f"{exported}/data").select("segment_id", "split_grouped").collect()}
    plain = sorted(export.read(spark, exported, *choice).collect(), key=lambda r: (of[r["segment_id"]], r["segment_id"]))
    assert len(items) == len(plain)
    for i in {0, 1, len(plain) // 2, len(plain) - 1, -1} if plain else ():
        assert items[i] == plain[i]
    for i in (len(plain), -len(plain) - 1):
        with pytest.raises(IndexError):
            items[i]


def test_an_item_reads_one_file(spark, exported):
    """Files hold ranges of positions: each place is in one file, and its id lies in that file's range."""
    items = export.Items(spark, exported)
    places = items.places.orderBy("before_n").collect()
    assert len(places) > 1 and len({p["file"] for p in places}) == len(places)
    assert [p["before_n"] for p in places] == [sum(q["n"] for q in places[:k]) for k in range(len(places))]
    for p in places:
        whole = spark.read.parquet(f"{exported}/data/{p['file']}")
        assert whole.count() == p["n"] and items[p["before_n"]]["segment_id"] == p["first_id"] == whole.agg(F.min("segment_id")).first()[0]


def md5(data):
    return hashlib.md5(data).hexdigest()


def test_a_cut_off_copy_goes_on(spark, tmp_path):
    data = {"a.bin": bytes(range(256)) * 70_000, "b.bin": b"", "c.bin": b"right", "d.bin": b"no digest"}
    (tmp_path / "in").mkdir(), (tmp_path / "out").mkdir()
    for name, x in data.items():
        (tmp_path / "in" / name).write_bytes(x)
    (tmp_path / "out" / "a.bin.part").write_bytes(data["a.bin"][:9_000_001])
    (tmp_path / "out" / "c.bin").write_bytes(b"wrong")
    rows = [(f"file://{tmp_path}/in/{n}", None if n == "d.bin" else md5(x)) for n, x in data.items()]
    files = spark.createDataFrame(rows + rows[:1], "url string, md5 string")
    first = {r["file"]: (r["state"], r["bytes"], r["md5"]) for r in mirror.mirror(files, f"{tmp_path}/out").collect()}
    assert first == {n: ("resumed" if n == "a.bin" else "copied", len(x), md5(x)) for n, x in data.items()}
    assert all((tmp_path / "out" / n).read_bytes() == x for n, x in data.items()) and not list((tmp_path / "out").glob("*.part"))
    assert {r["state"] for r in mirror.mirror(files, f"{tmp_path}/out").collect()} == {"kept"}
    assert {r["path"].split("/")[-1]: r["md5"] for r in raw.file_md5(spark, f"{tmp_path}/in").collect()} == {n: md5(x) for n, x in data.items()}


def test_damaged_and_missing_files_are_errors(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    (tmp_path / "y").write_bytes(b"good")
    rows = [(f"file://{tmp_path}/x", md5(b"abd")), (f"file://{tmp_path}/y", md5(b"good")), (f"file://{tmp_path}/z", None)]
    with pytest.raises(ValueError, match=r"x \(damaged\), z \(missing\)"):
        mirror.mirror(spark.createDataFrame(rows, "url string, md5 string"), f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["y"]
    for wrong in ([("file:///a/x", None), ("file:///b/x", None)], [(None, None)]):
        with pytest.raises(ValueError, match="one url"):
            mirror.mirror(spark.createDataFrame(wrong, "url string, md5 string"), f"{tmp_path}/out")


def test_a_server_without_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir(), (tmp_path / "out").mkdir()
    (tmp_path / "in" / "f").write_bytes(b"0123456789")
    (tmp_path / "out" / "f.part").write_bytes(b"0123")

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *a):
            super().__init__(*a, directory=str(tmp_path / "in"))

        def log_message(self, *a):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Quiet) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        files = spark.createDataFrame([(f"http://127.0.0.1:{server.server_port}/f", md5(b"0123456789"))], "url string, md5 string")
        assert [r["state"] for r in mirror.mirror(files, f"{tmp_path}/out").collect()] == ["resumed"]
        server.shutdown()
    assert (tmp_path / "out" / "f").read_bytes() == b"0123456789"


def test_a_stream_remembers_hashes_over_restarts(spark, tmp_path):
    """Three batches, with a restart after each, are judged as one table is."""
    base = raw.synthetic(spark, 1, 6, radar=SMALL).select("segment_id", "iq_re", "iq_im")
    base.union(base.where("segment_id % 3 = 0").withColumn("segment_id", F.col("segment_id") + 100)).write.parquet(f"{tmp_path}/all")
    rows = spark.read.parquet(f"{tmp_path}/all")
    thresholds = {r: 1e9 for r in INTEGRITY_RULES} | {"duplicate": 0.5}

    def run():
        found = monitor.flag_arrivals(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), thresholds, SMALL)
        q = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    for first, last in ((0, 12), (13, 102), (103, 999)):
        rows.where(F.col("segment_id").between(first, last)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    got = {r["segment_id"]: (r["rule_flags"], r["rule_score"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    stats = signals.measure(rows, SMALL, ("rules", "sha1"))
    marked = catalog.mark_repeats(stats).withColumn("duplicate", F.col("duplicate").cast("double"))
    want = {r["segment_id"]: (r["rule_flags"], r["rule_score"]) for r in rules.apply(marked, thresholds).collect()}
    assert got == want and sum(f > 0 for f, _ in got.values()) >= 10

"""Copies of files that are checked by digest and go on where they were cut off.

Each file is read in chunks by a task; no file is held whole and none passes the driver.
A copy grows in ``<name>.part`` and takes its own name only once its digest is right.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.storage import cut

CHUNK = 8 * 1024 * 1024

#: States of a copy.
KEPT, COPIED, RESUMED, DAMAGED, MISSING = "kept", "copied", "resumed", "damaged", "missing"

NAMED = 8  # files that an error names


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri) if ":/" in uri else f"file://{posixpath.abspath(uri)}")


def _chunks(f: BinaryIO) -> Iterator[bytes]:
    while piece := f.read(CHUNK):
        yield piece


def _md5(uri: str, seen: "hashlib._Hash | None" = None) -> "hashlib._Hash":
    digest = seen or hashlib.md5()
    store, path = _place(uri)
    with store.open_input_stream(path) as f:
        for piece in _chunks(f):
            digest.update(piece)
    return digest


def _size(uri: str) -> int | None:
    store, path = _place(uri)
    info = store.get_file_info(path)
    return info.size if info.type == fs.FileType.File else None


def _opened(url: str, at: int) -> BinaryIO:
    """``url`` from byte ``at``; a server that knows no ranges sends all, and what was there already is skipped."""
    if re.match("https?://", url):
        answer = urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={at}-"} if at else {}))
        left = at if answer.status != 206 else 0
        while left > 0 and (piece := answer.read(min(left, CHUNK))):
            left -= len(piece)
        return answer
    store, path = _place(url)
    f = store.open_input_file(path)
    f.seek(min(at, f.size()))
    return f


def _copy(url: str, target: str, md5: str | None) -> tuple[int, str | None, str]:
    """(bytes, md5, state) after ``url`` was brought to ``target``."""
    if _size(target) is not None:
        found = _md5(target).hexdigest()
        if md5 is None or found == md5:
            return _size(target), found, KEPT
    part = f"{target}.part"
    store, path = _place(part)
    store.create_dir(posixpath.dirname(path), recursive=True)
    at, digest, out = _size(part) or 0, hashlib.md5(), None
    if at:
        try:
            out = store.open_append_stream(path)
            digest = _md5(part)
        except (NotImplementedError, pa.ArrowNotImplementedError):  # object stores: from the start
            at = 0
    try:
        source = _opened(url, at)
    except (FileNotFoundError, urllib.error.URLError) as e:
        whole = isinstance(e, urllib.error.HTTPError) and e.code == 416  # nothing beyond what is there
        if not whole:
            if out:
                out.close()
            return at, None, MISSING
        source = None
    with out or store.open_output_stream(path) as f:
        for piece in _chunks(source) if source else ():
            digest.update(piece)
            f.write(piece)
    if source:
        source.close()
    size, found = _size(part), digest.hexdigest()
    if md5 is not None and found != md5:
        store.delete_file(path)  # the next run starts anew
        return size, found, DAMAGED
    store.move(path, _place(target)[1])
    return size, found, RESUMED if at else COPIED


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, md5) of a file or of every file under a folder, empty ones included; contents are read in chunks by tasks.

    Names and sizes are listed through Spark's file system; names that start with a dot or
    an underscore are left out, as Spark's readers do.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, names = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith((".", "_")):
            names.append((status.getPath().toString(), status.getLen()))
    listed = spark.createDataFrame(names, "path string, length long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_pydict({"path": [file], "bytes": pa.array([size], pa.int64()), "md5": [_md5(file).hexdigest()]})

    return _spread(listed).mapInArrow(run, "path string, bytes long, md5 string")


def _spread(files: DataFrame) -> DataFrame:
    """Rows in turn over tasks: files differ in size, so each task gets few."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def mirror(files: DataFrame, target: str) -> DataFrame:
    """(file, url, bytes, md5, state) of a copy of ``files`` (url, md5) into the folder ``target``, written to the shared folder.

    A file that is there with the right digest is kept, one that was cut off goes on after
    its last byte, others are copied from the start; where ``md5`` is null, what is there is
    taken as right. ValueError names the first files that were damaged (their parts are
    deleted) or missing; all others are in place by then. Equal rows are copied once;
    two urls of one file name are an error, as are null urls. ``target`` lies in storage that
    all executors share.
    """
    named = files.select("url", "md5").distinct().withColumn("file", F.regexp_extract("url", "([^/]+)/*$", 1))
    wrong = named.groupBy("file").agg(F.count("*").alias("n")).where("n > 1 or file is null or file = ''").limit(NAMED).collect()
    if wrong:
        raise ValueError(f"not one url for each file name: {', '.join(str(r['file']) for r in wrong)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, md5, file in zip(*(c.to_pylist() for c in batch.columns)):
                size, found, state = _copy(url, f"{target.rstrip('/')}/{file}", md5)
                yield pa.RecordBatch.from_pydict(
                    {"file": [file], "url": [url], "bytes": pa.array([size], pa.int64()), "md5": pa.array([found], pa.string()), "state": [state]}
                )

    states = cut(_spread(named).mapInArrow(run, "file string, url string, bytes long, md5 string, state string"), "mirror")
    failed = states.where(F.col("state").isin(DAMAGED, MISSING)).orderBy("file").limit(NAMED).collect()
    if failed:
        raise ValueError("not copied: " + ", ".join(f"{r['file']} ({r['state']})" for r in failed))
    return states

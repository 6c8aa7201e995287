"""WARC archives: writing, reading, and assembling transactions.

Writing: each page gives a request, a response or revisit, and a metadata record, all
tied by WARC-Concurrent-To to the response. Records are text rows that Spark's own
writer commits, so a lost executor leaves no half-written archive and any file system
that Spark can write to will do; files are bounded by records and so by bytes, as pages
of a size class are written together. A revisit carries the HTTP head with the length of the
payload, and the digest, but not the payload.

Reading: archives (plain, or gzip with one or many members) are parsed by
Content-Length, a file at a time, in Arrow batches. They are inflated as they are read, a
record is held at a time, and its payload digest is verified. Spark hands an archive over
as it is stored, so one of more than 2 GB has to be split first.

Assembly: records are joined through their concurrent-to identifiers, of which a record
may have several and which either side may name: connected components over these links
give one nested row per capture, with all its requests. Records that no link joins are rows of
their own. A revisit is joined with the response whose record id its WARC-Refers-To names.

Edge cases: a null html is an empty payload; a null url has no target URI. Records with
equal payloads of at least ``LEAST_REVISIT`` bytes refer to the one with the largest id;
smaller ones are all responses, and so are equal payloads if none of their rows has an
id. Rows without an id or with a repeated id are captures of their own (told apart by url
and a number within equal id, url and payload). Texts of
any content are safe, as lengths, not separators, end a record. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.storage import cut, fresh_path
from sigloom.operators.graph import connected_components

LEAST_REVISIT = 1000
#: Size classes of payloads, as (bytes from which, pages of a file): a file holds 256 MB of payload at most, or eight pages.
SIZES = ((0, 4000), (1 << 16, 256), (1 << 20, 8))
#: Repeated payloads (about 200 bytes each in memory) that are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of urls in them that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Date written into records whose page has none.
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
#: Parts that the rows of one payload are dealt to where they are joined with their first record.
SALTS = 16
#: Bytes of an archive that are inflated at a time.
CHUNK = 1 << 16


def _urn(*parts: Column) -> Column:
    """A record id that depends on ``parts`` alone, so that a task run again writes the same."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(kind: Column | str, rid: Column, headers: list[Column], block: Column) -> Column:
    """A record without the two line ends that close it. Null headers are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), rid),
        F.lit(f"WARC-Date: {DATE}"),
        *headers,
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    return F.concat(lines, F.lit(END), block)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _numbered(known: DataFrame) -> DataFrame:
    """``known`` with ``nr``, which tells rows of equal id, url and payload apart; payloads move only where ids repeat."""
    again = known.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("c")).where("c > 1 or id is null").select("id")
    if not again.limit(1).count():
        return known.withColumn("nr", F.lit(1))
    same = known["page_id"].eqNullSafe(again["id"])
    counted = known.join(again, same, "left_semi").groupBy("page_id", "url", "digest", "bytes").agg(F.first("html").alias("html"), F.count("*").alias("c"))
    told = counted.select(*known.columns, F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("nr"))
    return known.join(again, same, "left_anti").withColumn("nr", F.lit(1)).unionByName(told)


def _beside(rows: DataFrame, few: DataFrame, key: str, spread: list[str], text: Column) -> DataFrame:
    """``rows`` left-joined with ``few`` by ``key``: by broadcast if the counted rows of ``few`` and bytes of ``text`` allow it.

    Otherwise each row of ``few`` is copied to ``SALTS`` parts, to which ``rows`` go by the hash of ``spread``, so that no key is one task.
    """
    size = few.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES:
        return rows.join(F.broadcast(few), key, "left")
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], "left").drop("salt")


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, bytes, digest, nr, refers_to, refers_url): the last two are set for revisits.

    Ids of payloads are pre-aggregated before they are shuffled. Payloads that occur twice
    are broadcast if their counted rows are few; then no html is shuffled. Otherwise each
    is copied to ``SALTS`` parts, so that no payload is one task.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    known = pages.select("page_id", "url", html.alias("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    known = _numbered(known.withColumn("digest", F.sha1(F.col("html").cast("binary"))))
    large = known.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest")
    copies = large.agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1 and first.page_id is not null").select("digest", "first")
    copies = cut(copies, "warc-copies")
    joined = _beside(known, copies, "digest", ["page_id", "url"], F.col("first.url"))
    again = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    of = lambda c: F.when(again, F.col(f"first.{c}")).alias(f"refers_{'to' if c == 'page_id' else c}")
    return joined.select("page_id", "url", "html", "bytes", "digest", "nr", of("page_id"), of("url"))


def records(pages: DataFrame) -> DataFrame:
    """One text row per page: its request, response or revisit, and metadata record."""
    return _records(with_revisits(pages))


def _records(known: DataFrame) -> DataFrame:
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    host = F.regexp_extract(uri, r"://([^/?#]*)", 1)
    target = F.regexp_extract(uri, r"://[^/?#]*([^#]*)", 1)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    rid = lambda kind, of, url, nr: _urn(F.lit(kind), of, F.col("digest"), nr, F.coalesce(url, F.lit("")))
    own = [rid(k, name, F.col("url"), F.col("nr")) for k in ("request", "response", "metadata")]
    link = _header("WARC-Concurrent-To", own[1])
    to = _header("WARC-Target-URI", uri)
    ask = F.concat(F.lit("GET "), F.coalesce(F.nullif(target, F.lit("")), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END))
    again = F.col("refers_to").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    answer = F.concat(head, F.when(again, "").otherwise(F.col("html")))
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    first = F.when(again, _header("WARC-Refers-To", rid("response", F.col("refers_to").cast("string"), F.col("refers_url"), F.lit(1))))
    profile = F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    http = lambda kind: F.lit(f"Content-Type: application/http; msgtype={kind}")
    fields = F.concat(F.lit("page-id: "), name, F.lit("\r\n"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    return known.select(
        F.concat_ws(
            END,
            _record("request", own[0], [to, link, http("request")], ask),
            _record(kind, own[1], [to, digest, first, profile, http("response")], answer),
            _record("metadata", own[2], [to, link, F.lit("Content-Type: application/warc-fields")], fields),
        ).alias("value")
    )


def write(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the archives of ``pages`` below ``path``, a folder per size class that occurs; ``compression`` none lets readers seek records."""
    known = with_revisits(pages)
    size = F.lit(0)
    for k, (least, _) in enumerate(SIZES[1:], 1):
        size = F.when(F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))) >= least, k).otherwise(size)
    kinds = sorted(r[0] for r in pages.select(size.alias("k")).distinct().collect())  # at most one row per class
    for k in kinds or [0]:
        options = {"compression": compression, "lineSep": END, "maxRecordsPerFile": str(SIZES[k][1])}
        _records(known.where(size == k) if len(kinds) > 1 else known).write.options(**options).text(f"{path}/size-{k}")


def _pieces(content: bytes) -> Iterator[bytes]:
    """An archive's bytes in pieces, inflated member by member: ``CHUNK`` bytes of it are inflated at a time."""
    view = memoryview(content)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[at : at + CHUNK]) for at in range(0, len(view), CHUNK))
        return
    member = zlib.decompressobj(31)
    for at in range(0, len(view), CHUNK):
        rest = bytes(view[at : at + CHUNK])
        while rest := rest.lstrip(b"\0") if member.eof else rest:
            if member.eof:
                member = zlib.decompressobj(31)
            yield member.decompress(rest)
            rest = member.unused_data


class Headers(dict[str, str]):
    """Headers of a record by name in lower case; ``linked`` are the values of all its concurrent-to headers."""

    linked: list[str]


def parse(content: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers (names in lower case) and block of every record of one archive, of which one record is held at a time."""
    pieces, held = _pieces(content), bytearray()

    def find(what: bytes) -> int:
        """Where ``what`` begins in what is held, after reading on as far as need be; -1 if it doesn't come."""
        seen = 0
        while (at := held.find(what, seen)) < 0:
            seen = max(0, len(held) - len(what) + 1)
            if (piece := next(pieces, None)) is None:
                return -1
            held.extend(piece)
        return at

    while (at := find(b"WARC/1.")) >= 0:
        del held[:at]
        if (stop := find(END.encode())) < 0:
            raise ValueError("an archive ends within the headers of a record")
        lines = held[:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = Headers((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines))
        headers.linked = [v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip().lower() == "warc-concurrent-to"]
        end = stop + 4 + int(headers.get("content-length", 0))
        while len(held) < end and (piece := next(pieces, None)) is not None:
            held.extend(piece)
        block = bytes(held[stop + 4 : end])
        del held[:end]
        yield headers, block


RECORD = "type string, record_id string, concurrent_to array<string>, refers_to string, uri string, payload_bytes long, payload_digest string, fields string, payload binary"


def _parse_files(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("uri", pa.string())]
            + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for content in batch.column(0).drop_null():
                rows, size = [], 0
                for h, block in parse(content.as_buffer()):
                    kind = h.get("warc-type")
                    row = [kind, h.get("warc-record-id"), h.linked, h.get("warc-refers-to"), h.get("warc-target-uri"), None, None, None, None]
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        said = h.get("warc-payload-digest", "").rpartition(":")[2].lower()
                        if kind == "response":
                            row[5], row[6] = len(payload), hashlib.sha1(payload).hexdigest()
                            if said and said != row[6]:
                                raise ValueError(f"payload digest of {row[1]} does not match")
                            row[8] = payload if with_payload else None
                        else:
                            lengths = [int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            row[5], row[6] = lengths[0] if lengths else None, said
                    elif kind == "metadata":
                        row[7] = block.decode("utf-8", "replace")
                    rows.append(row)
                    size += len(row[8] or b"")
                    if len(rows) >= 5000 or size >= 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives under ``path``; payloads only if they are asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_parse_files(with_payload), RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, request, requests, metadata); absent records are null or empty.

    Records are linked through concurrent-to identifiers, whichever side names the other
    and through however many records. ``capture_id`` is the response's id, or else the
    least id of the group. A group of several responses has a row for each. ``requests`` are all
    requests of the group by id, and ``request`` the first of them. Records
    without an id are rows of their own; those of other types (such as warcinfo) belong to no
    capture. ``found`` is read for its links and for its records.
    """
    records_ = found.where(F.col("type").isin("request", "response", "revisit", "metadata"))
    named = records_.where("record_id is not null").select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    members = connected_components(named)
    nested = F.struct("record_id", "uri", "type", "refers_to", "payload_bytes", "payload_digest", "payload")
    answer = F.col("type").isin("response", "revisit")
    request, metadata = F.when(F.col("type") == "request", F.struct("record_id", "uri")), F.when(F.col("type") == "metadata", F.struct("record_id", "fields"))
    keyed = records_.where("record_id is not null").join(members.withColumnRenamed("node", "record_id"), "record_id", "left")
    groups = keyed.withColumn("root", F.coalesce("root", "record_id")).groupBy("root").agg(
        F.collect_list(F.when(answer, nested)).alias("responses"),
        F.array_sort(F.collect_list(request)).alias("requests"),
        F.collect_list(metadata).alias("metadata"),
        F.min("record_id").alias("least"),
    )
    alone = records_.where("record_id is null").select(
        F.array_compact(F.array(F.when(answer, nested))).alias("responses"), F.array_compact(F.array(request)).alias("requests"), F.array_compact(F.array(metadata)).alias("metadata"), F.col("record_id").alias("least")
    )
    groups = groups.drop("root").unionByName(alone)
    rows = groups.select(F.explode_outer("responses").alias("response"), "requests", "metadata", "least")
    return rows.select(F.coalesce("response.record_id", "least").alias("capture_id"), "response", F.get("requests", 0).alias("request"), "requests", "metadata")


def resolve(found: DataFrame) -> DataFrame:
    """``found``, rows of (record_id, type, refers_to, page_id), with ``refers_page``: the page of the response that a revisit names by its record id.

    Null where no response of that id was read. A response that very many revisits name is joined by broadcast or in parts.
    """
    named = found.where("type = 'revisit' and refers_to is not null").select("refers_to").distinct()
    responses = found.where("type = 'response' and record_id is not null").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("refers_page"))
    targets = cut(responses.join(named, "refers_to", "left_semi"), "warc-targets")
    joined = _beside(found, targets, "refers_to", ["record_id"], F.col("refers_to"))
    return joined.withColumn("refers_page", F.when(F.col("type") == "revisit", F.col("refers_page")))


def captures(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages``, read them back, and report every capture's response."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path)
    whole = assemble(cut(read(spark, path, with_payload=False), "warc-records"))
    page = F.nullif(F.regexp_extract(F.array_join("metadata.fields", ""), r"(?:^|\n)page-id: (-?[0-9]+)\r", 1), F.lit("")).cast("long")
    answers = whole.select(page.alias("page_id"), *(f"response.{c}" for c in ("record_id", "type", "refers_to", "payload_bytes", "payload_digest")))
    found = resolve(cut(answers, "warc-answers"))
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_page").alias("refers_to"))

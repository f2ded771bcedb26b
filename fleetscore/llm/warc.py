"""Legacy ARC archives to WARC: parsing, synthesis of what ARC lacks, revisit records, reading back.

An ARC file begins with a version block that declares the fields of its header lines: version 1 has URL, IP
address, date, type and length; version 2 adds result code, checksum, location, offset and file name. A record
is its header line, as many bytes as it declares, and a line feed. Fields are split off from the right, as only
the URL may hold blanks.

The converter adds what a WARC record needs: an identifier from the record's own fields (the same in every run),
an ISO date, the record type, and a SHA-1 digest of the payload in base32. The version block becomes a warcinfo
record, a block with an HTTP head a response, any other (dns:, for one) a resource of its own content type. Of
responses with equal payloads of at least `least` bytes the one with the smallest page stays, the others are revisits
of it. Heads and payloads are carried and written as the bytes they are.

Archives are written by Spark's text writer: a record ends in two line breaks, which are its line separator, so
files are committed as a whole or not at all. They are read back record by record by their declared lengths;
warcinfo records describe the file and are passed over, and a payload must have its stated digest.

Null html is an empty payload, a null url is written as `-` and read back as null. A null page_id comes last
in the choice of the response, and is read back as null. Rows with equal page_id and payload are all responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscore.llm.arrays import slices

# Fixed by the two formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
END = "\r\n\r\n"

RECORD = ("page_id long, url string, ip string, date string, type string, head binary, payload binary, "
          "payload_bytes long, payload_digest string, record_id string, kind string")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _arc_block(version: int, name: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    rest = "" if version == 1 else "200 - - 0 %s " % name
    return f"filedesc://{name} 0.0.0.0 20200101000000 text/plain {rest}{len(body)}\n".encode() + body + b"\n"


def pages_to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html) to (path, content): one ARC file's bytes per few megabytes of pages, versions in turn."""
    for count, batch in enumerate(slices(batches, "html")):
        ids = batch.column("page_id").to_pylist()
        version = 1 + (ids[0] or 0) % 2
        name = f"pages-{ids[0]}-{count}.arc"
        out, at = [_arc_block(version, name)], 0
        for page, url, html in zip(ids, batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            payload = (html or "").encode()
            where = "" if page is None else f"X-Page-Id: {page}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{where}Content-Length: {len(payload)}{END}".encode()
            at += len(out[-1])
            more = "" if version == 1 else f"200 - - {at} {name} "
            url = "-" if url is None else re.sub(r"\s", lambda m: quote(m[0]), url)
            out.append(f"{url} 0.0.0.0 20200101000000 text/html {more}{len(head) + len(payload)}\n".encode() + head + payload + b"\n")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.large_binary())], ["path", "content"])


def arc_records(content: bytes, whole: bool = False) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of every record of an ARC file behind its version block, or with it."""
    data = io.BytesIO(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)
    fields = None
    while line := data.readline():
        if not line.strip():
            continue
        if fields is None:
            block = data.read(int(line.split()[-1]))
            fields = ARC_FIELDS[int(block[:1])]
            if whole:
                parts = line.decode("utf-8", "replace").rstrip("\n").rsplit(" ", len(fields) - 1)
                yield dict(zip(fields, parts)) | {"version block": True}, block
            continue
        parts = line.decode("utf-8", "replace").rstrip("\n").rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields):
            raise ValueError(f"ARC header line of {len(parts)} fields: {line[:200]!r}")
        head = dict(zip(fields, parts))
        block = data.read(int(head["Archive-length"]))
        if len(block) < int(head["Archive-length"]):
            raise ValueError(f"ARC record ends early: {line[:200]!r}")
        yield head, block


def _split(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP head with the blank line that ends it, and the payload; a head without one is all there is."""
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end():]) if end else (block, b"")


def _record(head: dict, block: bytes) -> tuple:
    http = block.startswith(b"HTTP/")
    kind = "warcinfo" if "version block" in head else "response" if http else "resource"
    start, payload = _split(block) if kind == "response" else (b"", block)
    page = re.search(rb"(?mi)^X-Page-Id: *(-?\d+)", start)
    d, digest = head["Archive-date"], sha1_base32(payload)
    name = "\n".join([head["URL"], d, page[1].decode() if page else "", digest])
    return (
        int(page[1]) if page else None, None if head["URL"] == "-" else head["URL"], head["IP-address"],
        f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", head["Content-type"],
        start, payload, len(payload), digest, f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", kind)


def _convert(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), *[pa.large_string()] * 4, *[pa.large_binary()] * 2, pa.int64(), *[pa.string()] * 3]
    names = [f.split()[0] for f in RECORD.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows = [_record(*r) for r in arc_records(content.as_py(), whole=True)]
            if not payloads:
                rows = [(*r[:6], None, *r[7:]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def convert(arcs: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of ARC files (path, content); without payloads only what decides on revisits is carried."""
    return arcs.mapInArrow(lambda batches: _convert(batches, payloads), RECORD)


def to_warc(arcs: DataFrame, least: int = 0) -> DataFrame:
    """(value): the text of a WARC record for every record of ARC files (path, content), without its end."""
    keys = convert(arcs, payloads=False).where((F.col("kind") == "response") & (F.col("payload_bytes") >= least))
    order = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("p"), F.col("record_id").alias("r"), "url", "date", "page_id")
    first = keys.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"))
    records = convert(arcs).join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = (F.col("kind") == "response") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    # a cast of bytes to a string leaves them as they are, and so does the text writer
    block = F.concat(F.col("head").cast("string"), F.when(revisit, "").otherwise(F.col("payload").cast("string")))
    info = F.col("kind") == "warcinfo"

    def line(name: str, value) -> object:
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))

    value = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("kind"))),
        line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.when(~info, F.col("url"))),
        line("WARC-Filename", F.when(info, F.regexp_replace("url", "^filedesc://", ""))),
        line("WARC-IP-Address", F.when(~info, F.col("ip"))),
        line("WARC-Payload-Digest", F.when(~info, F.concat(F.lit("sha1:"), "payload_digest"))),
        line("WARC-Profile", F.when(revisit, REVISIT)), line("WARC-Refers-To", F.when(revisit, F.col("first.r"))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first.url"))),
        line("WARC-Refers-To-Date", F.when(revisit, F.col("first.date"))),
        line("Content-Type", F.when(F.col("kind") == "response", HTTP).otherwise(F.col("type"))), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    return records.select(value.alias("value"))


def write_warc(records: DataFrame, path: str, per_file: int = 5000) -> None:
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).option(
        "zlib.compress.level", "BEST_SPEED").text(path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of a WARC file; headers by lower-case name."""
    data = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        head = {}
        while (line := data.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, data.read(int(head["content-length"]))


def _read(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id", "url"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for head, block in warc_records(content.as_py()):
                kind, stated = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
                if kind == "warcinfo":
                    continue
                start, payload = (b"", block) if kind == "resource" else _split(block)
                if kind != "revisit" and sha1_base32(payload) != stated:
                    raise ValueError(f"payload of {head['warc-record-id']} has not its digest {stated}")
                page, size = (re.search(rb"(?mi)^%s: *(-?\d+)" % n, start) for n in (b"X-Page-Id", b"Content-Length"))
                rows.append((
                    int(page[1]) if page else None, len(payload) if kind != "revisit" else int(size[1]) if size else None,
                    stated, kind, head["warc-record-id"],
                    head.get("warc-refers-to"), head.get("warc-target-uri")))
                if len(rows) >= most:
                    yield table(rows)
                    rows = []
            yield table(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, record_id, refers_to_id, url of the archives' records."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                   "record_id string, refers_to_id string, url string")


def resolved(records: DataFrame) -> DataFrame:
    """Records read back, with refers_to: the page of the response that a revisit points to, whose size is its own."""
    pages = records.where("record_type = 'response'").groupBy("record_id").agg(
        F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("_bytes"))
    joined = records.join(pages.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
    return joined.withColumn("payload_bytes", F.coalesce("_bytes", "payload_bytes")).drop("_bytes")

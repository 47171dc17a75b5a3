"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. A reading task gets a byte range, scans it for the gzip magic, takes a place for a
member only if it decodes to a WARC header, and owns the records that start inside its range; it reads on past the end
for the last one's body. After a member the next place is known, so the scan only runs where a range starts or data is broken.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch, bounded_batches
from corpusmill.llm.files import Reader, make_folder, put

MAGIC = b"\x1f\x8b\x08"
#: An archive is closed beyond the first, a reading task gets ranges of the second size; bytes read at once; rows of a planning table.
ARCHIVE_BYTES, RANGE_BYTES, _CHUNK = 32 << 20, 8 << 20, 1 << 18
_EPOCH = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has no block; it carries the digest and length of the payload it stands for."""
    body = payload if kind == "response" else b""
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": _EPOCH, "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "X-Payload-Length": str(len(payload)), "Content-Type": "text/html", "Content-Length": str(len(body)),
    }
    if refers_to is not None:
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "replace") + body + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) and return the archives' (path, bytes): one row a file that a finished task wrote.

    Of pages with equal payloads of at least least_bytes the one with the largest page_id is the response and the others revisit it. A null html is empty.
    Rows that share that largest id are all responses. A null id never counts as larger.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 200)
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    make_folder(folder)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digested = rows.withColumn("sha", F.sha1("payload"))
    # only digests that occur twice take part; with the groups in a table of their own Spark can split a hot one's rows in the join
    many = digested.filter(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("largest"), F.count("*").alias("c")).filter("c > 1")
    many = scratch.write("groups", many.select(F.col("sha").alias("of"), "largest"))
    revisits = (F.col("largest").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("largest"))
    joined = digested.join(many, F.col("sha") == F.col("of"), "left").select("page_id", "url", "payload", F.when(revisits, F.col("largest")).alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            n = put(path, b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "bytes"])

        for batch in batches:
            for page_id, url, body, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(record("response" if refers is None else "revisit", page_id, url, body, refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    # the manifest is written, so files of lost or repeated tasks are never read
    return scratch.write("manifest", joined.mapInArrow(write, "path string, bytes long"))


def _member(read: Reader, at: int, first: bytes) -> tuple[bytes, int] | None:
    """The content of the member at a place and the place after it; None if none is there. It reads no further than the header unless that is a WARC header."""
    unpack, out, place, piece, seen = zlib.decompressobj(31), [], at, first, b""
    while True:
        try:
            part = unpack.decompress(piece)
        except zlib.error:
            return None
        place += len(piece)
        out.append(part)
        if len(seen) < 8:
            seen += part[:8]
            if not b"WARC/1.1"[: len(seen[:8])] == seen[:8]:
                return None
        if unpack.eof:
            return b"".join(out), place - len(unpack.unused_data)
        piece = read.read(place, _CHUNK)
        if not piece:
            return None


def records_in(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of the records that start in a byte range."""
    with Reader(path) as read:
        at, held, held_at = start, b"", start
        while at < end:
            if not (held_at <= at and at + 64 <= held_at + len(held)):
                held, held_at = read.read(at, _CHUNK), at
            found = held.find(MAGIC, at - held_at)
            if found < 0:
                at = held_at + max(1, len(held) - 2)
                if held_at + len(held) >= read.size:
                    return
                held = b""
                continue
            at = held_at + found
            if at >= end:
                return
            member = _member(read, at, held[found:])
            parsed = _parsed(member[0]) if member else None
            if parsed is None:
                at += 1
                continue
            yield parsed
            at = member[1]


def _parsed(content: bytes) -> tuple[dict[str, str], bytes] | None:
    head, mark, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    if not mark or not lines[0].startswith("WARC/1.") or "WARC-Type" not in fields or not fields.get("Content-Length", "").isdigit():
        return None
    size = int(fields["Content-Length"])
    return (fields, rest[:size]) if len(rest) >= size else None


def _page(field: str | None) -> int | None:
    told = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(told) if told.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to of every record of archives (path, bytes).

    html is null in revisits; a response's digest and size are computed from its block, and a record whose block contradicts its header raises.
    """
    bounded_batches(spark, 64)
    last = F.greatest(F.floor((F.col("bytes") - 1) / range_bytes), F.lit(0))
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("r")).select("path", (F.col("r") * range_bytes).alias("start"), ((F.col("r") + 1) * range_bytes).alias("end"))
    ranges = ranges.repartition(max(2, min(10_000, spark.sparkContext.defaultParallelism * 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, size = [], 0
                for head, block in records_in(path, start, end):
                    told = head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and told != base32_sha1(block):
                        raise ValueError(f"{path}: the record {head.get('WARC-Record-ID')} is damaged")
                    text = block.decode("utf-8", "replace") if kind == "response" else None
                    rows.append((_page(head.get("WARC-Record-ID")), head.get("WARC-Target-URI"), text, int(head.get("X-Payload-Length", len(block))), told, kind, _page(head.get("WARC-Refers-To"))))
                    size += len(block)
                    if size > 1 << 22:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.mapInArrow(run, "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

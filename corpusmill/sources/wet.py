"""WET archives as a Spark data source: one task for each byte range, so that an archive of any size is read by many.

A record belongs to the range in which it starts. In a gzip archive a task looks for the magic bytes of a member in its range and
takes those whose first decoded bytes open a record; the last one is read on beyond the range. In an uncompressed archive it
looks for a version line after a blank one and takes it if its header holds and the record ends where its length says. A gzip
archive that is one single member can only be read from its start, by one task and as a stream. Memory is one record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.sources.shared import Replacement, listed, make_folder, opened

SPLIT, CHUNK, PIECE, MOST_HEADER = 64 << 20, 1 << 18, 1 << 16, 1 << 16
_OPEN, _MAGIC, _BLANK = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
SCHEMA = "warc_file string, start long, type string, url string, timestamp string, language string, text string"


class _Stream:
    """Bytes taken one after another from chunks."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held, self.used = iter(chunks), b"", 0

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.held += chunk
        return True

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        return self.held[:n]

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left and (self.held or self._more()):
            parts.append(self.held[:left])
            left -= len(parts[-1])
            self.held = self.held[len(parts[-1]) :]
        out = b"".join(parts)
        self.used += len(out)
        return out

    def header(self) -> bytes | None:
        """What stands before the next blank line; None if there is none near."""
        while (at := self.held.find(_BLANK)) < 0:
            if len(self.held) > MOST_HEADER or not self._more():
                return None
        return self.take(at + 4)[:at]


def _fields(head: bytes) -> dict[str, str] | None:
    """The fields of a header, names in lower case; None for what is no header of a record."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}
    sound = lines[0].startswith("WARC/1.") and fields.get("content-length", "").isdigit() and "warc-type" in fields
    return fields if sound else None


def _records(stream: _Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of the records from here on; a broken or cut off record ends them."""
    while True:
        while stream.peek(2) == b"\r\n":
            stream.take(2)
        if stream.peek(len(_OPEN)) != _OPEN:
            return
        fields = _fields(stream.header() or b"")
        if fields is None:
            return
        size = int(fields["content-length"])
        content = stream.take(size)
        if len(content) < size:
            return
        yield fields, content


class _File:
    def __init__(self, uri: str, path: str):
        self.file = opened(uri)[0].open_input_file(path)
        self.size = self.file.size()

    def at(self, start: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - start)), start) if start < self.size else b""

    def chunks(self, start: int) -> Iterator[bytes]:
        while start < self.size:
            yield (chunk := self.at(start, CHUNK))
            start += len(chunk)

    def find(self, mark: bytes, start: int, end: int) -> int:
        """The first place of the mark in [start, end); -1 if none."""
        while start < end:
            chunk = self.at(start, CHUNK + len(mark) - 1)
            place = chunk.find(mark)
            if 0 <= place and start + place < end:
                return start + place
            start += CHUNK
        return -1


class _Member:
    """The decoded chunks of one gzip member; `end` is where it ends, once all are taken."""

    def __init__(self, file: _File, start: int):
        self.file, self.start, self.end = file, start, None

    def __iter__(self) -> Iterator[bytes]:
        decoder, at = zlib.decompressobj(31), self.start
        for chunk in self.file.chunks(self.start):
            at += len(chunk)
            while chunk:
                try:
                    out = decoder.decompress(chunk, PIECE)
                except zlib.error:
                    return
                if out:
                    yield out
                if decoder.eof:
                    self.end = at - len(decoder.unused_data)
                    return
                chunk = decoder.unconsumed_tail


def _packed(file: _File, low: int, high: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    at = low
    while (at := file.find(_MAGIC, at, high)) >= 0:
        member = _Member(file, at)
        stream, number = _Stream(member), 0
        if stream.peek(len(_OPEN)) == _OPEN:
            for fields, content in _records(stream):
                yield at + number, fields, content  # records of one member are told apart by their number
                number += 1
            while stream.take(CHUNK):
                pass
        at = member.end if number and member.end else at + 1


def _starts(file: _File, at: int) -> bool:
    """Whether a record starts here: its header holds, and behind its content the next one stands or the archive ends."""
    stream = _Stream(file.chunks(at))
    if next(_records(stream), None) is None:
        return False
    after = stream.peek(len(_BLANK + _OPEN))
    return after in (b"", _BLANK, _BLANK + _OPEN)


def _plain(file: _File, low: int, high: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    at = low
    if low:
        place = max(0, low - len(_BLANK)) - 1
        while True:
            place = file.find(_BLANK + _OPEN, place + 1, high - len(_BLANK))
            if place < 0:
                return
            at = place + len(_BLANK)
            if _starts(file, at):
                break
    first, stream = at, _Stream(file.chunks(at))
    while first + stream.used < high:
        here = first + stream.used
        found = next(_records(stream), None)
        if found is None:
            return
        yield here, *found
        while stream.peek(2) == b"\r\n":
            stream.take(2)


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.split = options["path"], max(1, int(options.get("split", SPLIT)))

    def partitions(self) -> list[_Range]:
        return [_Range(path, low, min(size, low + self.split)) for path, size in listed(self.uri) for low in range(0, size, self.split)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.high:
            return
        file = _File(self.uri, partition.path)
        every = _packed if file.at(0, 2) == _MAGIC[:2] else _plain
        for start, fields, content in every(file, partition.low, partition.high):
            yield partition.path, start, fields["warc-type"], fields.get("warc-target-uri", ""), fields.get("warc-date", ""), fields.get("warc-identified-content-language", "unknown"), content.decode("utf-8", "replace").strip()


class WetSource(DataSource):
    """Options: path (a file or a folder), split (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "wet_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def records(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """All records of the archives of a path: warc_file, start (a place that orders the records of a file), type, url, timestamp, language, text without outer white space."""
    spark.dataSource.register(WetSource)
    return spark.read.format("wet_records").option("split", split).load(path)


def write(docs: DataFrame, path: str, url: str = "url", text: str = "text", language: str = "language", timestamp: str = "timestamp", packed: bool = True) -> None:
    """Write rows as conversion records, one archive for each partition; null texts count as empty, null languages and times are left out."""
    make_folder(path)

    def run(batches):
        from pyspark import TaskContext

        out = None
        for batch in batches:
            for u, t, lang, when in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (t or "").encode("utf-8", "replace")
                head = [("WARC-Type", "conversion"), ("WARC-Target-URI", u or ""), ("WARC-Date", when), ("WARC-Identified-Content-Language", lang), ("Content-Type", "text/plain"), ("Content-Length", str(len(body)))]
                record = b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + body + b"\r\n\r\n"
                if packed:
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    record = squeeze.compress(record) + squeeze.flush()
                out = out or Replacement(f"{path}/part-{TaskContext.get().partitionId():06d}.warc.wet{'.gz' if packed else ''}")
                out.write(record)
        if out:
            out.close()
        yield from ()

    docs.select(*(F.col(c).cast("string") for c in (url, text, language, timestamp))).mapInArrow(run, "done int").write.format("noop").mode("overwrite").save()

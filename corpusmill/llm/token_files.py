"""Token files in patched frame-of-reference blocks.

A file holds whole documents in ascending id order. Its ids are cut into blocks of 128: the block's minimum is subtracted
and the rest packed at the width that a percentile of them needs; what does not fit goes to an exception list (place and
high bits). The header has the documents' ids and sizes and the start of every block, so any document can be read alone.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm.bpe import tokenizer_path
from corpusmill.llm.common import Scratch, bounded_batches
from corpusmill.llm.files import Reader, make_folder, put
from corpusmill.llm.pieces import PieceTable, text_bytes

BLOCK, PERCENTILE = 128, 95
#: A file is closed beyond so many ids.
FILE_IDS = 1_000_000
_MAGIC = b"PFOR0001"


@functools.lru_cache(maxsize=2)
def library_table(path: str) -> PieceTable:
    """Texts encoded by the tokenizers library: it is asked once for all new pieces of a batch, whose ids are then kept."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def learn(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in library.encode_batch_fast([p.decode("utf-8") for p in new], add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for own in ids for i in own), np.uint32, int(length.sum())), length

    return PieceTable(learn)


def _places(width: int) -> Iterator[tuple[int, int, int]]:
    """Of each of a block's values: its place, the 64-bit word where its bits begin, and the first bit there."""
    return ((i, i * width >> 6, i * width & 63) for i in range(BLOCK))


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK uint64 values below 2 ** width as rows of bytes, lowest bits first."""
    columns, out = np.ascontiguousarray(values.T), np.zeros((BLOCK * width >> 6, len(values)), np.uint64)
    for i, word, bit in _places(width):
        out[word] |= columns[i] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= columns[i] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T.astype("<u8")).view(np.uint8)


def unpack_bits(body: np.ndarray, width: int) -> np.ndarray:
    """The values that pack_bits was given."""
    words, mask = np.ascontiguousarray(np.ascontiguousarray(body).view("<u8").T), np.uint64((1 << width) - 1)
    out = np.empty((BLOCK, len(body)), np.uint64)
    for i, word, bit in _places(width):
        got = words[word] >> np.uint64(bit)
        if bit + width > 64:
            got |= words[word + 1] << np.uint64(64 - bit)
        out[i] = got & mask
    return out.T


def pack(ids: np.ndarray) -> bytes:
    """The blocks of uint32 ids with their index: blocks u32, minima u32, widths u8, exception counts u8, starts u64, data."""
    count = len(ids)
    blocks = -(-count // BLOCK)
    if not blocks:
        return struct.pack("<QI", 0, 0)
    full = np.zeros((blocks, BLOCK), np.int64)
    full.ravel()[:count] = ids
    if count % BLOCK:
        full[-1, count % BLOCK :] = full[-1, : count % BLOCK].min()
    low = full.min(axis=1)
    rest = full - low[:, None]
    needed = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # bits of each
    width = np.sort(needed, axis=1)[:, BLOCK * PERCENTILE // 100].astype(np.int64)
    block, place = np.nonzero(needed > width[:, None])
    exceptions = np.bincount(block, minlength=blocks)
    body = width * BLOCK // 8
    size = body + 5 * exceptions
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        out[start[rows][:, None] + np.arange(BLOCK * w // 8)] = pack_bits((rest[rows] & ((1 << w) - 1)).astype(np.uint64), w)
    # after the body of a block the places of its exceptions, then their high bits
    nth = np.arange(len(block)) - (np.cumsum(exceptions) - exceptions)[block]
    at = (start + body)[block]
    out[at + nth] = place
    high = (rest[block, place] >> width[block]).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(at + exceptions[block] + 4 * nth)[:, None] + np.arange(4)] = high
    return struct.pack("<QI", count, blocks) + low.astype("<u4").tobytes() + width.astype(np.uint8).tobytes() + exceptions.astype(np.uint8).tobytes() + start.astype("<u8").tobytes() + out.tobytes()


class Packed:
    """Reads packed ids; blocks are decoded when asked for."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        self.count, self.blocks = struct.unpack_from("<QI", data)
        n, at = self.blocks, 12
        self.low = np.frombuffer(data, "<u4", n, at).astype(np.int64)
        self.width = np.frombuffer(data, np.uint8, n, at + 4 * n).astype(np.int64)
        self.exceptions = np.frombuffer(data, np.uint8, n, at + 5 * n).astype(np.int64)
        self.start = np.frombuffer(data, "<u8", n, at + 6 * n).astype(np.int64)
        self.data = np.frombuffer(data, np.uint8, offset=at + 14 * n)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """uint32 ids first to last (not included)."""
        last = self.count if last is None else last
        if first >= last:
            return np.zeros(0, np.uint32)
        chosen = np.arange(first // BLOCK, -(-last // BLOCK))
        out = np.zeros((len(chosen), BLOCK), np.int64)
        for w in np.unique(self.width[chosen]):
            rows = np.flatnonzero(self.width[chosen] == w)
            own = chosen[rows]
            size = int(w) * BLOCK // 8
            if w:
                out[rows] = unpack_bits(self.data[self.start[own][:, None] + np.arange(size)], int(w)).astype(np.int64)
            many = self.exceptions[own]
            nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(self.start[own] + size, many)
            high = np.ascontiguousarray(self.data[(at + np.repeat(many, many) + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
            out[np.repeat(rows, many), self.data[at + nth]] |= high.astype(np.int64) << int(w)
        out += self.low[chosen][:, None]
        return out.ravel()[first - chosen[0] * BLOCK : last - chosen[0] * BLOCK].astype(np.uint32)


def write_files(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode texts (null: empty) as the tokenizers library does, append end_id to each and write files in ascending doc_id order; returns the manifest.

    Manifest: path, part and seq (files in id order), first (ids of all files before), docs, ids. Nulls come first, equal doc_ids in the order of their texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "tokens")
    folder, file = scratch.path("files"), path or tokenizer_path()
    make_folder(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, seq, held, size = library_table(file), 0, [], 0

        def close(part: int) -> pa.RecordBatch:
            doc_ids, null, sizes, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            head = _MAGIC + struct.pack("<I", len(doc_ids)) + doc_ids.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + sizes.astype("<u4").tobytes()
            name = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.pfor"
            n = put(name, head + pack(ids))
            values = ([name], [part], [seq], [len(doc_ids)], [int(sizes.sum())], [n])
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["path", "part", "seq", "docs", "ids", "bytes"])

        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at = library.encode(*text_bytes(batch.column(1)))
            part, doc_ids = batch.column(2)[0].as_py(), batch.column(0)
            held.append((np.array(doc_ids.fill_null(0)), np.array(doc_ids.is_null()), np.diff(at) + 1, np.insert(ids, at[1:], np.uint32(end_id))))
            size += len(held[-1][3])
            if size >= FILE_IDS:
                yield close(part)
                seq, held, size = seq + 1, [], 0
        if held:
            yield close(part)

    manifest = scratch.write("manifest", rows.select("doc_id", "text", "part").mapInArrow(write, "path string, part int, seq int, docs long, ids long, bytes long"))
    # one row a partition goes to the driver; inside a partition the files' totals are summed in their order
    offsets, before = [], 0
    for part, ids in manifest.groupBy("part").agg(F.sum("ids")).orderBy("part").collect():
        offsets.append((part, before))
        before += ids
    base = spark.createDataFrame(offsets, "part int, base long")
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = (F.col("base") + F.coalesce(F.sum("ids").over(earlier), F.lit(0))).alias("first")
    return manifest.join(F.broadcast(base), "part").select("path", "part", "seq", first, "docs", "ids")


def read_files(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if wanted, ids of each document, from the files alone and their places in the manifest."""
    spark = manifest.sparkSession

    want = ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with Reader(path) as f:
                    data = f.read(0, f.size)
                if data[:8] != _MAGIC:
                    raise ValueError(f"{path} is not a token file")
                n = struct.unpack_from("<I", data, 8)[0]
                doc_ids, null = np.frombuffer(data, "<i8", n, 12), np.frombuffer(data, np.uint8, n, 12 + 8 * n)
                sizes = np.frombuffer(data, "<u4", n, 12 + 9 * n).astype(np.int64)
                ids = Packed(memoryview(data)[12 + 13 * n :]).ids()
                at = np.cumsum(sizes) - sizes
                for low in range(0, n, 500):
                    own = range(low, min(n, low + 500))
                    lists = [ids[at[i] : at[i] + sizes[i]] for i in own]
                    values = ([None if null[i] else int(doc_ids[i]) for i in own], [first + int(at[i]) for i in own], [int(sizes[i]) for i in own], [zlib.crc32(x.astype("<u4").tobytes()) for x in lists], [x.astype(np.int32) if want else None for x in lists])
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    spread_out = manifest.select("path", "first").repartition(max(2, min(10_000, spark.sparkContext.defaultParallelism * 2)))
    found = spread_out.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
    return found if ids else found.drop("ids")

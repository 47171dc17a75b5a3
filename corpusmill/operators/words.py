"""The words of whole Arrow batches of texts, cut as tokens.PRETOKENS cuts one text in the JVM, and their counts.

A word begins where the kind of character changes: a space belongs to what follows it, white space gives up its last character, and an apostrophe that begins
a word takes s, t, re, ve, m, ll or d along. So all texts of a batch are cut by comparing neighbours in arrays. The kinds come from the JVM, whose Unicode
version Python need not share.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many bytes of texts are cut at once (a longer text alone), and a task hands on its words at so many.
_BYTES, _WORDS = 4_000_000, 200_000
#: The last code points of the kinds' ranges, U+D800 to U+DFFF being no characters.
_END, _LOW, _HIGH = 0x110000, 0xD800, 0xE000
_OTHER, _LETTER, _SPACE = 0, 1, 2


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 500):
    """For the actions inside, so many texts in an Arrow batch at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key, "10000")
    if not 0 < int(was) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


class Cutter:
    """Cuts texts. at: the code points from which on characters are of the kinds, ascending."""

    def __init__(self, at: np.ndarray, kinds: np.ndarray):
        self.at, self.kinds, self._kind = at, kinds, None

    @classmethod
    def of(cls, spark: SparkSession) -> Cutter:
        def kind(point: Column) -> Column:
            valid = F.when((point >= _LOW) & (point < _HIGH), F.lit(_HIGH)).otherwise(point)
            char = F.decode(F.unhex(F.lpad(F.hex(valid), 8, "0")), "UTF-32")
            return F.when(char.rlike(r"(?U)\w"), _LETTER).when(char.rlike(r"(?U)\s"), _SPACE).otherwise(_OTHER)

        ids = spark.range(_END).select("id", kind(F.col("id")).alias("k"), kind(F.greatest(F.col("id") - 1, F.lit(0))).alias("b"))
        rows = ids.filter("id = 0 OR k <> b").select("id", "k").toArrow().sort_by("id")
        return cls(rows.column("id").to_numpy(), rows.column("k").to_numpy().astype(np.uint8))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_kind": None}

    def starts(self, raw: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Where words begin in the UTF-8 of texts, joined. bound: where each text begins, the end of the last included."""
        if self._kind is None:
            self._kind = np.repeat(self.kinds, np.diff(self.at, append=_END))
        if not len(raw):
            return np.zeros(0, np.int64)
        plain = raw.max() < 128
        lead = None if plain else np.flatnonzero((raw & 0xC0) != 0x80)
        code = raw if plain else raw[lead]
        kind = self._kind[:256][code]
        if not plain:
            wide = np.flatnonzero(code >= 0xC0)
            at, b = lead[wide], code[wide].astype(np.int32)
            tail = np.append(raw, np.zeros(3, np.uint8))
            c, d, e = ((tail[at + k] & 0x3F).astype(np.int32) for k in (1, 2, 3))
            point = np.where(b < 0xE0, (b & 0x1F) << 6 | c, np.where(b < 0xF0, (b & 0xF) << 12 | c << 6 | d, (b & 7) << 18 | c << 12 | d << 6 | e))
            kind[wide] = self._kind[point]
        first = np.zeros(len(kind) + 1, bool)
        first[bound if plain else np.searchsorted(lead, bound)] = True
        before, now = kind[:-1], kind[1:]
        start = first[:-1].copy()
        start[1:] |= (before != now) & ((now == _SPACE) | (code[:-1] != 32))
        start[:-1] |= (before == _SPACE) & (now != _SPACE) & ~first[1:-1]
        quote = np.flatnonzero((code == 39) & start)
        follow = np.append(np.where(first[:-1], 0, code), [0, 0])  # 0: another text
        a, b = follow[quote + 1], follow[quote + 2]
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        taken = two | np.isin(a, list(b"stmd"))
        quote, size = quote[taken], 2 + two[taken]
        start[quote + 1] = False
        end = quote + size
        start[end[end < len(start)]] = True
        begin = np.flatnonzero(start)
        return begin if plain else lead[begin]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 of the texts joined, where each begins and the last ends) of some rows of a column of texts at a time; a null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + _BYTES, side="right")) - 1)
        yield low, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def distinct(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which of the distinct words each word is, these in the order in which they come up, and the words that are the first of their kind."""
    at = np.append(starts, len(raw)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    which = coded.indices.to_numpy()
    return which, coded.dictionary, np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))


def summed(parts: list[pa.Table]) -> pa.Table:
    """Rows of (key, freq, first place in two columns), one for each key, with the sum of freq and the least place."""
    whole = pa.concat_tables(parts)
    key, freq, *place = whole.column_names
    whole = whole.take(pc.sort_indices(whole, sort_keys=[(c, "ascending") for c in place], null_placement="at_start"))
    whole = whole.append_column("_row", pa.array(np.arange(len(whole))))
    told = whole.group_by(key, use_threads=False).aggregate([(freq, "sum"), ("_row", "min")])
    firsts = whole.select(place).take(told.column("_row_min"))
    return pa.table({key: told.column(key), freq: told.column(f"{freq}_sum")} | {c: firsts.column(c) for c in place})


def _counts(batches: Iterator[pa.RecordBatch], cutter: Cutter) -> Iterator[pa.RecordBatch]:
    """(word, freq, doc_id, pos), summed over a task; pos: the byte of its text where a word comes up first."""
    held, rows = [], 0
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_start"))
        for low, raw, bound in slices(batch.column(1)):
            starts = cutter.starts(raw, bound)
            if not len(starts):
                continue
            which, told, first = distinct(raw, starts)
            row = np.searchsorted(bound, starts[first], side="right") - 1
            columns = told.cast(pa.string()), pa.array(np.bincount(which)), batch.column(0).take(pa.array(low + row)), pa.array(starts[first] - bound[row])
            held.append(pa.table(dict(zip(("word", "freq", "doc_id", "pos"), columns, strict=True))))
            rows += len(told)
        if rows > 2 * _WORDS:
            held = [summed(held)]
            rows = len(held[0])
            if rows > _WORDS:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from summed(held).to_batches()


def valid(text: Column) -> Column:
    """A text without broken UTF-8, which the JVM's patterns replace as well."""
    return F.make_valid_utf8(text)


def _place(doc_id: Column, kind: T.DataType) -> Column:
    """A column that orders words by their first place, no document first. Of whole numbers one number is made: the least of numbers is found by hashing, that of structs by sorting all rows."""
    if isinstance(kind, T.IntegralType):
        return F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(Decimal(-(1 << 64)))) * F.lit(Decimal(1 << 32)) + F.col("pos").cast("decimal(20,0)")
    return F.struct(doc_id, "pos")


def frequencies(docs: DataFrame, least: int = 1) -> DataFrame:
    """What tokens.word_frequencies gives, but for the form of first (see _place): words are summed in each task before they meet."""
    cutter, kind = Cutter.of(docs.sparkSession), docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("freq", T.LongType()), T.StructField("doc_id", kind), T.StructField("pos", T.LongType())])
    words = docs.select("doc_id", valid(F.col("text")).alias("text")).mapInArrow(lambda batches: _counts(batches, cutter), schema)
    return words.groupBy("word").agg(F.sum("freq").alias("freq"), F.min(_place(F.col("doc_id"), kind)).alias("first")).filter(F.col("freq") >= least)

"""Benchmark decontamination by template canonicalisation.

Texts are cut into tokens; numbers, units after a number and, in a second reading, capitalised words become typed
placeholders. Windows of the template tokens are hash-joined with those of the benchmark. A hit counts when its slots are
consistent: each value of the benchmark's window is replaced by one value throughout, as in a re-parameterised question.
Windows with more numbers and units than words are no templates; a third reading joins them by their literal tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch, anti_join, bounded_batches, text_key
from corpusmill.llm.jaccard_join import _mix

#: Tokens of a window; a shorter item is one window of its own length. At least half of a template must be plain words; other windows match literally.
WINDOW = 10
# Unit words and signs that are typed when they follow a number.
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degrees degree mph kph kmh w kw v a hz khz mhz ghz kb mb gb tb % $ € £ °".split())
_TOKENS = regex.compile(r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+|[%$€£°]")
_WORD, _NAME, _NUMBER, _UNIT = range(4)
_U = np.uint64
_BITMAP = 1 << 18
_MARKS = _mix(np.arange(1, 4, dtype=_U), 31)
_FACTORS = _mix(np.arange(256, dtype=_U), 32) | _U(1)


class _Tokens(dict):
    """The token's hash without case, its kind in the lowest two bits."""

    def __missing__(self, token: str) -> int:
        if len(self) > 100_000:
            self.clear()
        low = token.lower()
        kind = _NUMBER if token[0].isnumeric() else _UNIT if low in UNITS else _NAME if token[0].isupper() and (len(token) == 1 or not token.isupper()) else _WORD
        self[token] = value = xxhash.xxh3_64_intdigest(low.encode("utf-8", "replace")) & ~3 | kind
        return value


_KNOWN = _Tokens()


def template_windows(text: str | None, window: int = WINDOW, wanted: np.ndarray | None = None, lengths: tuple[int, ...] = (), literal: bool = True) -> list[tuple[int, int, int, list[str]]]:
    """(hash, position, length, values of the slots) of each window of a whole text under each reading.

    wanted: a bitmap of hashes; other windows are left out. lengths: of shorter windows to take as well. Without it, a short text is one window.
    literal: also the windows that are mostly numbers and units, by their tokens without case and without slots.
    """
    tokens = _TOKENS.findall(text or "")
    if not tokens:
        return []
    h = np.fromiter(map(_KNOWN.__getitem__, tokens), _U, len(tokens))
    kind = h & _U(3)
    number = kind == _NUMBER
    unit = kind == _UNIT
    unit[1:] &= number[:-1]
    unit[0] = False
    # what stands before a window doesn't count here, so equal windows are literal in every text
    typed = np.concatenate([[0], np.cumsum(number | (kind == _UNIT))])
    exact = h >> _U(2)
    plain = exact.copy()
    plain[number], plain[unit] = _MARKS[0], _MARKS[1]
    named = np.where(kind == _NAME, _MARKS[2], plain)
    out = []
    sizes = sorted({window, *lengths}) if wanted is not None else [min(window, len(tokens))]
    for size in sizes:
        count = len(tokens) - size + 1
        if count < 1:
            continue
        for reading, values, slot in ((1, plain, number | unit), (2, named, number | unit | (kind == _NAME))):
            upto = np.concatenate([[0], np.cumsum(slot)])
            enough = 2 * (upto[size:] - upto[:-size]) <= size
            if reading == 2:  # without a name it is the same as the first
                names = np.concatenate([[0], np.cumsum(kind == _NAME)])
                enough &= names[size:] > names[:-size]
            made = np.full(count, reading * 1000 + size, _U)
            for j in range(size):  # token hashes are random bits already: odd factors tell places apart, one scrambling ends it
                made += values[j : j + count] * _FACTORS[j]
            made = _mix(made)
            if wanted is not None:
                enough &= (wanted[(made & _U(_BITMAP - 1)).astype(np.int64)] >> ((made >> _U(32)) & _U(63))) & _U(1) > 0
            for at in np.flatnonzero(enough).tolist():
                out.append((int(made[at].view(np.int64)), at, size, [tokens[at + j].lower() for j in range(size) if slot[at + j]]))
        dense = np.flatnonzero(2 * (typed[size:] - typed[:-size]) > size) if literal else typed[:0]
        if len(dense):
            made = np.full(len(dense), 3000 + size, _U)
            for j in range(size):
                made += exact[dense + j] * _FACTORS[j]
            made = _mix(made)
            if wanted is not None:
                found = (wanted[(made & _U(_BITMAP - 1)).astype(np.int64)] >> ((made >> _U(32)) & _U(63))) & _U(1) > 0
                dense, made = dense[found], made[found]
            out += [(value, at, size, []) for value, at in zip(made.view(np.int64).tolist(), dense.tolist(), strict=True)]
    return out


def _rows(ids: pa.Array, found) -> pa.RecordBatch:
    flat = [(i, *w) for i, windows in zip(ids.to_pylist(), found, strict=True) for w in windows]
    columns = list(zip(*flat, strict=True)) if flat else [[]] * 5
    types = (ids.type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["id", "hash", "pos", "size", "slots"])


_SCHEMA = "hash long, pos long, size long, slots array<string>"


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document that holds a benchmark window: doc_id, n_items, n_windows (long) and the sorted item_ids.

    Null or empty texts on either side match nothing; an item of fewer tokens than a window that are all numbers and units matches nothing, as any text may hold them; other number-dense windows match literally; equal items are all reported.
    Repeated doc_ids count as one document, null doc_ids as one as well. Empty tables give no rows.
    """
    found = _consistent(docs, benchmark, window, F.col("doc_id").cast("long"), "long")
    by_item = found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.count_distinct("pos").alias("n"))
    return by_item.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sum("n").alias("n_windows"), F.sort_array(F.collect_list("item_id")).alias("item_ids"))


def _consistent(docs: DataFrame, benchmark: DataFrame, window: int, key: Column, key_type: str) -> DataFrame:
    """id (the key), pos and item_id of each window of a document that is one of an item with its slots consistent."""
    if not 0 < window <= len(_FACTORS):
        raise ValueError(f"a window has 1 to {len(_FACTORS)} tokens")
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "decontam")

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                tokens = _TOKENS.findall(text or "")
                size = min(window, len(tokens))
                every = np.full(_BITMAP, -1, np.int64).view(_U)
                worded = len(tokens) >= window or any(_KNOWN[t] & 3 in (_WORD, _NAME) for t in tokens)
                found.append([w for w in template_windows(text, size, every, literal=worded) if w[2] == size] if tokens else [])
            yield _rows(batch.column(0), found)

    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    index = scratch.write("index", items.mapInArrow(of_items, f"id long, {_SCHEMA}"))
    # a Bloom bitmap of fixed size and the few lengths of short windows go to the tasks; the exact join comes after
    slot, bit = F.col("hash").bitwiseAND(F.lit(_BITMAP - 1)), F.call_function("shiftrightunsigned", "hash", F.lit(32)).bitwiseAND(F.lit(63)).cast("int")
    bits = np.zeros(_BITMAP, np.int64)
    for r in index.groupBy(slot.alias("s")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("b")).collect():
        bits[r.s] = r.b
    lengths = tuple(r["size"] for r in index.filter(F.col("size") < window).select("size").distinct().collect())
    shared = spark.sparkContext.broadcast(bits)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value.view(_U)
        for batch in batches:
            yield _rows(batch.column(0), [template_windows(t, window, wanted, lengths) for t in batch.column(1).to_pylist()])

    rows = docs.select(key.alias("id"), F.col("text").cast("string").alias("text"))
    hits = scratch.write("hits", rows.mapInArrow(of_docs, f"id {key_type}, {_SCHEMA}"))
    other = index.select(F.col("hash").alias("h"), F.col("id").alias("item_id"), F.col("slots").alias("theirs")).distinct()
    joined = hits.join(scratch.write("items", other), (F.col("hash") == F.col("h")) & (F.size("slots") == F.size("theirs")))
    # each value in the item has one value in the document
    return joined.filter(F.size(F.array_distinct(F.arrays_zip("theirs", "slots"))) == F.size(F.array_distinct("theirs")))


def decontamination_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows without a passage of the benchmark; all columns as they were, whatever their names. Each row is judged by its own text: null and repeated doc_ids change nothing."""
    found = _consistent(docs, benchmark, WINDOW, text_key(), "string").select("id").distinct()
    return anti_join(docs, Scratch(docs.sparkSession, "leaks").write("found", found), text_key(), "id")

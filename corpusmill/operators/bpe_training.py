"""BPE training whose words and pair counts stay on the cluster. The driver sees runs of symbols in bounded number and makes many merges of them a round.

A round takes the first pairs by count and place as candidates. Each word is cut where a pair is no candidate, and equal runs are summed; they are few, for
words share them. All merges that come before the first pair that is no candidate can be made on these runs alone: where a pair of new symbols stands, its
inner symbols stood side by side before, as often at least, so they were a candidate. Other pairs only get rarer, unless a merge makes a symbol that is there
already by another split; with such a merge the round ends. The merges are then applied to all words, and what changed is added to the counts.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.encoding import Ranks, merge, spread
from corpusmill.operators.words import distinct, short_batches, summed
from corpusmill.sources import shared

#: So many runs come to the driver in a round, and so many pairs are candidates at most.
RUNS, CANDIDATES = 100_000, 20_000
#: A task hands on what it has summed up at so many runs, and at so many changes of pairs.
_ENTRIES, _CHANGES = 100_000, 1_000_000
#: word: words are numbered by their first place. A row is a word (parts: its symbols, 32 bits each) or a change of a pair's count (n) with its birth, the merge (step), word and byte where it came up.
_ROWS = "word long, freq long, parts binary, left int, right int, n long, step int, born long, at int"
_ARROW = pa.schema([("word", pa.int64()), ("freq", pa.int64()), ("parts", pa.binary()), ("left", pa.int32()), ("right", pa.int32()), ("n", pa.int64()), ("step", pa.int32()), ("born", pa.int64()), ("at", pa.int32())])
_RUN = pa.schema([("run", pa.binary()), ("freq", pa.int64()), ("word", pa.int64()), ("at", pa.int32())])


def merged(parts: list, pair: tuple, made) -> list:
    out, i = [], 0
    while i < len(parts):
        if i + 1 < len(parts) and parts[i] == pair[0] and parts[i + 1] == pair[1]:
            out.append(made)
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


def _flat(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words of a column, of so many bytes each, and where each word begins."""
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return (raw.view(np.int32) if width == 4 else raw.astype(np.int32)), (at - at[0]) // width


def _among(parts: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each symbol and the next one are a pair of those (sorted) keys within one word."""
    pairs = (parts[:-1].astype(np.int64) << 32) | parts[1:]
    found = keys[np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)] == pairs
    found[at[1:-1] - 1] = False
    return found


def _keys(pairs) -> np.ndarray:
    return np.sort(np.array([(a << 32) | b for a, b in pairs], np.int64))


class _Changes:
    """Changes of pair counts and births, summed by pair."""

    def __init__(self):
        self._new()

    def _new(self) -> None:
        self.counts, self.births, self.held = [], [], 0

    def count(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> None:
        self.counts.append((left.astype(np.int64) << 32 | right, n))
        self.held += len(n)

    def born(self, left: np.ndarray, right: np.ndarray, step: np.ndarray, word: np.ndarray, at: np.ndarray) -> None:
        self.births.append((left.astype(np.int64) << 32 | right, step, word, at))
        self.held += len(step)

    def rows(self) -> pa.RecordBatch:
        births = [np.concatenate(x) for x in zip(*self.births, strict=True)] if self.births else [np.zeros(0, np.int64)] * 4
        pairs, which = np.unique(np.concatenate([births[0], *(k for k, _ in self.counts)]), return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, which[len(births[0]) :], np.concatenate([np.zeros(0, np.int64), *(x for _, x in self.counts)]))
        order = np.lexsort(births[:0:-1] + [which[: len(births[0])]])
        own = which[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        none, birth = np.ones(len(pairs), bool), np.zeros((3, len(pairs)), np.int64)
        none[own[first]] = False
        birth[:, own[first]] = [x[order[first]] for x in births[1:]]
        columns = [pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip((pairs >> 32, pairs & 0xFFFFFFFF, n), list(_ARROW)[3:6], strict=True)]
        columns += [pa.array(c.astype(f.type.to_pandas_dtype()), f.type, mask=none) for c, f in zip(birth, list(_ARROW)[6:], strict=True)]
        self._new()
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(pairs), f.type) for f in list(_ARROW)[:3]), *columns], schema=_ARROW)


def _word_rows(word, freq, parts) -> pa.RecordBatch:
    n = len(word)
    return pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(freq, pa.int64()), pa.array(parts, pa.binary()), *(pa.nulls(n, f.type) for f in list(_ARROW)[3:])], schema=_ARROW)


def _packed(parts: np.ndarray, size: np.ndarray) -> pa.Array:
    """Symbols of words as one binary each."""
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * np.int32(4)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(parts.astype(np.int32))])


def _inner(size: np.ndarray) -> np.ndarray:
    """Where in the joined symbols of words one stands that is not the last of its word."""
    inner = np.ones(int(size.sum()), bool)
    inner[np.cumsum(size)[size > 0] - 1] = False
    return np.flatnonzero(inner)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as bytes, with the counts of their pairs. Words of one byte never change."""
    changes = _Changes()
    for batch in batches:
        parts, at = _flat(batch.column("text"), 1)
        size = np.diff(at)
        long = np.flatnonzero(size > 1)
        words, freqs, size = batch.column("word").to_numpy()[long], batch.column("freq").to_numpy()[long], size[long]
        parts = spread(parts, at[long], size)
        k = _inner(size)
        row = np.repeat(np.arange(len(size)), size)[k]
        changes.count(parts[k], parts[k + 1], freqs[row])
        changes.born(parts[k], parts[k + 1], np.full(len(k), -1), words[row], k - (np.cumsum(size) - size)[row])
        yield _word_rows(words, freqs, _packed(parts, size))
        if changes.held > _CHANGES:
            yield changes.rows()
    yield changes.rows()


def _runs(batches: Iterator[pa.RecordBatch], keys: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Longest runs of symbols whose neighbours are pairs of the keys, summed, each with its first place."""
    held, rows = [], 0
    for batch in batches:
        parts, at = _flat(batch.column("parts"), 4)
        if not len(parts):
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], _among(parts, at, keys).astype(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2] + 1
        if not len(begin):
            continue
        row = np.searchsorted(at, begin, side="right") - 1
        upto = np.concatenate([[0], np.cumsum(size[parts], dtype=np.int64)])
        place, word, freq = upto[begin] - upto[at[row]], batch.column("word").to_numpy()[row], batch.column("freq").to_numpy()[row]
        order = np.lexsort((place, word))
        length = (end - begin)[order]
        which, runs, first = distinct(spread(parts, begin[order], length).astype(np.int32).view(np.uint8), 4 * (np.cumsum(length) - length))
        total = np.zeros(len(runs), np.int64)
        np.add.at(total, which, freq[order])
        held.append(pa.Table.from_arrays([runs, pa.array(total), pa.array(word[order[first]], pa.int64()), pa.array(place[order[first]].astype(np.int32))], schema=_RUN))
        rows += len(runs)
        if rows > 2 * _ENTRIES:
            held = [summed(held)]
            rows = len(held[0])
            if rows > _ENTRIES:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from summed(held).to_batches()


def _applied(batches: Iterator[pa.RecordBatch], steps: list[tuple[int, int, int, int]], size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The words after the merges (left, right, made, step), and the changes of pair counts."""
    left, right, made, step = (np.array(x, np.int64) for x in zip(*steps, strict=True))
    keys, ranks, changes = np.sort(left << 32 | right), Ranks(left, right, made), _Changes()
    for batch in batches:
        parts, at = _flat(batch.column("parts"), 4)
        if not len(parts):
            continue
        changed = np.zeros(len(at) - 1, bool)
        changed[np.searchsorted(at, np.flatnonzero(_among(parts, at, keys)), side="right") - 1] = True
        same = batch.filter(pa.array(~changed))
        yield _word_rows(same.column("word"), same.column("freq"), same.column("parts"))
        rows = np.flatnonzero(changed)
        if not len(rows):
            continue
        word, freq, count = batch.column("word").to_numpy()[rows], batch.column("freq").to_numpy()[rows], np.diff(at)[rows]
        old = spread(parts, at[rows], count)
        k, row = _inner(count), np.repeat(np.arange(len(rows)), count)
        changes.count(old[k], old[k + 1], -freq[row[k]])
        upto = np.cumsum(size[old], dtype=np.int64) - size[old]
        place = upto - upto[np.cumsum(count) - count][row]
        new, count = merge(old, count, ranks, place, lambda a, b, by, own, p, word=word: changes.born(a, b, step[by], word[own], p))
        k, row = _inner(count), np.repeat(np.arange(len(rows)), count)
        changes.count(new[k], new[k + 1], freq[row[k]])
        kept = np.flatnonzero(count > 1)
        yield _word_rows(word[kept], freq[kept], _packed(spread(new, np.cumsum(count)[kept] - count[kept], count[kept]), count[kept]))
        if changes.held > _CHANGES:
            yield changes.rows()
    yield changes.rows()


def _born(parts: list[int], made: int, size: list[int]) -> Iterator[tuple[tuple[int, int], int]]:
    """Pairs with a symbol, and the byte where each begins."""
    place = 0
    for pair in zip(parts, parts[1:], strict=False):
        if made in pair:
            yield pair, place
        place += size[pair[0]]


class Trainer:
    """What the driver holds: symbols, vocabulary and merges."""

    def __init__(self, symbols: list[str], vocab: dict[str, int], vocab_size: int, min_frequency: int):
        self.text, self.code, self.size = list(symbols), {s: k for k, s in enumerate(symbols)}, [1] * len(symbols)
        self.vocab, self.vocab_size, self.least = vocab, vocab_size, min_frequency
        self.merges: list[tuple[str, str]] = []

    def train(self, words: DataFrame, runs: int = RUNS, candidates: int = CANDIDATES) -> None:
        """words: (word, freq, first), by which they are numbered."""
        spark = words.sparkSession
        root = shared.folder(spark, "bpe")
        store, path = shared.opened(root)
        tables = 0

        def written(df: DataFrame) -> DataFrame:
            nonlocal tables
            tables += 1
            df.write.option("compression", "zstd").parquet(f"{root}/{tables}")
            return spark.read.schema(df.schema).parquet(f"{root}/{tables}")

        def summed(changes: DataFrame) -> DataFrame:
            births = F.min(F.when(F.col("step").isNotNull(), F.struct("step", "born", "at"))).alias("b")
            return changes.groupBy("left", "right").agg(F.sum("n").alias("n"), births).select("left", "right", "n", "b.step", "b.born", "b.at")

        try:
            with short_batches(spark):
                counted = written(words.select("first", "freq", "word"))
            ranges = max(spark.sparkContext.defaultParallelism, -(-counted.count() // 100_000))
            numbered = counted.repartitionByRange(ranges, "first").sortWithinPartitions("first").select(F.monotonically_increasing_id().alias("word"), "freq", F.encode("word", "UTF-8").alias("text"))
            made = written(numbered.mapInArrow(_starts, _ROWS))
            counts = written(summed(made.filter("left IS NOT NULL")))
            few = min(64, candidates)
            while len(self.vocab) < self.vocab_size:
                first = counts.filter(F.col("n") >= self.least).orderBy(F.desc("n"), "step", "born", "at").limit(few + 1).toArrow().to_pylist()
                if not first:
                    break
                own = made.filter("parts IS NOT NULL").select("word", "freq", "parts")
                while True:
                    pairs = first[:few]
                    keys, size = _keys((r["left"], r["right"]) for r in pairs), np.array(self.size, np.int32)
                    found = own.mapInArrow(lambda b, keys=keys, size=size: _runs(b, keys, size), "run binary, freq long, word long, at int")
                    found = found.groupBy("run").agg(F.sum("freq").alias("freq"), F.min(F.struct("word", "at")).alias("p")).select("run", "freq", "p.word", "p.at").limit(runs + 1).toArrow()
                    if len(found) <= runs or few == 1:
                        break
                    few = max(1, few // 4)
                steps = self.merge(found, pairs, first[few] if len(first) > few else None)
                few = max(1, min(candidates, int(few * min(4, 0.6 * runs / max(1, len(found))))))
                if len(self.vocab) >= self.vocab_size:
                    break
                sizes, old = np.array(self.size, np.int64), tables - 1
                made = written(own.mapInArrow(lambda b, steps=steps, sizes=sizes: _applied(b, steps, sizes), _ROWS))
                counts = written(summed(counts.unionByName(made.filter("left IS NOT NULL").select("left", "right", "n", "step", "born", "at"))))
                for k in (old, old + 1):
                    store.delete_dir(f"{path}/{k}")
        finally:
            if store.get_file_info(path).type.name == "Directory":
                store.delete_dir(path)

    def merge(self, found: pa.Table, pairs: list[dict], bound: dict | None) -> list[tuple[int, int, int, int]]:
        """The merges that come before the bound, made on the runs alone: (left, right, made, step)."""
        born = {(r["left"], r["right"]): (r["step"], r["born"], r["at"]) for r in pairs}
        counts = {(r["left"], r["right"]): r["n"] for r in pairs}
        stop = (-bound["n"], (bound["step"], bound["born"], bound["at"])) if bound else None
        parts = [np.frombuffer(x, np.int32).tolist() for x in found.column("run").to_pylist()]
        freqs, words, places = (found.column(c).to_pylist() for c in ("freq", "word", "at"))
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for k, run in enumerate(parts):
            for pair in zip(run, run[1:], strict=False):
                where[pair].add(k)
        heap = [(-n, born[p], p) for p, n in counts.items()]
        heapq.heapify(heap)
        steps = []
        while heap and len(self.vocab) < self.vocab_size:
            n, birth, pair = heapq.heappop(heap)
            if -n != counts.get(pair):
                continue  # an outdated entry
            if -n < self.least or (stop and (n, birth) >= stop):
                break
            text, step = self.text[pair[0]] + self.text[pair[1]], len(self.merges)
            again = text in self.code
            if not again:
                self.code[text] = len(self.text)
                self.text.append(text)
                self.size.append(self.size[pair[0]] + self.size[pair[1]])
            made = self.code[text]
            self.merges.append((self.text[pair[0]], self.text[pair[1]]))
            self.vocab.setdefault(text, len(self.vocab))
            steps.append((*pair, made, step))
            if again:
                break  # pairs with that symbol may stand outside the runs
            changed = set()
            for k in where.pop(pair):
                old, f = parts[k], freqs[k]
                for p in zip(old, old[1:], strict=False):
                    counts[p] -= f
                    changed.add(p)
                    if p in where:
                        where[p].discard(k)
                parts[k] = new = merged(old, pair, made)
                for p in zip(new, new[1:], strict=False):
                    counts[p] = counts.get(p, 0) + f
                    where[p].add(k)
                    changed.add(p)
                for p, at in _born(new, made, self.size):
                    told = (step, words[k], places[k] + at)
                    if told < born.get(p, (step + 1,)):
                        born[p] = told
            counts.pop(pair, None)
            for p in changed - {pair}:
                if counts.get(p, 0) >= self.least:
                    heapq.heappush(heap, (-counts[p], born[p], p))
        return steps

"""Merging words into ids, and whole Arrow batches of texts into ids and back."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa

from corpusmill.operators import words

#: So many words, or ids of words, are held in a worker; then it begins anew. Results do not depend on it.
HELD_WORDS, HELD_IDS = 500_000, 5_000_000
#: A word of more bytes is merged by itself.
SHORT = 64
_AT, _NONE = (1 << 32) - 1, np.int64(1 << 40)


def spread(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each pair, joined."""
    ends = np.cumsum(length)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)]


class Ranks:
    """Ranks of pairs of symbols, and what each pair makes. In the order of their ranks: left, right, made."""

    def __init__(self, left, right, made):
        left, right, self.made = (np.array(x, np.int64) for x in (left, right, made))
        key = left << 32 | right
        self.rank = np.argsort(key)
        self.key = key[self.rank]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it has none."""
        if not len(self.key):
            return np.full(len(left), _NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)


def merge(symbols: np.ndarray, size: np.ndarray, ranks: Ranks, place: np.ndarray | None = None, born: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of words, joined, once no pair has a rank, and how many each word has. size: how many each has before.

    A step makes each word's merge of the least rank, at all its places, for all words at once; words that are done leave. With the place of each symbol, born is
    told the pairs that a step makes: (left, right, rank of the merge, word, place).
    """
    symbol = np.array(symbols, np.int64)
    word, place = np.repeat(np.arange(len(size)), size), np.zeros(len(symbol), np.int64) if place is None else place
    within = lambda at: (at + 1 < len(word)) & (word[np.minimum(at + 1, len(word) - 1)] == word[at])
    inner = np.flatnonzero(within(np.arange(len(word))))
    rank = np.full(len(symbol), _NONE)
    rank[inner] = ranks.of(symbol[inner], symbol[inner + 1])
    done = []
    while len(symbol):
        head = np.flatnonzero(np.diff(word, prepend=-1))
        count = np.diff(head, append=len(word))
        least = np.minimum.reduceat(rank, head)
        going = least < _NONE
        if not going.all():
            kept = np.repeat(going, count)
            done.append((word[~kept], symbol[~kept]))
            word, symbol, rank, place, least, count = word[kept], symbol[kept], rank[kept], place[kept], least[going], count[going]
            if not len(symbol):
                break
        at = np.flatnonzero(rank == np.repeat(least, count))
        joined = np.diff(at, prepend=-2) == 1
        if joined.any():  # of places that overlap (aaa), every second one from the left
            k = np.arange(len(at))
            at = at[(k - np.maximum.accumulate(np.where(joined, 0, k))) % 2 == 0]
        own = rank[at]
        symbol[at] = ranks.made[own]
        kept = np.ones(len(symbol), bool)
        kept[at + 1] = False
        at -= np.arange(len(at))
        word, symbol, rank, place = word[kept], symbol[kept], rank[kept], place[kept]
        before = np.flatnonzero((at > 0) & (word[at - 1] == word[at]))
        touched, by = np.concatenate([at, at[before] - 1]), np.concatenate([own, own[before]])
        pairs = within(touched)
        rank[touched[~pairs]] = _NONE
        touched, by = touched[pairs], by[pairs]
        rank[touched] = ranks.of(symbol[touched], symbol[touched + 1])
        if born is not None:
            born(symbol[touched], symbol[touched + 1], by, word[touched], place[touched])
    if not done:
        return symbol, np.zeros(len(size), np.int64)
    word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
    return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(size))


class Merger:
    """The ids of words."""

    def __init__(self, vocab: dict[str, int], ranks: dict[tuple[str, str], int], symbols: list[str], unknown: int):
        code = {s: k for k, s in enumerate(symbols)}
        number = lambda s: code.setdefault(s, len(code))
        # a pair that was merged twice has its last rank, and all others keep their order
        self.pairs = [(number(a), number(b), number(a + b)) for a, b in sorted(ranks, key=ranks.get)]
        self.ranks, self.table = {a << 32 | b: k for k, (a, b, _) in enumerate(self.pairs)}, Ranks(*zip(*self.pairs, strict=True) if self.pairs else ([], [], []))
        self.ids = np.array([vocab.get(s, unknown) for s in code], np.int32)

    def of_word(self, word: bytes) -> list[int]:
        """Places of pairs lie in a heap by rank, so a word of any length takes about as long as its bytes are many."""
        part, n, rank_of = list(word), len(word), self.ranks.get
        heap = [k << 32 | i for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if (k := rank_of(a << 32 | b)) is not None]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        while heap:
            rank = heap[0] >> 32
            left, right, made = self.pairs[rank]
            touched = []
            while heap and heap[0] >> 32 == rank:  # all places of a pair, from the left, before new pairs count
                i = heappop(heap) & _AT
                j = after[i]
                if part[i] != left or j == n or part[j] != right:
                    continue  # outdated
                part[i], part[j], after[i] = made, -1, after[j]
                if after[j] < n:
                    before[after[j]] = i
                touched.append(i)
            for i in touched:
                for a in (before[i], i):
                    if a >= 0 and after[a] < n and (k := rank_of(part[a] << 32 | part[after[a]])) is not None:
                        heappush(heap, k << 32 | a)
        return self.ids[[p for p in part if p >= 0]].tolist()

    def of_words(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short words (their bytes joined, and how many each has), joined, and how many each has."""
        symbol, count = merge(raw, size, self.table)
        return self.ids[symbol], count


class Coder:
    """Encodes and decodes texts in one worker process; ids of words already seen are looked up. of_id: the bytes that each id stands for, none for those that decoding leaves out."""

    def __init__(self, merger: Merger, of_id: dict[int, bytes]):
        self.merger, size = merger, max(of_id, default=-1) + 1
        parts = [of_id.get(i, b"") for i in range(size)]
        self.bytes, self.size = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def _learn(self, new: list[bytes]) -> None:
        long = [w for w in new if len(w) > SHORT]
        short = [w for w in new if len(w) <= SHORT]
        ids, count = self.merger.of_words(np.frombuffer(b"".join(short), np.uint8), np.array([len(w) for w in short], np.int64))
        found = [np.array(self.merger.of_word(w), np.int32) for w in long]
        self.number.update(zip(short + long, range(len(self.number), len(self.number) + len(new)), strict=True))
        ends = self.ends[-1] + np.cumsum(np.concatenate([count, [len(i) for i in found]]).astype(np.int64))
        self.ids.frombytes(np.concatenate([ids, *found]).tobytes())
        self.ends.frombytes(ends.tobytes())

    def encode(self, which: np.ndarray, told: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (of the distinct ones told, which each is), joined, and how many each has."""
        if len(self.number) > HELD_WORDS or len(self.ids) > HELD_IDS:
            self._forget()
        own = told.to_numpy(zero_copy_only=False).tolist()
        if new := [w for w in own if w not in self.number]:
            self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))
        ends = np.frombuffer(self.ends, np.int64)
        start, length = ends[number], ends[number + 1] - ends[number]
        return spread(np.frombuffer(self.ids, np.int32), start[which], length[which]), length[which]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, joined, and how many each has."""
        size = self.size[ids]
        return spread(self.bytes, self.at[ids], size), size

    def checked(self, column: pa.Array, cutter: words.Cutter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of each text, whether decoding them gives it) for some texts at a time."""
        for _, raw, bound in words.slices(column):
            starts = cutter.starts(raw, bound)
            ids, length = self.encode(*words.distinct(raw, starts)[:2])
            at = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(starts, bound)]
            back, size = self.decode(ids)
            end = np.concatenate([[0], np.cumsum(size)])[at]
            if np.array_equal(end, bound) and np.array_equal(back, raw):
                same = np.ones(len(bound) - 1, bool)
            else:
                one = lambda x, b, k: x[b[k] : b[k + 1]].tobytes().decode("utf-8", "replace")
                same = np.array([one(back, end, k) == one(raw, bound, k) for k in range(len(bound) - 1)])
            yield np.diff(at), same

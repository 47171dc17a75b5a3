"""Texts as pieces that a tokenizer treats alone, and a table of the ids of pieces already seen.

A byte-level pre-tokenizer cuts before a space that stands before something other than white space: white space gives up its
last space to what follows, and no other word has a space inside. Cutting at some of these places only is right as well, so
the cuts are made on bytes, where the byte after the space cannot begin white space. All pieces of a batch are looked up at
once in an open-addressing table; a piece of up to 15 bytes is its own key, longer ones are keys of a dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Beyond so many pieces, or bytes of long pieces, a table forgets all but the most used ones; results do not depend on it.
MOST_PIECES, MOST_LONG_BYTES = 400_000, 16_000_000
SHORT = 15
_U = np.uint64
# what may follow a space that a piece begins with: no ASCII white space or control, and no lead byte of other white space
SAFE = np.zeros(256, bool)
SAFE[0x21:] = True
SAFE[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def spread(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each pair, joined."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(start - ends + length, length)]


def text_bytes(column: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of a column of texts (null: empty) and where each begins, the end of the last included."""
    if not isinstance(column, pa.Array):
        column = pa.array([None if t is None else t.encode("utf-8", "replace") for t in column], pa.binary()) if len(column) else pa.array([], pa.binary())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def cut(raw: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin."""
    begins = np.zeros(len(raw) + 1, bool)
    begins[bound] = True
    space = np.flatnonzero(raw[:-1] == 32) if len(raw) else np.zeros(0, np.int64)
    space = space[SAFE[raw[space + 1]] & ~begins[space + 1]]
    begins[space] = True
    return np.flatnonzero(begins[:-1])


class PieceTable:
    """The ids of pieces. learn(pieces) tells them: the ids of a list of byte strings, joined, and how many each has."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self._new(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _new(self, ids: np.ndarray, length: np.ndarray) -> None:
        bits = max(12, int(2 * MOST_PIECES).bit_length())
        self.shift, self.slots = _U(64 - bits), (1 << bits) - 1
        self.first, self.second = np.zeros(1 << bits, _U), np.zeros(1 << bits, _U)
        self.number = np.full(1 << bits, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.long_bytes, self.count = 0, len(length)
        self.ids, self.used = ids, len(ids)
        self.length, self.start = length, np.cumsum(length) - length
        self.uses = np.zeros(len(length), np.int64)

    def _slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        h = (first ^ (first >> _U(31))) * _U(0x9E3779B97F4A7C15) + second * _U(0xC2B2AE3D27D4EB4F)
        return (((h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64)

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The numbers of short pieces, -1 where unknown."""
        slot = self._slot(first, second)
        found = self.number[slot]
        wrong = np.flatnonzero((found >= 0) & ((self.first[slot] != first) | (self.second[slot] != second)))
        at = slot[wrong]
        while wrong.size:
            at = (at + 1) & self.slots
            got = self.number[at]
            found[wrong] = got
            more = (got >= 0) & ((self.first[at] != first[wrong]) | (self.second[at] != second[wrong]))
            wrong, at = wrong[more], at[more]
        return found

    def _put(self, first: np.ndarray, second: np.ndarray, number: np.ndarray) -> None:
        """Enter distinct short pieces that the table does not hold."""
        left, at = np.arange(len(first)), self._slot(first, second)
        while left.size:
            free = np.flatnonzero(self.number[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            one = free[one]
            where = at[one]
            self.first[where], self.second[where], self.number[where] = first[left[one]], second[left[one]], number[left[one]]
            rest = np.ones(left.size, bool)
            rest[one] = False
            left, at = left[rest], (at[rest] + 1) & self.slots

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Learn new pieces; their numbers."""
        ids, length = self.learn(pieces)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(ids), self.used, 1 << 16), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.uses = np.concatenate([self.uses, np.zeros(len(length), np.int64)])
        self.used += len(ids)
        self.count += len(pieces)
        return np.arange(self.count - len(pieces), self.count)

    def _shrink(self) -> None:
        """Keep the most used short pieces, as many as half the bound; long ones are learned anew."""
        held = np.flatnonzero(self.number >= 0)
        own = self.number[held]
        best = held[np.argsort(-self.uses[own], kind="stable")[: MOST_PIECES // 2]]
        first, second, own = self.first[best], self.second[best], self.number[best]
        uses = self.uses[own] // 2
        self._new(spread(self.ids, self.start[own], self.length[own]), self.length[own])
        self.uses = uses
        self._put(first, second, np.arange(len(own), dtype=np.int32))

    def numbers(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each piece raw[start : next start]."""
        if self.count > MOST_PIECES or self.long_bytes > MOST_LONG_BYTES:
            self._shrink()
        size = np.diff(starts, append=len(raw))
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        words = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(size <= SHORT)
        n, at = size[short], starts[short]
        first = words[at] & _MASK[np.minimum(n, 8)]
        second = words[at + 8] & _MASK[np.maximum(n - 8, 0)] | n.astype(_U) << _U(56)
        out[short] = found = self._find(first, second).astype(np.int64)
        new = np.flatnonzero(found < 0)
        if new.size:
            order = new[np.lexsort((second[new], first[new]))]
            a, b = first[order], second[order]
            head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            one = order[head]
            data = raw.tobytes()
            number = self._add([data[s : s + k] for s, k in zip(at[one].tolist(), n[one].tolist(), strict=True)])
            self._put(first[one], second[one], number.astype(np.int32))
            out[short[order]] = number[np.cumsum(head) - 1]
        long = np.flatnonzero(size > SHORT)
        if long.size:
            pieces = [raw[s : s + k].tobytes() for s, k in zip(starts[long].tolist(), size[long].tolist(), strict=True)]
            if fresh := [p for p in dict.fromkeys(pieces) if p not in self.long]:
                self.long.update(zip(fresh, self._add(fresh).tolist(), strict=True))
                self.long_bytes += sum(map(len, fresh))
            out[long] = [self.long[p] for p in pieces]
        self.uses += np.bincount(out, minlength=self.count)
        return out

    def encode(self, raw: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, joined, and where those of each begin, the end of the last included."""
        starts = cut(raw, bound)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bound), np.int64)
        number = self.numbers(raw, starts)
        length = self.length[number]
        before = np.concatenate([[0], np.cumsum(length)])
        return spread(self.ids, self.start[number], length), before[np.searchsorted(starts, bound)]

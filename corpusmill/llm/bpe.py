"""Byte-level BPE encoding and decoding with a pair occurrence index.

The new words of a batch are laid out in one linked list of symbols. The index holds, for every adjacent pair with a merge
rank, all its positions, in blocks of ranks. Blocks are taken in ascending order, and inside a block each word's lowest rank
goes first: it is applied to all its positions in the word, and only the index entries of the pairs beside them are looked up
again. Words do not touch, so one step serves all words of the batch at once. Pieces already seen come from a bounded table.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded_batches
from corpusmill.llm.pieces import SAFE, PieceTable, spread, text_bytes

#: Symbols laid out at once; a longer word is laid out alone.
MOST_SYMBOLS = 2_000_000
#: The first rank of each block of the index, and no rank.
_BLOCKS, _NONE = np.array([0, 64, 512, 2048, 8192, 24576]), np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file of byte-level BPE says: ids of bytes, merge ranks, bytes of ids and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        ids, symbols = told["model"]["vocab"], byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = np.array([ids[s] for s in symbols], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in told["model"]["merges"]]
        #: Of each rank: the two ids that it merges, and what they make.
        self.left, self.right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t.get(k) for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens must stand for their plain strings")
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in ids.items() if i not in self.special.values()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile(b"(" + b"|".join(regex.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None


class Ranks:
    """Merge ranks of pairs of ids, looked up for whole arrays at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        key = left << 32 | right
        key, self.ranks = np.unique(key, return_index=True)  # of a pair that is listed twice the first rank counts
        bits = max(4, (4 * len(key)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE)
        left_over, at = np.arange(len(key)), self._slot(key)
        while left_over.size:
            free = np.flatnonzero(self.key[at] < 0)
            one = free[np.unique(at[free], return_index=True)[1]]
            self.key[at[one]], self.rank[at[one]] = key[left_over[one]], self.ranks[left_over[one]]
            rest = np.ones(left_over.size, bool)
            rest[one] = False
            left_over, at = left_over[rest], (at[rest] + 1) & self.last

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NONE where it has none or an id is negative."""
        out = np.full(len(left), _NONE)
        asked = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[asked] << 32 | right[asked]
        at = self._slot(key)
        while asked.size:
            held = self.key[at]
            hit = held == key
            out[asked[hit]] = self.rank[at[hit]]
            on = ~hit & (held >= 0)
            asked, key, at = asked[on], key[on], (at[on] + 1) & self.last
        return out


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted and each once."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class PairIndexBPE:
    """Encodes batches of texts; one for each worker process."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        size = max(vocabulary.bytes_of, default=-1) + 1
        parts = [vocabulary.bytes_of.get(i, b"") for i in range(size)]
        self._bytes = np.frombuffer(b"".join(parts), np.uint8)
        self._length = np.array([len(p) for p in parts], np.int64)
        self._offset = np.concatenate([[0], np.cumsum(self._length)])
        self._ranks = Ranks(vocabulary.left, vocabulary.right)
        every = np.arange(256)
        self._byte_pair = self._ranks.of(np.repeat(vocabulary.byte_ids, 256), np.tile(vocabulary.byte_ids, 256))[every[:, None] * 256 + every].ravel()
        self._table = PieceTable(self._learn)

    def merge(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, joined, and how many each has. raw: the bytes of all words; size: how many of them each has."""
        end_of = np.cumsum(size)
        n = len(raw)
        word = np.repeat(np.arange(len(size)), size)
        symbol = self.v.byte_ids[raw]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        # the last of a word has no successor and the first no predecessor; position n stands for none
        after[end_of[size > 0] - 1] = n
        before[(end_of - size)[size > 0]] = n
        after, before, symbol = np.append(after, n), np.append(before, n), np.append(symbol, -1)
        rank = np.full(n + 1, _NONE)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self._byte_pair[raw[inner].astype(np.int64) * 256 + raw[inner + 1]]
        index: list[list[np.ndarray]] = [[] for _ in _BLOCKS]

        def enter(at: np.ndarray, first: int) -> None:
            """Put positions into the blocks of their ranks, none before the first."""
            block = np.searchsorted(_BLOCKS, rank[at], side="right") - 1
            for b in range(first, len(_BLOCKS)):
                if (own := at[block == b]).size:
                    index[b].append(own)

        enter(inner[rank[inner] < _NONE], 0)
        for b, end in enumerate([*_BLOCKS[1:].tolist(), int(_NONE)]):
            if not index[b]:
                continue
            at = _distinct(np.concatenate(index[b]))
            at = at[rank[at] < end]
            while at.size:
                own, mine = word[at], rank[at]
                head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                least = np.repeat(np.minimum.reduceat(mine, head), np.diff(head, append=len(at)))
                chosen = at[mine == least]
                # of occurrences that overlap (aaa), every second one from the left
                joined = np.concatenate([[False], after[chosen[:-1]] == chosen[1:]])
                joined[1:] &= rank[chosen[1:]] == rank[chosen[:-1]]
                place = np.arange(len(chosen))
                run = np.maximum.accumulate(np.where(joined, 0, place))
                chosen = chosen[(place - run) % 2 == 0]
                second = after[chosen]
                follows = after[second]
                symbol[chosen] = self.v.made[rank[chosen]]
                symbol[second], rank[second] = -1, _NONE
                after[chosen], before[follows] = follows, chosen
                before[n], symbol[n] = n, -1
                beside = before[chosen]
                touched = _distinct(np.concatenate([chosen, beside[beside < n]]))
                rank[touched] = self._ranks.of(symbol[touched], symbol[after[touched]])
                later = touched[(rank[touched] >= end) & (rank[touched] < _NONE)]
                if later.size:
                    enter(later, b + 1)
                at = _distinct(np.concatenate([at, touched[rank[touched] < end]]))
                at = at[rank[at] < end]
        kept = symbol[:n] >= 0
        return symbol[:n][kept].astype(np.uint32), np.bincount(word[kept], minlength=len(size))

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, joined, and how many each has. Where a piece begins as those that cut() makes, it is cut apart again in a row, so one search finds the words of many."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw, ends = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(length)
        begin = ends - length
        spaced = (length > 1) & (raw[begin] == 32)
        spaced[spaced] = SAFE[raw[begin[spaced] + 1]]
        sizes = [np.zeros(0, np.int64)]
        bound = [*begin[np.flatnonzero(~spaced)].tolist(), len(raw)]
        if bound[0] > 0:
            bound.insert(0, 0)
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            own = raw[a:b]
            data = own.tobytes()
            found = self.v.words.findall(data.decode("utf-8", "replace"))
            size = np.fromiter(map(len, found), np.int64, len(found))
            if not data.isascii():  # from characters to bytes
                lead = np.append(np.flatnonzero((own & 0xC0) != 0x80), b - a)
                size = np.diff(lead[np.cumsum(size)], prepend=0)
            sizes.append(size)
        size = np.concatenate(sizes)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids, count, low = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while low < len(size):
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + MOST_SYMBOLS, side="right")) - 1)
            got, each = self.merge(raw[upto[low] : upto[high]], size[low:high])
            ids.append(got), count.append(each)
            low = high
        each = np.concatenate([[0], np.cumsum(np.concatenate(count))])
        return np.concatenate(ids), np.diff(each[np.searchsorted(upto, ends)], prepend=0)

    def encode_bytes(self, raw: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (their UTF-8 joined, and where each begins), joined, and where those of each begin."""
        if self.v.cut is None or not any(raw.tobytes().find(s.encode()) >= 0 for s in self.v.special):
            return self._table.encode(raw, bound)
        # special tokens: what lies between them is text of its own
        parts, tokens = [], []
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            own = self.v.cut.split(raw[a:b].tobytes())
            parts += own[::2]
            tokens.append([self.v.special[t.decode()] for t in own[1::2]])
        ids, at = self._table.encode(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        out, k = [], 0
        for own in tokens:
            whole = [ids[at[k] : at[k + 1]]]
            for t in own:
                k += 1
                whole += [np.array([t], np.uint32), ids[at[k] : at[k + 1]]]
            k += 1
            out.append(np.concatenate(whole))
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int64)

    def encode(self, texts: list | pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text; a null is empty."""
        ids, at = self.encode_bytes(*text_bytes(texts))
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of ids, undecodable bytes replaced; unknown ids are left out."""
        known = ids[ids < len(self._length)].astype(np.int64)
        raw = spread(self._bytes, self._offset[known], self._length[known]).tobytes()
        return raw.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexBPE:
    """The encoder of this process; tasks that a worker runs one after another share its cache."""
    return PairIndexBPE(Vocabulary(path))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded (text) of every row. A null text counts as empty; repeated rows stay repeated."""
    return _mapped(docs, path, "ids array<int>, decoded string", lambda ids, text: (pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([t.decode() for t in text], pa.string())), ["ids", "decoded"])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, without moving ids or texts."""

    def of(ids, text):
        return pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]), pa.array([hashlib.sha256(t).hexdigest() for t in text])

    return _mapped(docs, path, "ids_sha256 string, decoded_sha256 string", of, ["ids_sha256", "decoded_sha256"])


def _mapped(docs: DataFrame, path: str | None, schema: str, of, names: list[str]) -> DataFrame:
    bounded_batches(docs.sparkSession)
    file = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(file)
        for batch in batches:
            ids = bpe.encode(batch.column(1))
            text = [bpe.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) for i in ids], pa.int64()), *of(ids, text)], names=["doc_id", "n_tokens", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {schema}")

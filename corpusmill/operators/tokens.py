"""Byte-level BPE training and encoding, token shards, windows and splits."""

from __future__ import annotations

import heapq
import json
import os
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import bpe_training, encoding
from corpusmill.operators import words as cutting
from corpusmill.sources import shared

#: Contractions, words and punctuation with an optional space before, white space.
PRETOKENS = r"(?U)'(?:s|t|re|ve|m|ll|d)| ?\w+| ?[^\s\w]+|\s+(?!\S)|\s+"
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PRETOKENS), F.lit(0))


def word_frequencies(docs: DataFrame, least: int = 1) -> DataFrame:
    """(word, freq, first): partial and final hash aggregation over all texts; first orders words by their first place."""
    words = docs.select("doc_id", F.posexplode(pretokens(F.col("text"))).alias("pos", "word"))
    return words.groupBy("word").agg(F.count("*").alias("freq"), F.min(F.struct("doc_id", "pos")).alias("first")).filter(F.col("freq") >= least)


def pair_frequencies(words: DataFrame) -> DataFrame:
    """(left, right, freq) of adjacent byte symbols, weighted by the words' frequencies."""
    table = F.array(*(F.lit(c) for c in symbols()))
    coded = words.withColumn("_hex", F.hex(F.encode("word", "UTF-8"))).withColumn("_n", (F.length("_hex") / 2).cast("int")).filter(F.col("_n") > 1)
    byte = lambda i: F.element_at(table, F.conv(F.substring(F.col("_hex"), 2 * i - 1, F.lit(2)), 16, 10).cast("int") + 1)
    parts = coded.select("freq", "_n", F.transform(F.sequence(F.lit(1), F.col("_n")), byte).alias("c"))
    pairs = F.transform(F.sequence(F.lit(1), F.col("_n") - 1), lambda i: F.struct(F.element_at(F.col("c"), i).alias("left"), F.element_at(F.col("c"), i + 1).alias("right")))
    return parts.select("freq", F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.sum("freq").alias("freq"))


def symbols() -> list[str]:
    """One printable character for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


#: The coder that a worker process used last; its next task of the same query finds the words known.
_last_coder: tuple[str, encoding.Coder] | None = None


class BPE:
    """Vocabulary and merges of a byte-level tokenizer."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], specials: tuple[str, ...] = SPECIALS):
        self.vocab, self.merges, self.specials = vocab, merges, specials
        self.ranks = {m: i for i, m in enumerate(merges)}
        self._symbol = symbols()
        self._byte = {s: b for b, s in enumerate(self._symbol)}
        self._back = {i: t for t, i in vocab.items()}
        self._seen: dict[str, list[int]] = {}
        self._placed: dict[str, tuple[list[int], list[int]]] = {}
        self._merger: encoding.Merger | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}, "_placed": {}, "_merger": None}

    @classmethod
    def of_bytes(cls, specials: tuple[str, ...] = SPECIALS) -> BPE:
        """Without merges: each byte is a token, its id the byte after the specials."""
        return cls({t: i for i, t in enumerate([*specials, *symbols()])}, [], specials)

    @classmethod
    def train(cls, docs: DataFrame, vocab_size: int, min_frequency: int = 2, specials: tuple[str, ...] = SPECIALS) -> BPE:
        """Counts words on the cluster; the merge loop runs on the driver over distinct words, with pair counts kept up to date. Ties go to the pair seen first."""
        rows = word_frequencies(docs, min_frequency).orderBy("first").select("word", "freq").collect()
        table = symbols()
        words = [[table[b] for b in r.word.encode()] for r in rows]
        freqs = [r.freq for r in rows]
        vocab = {t: i for i, t in enumerate([*specials, *table])}
        counts: dict[tuple[str, str], int] = defaultdict(int)
        where: dict[tuple[str, str], set[int]] = defaultdict(set)
        born: dict[tuple[str, str], int] = {}
        for w, parts in enumerate(words):
            for pair in zip(parts, parts[1:], strict=False):
                counts[pair] += freqs[w]
                where[pair].add(w)
                born.setdefault(pair, len(born))
        heap = [(-n, born[p], p) for p, n in counts.items()]
        heapq.heapify(heap)
        merges = []
        while heap and len(vocab) < vocab_size:
            n, _, pair = heapq.heappop(heap)
            if -n != counts.get(pair):
                continue  # an outdated entry
            if -n < min_frequency:
                break
            made = pair[0] + pair[1]
            merges.append(pair)
            vocab.setdefault(made, len(vocab))
            changed = set()
            for w in sorted(where.pop(pair)):
                old = words[w]
                for p in zip(old, old[1:], strict=False):
                    counts[p] -= freqs[w]
                    changed.add(p)
                    if p in where:
                        where[p].discard(w)
                words[w] = new = bpe_training.merged(old, pair, made)
                for p in zip(new, new[1:], strict=False):
                    counts[p] += freqs[w]
                    where[p].add(w)
                    born.setdefault(p, len(born))
                    changed.add(p)
            counts.pop(pair, None)
            for p in changed - {pair}:
                if counts.get(p, 0) > 0:
                    heapq.heappush(heap, (-counts[p], born[p], p))
        return cls(vocab, merges, specials)

    @classmethod
    def train_in_rounds(cls, docs: DataFrame, vocab_size: int, min_frequency: int = 2, specials: tuple[str, ...] = SPECIALS, runs: int = bpe_training.RUNS, candidates: int = bpe_training.CANDIDATES) -> BPE:
        """The same as train(), for words that no driver holds: words and pair counts stay on the cluster, and a round brings at most `runs` runs of symbols and `candidates` pairs to the driver (see bpe_training)."""
        table = symbols()
        trainer = bpe_training.Trainer(table, {t: i for i, t in enumerate([*specials, *table])}, vocab_size, min_frequency)
        trainer.train(cutting.frequencies(docs, min_frequency), runs, candidates)
        return cls(trainer.vocab, trainer.merges, specials)

    def _word(self, word: str) -> list[int]:
        if word not in self._seen:
            if len(self._seen) > 100_000:
                self._seen.clear()
            self._seen[word] = self.merger.of_word(word.encode("utf-8", "replace"))
        return self._seen[word]

    @property
    def merger(self) -> encoding.Merger:
        if self._merger is None:
            self._merger = encoding.Merger(self.vocab, self.ranks, self._symbol, self.vocab.get("<unk>", 0))
        return self._merger

    def coder(self) -> encoding.Coder:
        return encoding.Coder(self.merger, {i: b"" if t in self.specials else bytes(self._byte[c] for c in t) for i, t in self._back.items()})

    def _placed_word(self, word: str) -> tuple[list[int], list[int]]:
        """ids of a word and the character, counted from its own start, that holds the first byte of each."""
        if word not in self._placed:
            if len(self._placed) > 100_000:
                self._placed.clear()
            ids = self._word(word)
            char = np.repeat(np.arange(len(word)), [len(c.encode("utf-8", "replace")) for c in word]) if word else np.zeros(0, int)
            size = [len(self._back[i]) for i in ids]  # a symbol is a byte
            self._placed[word] = ids, char[np.cumsum(size) - size].tolist()
        return self._placed[word]

    def encode_words(self, words) -> list[int]:
        return [i for w in words for i in self._word(w)]

    def decode(self, ids, skip_special: bool = True) -> str:
        parts = [self._back.get(int(i), "") for i in ids]
        raw = b"".join(b"" if p in self.specials and skip_special else p.encode() if p in self.specials else bytes(self._byte[c] for c in p) for p in parts)
        return raw.decode("utf-8", "replace")

    def _of_bytes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids of a text where nothing merges, and the character to which each byte belongs."""
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        table = np.array([self.vocab.get(s, self.vocab.get("<unk>", 0)) for s in self._symbol], np.int32)
        return table[raw], (np.cumsum((raw & 0xC0) != 0x80) - 1).astype(np.int32)

    def encode(self, text: Column, bos: bool = False, eos: bool = False) -> Column:
        """ids of a text column: words are cut in the JVM, merges run in Arrow batches. Without merges a text need not be cut."""
        own = self
        if not self.merges:
            first, last = (np.array([self.vocab[s]] if on else [], np.int32) for s, on in (("<bos>", bos), ("<eos>", eos)))

            @F.pandas_udf("array<int>")
            def plain(texts: pd.Series) -> pd.Series:
                return texts.map(lambda x: np.concatenate([first, own._of_bytes(x)[0], last]))

            return plain(F.coalesce(text, F.lit("")))

        @F.pandas_udf("array<int>")
        def ids(words: pd.Series) -> pd.Series:
            return words.map(lambda w: [*([own.vocab["<bos>"]] if bos else []), *own.encode_words(w), *([own.vocab["<eos>"]] if eos else [])])

        return ids(pretokens(text))

    def count(self, text: Column) -> Column:
        """The number of ids of a text column, which stay where they are made. Without merges it is that of the bytes."""
        own = self
        if not self.merges:
            return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")

        @F.pandas_udf("long")
        def n(words: pd.Series) -> pd.Series:
            return words.map(lambda w: sum(len(own._word(x)) for x in w))

        return n(pretokens(text))

    def encode_placed(self, text: Column) -> Column:
        """(ids, starts) of a text column: starts are the places, in characters, where tokens begin (that of the character, if it is cut)."""
        own = self
        if not self.merges:

            @F.pandas_udf("ids array<int>, starts array<int>")
            def plain(texts: pd.Series) -> pd.DataFrame:
                return pd.DataFrame([own._of_bytes(x) for x in texts], columns=["ids", "starts"])

            return plain(F.coalesce(text, F.lit("")))

        @F.pandas_udf("ids array<int>, starts array<int>")
        def placed(words: pd.Series) -> pd.DataFrame:
            ids, starts = [], []
            for row in words:
                at, i, s = 0, [], []
                for w in row:
                    own_ids, own_starts = own._placed_word(w)
                    i += own_ids
                    s += [at + x for x in own_starts]
                    at += len(w)
                ids.append(i)
                starts.append(s)
            return pd.DataFrame({"ids": ids, "starts": starts})

        return placed(pretokens(text))

    def decode_column(self, ids: Column) -> Column:
        own = self

        @F.pandas_udf("string")
        def texts(rows: pd.Series) -> pd.Series:
            return rows.map(own.decode)

        return texts(ids)

    def round_trips(self, docs: DataFrame) -> DataFrame:
        """doc_id, n (ids of the text and the end token) and whether decoding the ids gives the text (null for a null). Texts are cut, encoded and decoded in one pass, a batch at a time."""
        own, key, cutter = self, uuid.uuid4().hex, cutting.Cutter.of(docs.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            global _last_coder
            if _last_coder is None or _last_coder[0] != key:
                _last_coder = key, own.coder()
            for batch in batches:
                told = [*_last_coder[1].checked(batch.column("text"), cutter)] or [(np.zeros(0, int), np.zeros(0, bool))]
                n, same = (np.concatenate(x) for x in zip(*told, strict=True))
                same = pa.array(same & batch.column("valid").to_numpy(zero_copy_only=False), mask=batch.column("text").is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n + 1, pa.int32()), same], names=["doc_id", "n", "round_trip"])

        text = F.col("text")
        schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.IntegerType()), T.StructField("round_trip", T.BooleanType())])
        return docs.select("doc_id", cutting.valid(text).alias("text"), F.coalesce(F.is_valid_utf8(text), F.lit(False)).alias("valid")).mapInArrow(run, schema)

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/vocab.json", "w", encoding="utf-8") as f:
            json.dump(self.vocab, f, ensure_ascii=False)
        with open(f"{folder}/merges.txt", "w", encoding="utf-8") as f:
            f.write("#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in self.merges))
        with open(f"{folder}/tokenizer_config.json", "w", encoding="utf-8") as f:
            json.dump({"vocab_size": len(self.vocab), "special_tokens": list(self.specials)}, f)

    @classmethod
    def load(cls, folder: str) -> BPE:
        with open(f"{folder}/vocab.json", encoding="utf-8") as f:
            vocab = json.load(f)
        with open(f"{folder}/merges.txt", encoding="utf-8") as f:
            merges = [tuple(line.rstrip("\n").split(" ")) for line in f if not line.startswith("#version")]
        with open(f"{folder}/tokenizer_config.json", encoding="utf-8") as f:
            return cls(vocab, merges, tuple(json.load(f)["special_tokens"]))


def pad(ids: Column, size: Column, value: int = 0) -> tuple[Column, Column]:
    """(ids of exactly a size, attention mask)."""
    n = F.least(F.size(ids), size)
    return F.concat(F.slice(ids, F.lit(1), n), F.array_repeat(F.lit(value), size - n)), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), size - n))


def encode_batch(df: DataFrame, bpe: BPE, by: str, text: str = "text", most: int | None = None, padding: bool = True) -> DataFrame:
    """Adds input_ids and attention_mask of the texts: cut at `most`, and padded to the longest of their batch (a column)."""
    ids = bpe.encode(F.col(text))
    out = df.withColumn("input_ids", F.slice(ids, F.lit(1), F.lit(most)) if most else ids)
    if not padding:
        return out
    out = out.withColumn("_width", F.max(F.size("input_ids")).over(Window.partitionBy(by)))
    padded, mask = pad(F.col("input_ids"), F.col("_width"), bpe.vocab.get("<pad>", 0))
    return out.withColumns({"input_ids": padded, "attention_mask": mask}).drop("_width")


def clip(ids: Column, most: int = 65535) -> Column:
    return F.transform(ids, lambda i: F.least(i, F.lit(most)))


class _Closing:
    """What a run of documents makes of the tokens that are held when it begins: the tokens held at its end, and the shards closed.

    Only the first document at which a shard closes depends on what was held. `at` are the totals up to each document that may be it (ascending, the
    last one being the first to reach the limit), `held` and `closed` what follows from each; `total` is all tokens. So there are no more steps than
    documents in the first shard, however long the run.
    """

    def __init__(self, at: np.ndarray, held: np.ndarray, closed: np.ndarray, total: int, limit: int):
        few = np.searchsorted(at, limit) + 1
        at, held, closed = at[:few], held[:few], closed[:few]
        last = np.ones(len(at), bool)  # of steps with one outcome the last one says it all
        last[:-1] = (held[1:] != held[:-1]) | (closed[1:] != closed[:-1])
        self.at, self.held, self.closed, self.total, self.limit = at[last], held[last], closed[last], total, limit

    @classmethod
    def of(cls, sizes: np.ndarray, limit: int) -> _Closing:
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        count = len(sizes)
        # where the next shard closes, if one closed at a place; beyond the last such place nothing closes
        follow = np.searchsorted(upto, upto + limit)
        end = np.arange(count + 1)
        closed = np.zeros(count + 1, np.int64)
        jump, hops = np.where(follow <= count, follow, end), (follow <= count).astype(np.int64)
        while True:
            end, closed = jump, hops
            jump, hops = end[end], closed + closed[end]
            if (jump == end).all():
                break
        return cls(upto[1:], (upto[count] - upto[end])[1:], closed[1:] + 1, int(upto[count]), limit)

    def __call__(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(held at the end, shards closed) for numbers of tokens held before."""
        held = np.asarray(held, np.int64)
        if not len(self.at):
            return held + self.total, np.zeros_like(held)
        which = np.minimum(np.searchsorted(self.at, self.limit - held), len(self.at) - 1)
        none = held + self.total < self.limit
        return np.where(none, held + self.total, self.held[which]), np.where(none, 0, self.closed[which])

    def then(self, other: _Closing) -> _Closing:
        held, closed = other(self.held)
        return _Closing(np.concatenate([self.at, self.total + other.at]), np.concatenate([held, other.held]), np.concatenate([self.closed + closed, other.closed]), self.total + other.total, self.limit)


#: So many neighbouring runs are joined at once, and a task holds about so many sizes.
_FAN, _RUN_ROWS = 16, 1_000_000
_CLOSING = "node long, at array<long>, held array<long>, closed array<long>, total long"


def assign_shards(lengths: DataFrame, limit: int, key: str = "doc_id", n: str = "n") -> DataFrame:
    """(key, n, shard_id) in key order: a shard closes after the document that reaches the limit. A null size counts as 0; texts take no part.

    A scan over functions: each range of documents becomes the function from the tokens held on entry to those held on exit and the shards closed;
    neighbouring ones are composed in a tree, what enters each is handed down again, and then all ranges are cut at once.
    """
    if limit < 1:
        raise ValueError("the limit is at least one token")
    spark = lengths.sparkSession
    rows = lengths.select(key, n).checkpoint()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // _RUN_ROWS))
    ordered = rows.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("_node", F.spark_partition_id().cast("long")).checkpoint()

    def row(node: int, f: _Closing) -> pd.DataFrame:
        return pd.DataFrame([(node, f.at, f.held, f.closed, f.total)], columns=["node", "at", "held", "closed", "total"])

    def function(r) -> _Closing:
        return _Closing(np.asarray(r.at, np.int64), np.asarray(r.held, np.int64), np.asarray(r.closed, np.int64), int(r.total), limit)

    def summed(frames):
        node, sizes = None, []
        for frame in frames:
            if len(frame):
                node = int(frame["_node"].iloc[0])
                sizes.append(frame[n].fillna(0).to_numpy(np.int64))
        if sizes:
            yield row(node, _Closing.of(np.concatenate(sizes), limit))

    def joined(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for r in frame.sort_values("node").itertuples():
            whole = function(r) if whole is None else whole.then(function(r))
        return row(int(group[0]), whole)

    def handed(_: tuple, frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        held, shard, out = int(entry["held"].iloc[0]), int(entry["shard"].iloc[0]), []
        for r in frame.sort_values("node").itertuples():
            out.append((r.node, held, shard))
            after, closed = function(r)(np.array([held]))
            held, shard = int(after[0]), shard + int(closed[0])
        return pd.DataFrame(out, columns=["node", "held", "shard"])

    up = F.floor(F.col("node") / _FAN).cast("long")
    levels = [ordered.select("_node", n).mapInPandas(summed, _CLOSING).checkpoint()]
    width = ranges
    while width > 1:
        levels.append(levels[-1].groupBy(up.alias("up")).applyInPandas(joined, _CLOSING).checkpoint())
        width = -(-width // _FAN)
    entries = spark.createDataFrame([(0, 0, 0)], "node long, held long, shard long")
    for level in levels[-2::-1]:
        entries = level.groupBy(up.alias("up")).cogroup(entries.groupBy(F.col("node").alias("up"))).applyInPandas(handed, "node long, held long, shard long").checkpoint()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lengths.select(key, n).schema) + ", shard_id int"

    def cut(frames):
        held = shard = None
        for frame in frames:
            if not len(frame):
                continue
            if held is None:
                held, shard = int(frame["_held"].iloc[0]), int(frame["_shard"].iloc[0])
            upto = np.cumsum(frame[n].fillna(0).to_numpy(np.int64))
            out, at, before = np.zeros(len(frame), np.int32), 0, -held
            while at < len(frame):  # one step a shard
                end = min(int(np.searchsorted(upto, before + limit)) + 1, len(frame))
                out[at:end] = shard
                at, held = end, int(upto[end - 1]) - before
                if held >= limit:
                    before, held, shard = int(upto[end - 1]), 0, shard + 1
            yield frame[[key, n]].assign(shard_id=out)

    # one short row a range
    entered = entries.select(F.col("node").alias("_node"), F.col("held").alias("_held"), F.col("shard").alias("_shard"))
    return ordered.join(F.broadcast(entered), "_node").select(key, n, "_held", "_shard").mapInPandas(cut, schema)


def token_windows(ids: Column, size: int) -> Column:
    """Windows (input, label) of a token array: labels are inputs shifted by one; (len - 1) // size of them."""
    count = F.floor((F.size(ids) - 1) / size).cast("int")
    one = lambda k: F.struct(F.slice(ids, k * size + 1, F.lit(size)).alias("input_ids"), F.slice(ids, k * size + 2, F.lit(size)).alias("labels"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array())


def split_shards(shards: DataFrame, seed: int = 42, key: str = "shard_id") -> DataFrame:
    """Adds split: max(1, 0.1 %) test, max(1, 0.5 %) validation, the rest train, in a seeded hash order. One row a shard."""
    n = shards.select(key).distinct().count()
    test, val = max(1, int(n * 0.001)), max(1, int(n * 0.005))
    place = F.row_number().over(Window.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))
    split = shards.select(key).distinct().withColumn("_r", place).withColumn("split", F.when(F.col("_r") <= test, "test").when(F.col("_r") <= test + val, "val").otherwise("train")).drop("_r")
    return shards.join(F.broadcast(split), key)


def estimate_tokens(docs: DataFrame, count: Column, sample: int = 100) -> DataFrame:
    """avg_tokens of the first `sample` texts by id, docs, estimate."""
    head = docs.orderBy("doc_id").limit(sample).agg(F.avg(count).alias("avg_tokens"))
    return head.crossJoin(docs.agg(F.count("*").alias("docs"))).withColumn("estimate", (F.col("avg_tokens") * F.col("docs")).cast("long"))  # one row each


def to_bytes(ids: list[int]) -> bytes:
    return np.minimum(np.asarray(ids), 65535).astype("<u2").tobytes()


def write_bins(shards: DataFrame, folder: str, split: str = "train", ids: str | Column = "ids", order: str = "doc_id") -> DataFrame:
    """One flat little-endian uint16 file a shard, <split>_<shard>.bin, in a folder (or URI) that all executors see; returns (shard_id, path, tokens). A shard is one sorted run of rows, written as it comes. ids may be a column made of others, such as BPE.encode of a text: rows are dealt with these, which are shorter, and encoded where they are written."""

    def write(it):
        shard, file, tokens = None, None, 0

        def close():
            file.close()
            return pd.DataFrame({"shard_id": [shard], "path": [file.path], "tokens": [tokens]})

        for frame in it:
            for s, v in zip(frame["shard_id"], frame["_ids"], strict=True):
                if s != shard:
                    if file:
                        yield close()
                    shard, file, tokens = int(s), shared.Replacement(f"{folder}/{split}_{s:05d}.bin"), 0
                file.write(to_bytes(v))
                tokens += len(v)
        if file:
            yield close()

    shared.make_folder(folder)
    dealt = shards.select("shard_id", order, ids) if isinstance(ids, str) else shards
    dealt = dealt.repartition("shard_id").sortWithinPartitions("shard_id", order)
    return dealt.select("shard_id", (F.col(ids) if isinstance(ids, str) else ids).alias("_ids")).mapInPandas(write, "shard_id int, path string, tokens long")


def read_bins(spark, folder: str, split: str = "train") -> DataFrame:
    """(path, ids) of the token files, each whole."""

    @F.pandas_udf("array<int>")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: np.frombuffer(b, "<u2").astype(np.int32))

    return spark.read.format("binaryFile").load(f"{folder}/{split}_*.bin").select("path", decode("content").alias("ids"))


def file_windows(spark, folder: str, size: int, split: str = "train", batch: int = 1024) -> DataFrame:
    """(window, input_ids, labels) of the token files of a split as one stream, in the order of their names: windows of a size, labels shifted by one; (tokens - 1) // size of them.

    An index of where each file begins in the stream tells which byte ranges a window needs, so windows run on over the borders of files and a task reads only its own.
    No file of the split is an error; fewer than two tokens give no window.
    """
    found = [(path, n // 2) for path, n in shared.listed(folder, ".bin") if path.rpartition("/")[2].startswith(f"{split}_")]
    if not found:
        raise FileNotFoundError(f"no {split} token files in {folder}")
    begins = np.concatenate([[0], np.cumsum([n for _, n in found])])
    count = max(0, (int(begins[-1]) - 1) // size)

    def read(it):
        store, _ = shared.opened(folder)
        for frame in it:
            for first in frame["id"] * batch:
                last = min(first + batch, count)
                low, high = first * size, last * size + 1
                parts = []
                for k in range(int(np.searchsorted(begins, low, "right")) - 1, len(found)):
                    a, b = max(low, int(begins[k])), min(high, int(begins[k + 1]))
                    if begins[k] >= high:
                        break
                    if a < b:
                        with store.open_input_file(found[k][0]) as f:
                            parts.append(np.frombuffer(f.read_at(2 * (b - a), 2 * (a - int(begins[k]))), "<u2"))
                ids = np.concatenate(parts).astype(np.int32)
                inputs, labels = (ids[o : o + (last - first) * size].reshape(-1, size) for o in (0, 1))
                yield pd.DataFrame({"window": np.arange(first, last), "input_ids": list(inputs), "labels": list(labels)})

    tasks = -(-count // batch)
    return spark.range(0, tasks, 1, max(1, min(tasks, 10_000))).mapInPandas(read, "window long, input_ids array<int>, labels array<int>")

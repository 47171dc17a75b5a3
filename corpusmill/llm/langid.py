"""Language identification by prediction by partial matching (PPM).

For each language a variable-order tree of byte contexts (orders 0 to 3) is counted on a bounded labelled sample. A byte
seen after its context costs log2((N + t) / n) bits, N being the context's count and t its distinct successors (escape
method C). Otherwise it costs the escape and then what the next shorter context says, with the symbols of the longer
context excluded. All statistics are frozen, so for every byte n-gram of any language the exact code length under every
language is tabulated once and scoring a text is a table look-up per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded_batches

ORDER = 3
PAD = b"\0" * ORDER
#: Bounds of the training sample: rows of one language, and bytes of one language. Whole rows are taken while the sum stays below, and none of more than an eighth of it.
ROWS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 512, 1_500_000
#: The typical word of a text in a learned language costs at most so many times the bits a byte that all but one in a thousand of the labelled rows not learned from do.
SLACK = 2.25
#: With fewer such rows, the bits a byte beyond which a text is in no language: more than the 8 of random bytes.
LEAST_HELD, NO_LANGUAGE = 100, 10.0
_SLICE = 1 << 18
_LETTER = regex.compile(r"\p{L}")


class _Grams:
    """An open-addressing table from packed n-grams to row numbers, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        self.keys, self.rows, self.probes = np.zeros(1 << bits, np.uint32), np.full(1 << bits, -1, np.int32), 0
        left = np.arange(len(keys), dtype=np.int32)
        while left.size:
            slot = self._slot(keys[left], self.probes)
            free = self.rows[slot] < 0
            first = np.zeros(left.size, bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.rows[slot[put]] = keys[left[put]], left[put]
            left = left[~put]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys * np.uint32(2654435761)) >> self.shift) + np.uint32(probe)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys, 0)
        found = self.rows[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        found[wrong] = -1
        for probe in range(1, self.probes):
            if not wrong.size:
                break
            slot = self._slot(keys[wrong], probe)
            rows, same = self.rows[slot], self.keys[slot] == keys[wrong]
            hit = (rows >= 0) & same
            found[wrong[hit]] = rows[hit]
            wrong = wrong[(rows >= 0) & ~same]
        return found


def _packed(a: np.ndarray) -> list[np.ndarray]:
    """For n = 1 to ORDER + 1 the n-gram that ends at each byte from the ORDER-th on."""
    wide, out = a.astype(np.uint32), []
    key = np.zeros(len(a) - ORDER, np.uint32)
    for n in range(ORDER + 1):
        key = key | (wide[ORDER - n : len(a) - n] << np.uint32(8 * n))
        out.append(key)
    return out


class PPM:
    """Frozen statistics of several languages. languages are in sorted order."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        counts = [self._counts(texts[name]) for name in self.languages]
        width = len(self.languages)
        self.keys = [np.unique(np.concatenate([np.zeros(0, np.uint32), *(c[n][0] for c in counts)])) for n in range(ORDER + 1)]
        for n in range(ORDER - 1, -1, -1):  # a context is a key itself, also one of padding, which no text's byte ends
            self.keys[n] = np.unique(np.concatenate([self.keys[n], self.keys[n + 1] >> np.uint32(8)]))
        self.bits = [np.zeros((len(k) + 1, width), np.float32) for k in self.keys]
        #: escape[n][row]: what leaving a context of n bytes costs; its last row stands for an unseen context.
        self.escape = [np.zeros((1 if n == 0 else len(self.keys[n - 1]) + 1, width), np.float32) for n in range(ORDER + 1)]
        for j, count in enumerate(counts):
            below = np.full(256, 1 / 256)
            for n in range(ORDER + 1):
                keys = self.keys[n]
                seen = np.zeros(len(keys))
                seen[np.searchsorted(keys, count[n][0])] = count[n][1]
                if n == 0:
                    context, contexts, lower = np.zeros(len(keys), int), 1, below[keys]
                else:
                    context, contexts = np.searchsorted(self.keys[n - 1], keys >> np.uint32(8)), len(self.keys[n - 1])
                    lower = below[np.searchsorted(self.keys[n - 1], keys & np.uint32((1 << 8 * n) - 1))]
                total, kinds = np.bincount(context, seen, contexts), np.bincount(context, seen > 0, contexts)
                covered = np.bincount(context, np.where(seen > 0, lower, 0), contexts)
                scale = np.where(total > 0, kinds / np.maximum(total + kinds, 1) / np.maximum(1 - covered, 1e-9), 1.0)
                here = np.where(seen > 0, seen / np.maximum(total + kinds, 1)[context], scale[context] * lower)
                self.escape[n][:contexts, j] = -np.log2(scale)
                self.bits[n][: len(keys), j] = -np.log2(here)
                below = here
        #: Bits a byte of a typical word beyond which a text is in none of the languages.
        self.most_bits = NO_LANGUAGE
        self._tables: list[_Grams] | None = None

    @staticmethod
    def _counts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        joined = np.frombuffer(PAD + PAD.join(t + b"" for t in texts), np.uint8)
        ends = np.cumsum([len(t) + ORDER for t in texts], dtype=np.int64) - ORDER
        keep = np.zeros(max(0, len(joined) - ORDER), bool)
        for end, text in zip(ends, texts, strict=True):
            keep[end - len(text) : end] = True
        return [np.unique(k[keep], return_counts=True) for k in _packed(joined)] if len(joined) > ORDER else [(np.zeros(0, np.uint32), np.zeros(0, int))] * (ORDER + 1)

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def code_lengths(self, a: np.ndarray) -> np.ndarray:
        """Bits of each byte after the first ORDER ones, one column a language."""
        if self._tables is None:
            self._tables = [_Grams(k) for k in self.keys]
        packed = _packed(a)
        row = self._tables[ORDER].find(packed[ORDER])
        out = self.bits[ORDER][row]
        left = np.flatnonzero(row < 0)
        for n in range(ORDER, 0, -1):
            if not left.size:
                return out
            out[left] += self.escape[n][self._tables[n - 1].find(packed[n][left] >> np.uint32(8))]
            row = self._tables[n - 1].find(packed[n - 1][left])
            out[left] += self.bits[n - 1][row]
            left = left[row < 0]
        out[left] += self.escape[0][0] + np.float32(8)
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language."""
        return self._measured(texts, False)[0]

    def rated(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """totals(), and the bits a byte of each text's median word under its best language (words of one byte count if there are no others)."""
        return self._measured(texts, True)

    def _measured(self, texts: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Long texts go through in slices that overlap by the context."""
        joined = np.frombuffer(PAD + PAD.join(texts) + PAD, np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(size + ORDER) - size - ORDER
        total = np.zeros((len(texts), len(self.languages)))
        inside = joined[ORDER:] > 32
        begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if words else np.zeros(0, np.int64)
        cost = np.zeros((len(begins), len(self.languages)))
        for low in range(0, len(joined) - ORDER, _SLICE):
            bits = self.code_lengths(joined[low : low + _SLICE + ORDER])
            upto = np.vstack([np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)])
            total += upto[np.clip(start + size - low, 0, len(bits))] - upto[np.clip(start - low, 0, len(bits))]
            if words:
                own = np.flatnonzero(inside[low : low + len(bits)])
                word = np.searchsorted(begins, own + low, side="right") - 1
                first = int(word[0]) if len(word) else 0
                for k in range(cost.shape[1]) if len(word) else ():
                    sums = np.bincount(word - first, bits[own, k])
                    cost[first : first + len(sums), k] += sums
        typical = np.zeros(len(texts))
        if len(begins):
            ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
            text = np.searchsorted(start, begins, side="right") - 1
            rate = cost[np.arange(len(begins)), total.argmin(axis=1)[text]] / (ends - begins)
            short = ends - begins < 2
            fine = ~short | (np.bincount(text, ~short, len(texts)) == 0)[text]
            text, rate = text[fine], rate[fine]
            order = np.lexsort((rate, text))
            count = np.bincount(text, minlength=len(texts))
            some = np.flatnonzero(count)
            typical[some] = rate[order][(np.cumsum(count) - count)[some] + (count[some] - 1) // 2]
        return total, typical


def held_out(doc_id: Column) -> Column:
    """Rows never learned from. A null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def train(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, size: int = BYTES_PER_LANGUAGE, learn: Column | None = None) -> PPM:
    """Fit on at most `rows` rows and `size` bytes of each language: of each of `rows` hash slots the row with the least hash among those of at most size / 8 bytes.

    most_bits is set by the rows with the largest hash of those slots, within the same bounds, where these are others. Only ids, labels and sizes are read to choose the
    rows, and no more than the chosen ones' hashes and sizes, then their texts, go to the driver. learn: the rows that may be used, by doc_id, text or lang.
    """
    labelled = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= size // 8) & (F.lit(True) if learn is None else learn))
    keyed = usable.withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = keyed.withColumn("s", F.pmod(F.hash(F.col("h")), F.lit(rows)))
    row = F.struct("h", F.octet_length("text").alias("n"))
    chosen, held = [], {}
    for r in sorted(keyed.groupBy("lang", "s").agg(F.min(row).alias("a"), F.max(row).alias("b")).collect(), key=lambda r: (r.lang, r.s)):
        for use, x in enumerate((r.a, r.b)):
            before = held.get((r.lang, use), 0)
            if before + x.n <= size and (use == 0 or x.h != r.a.h):
                held[r.lang, use] = before + x.n
                chosen.append((r.lang, r.s, x.h, use))
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, s int, h long, use int")
    picked = keyed.join(F.broadcast(wanted), ["lang", "s", "h"]).groupBy("lang", "s", "use").agg(F.min("text").alias("text")).collect() if chosen else []
    texts: dict[str, list[bytes]] = {}
    others: dict[str, list[bytes]] = {}
    for r in sorted(picked, key=lambda r: (r.lang, r.s)):
        (others if r.use else texts).setdefault(r.lang, []).append(r.text.encode("utf-8", "replace"))
    model = PPM(texts)
    told = [model.rated(own)[1] for own in others.values()]
    if sum(map(len, told)) >= LEAST_HELD:
        model.most_bits = SLACK * max(float(np.quantile(t, 0.999)) for t in told)
    return model


def _judged(ppm: PPM, texts: list[str | None], words: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a byte of each text, or of its median word."""
    known = [bool(t) and bool(ppm.languages) and _LETTER.search(t) is not None for t in texts]
    coded = [t.encode("utf-8", "replace") for t, ok in zip(texts, known, strict=True) if ok]
    names, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if coded:
        total, typical = ppm.rated(coded) if words else (ppm.totals(coded), None)
        best = total.argmin(axis=1)
        at = np.flatnonzero(known)
        least = total[np.arange(len(coded)), best]
        score[at] = 1 / np.exp2(np.maximum(least[:, None] - total, -1000)).sum(axis=1)
        rate[at] = typical if words else least / [len(c) for c in coded]
        for i, b in zip(at, best, strict=True):
            names[i] = ppm.languages[b]
    return names, score, rate


def identify(docs: DataFrame, model: PPM) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for each row.

    A text that is null or has no letter is `und` with score 0. Ties go to the language first in order. With nothing learned, all is `und`.
    score is the posterior probability of the language under equal priors. Each row is judged by its text alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rate = _judged(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rate)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, bits_per_byte double")


def language_stage(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Rows in a language that the model knows and is sure of; all columns as they were, whatever their names.

    Each row is judged by its own text, so a null or repeated doc_id changes nothing. Texts that are null or have no letter go, as do those
    without a language of at least the score, and those whose median word costs more bits a byte under the best one than the model's most_bits,
    which labelled rows that it did not learn from set: they are in none. A few keys or numbers in a short text do not move the median; languages
    that share most of their spelling with a learned one stay. With nothing learned all go; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared, at = spark.sparkContext.broadcast(train(docs)), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rate = _judged(shared.value, batch.column(at).to_pylist(), words=True)
            fine = (np.array(names, object) != "und") & (score >= least_score) & (rate <= shared.value.most_bits)
            yield batch.filter(pa.array(fine, pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # any name will do outside
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)

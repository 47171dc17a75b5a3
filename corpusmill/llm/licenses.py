"""License scans: short notices found with spelling errors, scanner's line breaks and punctuation.

A text becomes its words, A-Z lower-cased, with one space between. A notice of m bytes may hold k = min(4, m // 10) edits (a byte
of UTF-8 inserted, dropped or replaced). Cut into k + 1 pieces it has one piece without an edit wherever it stands (pigeonhole), so
all pieces of all notices are searched at once as exact seeds by an Aho-Corasick automaton. Where a seed stands, the notice can
only begin within k bytes of the place that the seed implies; the regex library's bounded-error match of that window says
whether it does, and gives its span and its edits. Whole texts are searched; the work grows with their length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bounded_batches

#: The phrases of the base rule and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Openings of public licenses' own notices, as words, and their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license": "apache",
    "licensed under the apache license version 2 0": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc0 1 0 universal": "cc0",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: A notice may hold one edit for so many bytes, and so many at most: long pieces make rare seeds.
BYTES_PER_EDIT, MOST_EDITS = 10, 4
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_SPACED = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal(text: str | None) -> bytes:
    """The words of a text with a space before each and one after the last; a single space if there is none."""
    return b" ".join([b"", *(text or "").encode("utf-8", "replace").lower().translate(_SPACED).split(), b""]) or b" "


class FuzzyNotices:
    """The seeds and bounded-error patterns of some notices."""

    def __init__(self, notices: dict[str, str], bytes_per_edit: int = BYTES_PER_EDIT, most: int = MOST_EDITS):
        self.notices = [(n.encode(), label, min(most, len(n.encode()) // bytes_per_edit)) for n, label in notices.items()]
        # the best match between two spaces; an edit may touch spaces inside
        self.patterns = [regex.compile(rb"(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(n), k), regex.BESTMATCH) for n, _, k in self.notices]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (n, _, k) in enumerate(self.notices):
            cuts = [j * len(n) // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places[n[a:b].decode("latin-1")].append((i, a))
        self.seeds = ahocorasick.Automaton()
        for seed, where in places.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def find(self, words: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of matches in a normal text. Of matches of one notice that overlap that with the fewest edits stays, then the leftmost."""
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (size, where) in self.seeds.iter(words.decode("latin-1")):
            for i, offset in where:
                starts[i].add(last + 1 - size - offset)
        out = []
        for i, places in starts.items():
            n, _, k = self.notices[i]
            exact = {s for s in places if words[max(s - 1, 0) : s + len(n) + 1] == b" " + n + b" "}
            found = {(0, s, s + len(n)) for s in exact}
            for s in sorted(places - exact):
                if k == 0 or any(s + d in exact for d in range(-k, k + 1)):
                    continue  # whatever stands here overlaps an exact match
                window = (max(0, s - k - 1), s + len(n) + 2 * k + 1)
                m = self.patterns[i].search(words[window[0] : window[1]])
                if m:
                    found.add((sum(m.fuzzy_counts), window[0] + m.start(), window[0] + m.end()))
            out += [(i, a, b, edits) for edits, a, b in _apart(found)]
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping (edits, start, end) the least; groups that touch each other are settled one by one, so that long texts stay cheap."""
    out: list[tuple[int, int, int]] = []
    group: list[tuple[int, int, int]] = []
    end = -1

    def settle() -> None:
        kept: list[tuple[int, int, int]] = []
        for f in sorted(group):
            if all(f[2] <= a or b <= f[1] for _, a, b in kept):
                kept.append(f)
        out.extend(kept)

    for f in sorted(found, key=lambda f: f[1]):
        if f[1] >= end:
            settle()
            group = []
        group.append(f)
        end = max(end, f[2])
    settle()
    return out


def _base_places(words: bytes) -> list[tuple[int, str]]:
    """(offset, phrase) of every place of a base phrase, in order."""
    out = []
    for phrase in BASE:
        wanted = b" " + phrase.encode() + b" "
        at = words.find(wanted)
        while at >= 0:
            out.append((at + 1, phrase))
            at = words.find(wanted, at + 1)
    return sorted(out)


def _word_numbers(words: bytes, offsets: list[int]) -> dict[int, int]:
    """Which word, from 0, begins at or holds each offset."""
    out, at, number = {}, 0, -1
    for o in sorted(set(offsets)):
        number += words.count(b" ", at, o)
        at = o
        out[o] = number
    return out


def scan_text(text: str | None, notices: FuzzyNotices) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, start and end in code points, edits) of one text."""
    words = normal(text)
    base, fuzzy = _base_places(words), notices.find(words)
    n_words = len(words.split())
    if not base and not fuzzy:
        return n_words, 0, None, None, "", "", 0.0, []
    number = _word_numbers(words, [o for o, _ in base] + [o for _, a, b, _ in fuzzy for o in (a, b - 1)] + [o + len(p) - 1 for o, p in base])
    chars = [m.span() for m in _WORD.finditer(text.encode("utf-8", "replace").decode("utf-8"))]
    found = {(BASE[p], number[o], number[o + len(p) - 1], 0): 1.0 for o, p in base}
    for i, a, b, edits in fuzzy:
        n, label, _ = notices.notices[i]
        found.setdefault((label, number[a], number[b - 1], edits), 1 - edits / len(n))
    spans = sorted((label, chars[a][0], chars[b][1], edits) for label, a, b, edits in found)
    at = [number[o] for o, _ in base]
    join = lambda labels: ",".join(sorted(set(labels)))
    return n_words, len(base), min(at, default=None), max(at, default=None), join(BASE[p] for _, p in base), join(s[0] for s in spans), max(found.values()), spans


_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: int, end: int, edits: int>>"


def scan(docs: DataFrame, notices: dict[str, str] | None = None, key: str = "doc_id") -> DataFrame:
    """The key and what scan_text says of every row's whole text, row by row.

    n_base counts all places where a base phrase's words stand consecutively; first_word and last_word are the smallest and the largest number of
    the word such a place starts with. labels are theirs and those of all notices found with few enough edits; score is 1 less the share of
    edited bytes in the best of them, 0 without any. A null text counts as empty: no words, no labels, score 0. Null and repeated
    keys are rows like any other; an empty table gives no rows; other columns play no part.
    """
    bounded_batches(docs.sparkSession)
    found = FuzzyNotices(NOTICES if notices is None else notices)
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t, found) for t in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            spans = lambda c: [[dict(zip(("label", "start", "end", "edits"), s, strict=True)) for s in x] for x in c]
            arrays = [pa.array(spans(c) if t == span else list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {_RESULT}")

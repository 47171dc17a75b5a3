"""A language detector of hashed character trigrams, scored inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _let(value: Column, body) -> Column:
    """body(value), the value computed once: an expression that a lambda names would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _buckets(text: Column, chars: int, size: int) -> Column:
    """The buckets of the trigrams of a text's first characters, letters lower-cased, all else one space."""
    said = F.regexp_replace(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, chars)), r"\P{L}+", " ")
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - (GRAM - 1)), lambda i: F.pmod((F.element_at(c, i) * 31 + F.element_at(c, i + 1)) * 31 + F.element_at(c, i + 2), F.lit(size)))
    return _let(F.transform(F.split(said, ""), lambda c: F.ascii(c)), grams)


class TrigramDetector:
    """Smoothed logarithms of each language's trigram frequencies, `size` buckets a language. Languages are in sorted order."""

    def __init__(self, weights: dict[str, list[float]], size: int, chars: int):
        self.languages, self.size, self.chars = sorted(weights), size, chars
        self.weights = weights

    @classmethod
    def train(cls, docs: DataFrame, text: str = "text", lang: str = "lang", chars: int = 1000, size: int = 4096) -> TrigramDetector:
        """Counts over all labelled rows; at most `size` counts a language go to the driver. chars: only so many first characters of a text count, here and in detection."""
        known = docs.filter(F.col(lang).isNotNull() & (F.length(text) >= GRAM))
        rows = known.select(F.col(lang).cast("string").alias("lang"), F.explode(_buckets(F.col(text), chars, size)).alias("b")).groupBy("lang", "b").agg(F.count("*").alias("n")).collect()
        counts: dict[str, dict[int, int]] = {}
        for r in rows:
            counts.setdefault(r.lang, {})[r.b] = r.n
        return cls({lang: [math.log((own.get(b, 0) + 1) / (sum(own.values()) + size)) for b in range(size)] for lang, own in counts.items()}, size, chars)

    def detect(self, text: Column) -> Column:
        """(language, confidence): the most probable language and its share under equal priors; ('unknown', 0) for texts without a letter or under three characters, or with nothing learned. Equal scores go to the language first in order."""
        unknown = F.struct(F.lit("unknown").alias("language"), F.lit(0.0).alias("confidence"))
        if not self.languages:
            return unknown
        tables = [F.split(F.lit(",".join(map(repr, self.weights[name]))), ",").cast("array<double>") for name in self.languages]  # folded once into a constant

        def total(b: Column, table: Column) -> Column:
            return F.aggregate(b, F.lit(0.0), lambda s, x: s + F.element_at(table, x + 1))

        found = lambda b: F.array(*(total(b, t) for t in tables))
        judged = _let(_buckets(text, self.chars, self.size), found)
        names = F.array(*(F.lit(n) for n in self.languages))
        told = lambda s: F.struct(F.element_at(names, F.array_position(s, F.array_max(s)).cast("int")).alias("language"), (1 / F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(s)))).alias("confidence"))
        enough = F.coalesce((F.length(text) >= GRAM) & F.substring(text, 1, self.chars).rlike(r"\p{L}"), F.lit(False))
        return F.when(enough, _let(judged, told)).otherwise(unknown)

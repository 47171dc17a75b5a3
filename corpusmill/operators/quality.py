"""Rule-based quality filters: the general one, the repetition-based one and the educational score.

Every filter adds one struct (passed, score, reasons); all checks run, so every failing reason is told. A null text counts as empty.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# What starts a bullet line.
BULLETS = r"^[•\-*·◦▪]"
GOPHER_BULLETS = r"^[•\-*·◦▪–]"


@dataclass(frozen=True)
class QualityRules:
    min_length: int = 100
    max_length: int = 100_000
    min_words: int = 20
    max_words: int = 100_000
    min_word_length: float = 3.0
    max_word_length: float = 10.0
    max_symbols: float = 0.1
    max_digits: float = 0.2
    max_upper: float = 0.3
    max_line_repeats: float = 0.3
    min_unique: float = 0.2
    max_html: float = 0.05
    max_bullets: float = 0.9


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds q_words, q_lines and the numbers that the checks compare; each is computed once."""
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"q_words": T.words(F.col("_t")), "q_lines": T.lines(F.col("_t")), "_alpha": T.count_of(F.col("_t"), r"\p{L}")})
    n, w, k = F.length("_t"), F.size("q_words"), F.size("q_lines")
    alpha = F.col("_alpha")
    return df.withColumns({
        "q_length": n, "q_n_words": w, "q_n_lines": k, "q_word_length": F.when(w > 0, T.total_length(F.col("q_words")) / w),
        "q_symbols": F.when(n > 0, T.count(F.col("_t"), r"(?U)[^\p{L}\p{N}\s]") / n), "q_digits": F.when(n > 0, T.count(F.col("_t"), r"\p{Nd}") / n), "q_upper": F.when(alpha > 0, T.count(F.col("_t"), r"\p{Lu}") / alpha),
        "q_repeats": F.when(k > 1, T.most_frequent(F.col("q_lines")) / k).otherwise(0.0), "q_unique": F.when(w > 0, F.size(F.array_distinct("q_words")) / w), "q_html": T.ratio(T.count(F.col("_t"), "<[^>]+>"), w),
        "q_bullets": F.when(k > 0, F.size(F.filter("q_lines", lambda x: x.rlike(BULLETS))) / k).otherwise(0.0),
    })


def _checks(r: QualityRules) -> dict[str, Column]:
    c = F.col
    no = F.lit(False)
    return {
        "length": c("q_length").between(r.min_length, r.max_length), "word_count": c("q_n_words").between(r.min_words, r.max_words),
        "word_length": F.coalesce(c("q_word_length").between(r.min_word_length, r.max_word_length), no), "symbols": F.coalesce(c("q_symbols") <= r.max_symbols, no),
        "digits": F.coalesce(c("q_digits") <= r.max_digits, no), "uppercase": F.coalesce(c("q_upper") <= r.max_upper, no), "line_repetition": c("q_repeats") <= r.max_line_repeats,
        "unique_words": F.coalesce(c("q_unique") >= r.min_unique, no), "html": c("q_html") <= r.max_html, "bullets": c("q_bullets") <= r.max_bullets,
    }


def verdict(checks: dict[str, Column], score: Column) -> Column:
    failed = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())))
    return F.struct((F.size(failed) == 0).alias("passed"), score.cast("double").alias("score"), failed.alias("reasons"))


def quality(df: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", to: str = "quality") -> DataFrame:
    """The ten checks; score = min(1, passed / 10 + 0.1 * min(1, words / 500) + 0.1 * distinct share)."""
    m = measures(df, text)
    checks = _checks(rules)
    passed = sum((ok.cast("int") for ok in checks.values()), F.lit(0))
    score = F.least(F.lit(1.0), passed / 10.0 + F.least(F.lit(1.0), F.col("q_n_words") / 500.0) * 0.1 + F.coalesce("q_unique", F.lit(0.0)) * 0.1)
    return m.withColumn(to, verdict(checks, score)).select(*df.columns, to)


def top_gram_share(df: DataFrame, text: str = "text", sizes: tuple[int, ...] = (2, 3, 4), to: str = "gram_share") -> DataFrame:
    """For each n, length * count of the most frequent word n-gram over the text's length; ties go to the gram that occurs first.

    Arrow-batched: a counter per text is about ten times faster than exploding all grams, and keeps a text in one place.
    """

    @F.pandas_udf("array<double>")
    def shares(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[float]:
            ws, out = t.split(), []
            for n in sizes:
                counts = Counter(zip(*(ws[k:] for k in range(n)), strict=False))  # words hold no space, so they need not be joined
                best = max(counts, key=counts.get, default=())  # the first of equals
                out.append(len(" ".join(best)) * counts[best] / max(1, len(t)))
            return out

        return texts.map(one)

    return df.withColumn(to, shares(F.coalesce(F.col(text), F.lit(""))))


def duplicate_share(parts: Column, length: Column) -> Column:
    """Characters in repeats of a part over all characters."""
    return (T.total_length(parts) - T.total_length(F.array_distinct(parts))) / F.greatest(length, F.lit(1))


def gopher(df: DataFrame, text: str = "text", to: str = "gopher") -> DataFrame:
    """The eight repetition and shape checks; score is the share of passed ones."""
    m = top_gram_share(df, text, to="_grams").withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    m = m.withColumns({"_w": T.words(F.col("_t")), "_l": T.lines(F.col("_t")), "_p": T.paragraphs(F.col("_t"))})
    w, k, n = F.size("_w"), F.size("_l"), F.length("_t")
    share = lambda test: F.when(k > 0, F.size(F.filter("_l", test)) / k).otherwise(0.0)
    checks = {
        "word_count": w.between(50, 100_000), "word_length": F.coalesce(F.when(w > 0, T.total_length(F.col("_w")) / w).between(3.0, 10.0), F.lit(False)),
        "symbols": F.when(w > 0, T.count(F.col("_t"), r"[#<>{}/\\|@$%^&*~`]") / F.greatest(w, F.lit(1)) <= 0.1).otherwise(False), "bullets": share(lambda x: x.rlike(GOPHER_BULLETS)) <= 0.9,
        "ellipsis": share(lambda x: x.rlike(r"\.\.\.$|…")) <= 0.3, "duplicate_lines": duplicate_share(F.col("_l"), n) <= 0.2,
        "duplicate_paragraphs": duplicate_share(F.col("_p"), n) <= 0.2, "top_ngram": ~F.exists("_grams", lambda x: x > 0.2),
    }
    passed = sum((ok.cast("int") for ok in checks.values()), F.lit(0))
    return m.withColumn(to, verdict(checks, passed / 8.0)).select(*df.columns, to)


# Keywords that speak for or against a text's educational worth.
HIGH = ("therefore", "consequently", "furthermore", "however", "analysis", "evidence", "hypothesis", "conclusion", "research", "study", "theory", "concept", "principle", "definition", "example", "explain", "understand", "learn", "knowledge", "science", "mathematics", "history", "literature", "philosophy")
MEDIUM = ("because", "although", "despite", "while", "since", "show", "demonstrate", "describe", "discuss", "important", "significant", "useful", "helpful")
LOW = ("click", "subscribe", "buy", "sale", "discount", "follow", "like", "share", "comment", "tweet", "cookie", "privacy policy", "terms of service")


def educational_score(text: Column, high=HIGH, medium=MEDIUM, low=LOW) -> Column:
    """clip(0.4 * keywords + 0.4 * structure + 0.2 * sentence length, 0, 1) over distinct lower-case tokens; 0 without words."""
    t = F.coalesce(text, F.lit(""))
    ws = T.words(F.lower(t))
    n = F.size(ws)
    hits = lambda keys: F.size(F.array_intersect(ws, F.array(*map(F.lit, keys))))
    keywords = (2 * hits(high) + hits(medium) - 3 * hits(low)) / F.greatest(n, F.lit(1))
    ends = T.count(t, "[.!?]")
    structure = F.least(F.lit(1.0), 0.1 * T.count(t, "\n\n") + 0.02 * ends)
    per = n / F.greatest(ends, F.lit(1))
    score = 0.4 * keywords + 0.4 * structure + 0.2 * F.when(per.between(10, 30), 1.0).otherwise(0.5)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))

"""Safety taggers: harmful content, toxicity, personal-data redaction, language allow-lists."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns.
HARMFUL = r"(?iU)\b(kill|murder|attack)\s+(all|every)\b"
BASIC_PII = (r"(?U)\b\d{3}-\d{2}-\d{4}\b", r"(?U)\b\d{16}\b", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b")
TOXIC = (r"(?iU)\b(hate|kill|murder)\s+(all|every)\s+\w+", r"(?iU)\b(racist|sexist|homophobic)\b.*\b(slur|attack)\b")
NSFW = ("xxx", "porn", "adult", "nsfw", "sex")
PII = (
    ("ssn", r"(?U)\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"),
    ("credit_card", r"(?U)\b(?:\d{4}[- ]?){3}\d{4}\b", "[CC_REDACTED]"),
    ("email", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    ("phone_us", r"(?U)\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", "[PHONE_REDACTED]"),
    ("ip_address", r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_REDACTED]"),
    ("passport", r"(?U)\b[A-Z]{1,2}\d{6,9}\b", "[PASSPORT_REDACTED]"),
)
#: What each match holds, of patterns without an @.
_PARTS = {p: r"(?U)" + part for p, part in zip((*BASIC_PII[:2], *(p for _, p, _ in PII if "@" not in p)), (r"\d{3}-\d{2}-\d{4}", r"\d{16}", r"\d{3}-\d{2}-\d{4}", r"\d{4}[- ]?\d{4}[- ]?\d{4}", r"\d{3}[-.\s]?\d{4}", r"\d\.\d{1,3}\.\d", r"[A-Z]\d{6}"), strict=True)}


def issues(text: Column) -> Column:
    """harmful_content, pii_detected: those that hold."""
    return F.array_compact(F.array(F.when(text.rlike(HARMFUL), F.lit("harmful_content")), F.when(has_basic_pii(text), F.lit("pii_detected"))))


def found(text: Column, pattern: str) -> Column:
    """Whether a pattern of personal data is found. A part of it that needs no look at the ends of words is sought first, and most texts have none."""
    return (F.contains(text, F.lit("@")) if "@" in pattern else text.rlike(_PARTS[pattern])) & text.rlike(pattern)


def has_basic_pii(text: Column) -> Column:
    return functools.reduce(lambda x, y: x | y, (found(text, p) for p in BASIC_PII))


def redact_basic(text: Column) -> Column:
    for p in BASIC_PII:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


def toxicity(text: Column) -> Column:
    """The share of patterns that hit."""
    return sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in TOXIC), F.lit(0)) / len(TOXIC)


def is_toxic(text: Column, threshold: float = 0.5) -> Column:
    return toxicity(text) >= threshold


def nsfw_url(url: Column) -> Column:
    """Whether the lower-cased URL contains one of the words anywhere."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return sum((F.contains(low, F.lit(w)).cast("int") for w in NSFW), F.lit(0)) > 0


def redact(df, text: str = "text", to: str = "redacted", types: str = "pii_types"):
    """Six kinds in order, each on the text that the ones before have left; adds the text and the kinds found."""
    df = df.withColumn(to, F.col(text)).withColumn(types, F.array().cast("array<string>"))
    for name, pattern, mark in PII:  # a column per stage, so that each search runs once, and replacements where something was found
        df = df.withColumn("_found", found(F.col(to), pattern))
        df = df.withColumns({types: F.when(F.col("_found"), F.concat(F.col(types), F.array(F.lit(name)))).otherwise(F.col(types)), to: F.when(F.col("_found"), F.regexp_replace(F.col(to), pattern, F.lit(mark))).otherwise(F.col(to))})
    return df.drop("_found")


def has_pii(text: Column) -> Column:
    """Whether any of the six kinds occurs."""
    out = F.lit(False)
    for _, pattern, _ in PII:
        out = out | F.coalesce(text.rlike(pattern), F.lit(False))
    return out


def language_allowed(lang: Column, confidence: Column, allowed: tuple[str, ...] = ("en",), least: float = 0.65) -> Column:
    """An unknown language (null) passes, as it does where no detector is there."""
    return lang.isNull() | (lang.isin(*allowed) & (confidence >= least))

"""Column functions on texts. Patterns are Unicode-aware throughout; lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters of Unicode's white space, those of (?U)\s.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends. Trimming looks at the ends alone; a pattern would try every place of every line."""
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """White-space words, without empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\n+"), strip), lambda x: x != "")


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body or a lambda in it names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total_length(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def count_of(c: Column, kind: str) -> Column:
    """How many characters are of a kind (a class of single characters), for kinds of which texts are full: whole runs are matched, not each character."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{kind}+", ""))


def ratio(top: Column, bottom: Column) -> Column:
    return top.cast("double") / F.greatest(bottom, F.lit(1))


def most_frequent(a: Column) -> Column:
    """How often the most frequent element of an array of texts occurs; sorting makes it one pass, not one for each element."""
    step = lambda s, x: F.struct(x.alias("last"), F.when(x == s["last"], s["run"] + 1).otherwise(1).alias("run"), F.greatest(s["most"], F.when(x == s["last"], s["run"] + 1).otherwise(1)).alias("most"))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    return F.aggregate(F.sort_array(a), start, step, lambda s: s["most"])

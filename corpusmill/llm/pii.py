"""Personal data: exact base patterns, and more spans from candidates that boosted trees accept.

Everything on the rows is SQL functions. Matches and the pieces between them give the places of spans: a match starts after
all pieces and matches before it. High-recall generators propose further spans with the text around them; trees over format
and context features score them, and thresholds calibrated on held-out cases select. Base spans always stay.

The possessive and look-behind forms of the base patterns match what the plain forms match, in time linear in the text.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import quoted, unused
from corpusmill.llm.gbt import BoostedTrees, threshold

KINDS = ("email", "ip", "card", "phone")
# The base patterns. A run that fails at its start fails at every later start too, so only starts of runs (or the end of the match before) are tried.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that texts with a match pass.
_MAY = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
#: What the generators propose, and the tests before them.
CANDIDATES = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}| at |@) ?[a-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[a-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?: ?(?:\[\.\]|\(\.\)|\.) ?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{12,19}+|[0-9]{3,6}(?:[ ./-][0-9]{2,6}+){2,4}+)(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])",
}
_MAY_BE = {"email": r"(?i)[\[({ ]at[\])} ]|@", "ip": r"[0-9] ?[\[(]?\. ?", "card": r"[0-9](?:[ ./-]?[0-9]){6}", "phone": r"[0-9]\)?[ ./-][0-9]{3}"}
#: Characters of context before and after a candidate.
BEFORE, AFTER = 40, 12
# Words before a span that speak for a kind of it, or against any.
_WORDS = {
    "says_mail": r"(?i)(e-?mail|contact|write|reach|address)",
    "says_ip": r"(?i)(\bip\b|host|server|client|login|logged)",
    "says_card": r"(?i)(card|visa|master|amex|credit|debit|account|payment|paid|iban)",
    "says_phone": r"(?i)(phone|tel|call|mobile|cell|fax|dial|whatsapp|sms)",
    "says_other": r"(?i)(order|isbn|version|serial|invoice|ticket|token|hash|sha|commit|build|doi|issn|sku|part|total|count|population|figure|page|pages|\bno\.|nr\.|#|\$|€|£|=)",
}
FEATURES = ["is_email", "is_ip", "is_card", "is_phone", "length", "digits", "luhn", "separators", "grouped", "plus", "paren", "marks", "spelled", "leading", "glued", "quoted", "zeros", *_WORDS]


def _let(value: Column, body) -> Column:
    """body(value), the value computed once: an expression that a lambda names would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, fold, zero: int = 0) -> Column:
    """For each element of an array of int what fold makes of all elements before it, in blocks, so that thousands of matches don't cost their square."""
    block = 256
    total = lambda part: F.aggregate(part, F.lit(zero), fold)
    at = lambda i: F.floor(i / block).cast("int")
    sums = lambda values: F.transform(F.sequence(F.lit(0), at(F.size(values))), lambda b: total(F.slice(values, b * block + 1, F.lit(block))))
    before = lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
    each = lambda values, before: F.transform(values, lambda _, i: fold(F.element_at(before, at(i) + 1), total(F.slice(values, at(i) * block + 1, F.pmod(i, F.lit(block))))))
    return _let(values, lambda values: _let(_let(sums(values), before), lambda before: each(values, before)))


def _starts(sizes: Column) -> Column:
    """Exclusive prefix sums of an array."""
    return _before(sizes, lambda a, v: a + v)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def total(d: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            v = F.substring(d, -i, F.lit(1)).cast("int")
            return a + F.when(i % 2 == 1, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))

        return F.when(F.length(d).between(2, 19), F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0).otherwise(False)

    return _let(d, total)


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(s)).between(13, 19) & _luhn(_digits(s))
    return F.length(_digits(s)).between(9, 15) if kind == "phone" else F.lit(True)


def _sizes(m: Column, p: Column) -> Column:
    return _let(p, lambda p: F.transform(m, lambda x, i: F.length(x) + F.length(F.element_at(p, i + 1))))


def _placed(m: Column, p: Column, s: Column) -> Column:
    def one(p: Column, s: Column, x: Column, i: Column) -> Column:
        start = F.element_at(s, i + 1) + F.length(F.element_at(p, i + 1))
        around = (F.substring(F.element_at(p, i + 1), -BEFORE, BEFORE).alias("before"), F.substring(F.element_at(p, i + 2), 1, AFTER).alias("after"))
        return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("s"), *around)

    return _let(p, lambda p: _let(s, lambda s: F.transform(m, lambda x, i: one(p, s, x, i))))


def _matches(df: DataFrame, patterns: dict[str, str], tests: dict[str, str], mark: str) -> DataFrame:
    """Adds <mark><kind>: an array of (start, end, s, before, after) in code points for each pattern's leftmost matches."""
    empty = F.array().cast("array<string>")
    for step in ("m", "p", "s", ""):
        more = {}
        for kind, pattern in patterns.items():
            m, p, s = (F.col(f"_{mark}{kind}_{x}") for x in "mps")
            if step == "m":
                test = F.contains("text", F.lit("@")) if tests[kind] == "@" else F.col("text").rlike(tests[kind])
                more[f"_{mark}{kind}_m"] = F.when(test, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty)
            elif step == "p":
                more[f"_{mark}{kind}_p"] = F.when(F.size(m) > 0, F.split("text", pattern, -1)).otherwise(empty)
            elif step == "s":
                more[f"_{mark}{kind}_s"] = F.when(F.size(m) > 0, _starts(_sizes(m, p))).otherwise(F.array().cast("array<int>"))
            else:
                more[f"{mark}{kind}"] = _placed(m, p, s)
        df = df.withColumns(more)
    return df.drop(*(f"_{mark}{k}_{x}" for k in patterns for x in "mps"))


def _features(kind: str, c: Column) -> Column:
    s, d = c["s"], _digits(c["s"])
    flag = lambda x: x.cast("double")
    told = {f"is_{k}": F.lit(float(k == kind)) for k in KINDS}
    told |= {
        "length": flag(F.length(s)), "digits": flag(F.length(d)), "luhn": flag(_luhn(d)), "separators": flag(F.length(F.regexp_replace(s, r"[^ ./-]", ""))),
        "grouped": flag(s.rlike(r"^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}$|^[0-9]{16}$")), "plus": flag(s.rlike(r"^\+|^00")), "paren": flag(F.contains(s, F.lit("("))),
        "marks": flag(F.regexp_count(s, F.lit(r"[\[({]"))), "spelled": flag(s.rlike(r"(?i) dot |[\[({]dot[\])}]")), "leading": flag(F.startswith(s, F.lit("0"))),
        "glued": flag(c["before"].rlike(r"[\p{L}\p{N}_./:-]$") | c["after"].rlike(r"^[\p{L}\p{N}_/%]|^[.,][0-9]")), "quoted": flag(c["before"].rlike("[\"'=]$")), "zeros": flag(d.rlike("0{5,}$")),
    }
    told |= {name: flag(c["before"].rlike(pattern)) for name, pattern in _WORDS.items()}
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["s"].alias("s"), *(told[f].alias(f) for f in FEATURES))


def _bound(f, *first):
    """f with its first arguments given, as a function of one column."""
    return lambda c: f(*first, c)


def _candidates(df: DataFrame) -> DataFrame:
    df = _matches(df, CANDIDATES, _MAY_BE, "c_")
    return df.withColumns({f"c_{k}": F.transform(f"c_{k}", _bound(_features, k)) for k in KINDS})


def _cases(seed: int, count: int) -> list[tuple[str, int, int, str]]:
    """Labelled training cases (text, start, end, kind or ''), made from templates and random numbers."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    words = lambda n: " ".join("".join(r.choice("aeiounrstlmdch") for _ in range(r.randint(2, 9))) for _ in range(n))

    def luhn(n: int) -> str:
        body = r.choice("3456") + digits(n - 2)
        total = sum(v if i % 2 else (2 * v - 9 * (v > 4)) for i, v in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    four = lambda s, by: by.join(s[i : i + 4] for i in range(0, len(s), 4))
    good = {
        "card": [lambda: digits(16), lambda: luhn(16), lambda: four(digits(16), " "), lambda: four(digits(16), "-"), lambda: luhn(15)],
        "phone": [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", lambda: f"00{r.randint(1, 99)} {digits(3)} {digits(4)}{digits(3)}", lambda: f"00{r.randint(1, 99)} {digits(2)} {digits(6)} {digits(2)}", lambda: f"0{digits(r.choice((2, 3, 4)))} {digits(3)}{digits(1)} {digits(4)}"],
        "email": [lambda: f"{words(1)}{digits(2)} at {words(1)} dot com", lambda: f"{words(1)}[at]{words(1)}[dot]org", lambda: f"{words(1)} (at) {words(1)} (dot) net", lambda: f"{words(1)}.{words(1)} [at] {words(1)}.com"],
        "ip": [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)).replace(".", "[.]"), lambda: " . ".join(str(r.randint(0, 255)) for _ in range(4)), lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))],
    }
    bad = [
        lambda: digits(r.randint(17, 19)), lambda: str(r.randint(1, 9)) + digits(r.randint(2, 6)) + "0" * 9, lambda: digits(r.choice((12, 13, 14))), lambda: f"{digits(4)}-{digits(2)}-{digits(2)} {digits(2)} {digits(2)}",
        lambda: f"20{digits(2)}.{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"{r.randint(300, 999)}.{r.randint(300, 999)}.{r.randint(1, 99)}.{r.randint(1, 99)}", lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{digits(3)}/{digits(3)} {digits(3)}",
        lambda: f"{words(1)} at {words(1)}. {words(1)}", lambda: f"{words(1)} at the {words(1)}. But", lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"a{digits(16)}f{digits(3)}",
    ]
    speaks = {"card": ["card ", "visa card number ", "account "], "phone": ["call ", "phone: ", "tel. "], "email": ["mail ", "contact ", "write to "], "ip": ["server ", "logged in from ", "IP "]}
    against = ["order ", "ISBN ", "version ", "token = \"", "serial ", "total of $", "invoice #", "build "]
    out = []
    for _ in range(count):
        kind = r.choice(KINDS) if r.random() < 0.6 else ""
        span = r.choice(good[kind])() if kind else r.choice(bad)()
        head = r.choice(speaks[kind]) if kind and r.random() < 0.4 else r.choice(against) if not kind and r.random() < 0.5 else ""
        if kind and not head and r.random() < 0.05:  # the same forms with words against them are no personal data
            kind, head = "", r.choice(against)
        before = words(r.randint(2, 8)) + " " + head
        out.append((before + span + r.choice([" ", ", ", ". ", "!! "]) + words(4), len(before), len(before) + len(span), kind))
    return out


@functools.cache
def _model(seed: int = 7, count: int = 3000) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees and one threshold a kind; fitted once in a process on generated cases, a third of them held out for the thresholds."""
    spark = SparkSession.getActiveSession()
    cases = _cases(seed, count)
    df = _candidates(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string").coalesce(1))
    x, y, held, kinds = [], [], [], []
    for kind in KINDS:
        for r in df.select("i", F.explode(f"c_{kind}").alias("c")).select("i", "c.*").collect():
            _, start, end, truth = cases[r.i]
            x.append([r[f] for f in FEATURES])
            y.append(float(truth == kind and r.start <= start + 1 and r.end >= end - 1 and r.start < end))
            held.append(r.i % 3 == 0)
            kinds.append(kind)
    x, y, held, kinds = np.array(x), np.array(y), np.array(held), np.array(kinds)
    model = BoostedTrees(FEATURES, trees=30).fit(x[~held], y[~held])
    score = model.score(x)
    return model, {k: threshold(score[held & (kinds == k)], y[held & (kinds == k)], 0.97) for k in KINDS}


def _mask(spans: Column) -> Column:
    """A byte for each code point up to the end of the last span: 1 in a span, 0 elsewhere. Spans are in order and don't overlap."""
    gap = lambda c, i: c["start"] - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
    return F.encode(F.array_join(F.transform(spans, lambda c, i: F.concat(F.repeat(F.lit("0"), gap(c, i)), F.repeat(F.lit("1"), c["end"] - c["start"]))), ""), "US-ASCII")


def _free(good: Column, masks: list[Column]) -> Column:
    """The spans that no mask has a place of. A part of a byte string costs its own length only, so this is linear in the spans' lengths."""
    taken = lambda c, mask: F.contains(F.substring(mask, c["start"] + 1, c["end"] - c["start"]), F.lit(b"1"))

    def free(c: Column) -> Column:
        out = F.lit(True)
        for mask in masks:
            out = out & ~taken(c, mask)
        return out

    return F.filter(good, free)


def spans(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """The kept column, text (null: empty), and for each kind base_<kind> and all_<kind>: arrays of (start, end), code points, end exclusive, by start.

    all_<kind> holds the base spans and the accepted candidates that overlap no base span of any kind and no earlier accepted one of theirs.
    An e-mail candidate has at most 64 characters before its sign; base spans have no such bound. An empty table gives no rows.
    """
    model, least = _model()
    df = docs.select(F.col(quoted(keep)), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = _matches(df, BASE, _MAY, "b_")
    place = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))
    df = df.withColumns({f"base_{k}": F.transform(F.filter(f"b_{k}", _bound(lambda k, c: _valid(k, c["s"]), k)), place) for k in KINDS}).drop(*(f"b_{k}" for k in KINDS))
    df = _candidates(df)
    none = F.array().cast("array<struct<start:int,end:int>>")
    for k in KINDS:
        good = F.filter(f"c_{k}", _bound(lambda cut, c: model.expression(lambda f: c[f]) >= cut, least[k]))
        df = df.withColumn(f"good_{k}", F.when(F.size(f"c_{k}") > 0, F.transform(good, place)).otherwise(none)).drop(f"c_{k}")
    # masks of base spans are made only where some candidate was accepted
    some = F.greatest(*(F.size(f"good_{k}") for k in KINDS)) > 0
    df = df.withColumns({f"mask_{k}": F.when(some & (F.size(f"base_{k}") > 0), _let(F.col(f"base_{k}"), _mask)).otherwise(F.lit(b"")) for k in KINDS})
    masks = [F.col(f"mask_{k}") for k in KINDS]
    for k in KINDS:
        free = _free(F.col(f"good_{k}"), masks)
        df = df.withColumn(f"new_{k}", F.when(F.size(f"good_{k}") > 0, free).otherwise(none))
        df = df.withColumn(f"taken_{k}", F.when(F.size(f"new_{k}") > 0, _let(F.col(f"new_{k}"), _mask)).otherwise(F.lit(b"")))
        masks = [*masks, F.col(f"taken_{k}")]
    every = {f"all_{k}": F.when(F.size(f"new_{k}") > 0, F.array_sort(F.concat(f"base_{k}", f"new_{k}"))).otherwise(F.col(f"base_{k}")) for k in KINDS}
    return df.withColumns(every).select(F.col(quoted(keep)), "text", *(f"{w}_{k}" for w in ("base", "all") for k in KINDS))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and the spans of every row; repeated rows stay repeated, a null doc_id stays null."""
    df = spans(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    one = lambda k, c: F.concat_ws(":", F.lit(k), c["start"].cast("string"), c["end"].cast("string"))
    told = lambda what: F.concat_ws(",", *(F.transform(f"{what}_{k}", _bound(one, k)) for k in KINDS))
    return df.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(told("base"), 256).alias("base_sha256"), told("all").alias("spans"))


def redaction_stage(docs: DataFrame) -> DataFrame:
    """All rows and columns, whatever their names, every span of the text replaced by its kind in brackets; overlapping spans become one, named after the first.

    n_chars, where it is a column, follows the new text. A null text stays null. Ids play no part.
    """
    (row,) = unused(docs, "row")
    df = spans(docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias(row), "text"), row)
    named = F.concat(*(F.transform(f"all_{k}", _bound(lambda k, c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(k).alias("kind")), k)) for k in KINDS))
    df = df.withColumn("every", F.array_sort(named))
    # the end of all spans before each; a span that begins there or later is the head of a group
    df = df.withColumn("reach", _before(F.transform("every", lambda c: c["end"]), lambda a, v: F.greatest(a, v)))
    df = df.withColumn("heads", F.filter(F.arrays_zip("every", "reach"), lambda c: c["every"]["start"] >= c["reach"]))
    df = df.withColumn("points", F.when(F.size("heads") > 0, F.encode("text", "UTF-32")))  # four bytes a code point: any part of it is found at once
    part = lambda points, a, b: F.decode(F.substring(points, 4 * a + 1, 4 * (b - a)), "UTF-32")
    told = lambda points: F.transform("heads", lambda c: F.concat(part(points, c["reach"], c["every"]["start"]), F.lit("["), F.upper(c["every"]["kind"]), F.lit("]")))
    last = F.array_max(F.transform("every", lambda c: c["end"]))
    new = F.when(F.size("heads") > 0, _let(F.col("points"), lambda p: F.concat(F.array_join(told(p), ""), part(p, last, F.length("text"))))).otherwise(F.col("text"))
    df = df.select(row, new.alias("new"))
    whole = lambda c: F.col(row)[c]
    out = {"text": F.when(whole("text").isNotNull(), F.col("new")), "n_chars": F.when(whole("text").isNotNull(), F.length("new"))}
    types = dict(zip(docs.columns, (f.dataType for f in docs.schema.fields), strict=True))
    return df.select(*((out[c].cast(types[c]) if c in out else F.col(row).getField(c)).alias(c) for c in docs.columns))

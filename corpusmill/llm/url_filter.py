"""URL filter: host and path rules, and for other URLs gradient-boosted trees on lexical features.

Only SQL functions run on the rows. The trees are fitted on the driver from a bounded sample of labelled URLs. A URL is labelled by the
words of its host: those of a fixed list speak for spam, adverts or adult pages. The trees never see words, only the lexical form, so that they judge hosts
with other words by what such hosts look like.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.gbt import BoostedTrees

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words of hosts that label a URL as one to block.
SPAM = ("ad", "adult", "ads", "banner", "bet", "bets", "betting", "casino", "click", "dating", "escort", "jackpot", "loan", "loans", "lottery", "payday", "pharmacy", "pills", "poker", "popup", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx")
#: Labelled rows of each verdict that training may use, one of each hash slot. Suffixes with statistics of their own.
SAMPLE, SUFFIXES = 2000, 24


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: what follows the first `://` up to the first of / ? # and from there up to the first of ? #. Both are empty without it."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host, one of its parent domains included, and the start of the path; null if none does."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return out


def _features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    length = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    chars = F.split(host, "")
    share = lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / F.greatest(F.length(host), F.lit(1))
    entropy = F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return {
        "length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "depth": F.size(F.filter(F.split(path, "/"), lambda c: c != "")).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"), "digits": (F.length(F.regexp_replace(url, "[^0-9]", "")) / length).cast("double"), "hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
        "entropy": entropy, "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")), "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https")).cast("double"), "slash": F.endswith(path, F.lit("/")).cast("double"),
    }


def _suffixes(host: Column, path: Column) -> dict[str, Column]:
    return {"host_suffix": F.regexp_extract(host, r"([^.]*)$", 1), "file_suffix": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,6})$", 1)}


def _ruled(pages: DataFrame, rules, key: str, column: str) -> DataFrame:
    base = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("_url"))
    host, path = parts(F.col("_url"))
    base = base.withColumns({"host": host, "path": path})
    return base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score for every row; a null url or one without `://` has empty parts.

    verdict is the rule's, else `block` where the trees say at least one half. Where no host or every host has a word of the list, there is nothing to learn and everything else is allowed.
    Repeated rows are judged alike, each by its url alone; an empty table gives no rows.
    """
    base = _ruled(pages, rules, key, column)
    blocked = F.col("rule").isin([r for r, v in rules if v == "block"])
    told = base.withColumns(_features(F.col("_url"), F.col("host"), F.col("path")) | _suffixes(F.col("host"), F.col("path")))
    rows = _sample(base)
    model, rates = _fitted(rows, np.arange(len(rows)))
    if model is None:
        score = F.lit(0.0)
    else:
        score = model.expression(lambda name: _rate(rates[name], F.col(name)) if name in rates else F.col(name))
    scored = told.withColumn("score", score)
    verdict = F.when(F.col("rule").isNotNull(), F.when(blocked, "block").otherwise("allow")).when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def _rate(rates: dict[str, float], suffix: Column) -> Column:
    out = None
    for name, rate in rates.items():
        out = F.when(suffix == name, rate) if out is None else out.when(suffix == name, rate)
    return F.lit(0.5) if out is None else out.otherwise(0.5)


def _spam(host: Column) -> Column:
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, SPAM)))


def _sample(base: DataFrame) -> list:
    """Labelled URLs with their features: of each of SAMPLE hash slots of each label the row with the least hash, so no task and no driver holds more."""
    hashed = base.filter(F.col("host") != "").withColumns({"label": _spam(F.col("host")).cast("double"), "h": F.xxhash64("_url")})
    chosen = hashed.groupBy("label", F.pmod(F.hash("h"), F.lit(SAMPLE)).alias("slot")).agg(F.min(F.struct("h", "_url", "host", "path")).alias("r")).select("label", "r.*")
    url, host, path = F.col("_url"), F.col("host"), F.col("path")
    return chosen.select("label", "host", *(c.alias(n) for n, c in (_features(url, host, path) | _suffixes(host, path)).items()), "h").orderBy("label", "h").collect()


def _shares(values: list[str], hosts: list[str], y: np.ndarray) -> tuple[np.ndarray, dict[str, float]]:
    """Smoothed shares of blocked URLs by suffix: for each row those of other hosts alone, so that a host's own label says nothing of it; and for other URLs those of the suffixes that several hosts have."""
    total: dict[str, list[float]] = {}
    own: dict[tuple[str, str], list[float]] = {}
    for v, h, label in zip(values, hosts, y, strict=True):
        for t in (total.setdefault(v, [0, 0]), own.setdefault((v, h), [0, 0])):
            t[0] += label
            t[1] += 1
    share = lambda blocked, n: (blocked + 5) / (n + 10)
    rows = [share(total[v][0] - own[v, h][0], total[v][1] - own[v, h][1]) for v, h in zip(values, hosts, strict=True)]
    several = {v for v in total if len({h for x, h in own if x == v}) > 1}
    best = sorted(several, key=lambda v: (-total[v][1], v))[:SUFFIXES]
    return np.array([r if v in best else 0.5 for r, v in zip(rows, values, strict=True)]), {v: share(*total[v]) for v in best}


def _numeric(row) -> list[str]:
    return [c for c in row.__fields__ if c not in ("label", "host", "h", "host_suffix", "file_suffix")]


def _fitted(rows: list, at: np.ndarray) -> tuple[BoostedTrees | None, dict]:
    """The trees and the suffix shares of the rows at some places; no trees where these have one label."""
    y = np.array([rows[i].label for i in at])
    if len(np.unique(y)) < 2:
        return None, {}
    mine, numeric = [rows[i] for i in at], _numeric(rows[0])
    shares = {c: _shares([r[c] for r in mine], [r.host for r in mine], y) for c in ("host_suffix", "file_suffix")}
    x = np.array([[*(float(r[c]) for c in numeric), *(shares[c][0][i] for c in shares)] for i, r in enumerate(mine)])
    return BoostedTrees([*numeric, *shares], trees=30).fit(x, y), {c: s[1] for c, s in shares.items()}


def _matrix(rows: list, rates: dict) -> np.ndarray:
    return np.array([[*(float(r[c]) for c in _numeric(r)), *(rates[c].get(r[c], 0.5) for c in rates)] for r in rows])


def held_out_accuracy(pages: DataFrame, rules=RULES, key: str = "page_id", column: str = "url", folds: int = 4) -> dict:
    """rows, right (share), always (that of the commoner label), precision and recall of `block` for labelled URLs, each judged by trees that saw no URL of its host."""
    rows = _sample(_ruled(pages, rules, key, column))
    fold = np.array([zlib.crc32(r.host.encode()) % folds for r in rows])
    y, said = np.array([r.label for r in rows]), np.zeros(len(rows))
    for k in range(folds):
        model, rates = _fitted(rows, np.flatnonzero(fold != k))
        away = np.flatnonzero(fold == k)
        if model is not None and len(away):
            said[away] = model.score(_matrix([rows[i] for i in away], rates)) >= 0.5
    hit = float((said * y).sum())
    return {"rows": len(y), "right": float((said == y).mean()), "always": float(max(y.mean(), 1 - y.mean())), "precision": hit / max(float(said.sum()), 1), "recall": hit / max(float(y.sum()), 1)}

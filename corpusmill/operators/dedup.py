"""Exact and greedy near-duplicate removal with first-wins semantics."""

from __future__ import annotations

import random
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime over 2^32; a * h + b stays below 2^63 for a below 2^31.
MODULUS = 4294967311
#: So many shingles are hashed at once.
_BLOCK = 256


def exact_dedup(df: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each text by the order column; nulls come last, and of rows equal in both any one stays. A null text counts as the empty one.

    First places come from a pre-aggregated group-by of hashes. Rows then meet them by hash and order together, so a text that a third of the rows share is no hot task.
    """
    told = df.withColumn("_h", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    first = told.groupBy(F.col("_h").alias("_g")).agg(F.min(order).alias("_first"))
    return told.join(first, (F.col("_h") == F.col("_g")) & F.col(order).eqNullSafe(F.col("_first")), "left_semi").dropDuplicates(["_h", order]).drop("_h")


def coefficients(perms: int, seed: int = 42) -> list[tuple[int, int]]:
    r = random.Random(seed)
    return [(r.randrange(1, 1 << 31), r.randrange(1 << 32)) for _ in range(perms)]


def shingles(text: str | None, n: int = 5) -> set[str]:
    """Distinct lower-case word n-grams; of fewer words, the single words."""
    ws = (text or "").lower().split()
    return {" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else set(ws)


def minhash(df: DataFrame, perms: int = 128, text: str = "text", to: str = "signature") -> DataFrame:
    """Adds the element-wise minimum of affine hashes of the shingles' md5 tails; a text without words gets 2^32 - 1 everywhere.

    Arrow-batched: the md5 of every shingle and 128 hashes of it are array arithmetic, which interpreted lambdas do far slower.
    """
    a, b = (np.array(x, np.uint64)[:, None] for x in zip(*coefficients(perms), strict=True))

    def one(t: str | None, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        h = np.frombuffer(b"".join([md5(g.encode("utf-8", "replace")).digest()[-4:] for g in shingles(t)]), ">u4").astype(np.uint64)
        least = np.full(perms, (1 << 32) - 1, np.uint64)
        for low in range(0, len(h), _BLOCK):
            some = h[low : low + _BLOCK]
            v, q = x[:, : len(some)], y[:, : len(some)]
            np.add(np.multiply(a, some, out=v), b, out=v)
            np.multiply(np.floor_divide(v, np.uint64(MODULUS), out=q), np.uint64(MODULUS), out=q)  # numpy divides by one number far faster than it takes remainders
            found = np.subtract(v, q, out=v).min(axis=1)
            least = np.minimum(least, found) if low else found
        return least.astype(np.int64)

    @F.pandas_udf("array<bigint>")
    def signature(texts: pd.Series) -> pd.Series:
        x, y = (np.empty((perms, _BLOCK), np.uint64) for _ in range(2))  # taken once: fresh memory for each text costs more than the arithmetic
        return texts.map(lambda t: one(t, x, y))

    return df.withColumn(to, signature(F.coalesce(F.col(text), F.lit(""))))


def bands(df: DataFrame, rows: int = 4, key: str = "doc_id", signature: str = "signature") -> DataFrame:
    """(doc id, band, band_key) of every band of rows values."""
    count = F.size(signature) / rows
    cut = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.struct(i.alias("band"), F.md5(F.concat_ws(",", F.slice(signature, i * rows + 1, F.lit(rows)).cast("array<string>"))).alias("band_key")))
    return df.select(key, F.explode(cut).alias("b")).select(key, "b.band", "b.band_key")


def candidate_edges(banded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct (earlier, later) pairs that share a band."""
    x, y = banded.alias("x"), banded.alias("y")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.band_key") == F.col("y.band_key")) & (F.col(f"x.{key}") < F.col(f"y.{key}"))
    return x.join(y, same).select(F.col(f"x.{key}").alias("earlier"), F.col(f"y.{key}").alias("later")).distinct()


def candidate_pairs(signed: DataFrame, key: str = "doc_id", signature: str = "signature") -> DataFrame:
    """candidate_edges of signed rows. Rows of one signature are a class; bands are met by classes alone, and each pair of these becomes pairs of rows once, not once for each band that they share. Checkpointed."""
    members = signed.select(key, F.md5(F.concat_ws(",", F.col(signature).cast("array<string>"))).alias("_c"), signature).checkpoint()
    classes = candidate_edges(bands(members.dropDuplicates(["_c"]), key="_c", signature=signature), "_c")
    x, y = (members.select(F.col(key).alias(k), F.col("_c").alias(c)).distinct() for k, c in (("_x", "_cx"), ("_y", "_cy")))
    within = x.join(y, (F.col("_cx") == F.col("_cy")) & (F.col("_x") < F.col("_y"))).select("_x", "_y")
    across = classes.join(x, F.col("earlier") == F.col("_cx")).join(y, F.col("later") == F.col("_cy")).filter("_x <> _y").select(F.least("_x", "_y").alias("_x"), F.greatest("_x", "_y").alias("_y"))
    pairs = within.unionByName(across).select(F.col("_x").alias("earlier"), F.col("_y").alias("later"))
    # only a key with several texts can bring up a pair twice
    return pairs.distinct() if x.groupBy("_x").count().filter("count > 1").limit(1).count() else pairs


def greedy_keep(ids: DataFrame, buckets: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids kept when each id is dropped iff it shares a bucket with an earlier kept one (the lexicographically first independent set). buckets: (key, bucket), a row for each bucket of an id.

    Buckets are never made into pairs. In a round every bucket names its least open id; an id that is the least of all its buckets is kept, the others of these
    buckets are dropped, and rows of settled ids go. The least open id is always settled, so rounds end; rows only get fewer. They are checkpointed.
    """
    rows = buckets.select(F.col(key).alias("_i"), F.col("bucket").alias("_b"))  # nearly all buckets hold one id, so nothing is written before these are gone
    dropped = rows.select("_i").limit(0)
    while True:
        # a bucket of one id says nothing
        least = rows.groupBy("_b").agg(F.min("_i").alias("_m"), F.max("_i").alias("_n")).filter("_m < _n").select("_b", "_m")
        marked = rows.join(least, "_b").checkpoint()
        if not marked.limit(1).count():
            return ids.join(dropped, ids[key] == dropped["_i"], "left_anti")
        kept = marked.groupBy("_i").agg(F.min("_m").alias("_m")).filter("_m = _i").select("_i")
        gone = marked.join(kept.select(F.col("_i").alias("_m")), "_m", "left_semi").filter("_i > _m").select("_i").distinct().checkpoint()
        dropped = dropped.unionByName(gone).checkpoint()
        rows = marked.select("_i", "_b").join(gone, "_i", "left_anti").join(kept, "_i", "left_anti").checkpoint()


def kept_keys(signed: DataFrame, key: str = "doc_id", signature: str = "signature") -> DataFrame:
    """The keys of signed rows that share no band with an earlier kept one."""
    first = signed.groupBy(signature).agg(F.min(key).alias(key)).select(key, signature).checkpoint()
    return greedy_keep(first.select(key), bands(first, key=key, signature=signature).select(key, F.struct("band", F.unhex("band_key").alias("band_key")).alias("bucket")), key)


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", perms: int = 128) -> DataFrame:
    """Rows that share no signature band with an earlier kept one. Rows with an equal signature fall to the first of them before any pair is made."""
    kept = kept_keys(minhash(df.select(key, text), perms, text), key)
    return df.join(kept.select(F.col(key).alias("_k")), df[key] == F.col("_k"), "left_semi")

"""Exact top-k inner-product search over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it and stored in blocks of a sorted annulus [low, high] of
one pivot. For a query q with distance D to the pivot, |q - x| >= max(0, D - high, low - D) holds for all x of a block, and
so <q, x> <= (|q|^2 + max|x|^2 - that^2) / 2, as well as <q, x> <= <q, p> + |q| * high. A query visits the annuli in the order
of these bounds, in rounds that widen; the k-th score so far rises from round to round, only rows that reach it are kept, and
the search ends when the bound of the next annulus falls below it. Results are exact whatever the pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch, batch_rows

#: Rows of a block, pivots, and rows that pivots are chosen from: a bounded sample, the rows of least id hash.
BLOCK_ROWS, PIVOTS, SAMPLE = 1024, 48, 4096
#: A round visits so many times the blocks of all rounds before.
GROWTH = 6
#: There are about this many blocks at most, so that the table of their bounds can be broadcast: blocks grow beyond.
MOST_BLOCKS = 65_536


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 64) -> DataFrame:
    """key and v, floor(scale * x) of each component as long. Vectors that are null or hold a null or non-finite component are left out, as are null keys.

    A finite component whose floor(scale * x) is no long raises an error: no score could be given for it.
    """
    x = F.col(column)
    told = lambda c: F.floor(c.cast("double") * scale)
    whole = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**63, told(c).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for an integer score")).cast("long")))
    sound = x.isNotNull() & F.col(key).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias(key), whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row a vector; shorter ones are filled with zeros, which change no product."""
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    if len(values):
        row = np.repeat(np.arange(len(column)), sizes)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products. Floating point and longs are used only where every sum is exact in them; beyond, they are Python's integers."""
    most = lambda m: max(-int(m.min(initial=0)), int(m.max(initial=0)))
    bound = most(a) * most(b) * max(1, a.shape[1])
    if bound < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def _longs(scores: np.ndarray) -> np.ndarray:
    """Products as longs; one that is no long raises an error."""
    if scores.dtype == object and any(not -(2**63) <= s < 2**63 for s in scores):
        raise OverflowError("a score is too large for a long")
    return scores.astype(np.int64)


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice."""
    points = sample.astype(np.float64)
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(count, len(points)):
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
        if far.max() == 0:
            break
        chosen.append(int(far.argmax()))
    return points[chosen]


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k highest integer inner products of each query with all vectors but those of its own id.

    Both tables have the key and `v` (array of long). Ties go to the smaller id; repeated rows each count, repeated query ids ask once. Fewer candidates give fewer rows, empty tables none.
    Shorter vectors count as filled with zeros. A score that is no long raises an error.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    bounds = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    width = max(int(bounds.w or 0), int(queries.agg(F.max(F.size("v"))).first()[0] or 0), 1)
    if not bounds.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    slot = F.pmod(F.hash(key), F.lit(SAMPLE))  # of each hash slot the row with the least hash
    sample = [r.r for r in vectors.groupBy(slot.alias("s")).agg(F.min(F.struct(F.xxhash64(key).alias("h"), "v")).alias("r")).orderBy("s").collect()]
    pivots = _pivots(_matrix(pa.array([r.v for r in sample], pa.list_(pa.int64())), width), PIVOTS)
    block_rows = max(BLOCK_ROWS, bounds.n // MOST_BLOCKS)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _distances(_matrix(batch.column(1), width).astype(np.float64), pivots)
            near = away.argmin(axis=1) if len(away) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(away)), near])], names=["id", "v", "pivot", "dist"])

    placed = vectors.select(F.col(key).alias("id"), "v").mapInArrow(keyed, "id long, v array<long>, pivot int, dist double")
    # sorted by pivot and distance over all; the id cuts a vector that many rows share
    dealt = placed.repartitionByRange("pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def close(rows) -> pa.RecordBatch:
            ids, v, pivot, dist = (np.concatenate(c) for c in zip(*rows, strict=True))
            norm = float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1).max()))
            values = [[int(pivot[0])], [float(dist.min())], [float(dist.max())], [norm], [len(ids)], [ids.tobytes()], [v.tobytes()]]
            types = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, types, strict=True)], names=["pivot", "low", "high", "norm", "n", "ids", "vecs"])

        for batch in batches:
            ids, v, pivot, dist = batch.column("id").to_numpy(), _matrix(batch.column("v"), width), batch.column("pivot").to_numpy(), batch.column("dist").to_numpy()
            at = 0
            while at < len(ids):
                if held and held[-1][2][0] != pivot[at]:
                    yield close(held)
                    held, count = [], 0
                end = min(len(ids), at + block_rows - count, at + int((pivot[at:] == pivot[at]).argmin() or len(ids) - at))
                held.append((ids[at:end], v[at:end], pivot[at:end], dist[at:end]))
                count += end - at
                at = end
                if count == block_rows:
                    yield close(held)
                    held, count = [], 0
        if held:
            yield close(held)

    shape = "pivot int, low double, high double, norm double, n int, ids binary, vecs binary"
    with batch_rows(spark, 4096):
        index = scratch.write("index", dealt.mapInArrow(blocks, shape).withColumn("block", F.monotonically_increasing_id()))
    meta = index.select("block", "pivot", "low", "high", "norm", "n").toPandas().sort_values("block")
    shared = spark.sparkContext.broadcast((meta, pivots))

    def reach(q: np.ndarray) -> np.ndarray:
        """For each query and block the upper bound of the product."""
        m, p = shared.value
        q = q.astype(np.float64)
        away, product, norm = _distances(q, p), q @ p.T, np.linalg.norm(q, axis=1)
        where, most = m["pivot"].to_numpy(), m["norm"].to_numpy()
        least = np.maximum(0, np.maximum(away[:, where] - m["high"].to_numpy(), m["low"].to_numpy() - away[:, where]))
        squares = norm[:, None] ** 2 + most**2
        by_pivot = product[:, where] + norm[:, None] * m["high"].to_numpy()
        bound = np.minimum(np.minimum((squares - least**2) / 2, by_pivot), norm[:, None] * most)
        return bound + 1e-6 * (1 + squares)  # what rounding may take away

    def requests(number: int) -> callable:
        """Rows (block, qids, qleast, qvecs) for the blocks of a round: of each query's blocks by their bounds the next ones, as far as they reach its k-th score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value[0]
            names, held = m["block"].to_numpy(), m["n"].to_numpy()
            for whole in batches:
                for low in range(0, whole.num_rows, 256):
                    batch = whole.slice(low, 256)
                    q = _matrix(pa.array(batch.column("v").to_pylist(), pa.list_(pa.int64())), width)
                    ids = batch.column("id").to_numpy()
                    least = np.array([-np.inf if t is None else float(t) for t in batch.column("least").to_pylist()])
                    bound = reach(q)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    place = np.argsort(order, axis=1)
                    # the first round holds over k rows (and the query's own), each later one GROWTH times the blocks
                    first = (np.cumsum(held[order], axis=1) <= k).sum(axis=1)[:, None] + 1
                    after = first * GROWTH ** (number - 1) if number else 0 * first
                    picked = (place >= after) & (place < first * GROWTH**number) & (bound >= least[:, None])
                    some = np.flatnonzero(picked.any(axis=0))
                    rows = [[int(names[b]) for b in some], *([x[picked[:, b]].tobytes() for b in some] for x in (ids, least, q))]
                    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "qids", "qleast", "qvecs"])

        return run

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for qids, qleast, qvecs, ids, vecs in frame.itertuples(index=False):
                q, least, x = np.frombuffer(qids, np.int64), np.frombuffer(qleast, np.float64), np.frombuffer(ids, np.int64)
                score = _products(np.frombuffer(qvecs, np.int64).reshape(len(q), width), np.frombuffer(vecs, np.int64).reshape(len(x), width))
                parts = []
                for i, own in enumerate(q):
                    other = np.flatnonzero(x != own)
                    held = _longs(score[i, other])
                    other, held = other[held >= least[i]], held[held >= least[i]]
                    top = _best(held, x[other], k)
                    parts.append((np.full(len(top), own), x[other][top], held[top]))
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    # equal queries get equal answers, so a query id asks once
    asked = scratch.write("queries", queries.select(F.col(key).alias("id"), "v").dropDuplicates(["id"]))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, number = None, 0
    while True:
        if best is None:
            open_queries = asked.withColumn("least", F.lit(None).cast("long"))
        else:
            least = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
            open_queries = asked.join(least, asked["id"] == least["query_id"], "left").select("id", "v", "least")
        with batch_rows(spark, 4096):
            needed = scratch.write(f"requests-{number}", open_queries.mapInArrow(requests(number), "block long, qids binary, qleast binary, qvecs binary"))
        if not needed.limit(1).count():
            break  # bounds only fall from here on
        both = needed.join(index.select("block", "ids", "vecs"), "block").select("qids", "qleast", "qvecs", "ids", "vecs")
        with batch_rows(spark, 32):  # blocks are large rows
            found = scratch.write(f"found-{number}", both.mapInPandas(answer, "query_id long, vec_id long, score long"))
        pool = found if best is None else found.unionByName(best)
        best = scratch.write(f"best-{number}", pool.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "vec_id", "score"))
        scratch.drop(f"requests-{number}", f"found-{number}")
        number += 1
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.withColumn("rank", F.row_number().over(ranked)).select("query_id", "rank", "vec_id", "score")

"""Hard-negative mining by branch and bound over ball trees.

The rows are dealt evenly, and each task builds ball trees of its own over a bounded number of them: a node has a centre c and
a radius r, so that <q, c> - |q| r <= <q, x> <= <q, c> + |q| r for all its rows x. A search asks for the k highest scores
within a window [low, high], among rows of the anchor's label (its positives) or of others (its negatives). A node is left out
if its upper bound falls below the window or strictly below the k-th score so far, or if its lower bound lies above the window.

Trees are visited in rounds that widen: the k-th scores of one round are the least scores that count in the next. Every
anchor meets every tree, in blocks; scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch, batch_rows, quoted
from corpusmill.llm.topk import _longs, _matrix, _products

#: Rows of a tree and of a leaf, and anchors of a block.
TREE_ROWS, LEAF_ROWS, BLOCK_ROWS = 8192, 128, 512
#: A round visits so many times the trees of all rounds before.
GROWTH = 6
_LEAST, _MOST = -(2**63), 2**63 - 1


def labelled_vectors(rows: DataFrame, label: Column, key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """id, label and v, floor(scale * x) of each component as long. Rows with a null id, label or vector or with a null or non-finite component are left out.

    A finite component whose floor(scale * x) is no long raises an error.
    """
    x = F.col(quoted(column))
    whole = lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**63, F.floor(c.cast("double") * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for an integer score")).cast("long"))
    unsound = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    known = F.col(quoted(key)).isNotNull() & label.isNotNull() & x.isNotNull()
    return rows.filter(known & ~F.coalesce(unsound, F.lit(True))).select(F.col(quoted(key)).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, whole).alias("v"))


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the column's value changes."""
    for batch in batches:
        value = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1), len(value)]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


class BallTree:
    """Rows in the order of the leaves, and of each node its parent, level by level, centre, radius, rows and least and largest label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        order = np.arange(len(ids))
        points = v.astype(np.float64)
        self.nodes: list[tuple[int, int, int]] = []  # parent, first row, end
        level = [(-1, 0, len(ids))]
        while level:
            after = []
            for parent, low, high in level:
                at = len(self.nodes)
                self.nodes.append((parent, low, high))
                if high - low <= LEAF_ROWS:
                    continue
                own = points[order[low:high]]
                # from one far row to the one farthest from it; the median along their line cuts, so that depth is bounded also where rows repeat
                far = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                end = own[((own - far) ** 2).sum(axis=1).argmax()]
                half = (high - low) // 2
                order[low:high] = order[low:high][np.argpartition(own @ (end - far), half)]
                after += [(at, low, low + half), (at, low + half, high)]
            level = after
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        points = points[order]
        self.centre = np.stack([points[low:high].mean(axis=0) for _, low, high in self.nodes])
        self.radius = np.array([np.sqrt(((points[low:high] - c) ** 2).sum(axis=1).max()) for (_, low, high), c in zip(self.nodes, self.centre, strict=True)])
        self.least, self.most = (np.array([f(self.labels[low:high]) for _, low, high in self.nodes]) for f in (np.min, np.max))
        inner = {parent for parent, *_ in self.nodes}
        self.leaves = [i for i in range(len(self.nodes)) if i not in inner]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the product of each query with the rows of each node; no child's are looser than its parent's."""
        q = q.astype(np.float64)
        norm = np.linalg.norm(q, axis=1)[:, None]
        middle, reach = q @ self.centre.T, norm * self.radius
        rounding = 1e-9 * (1 + norm * (np.linalg.norm(self.centre, axis=1) + self.radius))
        up, down = middle + reach + rounding, middle - reach - rounding
        for i, (parent, *_) in enumerate(self.nodes):
            if parent >= 0:
                up[:, i] = np.minimum(up[:, i], up[:, parent])
                down[:, i] = np.maximum(down[:, i], down[:, parent])
        return up, down


def search(tree: BallTree, own: np.ndarray, label: np.ndarray, q: np.ndarray, ask: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, id, score) of at least the k best rows of the tree for each ask, and of none outside its window.

    An ask belongs to the query ask[i] and wants scores from low[i] to high[i], among rows of the query's label if same, else of others;
    rows with the query's own id are left out.
    """
    up, down = tree.bounds(q)
    low, high = low.copy(), high
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    best = np.full((len(ask), k), _LEAST)
    for leaf in sorted(tree.leaves, key=lambda i: -up[:, i].mean()):
        alone = tree.least[leaf] == tree.most[leaf]
        fits = (tree.least[leaf] <= label) & (label <= tree.most[leaf]) if same else ~(alone & (label == tree.least[leaf]))
        alive = np.flatnonzero(fits[ask] & (up[ask, leaf] >= low) & (down[ask, leaf] <= high))
        if not len(alive):
            continue
        _, first, end = tree.nodes[leaf]
        ids, labels = tree.ids[first:end], tree.labels[first:end]
        queries, at = np.unique(ask[alive], return_inverse=True)
        product = _products(q[queries], tree.v[first:end])
        wanted = (labels == label[queries, None]) == same
        wanted &= ids != own[queries, None]
        score = np.stack([_longs(p) for p in product]) if product.dtype == object else product
        mine = score[at]
        ok = wanted[at] & (mine >= low[alive, None]) & (mine <= high[alive, None])
        rows, columns = np.nonzero(ok)
        if not len(rows):
            continue
        found.append((alive[rows], ids[columns], mine[rows, columns]))
        # the k-th score so far is the least that counts from here on
        touched = np.unique(rows)
        merged = np.concatenate([best[alive[touched]], np.where(ok[touched], mine[touched], _LEAST)], axis=1)
        best[alive[touched]] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
        low[alive[touched]] = np.maximum(low[alive[touched]], best[alive[touched]].min(axis=1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
    fine = np.flatnonzero(score >= low[a])
    order = fine[np.lexsort((ids[fine], -score[fine], a[fine]))]
    a = a[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    kept = order[place < k]
    return a[place < k], ids[kept], score[kept]


class HardNegatives:
    """One run: trees over all rows, then the anchors' positives and the negatives of each of them."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.scratch = Scratch(self.spark, "negatives")
        self.rows = self.scratch.write("rows", rows.select("id", "label", "v"))
        facts = self.rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
        self.width = max(int(facts.w or 0), 1)
        self.trees = max(1, -(-facts.n // TREE_ROWS))
        self.index = self._built()

    def _built(self) -> DataFrame:
        """tree and its rows. Rows are dealt by places in the written table, thus evenly whatever they hold."""
        width = self.width

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _runs(batches, "tree"):
                columns = [[int(batch.column("tree")[0].as_py())], [batch.column("id").to_numpy().tobytes()], [batch.column("label").to_numpy().tobytes()], [_matrix(batch.column("v"), width).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["tree", "ids", "labels", "vecs"])

        placed = self.rows.withColumn("tree", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(self.trees)))
        dealt = placed.repartition(self.trees, "tree").sortWithinPartitions("tree", "id", "label")
        with batch_rows(self.spark, 2 * TREE_ROWS):
            return self.scratch.write("index", dealt.select("tree", "id", "label", "v").mapInArrow(pack, "tree long, ids binary, labels binary, vecs binary"))

    def best(self, name: str, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """id, no, hit, score of the k best rows of each ask (ties to the smaller id). asks: id, label, v of an anchor and its asks, an array of (no, low, high)."""
        trees, width = self.trees, self.width
        blocks = max(1, -(-asks.count() // BLOCK_ROWS))
        asks = asks.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        ranked = Window.partitionBy("id", "no").orderBy(F.desc("score"), "hit")

        def requests(first: int, end: int):
            """Blocks of anchors for the trees from `first` to `end`, counted from a place that differs by block, so that no tree leads for all."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in _runs(batches, "block"):
                    ids, asked = batch.column("id").to_numpy(), batch.column("asks")
                    ask = np.repeat(np.arange(len(ids)), np.diff(asked.offsets.to_numpy()))
                    no, low, high = (asked.flatten().field(c).to_numpy().astype(np.int64) for c in ("no", "low", "high"))
                    packed = [x.tobytes() for x in (ids, batch.column("label").to_numpy(), _matrix(batch.column("v"), width), ask, no, low, high)]
                    start = batch.column("block")[0].as_py() * trees // blocks
                    for t in range(first, end):
                        yield pa.RecordBatch.from_arrays([pa.array([(start + t) % trees], pa.int64()), *(pa.array([p], pa.binary()) for p in packed)], names=["tree", *_PACKED])

            return run

        def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, tree = None, None
            for frame in frames:
                for ids, labels, vecs, *packed in frame.itertuples(index=False):
                    if (ids, vecs) != last:
                        x = np.frombuffer(ids, np.int64)
                        last, tree = (ids, vecs), BallTree(x, np.frombuffer(labels, np.int64), np.frombuffer(vecs, np.int64).reshape(len(x), width))
                    own, label, q, ask, no, low, high = (np.frombuffer(p, np.int64) for p in packed)
                    a, hit, score = search(tree, own, label, q.reshape(len(own), width), ask, low, high, k, same)
                    yield pd.DataFrame({"id": own[ask[a]], "no": no[a], "hit": hit, "score": score})

        scratch, best, first, number = self.scratch, None, 0, 0
        while first < trees:
            end = min(trees, max(1, first * GROWTH))
            now = asks
            if best is not None:  # the k-th score of an ask is the least that still counts
                least = best.groupBy("id", "no").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).filter("least IS NOT NULL")
                lists = least.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("no", "least"))).alias("least"))  # an anchor has a few asks
                raised = F.transform("asks", lambda a: F.struct(a["no"].alias("no"), F.greatest(a["low"], F.coalesce(F.try_element_at("least", a["no"]), a["low"])).alias("low"), a["high"].alias("high")))
                now = asks.join(lists, "id", "left").select("block", "id", "label", "v", F.coalesce(raised, "asks").alias("asks"))
            now = now.repartition(blocks, "block").sortWithinPartitions("block", "id")
            with batch_rows(self.spark, BLOCK_ROWS):
                asked = scratch.write(f"{name}-asked-{number}", now.mapInArrow(requests(first, end), "tree long, " + ", ".join(f"{c} binary" for c in _PACKED)))
            met = asked.join(self.index, "tree").select("ids", "labels", "vecs", *_PACKED)
            with batch_rows(self.spark, 4):  # large rows
                found = scratch.write(f"{name}-found-{number}", met.mapInPandas(answer, "id long, no long, hit long, score long"))
            pool = found if best is None else found.unionByName(best)
            best = scratch.write(f"{name}-best-{number}", pool.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).drop("rank"))
            scratch.drop(f"{name}-asked-{number}", f"{name}-found-{number}")
            first, number = end, number + 1
        return best


_PACKED = ["own", "label", "q", "ask", "no", "low", "high"]


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id, label, v (array of long), none null; anchors: which of them are anchors. Positives are the highest scoring other rows of the anchor's label,
    negatives those of other labels whose score is at most the positive's and at least `least` hundredths of it; ties go to the smaller
    id. Rows with the anchor's own id are never its hits; other repeated rows each count. An anchor id that comes twice asks once, with its
    least label and vector. A positive below zero has no negatives, as the window is empty. Shorter vectors count as filled with
    zeros; a score that is no long raises an error; empty tables give no rows.
    """
    run = HardNegatives(rows)
    w = Window.partitionBy("anchor_id", "positive_id", "turn").orderBy(F.desc("negative_score"), "negative_id")
    asked = run.rows.filter(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    asked = run.scratch.write("anchors", asked)
    every = F.array(F.struct(F.lit(0).cast("long").alias("no"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high")))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "hit")
    found = run.best("positives", asked.withColumn("asks", every), positives, True)
    found = run.scratch.write("positives", found.withColumn("no", F.row_number().over(order).cast("long")))
    # the least whole number n with 100 n >= least * score is score - floor((100 - least) * score / 100); no step leaves the longs
    low = F.expr(f"score - {100 - least} * (score div 100) - {100 - least} * (score % 100) div 100")
    windows = found.filter("score >= 0").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("no", low.alias("low"), F.col("score").alias("high")))).alias("asks"))
    asked = run.scratch.write("windows", asked.join(windows, "id"))
    hits = run.best("hits", asked, negatives, False)
    told = hits.select(F.col("id").alias("anchor_id"), F.col("no").alias("turn"), F.col("hit").alias("negative_id"), F.col("score").alias("negative_score"))
    mine = found.select(F.col("id").alias("anchor_id"), F.col("no").alias("turn"), F.col("hit").alias("positive_id"), F.col("score").alias("positive_score"))
    both = told.join(mine, ["anchor_id", "turn"]).withColumn("rank", F.row_number().over(w))
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch


def _star(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """One step. Minima come from a pre-aggregated group-by, so no node's neighbours meet in one task; the join with them is by a unique key
    from a written table, so that Spark can split the edges of a hub."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    else:  # from each node to its smaller neighbours
        both = edges.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
    least = scratch.write(f"{name}-min", both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m")))
    joined = both.join(least.withColumnRenamed("x", "k"), F.col("x") == F.col("k")).select("x", "y", "m")
    if large:
        out = joined.filter(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return scratch.write(name, out.filter(F.col("u") != F.col("v")).distinct())


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (columns a, b; longs): component is the smallest node reachable.

    Nulls and self-loops count for nothing; no edge gives an empty table. Each round is written to the shared folder.
    """
    now = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.write(f"{name}-0", now)
    for k in range(1, most_rounds):
        _star(now, scratch, f"{name}-{k}l", large=True)
        grown = scratch.spark.read.parquet(scratch.path(f"{name}-{k}l"))
        after = _star(grown, scratch, f"{name}-{k}", large=False)
        # stars with the least node at the centre are the fixed point: then no centre is itself a leaf
        open_ends = after.select("v").join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        scratch.drop(f"{name}-{k}l", f"{name}-{k}l-min", f"{name}-{k}-min", f"{name}-{k - 1}")
        now = after
        if not open_ends and not after.groupBy("u").agg(F.min("v").alias("p"), F.max("v").alias("q")).filter("p < q").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return scratch.write(name, stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))

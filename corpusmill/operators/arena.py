"""Pairwise comparisons: ratings, tallies, leaderboards and agreement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expected(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def tallies(comparisons: DataFrame) -> DataFrame:
    """model, wins, losses, ties, total, first (order of its first comparison)."""
    side = lambda me, mark: comparisons.select(F.col(me).alias("model"), (F.col("winner") == mark).cast("long").alias("w"), (F.col("winner") == "tie").cast("long").alias("t"), "comparison_id")
    both = side("model_a", "a").unionByName(side("model_b", "b"))
    return both.groupBy("model").agg(F.sum("w").alias("wins"), F.sum(1 - F.col("w") - F.col("t")).alias("losses"), F.sum("t").alias("ties"), F.count("*").alias("total"), F.min("comparison_id").alias("first"))


def wilson(wins: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """(low, high) of the 95 % interval; (0, 1) without comparisons."""
    n = F.greatest(total, F.lit(1)).cast("double")
    p = wins / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (middle - half) / scale)), F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), (middle + half) / scale))


def elo(comparisons: DataFrame, k: float = 32.0, start: float = 1000.0, before: DataFrame | None = None) -> DataFrame:
    """(model, elo) after all comparisons in the order of comparison_id. Ratings depend on that order, so one task folds the sorted (id, a, b, winner) stream; its state is one number a model.

    before: ratings (model, elo) to start from, a row a model; they are given back with what the comparisons make of them.
    """
    held = {r.model: r.elo for r in before.select("model", "elo").collect()} if before is not None else {}

    def fold(it):
        rating: dict[str, float] = dict(held)
        for frame in it:
            for a, b, w in zip(frame["model_a"], frame["model_b"], frame["winner"], strict=True):
                ra, rb = rating.get(a, start), rating.get(b, start)
                ea = 1 / (1 + 10 ** ((rb - ra) / 400))
                sa = 1.0 if w == "a" else 0.0 if w == "b" else 0.5
                rating[a] = ra + k * (sa - ea)
                rating[b] = rb + k * (ea - sa)
        yield pd.DataFrame({"model": list(rating), "elo": list(rating.values())}).astype({"model": "object", "elo": "float64"})

    rows = comparisons.select("comparison_id", "model_a", "model_b", "winner").orderBy("comparison_id").coalesce(1)
    return rows.mapInPandas(fold, "model string, elo double")


def leaderboard(comparisons: DataFrame) -> DataFrame:
    """rank, model, elo (one decimal), wins, losses, ties, win_rate and its interval; equal ratings in order of appearance."""
    low, high = wilson(F.col("wins"), F.col("total"))
    rated = elo(comparisons).withColumn("elo", F.bround("elo", 1)).join(tallies(comparisons), "model")
    rank = F.row_number().over(Window.orderBy(F.desc("elo"), "first"))  # one row a model
    return rated.select(rank.alias("rank"), "model", "elo", "wins", "losses", "ties", (F.col("wins") / F.col("total")).alias("win_rate"), low.alias("low"), high.alias("high"))


def model_stats(comparisons: DataFrame, model: str) -> DataFrame:
    """One row of a model's rating: model, elo, wins, losses, ties, total, win_rate and ci_low, ci_high in per cent; none for an unknown model."""
    row = leaderboard(comparisons).filter(F.col("model") == model)
    total = F.col("wins") + F.col("losses") + F.col("ties")
    return row.select("model", "elo", "wins", "losses", "ties", total.alias("total"), F.round(100 * F.col("win_rate"), 2).alias("win_rate"), F.round(100 * F.col("low"), 1).alias("ci_low"), F.round(100 * F.col("high"), 1).alias("ci_high"))


def agreement(comparisons: DataFrame) -> DataFrame:
    """One row: over unordered model pairs with two votes at least, the mean share of the most frequent vote (position-relative)."""
    pair = [F.least("model_a", "model_b").alias("x"), F.greatest("model_a", "model_b").alias("y")]
    votes = comparisons.groupBy(*pair, "winner").agg(F.count("*").alias("n"))
    share = votes.groupBy("x", "y").agg(F.max("n").alias("m"), F.sum("n").alias("t")).filter("t >= 2")
    return share.agg(F.avg(F.col("m") / F.col("t")).alias("agreement"), F.count("*").alias("pairs"))

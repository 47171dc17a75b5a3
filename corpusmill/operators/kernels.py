"""Decoding steps over (ctx_id, token_id, logit) tables, and reinforcement-learning and schedule arithmetic."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def temperature(logits: DataFrame, t: float) -> DataFrame:
    if t <= 0:
        raise ValueError("the temperature must be positive")
    return logits.withColumn("logit", F.col("logit") / t)


def repetition_penalty(logits: DataFrame, context: DataFrame, penalty: float) -> DataFrame:
    """Tokens of the context (ctx_id, pos, token_id): a negative logit times the penalty, another divided by it."""
    seen = context.select("ctx_id", "token_id").distinct().withColumn("_s", F.lit(True))
    worse = F.when(F.col("logit") < 0, F.col("logit") * penalty).otherwise(F.col("logit") / penalty)
    return logits.join(seen, ["ctx_id", "token_id"], "left").withColumn("logit", F.when(F.col("_s"), worse).otherwise(F.col("logit"))).drop("_s")


def no_repeat_ngrams(logits: DataFrame, context: DataFrame, n: int) -> DataFrame:
    """Without the tokens that would complete an n-gram that the context has."""
    w = Window.partitionBy("ctx_id").orderBy("pos")
    grams = context.select("ctx_id", "pos", F.array(*(F.lead("token_id", j).over(w) for j in range(n))).alias("g")).filter(~F.exists("g", lambda x: x.isNull()))
    tail = context.withColumn("_r", F.row_number().over(Window.partitionBy("ctx_id").orderBy(F.desc("pos")))).filter(F.col("_r") < n)
    tail = tail.groupBy("ctx_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"]).alias("tail"))
    banned = grams.join(tail, "ctx_id").filter(F.slice("g", 1, n - 1) == F.col("tail")).select("ctx_id", F.element_at("g", n).alias("token_id")).distinct()
    return logits.join(banned, ["ctx_id", "token_id"], "left_anti")


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """Logits from the k-th largest on; ties stay."""
    if k <= 0:
        return logits
    return logits.withColumn("_r", F.rank().over(Window.partitionBy("ctx_id").orderBy(F.desc("logit")))).filter(F.col("_r") <= k).drop("_r")


def softmax(logits: DataFrame) -> DataFrame:
    w = Window.partitionBy("ctx_id")
    e = logits.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return e.withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_p(logits: DataFrame, p: float) -> DataFrame:
    """Tokens while the probability before them is at most p."""
    before = F.sum("prob").over(Window.partitionBy("ctx_id").orderBy(F.desc("logit"), "token_id").rowsBetween(Window.unboundedPreceding, -1))
    return softmax(logits).withColumn("_b", F.coalesce(before, F.lit(0.0))).filter(F.col("_b") <= p).drop("_b")


def greedy(logits: DataFrame) -> DataFrame:
    return logits.groupBy("ctx_id").agg(F.max_by("token_id", F.struct("logit", -F.col("token_id"))).alias("token_id"))


def sample(logits: DataFrame, seed: int) -> DataFrame:
    """One token a context by the Gumbel maximum with seeded hashes: a draw from the softmax."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "ctx_id", "token_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    noisy = logits.withColumn("_g", F.col("logit") - F.log(-F.log(u)))
    return noisy.groupBy("ctx_id").agg(F.max_by("token_id", F.struct("_g", -F.col("token_id"))).alias("token_id"))


def beam_step(beams: DataFrame, logits: DataFrame, width: int, alpha: float = 1.0) -> DataFrame:
    """(batch_id, ctx_id, token_id, score, rank): the best 2 * width extensions of beams (batch_id, ctx_id, score, length)."""
    logp = softmax(logits).withColumn("_l", F.log("prob"))
    ext = beams.join(logp, "ctx_id").withColumn("score", F.col("score") + F.col("_l"))
    final = F.col("score") / (F.pow(5.0 + F.col("length") + 1, F.lit(alpha)) / 6**alpha)
    rank = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("score"), "ctx_id", "token_id"))
    return ext.withColumns({"rank": rank, "normalised": final}).filter(F.col("rank") <= 2 * width).select("batch_id", "ctx_id", "token_id", "score", "normalised", "rank")


def log_probs(logits: DataFrame, chosen: DataFrame) -> DataFrame:
    """log-softmax of the chosen (ctx_id, token_id)."""
    return softmax(logits).withColumn("logp", F.log("prob")).join(chosen, ["ctx_id", "token_id"], "left_semi").select("ctx_id", "token_id", "logp")


def adaptive_kl(kls: Column, start: float, target: float, n: int, horizon: float) -> Column:
    """The coefficient after an array of KL values in order; never under 0.001."""
    return F.aggregate(kls, F.lit(start), lambda c, kl: F.greatest(F.lit(0.001), c * (1 + (kl / target - 1) * n / horizon)))


def token_rewards(steps: DataFrame, coef: float, clip: float = 10.0) -> DataFrame:
    """-coef * (logp - ref_logp) a token; the last of a rollout also gets its score, normalised over rollouts (sample deviation) and clipped."""
    scores = steps.groupBy("rollout_id").agg(F.max("t").alias("_last"), F.max("score").alias("_score"))
    stats = scores.agg(F.avg("_score").alias("_mean"), F.coalesce(F.stddev_samp("_score"), F.lit(0.0)).alias("_dev"))
    normal = scores.crossJoin(F.broadcast(stats)).withColumn("_n", F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col("_score") - F.col("_mean")) / (F.col("_dev") + 1e-8))))  # stats is one row
    out = steps.join(normal.select("rollout_id", "_last", "_n"), "rollout_id")
    return out.withColumn("reward", -coef * (F.col("logp") - F.col("ref_logp")) + F.when(F.col("t") == F.col("_last"), F.col("_n")).otherwise(0.0)).drop("_last", "_n")


def gae(steps: DataFrame, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """advantage and return of each step of (rollout_id, t, reward, value), from the last to the first."""
    w = Window.partitionBy("rollout_id").orderBy("t")
    delta = steps.withColumn("_d", F.col("reward") + gamma * F.coalesce(F.lead("value").over(w), F.lit(0.0)) - F.col("value"))
    rows = delta.groupBy("rollout_id").agg(F.reverse(F.sort_array(F.collect_list(F.struct("t", F.col("_d").alias("d"), "value")))).alias("r"))
    step = lambda s, x: F.struct((x["d"] + gamma * lam * s["a"]).alias("a"), F.concat(s["out"], F.array(F.struct(x["t"].alias("t"), (x["d"] + gamma * lam * s["a"]).alias("advantage"), x["value"].alias("value")))).alias("out"))
    start = F.struct(F.lit(0.0).alias("a"), F.array().cast(f"array<struct<t:{steps.schema['t'].dataType.simpleString()},advantage:double,value:double>>").alias("out"))
    return rows.select("rollout_id", F.explode(F.aggregate("r", start, step, lambda s: s["out"])).alias("x")).select("rollout_id", "x.t", "x.advantage", (F.col("x.advantage") + F.col("x.value")).alias("ret"))


def ppo_losses(df: DataFrame, clip: float = 0.2, value_weight: float = 0.1, entropy_weight: float = 0.01) -> DataFrame:
    """One row over (rollout_id, logp, old_logp, advantage, value, old_value, ret): policy_loss on normalised advantages, value_loss (the larger of the plain and the clipped mean square), entropy, loss, kl and the clipped share.

    Advantages are normalised by their mean and sample deviation; entropy is the mean over rollouts of -sum(exp(logp) * logp).
    """
    whole = df.agg(F.avg("advantage").alias("_mean"), F.coalesce(F.stddev_samp("advantage"), F.lit(0.0)).alias("_dev"))
    df = df.crossJoin(F.broadcast(whole))  # one row
    ratio = F.exp(F.col("logp") - F.col("old_logp"))
    advantage = (F.col("advantage") - F.col("_mean")) / (F.col("_dev") + 1e-8)
    bounded = F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio))
    value = F.col("old_value") + F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("value") - F.col("old_value")))
    out = df.agg(
        F.avg(F.greatest(-ratio * advantage, -bounded * advantage)).alias("policy_loss"),
        F.greatest(F.avg(F.pow(F.col("value") - F.col("ret"), 2)), F.avg(F.pow(value - F.col("ret"), 2))).alias("value_loss"),
        (-F.sum(F.exp("logp") * F.col("logp")) / F.count_distinct("rollout_id")).alias("entropy"),
        F.avg(F.col("old_logp") - F.col("logp")).alias("kl"), F.avg((F.abs(ratio - 1) > clip).cast("double")).alias("clipped"),
    )
    return out.withColumn("loss", F.col("policy_loss") + value_weight * F.col("value_loss") - entropy_weight * F.col("entropy"))


def processors(logits: DataFrame, context: DataFrame, penalty: float = 1.0, grams: int = 0, t: float = 1.0, k: int = 0, p: float = 1.0) -> DataFrame:
    """The chain of logit processors in their order: repetition penalty, no repeated n-grams, temperature, top-k, top-p. Each is left out at its neutral value."""
    out = repetition_penalty(logits, context, penalty) if penalty != 1.0 else logits
    out = no_repeat_ngrams(out, context, grams) if grams > 0 else out
    out = temperature(out, t) if t != 1.0 else out
    out = top_k(out, k)
    return top_p(out, p).select(*logits.columns) if p < 1.0 else out


def preference_loss(df: DataFrame) -> DataFrame:
    """One row over (chosen, rejected) scores: -log sigmoid of the margin, accuracy, margin and means."""
    d = F.col("chosen") - F.col("rejected")
    loss = F.when(d > 0, F.log1p(F.exp(-d))).otherwise(-d + F.log1p(F.exp(d)))
    return df.agg(F.avg(loss).alias("loss"), F.avg((d > 0).cast("double")).alias("accuracy"), F.avg(d).alias("margin"), F.avg("chosen").alias("chosen"), F.avg("rejected").alias("rejected"))


def cosine_lr(step: Column, warmup: int, most: int, low: float, high: float) -> Column:
    """Linear warm-up, then a cosine; progress isn't clamped."""
    progress = (step - warmup) / max(1, most - warmup)
    return F.when(step < warmup, high * step / max(1, warmup)).otherwise(low + 0.5 * (high - low) * (1 + F.cos(math.pi * progress)))


def running_mean(df: DataFrame, value: str, order: str, by: list[str], last: int = 100) -> DataFrame:
    return df.withColumn("running_mean", F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - last, 0)))


def warmup_steps(total: Column, ratio: float = 0.03) -> Column:
    return F.floor(total * ratio).cast("long")


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    """0 where no time has passed."""
    return F.when(seconds > 0, tokens / seconds).otherwise(0.0)


def duration(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h "), F.floor(seconds % 3600 / 60).cast("string"), F.lit("m"))


def rate_limit(events: DataFrame, limit: int, window_s: float, user: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(order, user, allowed): at most `limit` admitted events in a sliding window; rejected ones don't count.

    Users are sorted partitions that stream through Arrow batches with at most `limit` times held, so a user with a third of all events needs no memory.
    """
    rows = events.select(order, user, F.col(ts).cast("timestamp").cast("double").alias("_s")).repartition(user).sortWithinPartitions(user, "_s", order)
    schema = f"{order} {events.schema[order].dataType.simpleString()}, {user} {events.schema[user].dataType.simpleString()}, allowed boolean"

    def fold(it):
        now, held = object(), []
        for frame in it:
            out = []
            for u, s in zip(frame[user], frame["_s"], strict=True):
                if u != now:
                    now, held = u, []
                held = [h for h in held if h > s - window_s]
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(s)
            yield pd.DataFrame({order: frame[order], user: frame[user], "allowed": out})

    return rows.mapInPandas(fold, schema)

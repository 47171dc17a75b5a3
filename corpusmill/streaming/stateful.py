"""Streaming forms of the stateful operators. A batch table and the same rows as a stream give the same result within the watermark."""

from __future__ import annotations

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.operators import arena
from corpusmill.sources import shared


def dedup_stream(docs: DataFrame, ts: str = "ts", text: str = "text", delay: str = "1 hour") -> DataFrame:
    """The first row of each text within the watermark's delay."""
    return docs.withColumn("content_hash", F.sha2(F.coalesce(text, F.lit("")), 256)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_hash"])


#: A watermark starts at 1970, and rows from before it would be late. The clock that it follows is this many seconds ahead.
_CLOCK_S = 200 * 365 * 86400


def rate_limit_stream(events: DataFrame, limit: int, window_s: float, delay: str = "1 hour") -> DataFrame:
    """(event_id, user_id, allowed) of events (event_id, user_id, ts); each user's state is at most `limit` admitted times, and goes once the watermark is a window past the last of them.

    Events of one trigger are taken in the order of their time; one that comes later than the delay is dropped.
    """

    def fold(key: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["s", "event_id"])
        allowed = []
        for s in rows["s"]:
            held = [h for h in held if h > s - window_s]
            allowed.append(len(held) < limit)
            if allowed[-1]:
                held.append(float(s))
        if held:
            state.update((held,))
            state.setTimeoutTimestamp(max(int((held[-1] + window_s + _CLOCK_S) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "allowed": allowed})

    s = F.col("ts").cast("timestamp").cast("double")
    rows = events.select("event_id", "user_id", s.alias("s"), F.timestamp_seconds(s + _CLOCK_S).alias("clock")).withWatermark("clock", delay)
    return rows.groupBy("user_id").applyInPandasWithState(fold, "event_id long, user_id long, allowed boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def rating_stream(comparisons: DataFrame, path: str, checkpoint: str, **elo):
    """A writer, to be started, that keeps ratings up to date: each trigger folds its new comparisons, in the order of their ids, into the snapshot before it and writes the next, `path`/version=<trigger>.

    A trigger that runs again after a failure starts from the same snapshot and writes the same one again. ratings() reads the last snapshot.
    """

    def step(batch: DataFrame, number: int) -> None:
        before = ratings(batch.sparkSession, path, number)
        arena.elo(batch, before=before, **elo).write.mode("overwrite").parquet(f"{path}/version={number}")

    return comparisons.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def ratings(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """(model, elo) of the last snapshot, of those before a version if one is given; None if there is none."""
    store, root = shared.opened(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    numbers = [int(f.base_name.removeprefix("version=")) for f in found if f.base_name.startswith("version=")]
    numbers = [n for n in numbers if below is None or n < below]
    return spark.read.parquet(f"{path}/version={max(numbers)}") if numbers else None


def windowed_counts(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events and their value by type and tumbling window."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))

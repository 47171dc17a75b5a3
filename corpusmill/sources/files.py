"""JSONL, WET and index sources; JSONL sinks; comparison logs and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import dedup
from corpusmill.sources import wet


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; malformed and blank lines are left out. Adds doc_key: content_hash, else the md5 of the line, and the file's path."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file")).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})).filter("r._corrupt IS NULL")
    known = F.col("r.content_hash") if "content_hash" in schema else F.lit(None).cast("string")
    return parsed.withColumn("doc_key", F.coalesce(known, F.md5("value"))).select("r.*", "doc_key", "source_file").drop("_corrupt")


def write_jsonl(df: DataFrame, path: str, without: tuple[str, ...] = ("html", "links")) -> None:
    df.drop(*without).write.mode("overwrite").json(path)


def wet_paths(spark: SparkSession, path: str, segments: int) -> DataFrame:
    """The first paths of a (gzipped) list."""
    return spark.read.text(path).withColumn("i", F.monotonically_increasing_id()).orderBy("i").limit(segments).select(F.col("value").alias("path"))


def read_wet(spark: SparkSession, path: str, language: str | None = None, least: int = 200, cap: int | None = None, split: int = wet.SPLIT) -> DataFrame:
    """url, text, language, timestamp, content_hash, warc_file of conversion records of at least `least` characters, whose language holds `language` if one is given. cap bounds the records of one file, the first ones of it.

    Archives are read by ranges of `split` bytes.
    """
    found = wet.records(spark, path, split).filter((F.col("type") == "conversion") & (F.length("text") >= least))
    if language:
        found = found.filter(F.col("language").contains(language))
    if cap:
        place = F.row_number().over(Window.partitionBy("warc_file").orderBy("start"))
        found = found.withColumn("_n", place).filter(F.col("_n") <= cap)
    return found.select("url", "text", "language", "timestamp", "warc_file").withColumn("content_hash", F.sha2("text", 256))


def process_wet(spark: SparkSession, paths: list[str], target: str, language: str | None = None, cap: int | None = None) -> int:
    """Extract the records of archives, the first of each content in the order of paths, files and places, and write them as JSON lines with their source; returns how many."""
    whole = None
    for i, path in enumerate(paths):
        part = read_wet(spark, path, language, cap=cap).withColumn("_place", F.struct(F.lit(i).alias("path"), "warc_file", F.monotonically_increasing_id().alias("row")))
        whole = part if whole is None else whole.unionByName(part)
    kept = dedup.exact_dedup(whole, "_place").withColumn("source", F.lit("common_crawl")).drop("_place")
    kept.write.mode("overwrite").json(target)
    return spark.read.text(target).count()


def read_index(spark: SparkSession, path: str, schema: str, limit: int) -> DataFrame:
    """Index lines with status 200; bad lines skipped."""
    return read_jsonl(spark, path, schema).filter(F.col("status").cast("string") == "200").limit(limit)


def subject_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Benchmark files <subject>_test.jsonl with their subject."""
    return read_jsonl(spark, pattern, schema).withColumn("subject", F.regexp_extract("source_file", r"([^/]+)_test\.jsonl", 1))


def append_comparisons(df: DataFrame, path: str) -> None:
    df.filter(F.col("winner").isin("a", "b", "tie")).withColumn("comparison_id", F.coalesce("comparison_id", F.uuid())).write.mode("append").json(path)


COMPARISON = "comparison_id STRING, prompt STRING, model_a STRING, model_b STRING, response_a STRING, response_b STRING, winner STRING, judge_id STRING, timestamp DOUBLE, metadata MAP<STRING, STRING>"


def read_comparisons(spark: SparkSession, path: str) -> DataFrame:
    """The comparison log; malformed lines and those without models or winner are left out. Replay it in the order of timestamp and comparison_id."""
    return read_jsonl(spark, path, COMPARISON).filter("model_a IS NOT NULL AND model_b IS NOT NULL AND winner IN ('a', 'b', 'tie')").drop("doc_key", "source_file")


def save_leaderboard(board: DataFrame, comparisons: DataFrame, path: str) -> None:
    """A snapshot: one JSON record of timestamp, leaderboard (rows by rank) and total_comparisons. The board has one row a model."""
    rows = board.agg(F.sort_array(F.collect_list(F.struct("rank", *(c for c in board.columns if c != "rank")))).alias("leaderboard"))
    total = comparisons.agg(F.count("*").alias("total_comparisons"))
    rows.crossJoin(total).select(F.unix_micros(F.current_timestamp()).cast("double").alias("timestamp") / 1e6, "leaderboard", "total_comparisons").toDF("timestamp", "leaderboard", "total_comparisons").write.mode("overwrite").json(path)  # one row each


def latest_checkpoints(paths: DataFrame, keep: int) -> DataFrame:
    """The last checkpoints by the step in their name."""
    step = F.regexp_extract("path", r"(\d+)/?$", 1).try_cast("long")
    return paths.withColumn("step", step).filter("step IS NOT NULL").withColumn("_r", F.row_number().over(Window.orderBy(F.desc("step")))).filter(F.col("_r") <= keep).drop("_r")

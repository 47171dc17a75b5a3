"""Training examples from text to labels: chat turns and preference pairs as token ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import shaping, tokens
from corpusmill.sources import files


def sft_examples(rows: DataFrame, bpe: tokens.BPE, messages: Column | None = None, template: str = "chatml", most: int = 2048) -> DataFrame:
    """Adds input_ids, labels and attention_mask of length `most` to rows with messages (an array of role and content): labels are the ids of tokens that begin inside an answer or its end mark, -100 elsewhere. Rows without messages go."""
    told = rows.withColumn("_m", messages if messages is not None else F.col("messages")).filter("_m IS NOT NULL")
    said = told.withColumn("_placed", bpe.encode_placed(shaping.format_messages(F.col("_m"), template)))
    made = shaping.padded_example(F.col("_placed.ids"), F.col("_placed.starts"), shaping.char_mask(F.col("_m"), template), most, bpe.vocab.get("<pad>", 0))
    return said.withColumn("_x", made).select(*rows.columns, "_x.*")


def conversation_examples(turns: DataFrame, bpe: tokens.BPE, template: str = "chatml", most: int = 2048) -> DataFrame:
    """(conv_id, input_ids, labels, attention_mask) of a table of turns."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content"))))
    return sft_examples(turns.groupBy("conv_id").agg(ordered.alias("messages")), bpe, None, template, most).drop("messages")


def preference_examples(rows: DataFrame, bpe: tokens.BPE, most: int = 1024) -> DataFrame:
    """Adds <side>_input_ids and <side>_attention_mask of length `most`, side being chosen and rejected, of (prompt, chosen, rejected): the texts cut and padded. Rows with a null part go."""
    out = rows.filter("prompt IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL")
    for side in ("chosen", "rejected"):
        ids = bpe.encode(shaping.preference_text(F.col("prompt"), F.col(side)))
        out = out.withColumn("_ids", F.slice(ids, 1, most))
        padded, mask = tokens.pad(F.col("_ids"), F.lit(most), bpe.vocab.get("<pad>", 0))
        out = out.withColumns({f"{side}_input_ids": padded.cast("array<int>"), f"{side}_attention_mask": mask}).drop("_ids")
    return out


def load_sft(spark: SparkSession, path: str, bpe: tokens.BPE, template: str = "chatml", most: int = 2048) -> DataFrame:
    """sft_examples of JSON lines with messages, or instruction, input and output, or prompt and response; other lines are left out."""
    rows = files.read_jsonl(spark, path, "messages ARRAY<STRUCT<role: STRING, content: STRING>>, instruction STRING, input STRING, output STRING, prompt STRING, response STRING")
    return sft_examples(rows, bpe, shaping.to_messages(rows), template, most).select("doc_key", "input_ids", "labels", "attention_mask")


def load_preferences(spark: SparkSession, path: str, bpe: tokens.BPE, most: int = 1024) -> DataFrame:
    """preference_examples of JSON lines with prompt, chosen and rejected; other lines are left out."""
    return preference_examples(files.read_jsonl(spark, path, "prompt STRING, chosen STRING, rejected STRING"), bpe, most).drop("source_file")

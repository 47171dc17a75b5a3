"""Chat templates, instruction and preference formats, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Fixed values: (start, end) of each role.
TEMPLATES = {
    "chatml": {"system": ("<|im_start|>system\n", "<|im_end|>\n"), "user": ("<|im_start|>user\n", "<|im_end|>\n"), "assistant": ("<|im_start|>assistant\n", "<|im_end|>\n")},
    "llama2": {"system": ("[INST] <<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("", " [/INST] "), "assistant": ("", " </s><s>[INST] ")},
}
ALPACA = {"instruction": ("### Instruction:\n", "\n\n"), "input": ("### Input:\n", "\n\n"), "response": ("### Response:\n", "\n\n")}


def wrapped(role: Column, content: Column, template: str = "chatml") -> Column:
    out = F.lit("")
    for name, (start, end) in TEMPLATES[template].items():
        out = F.when(role == name, F.concat(F.lit(start), content, F.lit(end))).otherwise(out)
    return out


def format_messages(messages: Column, template: str = "chatml", system: str | None = None, reply: bool = False) -> Column:
    """The text of an array of (role, content), with an optional system prompt before and the head of an answer after."""
    body = F.concat_ws("", F.transform(messages, lambda m: wrapped(m["role"], m["content"], template)))
    head = F.lit("".join((TEMPLATES[template]["system"][0], system, TEMPLATES[template]["system"][1])) if system else "")
    return F.concat(head, body, F.lit(TEMPLATES[template]["assistant"][0] if reply else ""))


def conversations(turns: DataFrame, template: str = "chatml") -> DataFrame:
    """conv_id, n_turns and the formatted text of a table of turns."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(ordered.alias("m")).select("conv_id", F.size("m").alias("n_turns"), format_messages(F.col("m"), template).alias("text"))


def _said(message: Column, template: str) -> Column:
    return F.coalesce(F.length(wrapped(message["role"], message["content"], template)), F.lit(0))


def char_mask(messages: Column, template: str = "chatml") -> Column:
    """(start, end) character ranges of assistant contents with their end marks in the formatted text; the loss is taken there. A message without content is no part of that text."""
    step = lambda s, m: F.struct((s["at"] + _said(m, template)).alias("at"), F.when(m["role"] == "assistant", F.concat(s["spans"], F.array(F.struct((s["at"] + len(TEMPLATES[template]["assistant"][0])).alias("start"), (s["at"] + _said(m, template)).alias("end"))))).otherwise(s["spans"]).alias("spans"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(messages, start, step, lambda s: s["spans"])


def label_mask(ids: Column, starts: Column, spans: Column) -> Column:
    """ids where a token starts inside a span, -100 elsewhere. The spans are bound first, not found again for every token."""
    return T.let(spans, lambda spans: F.zip_with(ids, starts, lambda i, at: F.when(F.exists(spans, lambda s: (s["start"] <= at) & (at < s["end"])), i).otherwise(-100)))


def alpaca(instruction: Column, given: Column, response: Column) -> Column:
    part = lambda name, c: F.concat(F.lit(ALPACA[name][0]), c, F.lit(ALPACA[name][1]))
    return F.concat(part("instruction", instruction), F.when(F.coalesce(given, F.lit("")) != "", part("input", given)).otherwise(""), part("response", response))


def to_messages(df: DataFrame) -> Column:
    """messages, else instruction/input/output, else prompt/response; null where none is there."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    pair = lambda q, a: F.array(F.struct(F.lit("user").alias("role"), q.alias("content")), F.struct(F.lit("assistant").alias("role"), a.alias("content")))
    asked = F.concat(has("instruction"), F.when(F.coalesce(has("input"), F.lit("")) != "", F.concat(F.lit("\n"), has("input"))).otherwise(""))
    options = [F.when(has("instruction").isNotNull() & has("output").isNotNull(), pair(asked, has("output"))), F.when(has("prompt").isNotNull() & has("response").isNotNull(), pair(has("prompt"), has("response")))]
    return F.coalesce(*([F.col("messages")] if "messages" in df.columns else []), *options)


def preference_text(prompt: Column, answer: Column) -> Column:
    return F.concat(F.lit("Human: "), prompt, F.lit("\nAssistant: "), answer)


def length_batches(df: DataFrame, batch: int, seed: int = 42, key: str = "doc_id", length: str = "n_chars", mega: int = 1000) -> DataFrame:
    """(key, length, megabatch, batch): rows in megabatches of about mega * batch rows, sorted by length inside and cut into batches, whose order is shuffled.

    Megabatches are hash buckets, so no global sort is needed. Ties of length go by the key.
    """
    rows = df.select(key, length)
    buckets = max(1, -(-rows.count() // (mega * batch)))
    rows = rows.withColumn("megabatch", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets)).cast("int"))
    place = F.row_number().over(Window.partitionBy("megabatch").orderBy(length, key)) - 1
    cut = rows.withColumn("_cut", F.floor(place / batch))
    shuffled = F.dense_rank().over(Window.partitionBy("megabatch").orderBy(F.xxhash64("megabatch", "_cut", F.lit(seed + 1)), "_cut")) - 1
    return cut.withColumn("batch", shuffled.cast("int")).drop("_cut")


def _padded(ids: Column, width: Column, fill: int) -> Column:
    return F.concat(F.slice(ids, F.lit(1), width), F.array_repeat(F.lit(fill), F.greatest(width - F.size(ids), F.lit(0)))).cast("array<int>")


def _width(ids: str, by: str, most: int) -> Column:
    return F.least(F.max(F.size(ids)).over(Window.partitionBy(by)), F.lit(most))


def collate(df: DataFrame, by: str, ids: str = "input_ids", labels: str | None = None, mask: str | None = None, pad: int = 0, most: int = 2048, ignore: int = -100) -> DataFrame:
    """Rows of token ids made equally long within each batch (a column): as long as the longest, at most `most`. Adds input_ids, labels (the ids where none are given; padded with `ignore`) and attention_mask (ones where none is given; padded with 0)."""
    width = F.col("_width")
    told = df.withColumn("_width", _width(ids, by, most))
    every = F.transform(F.col(ids), lambda _: F.lit(1))
    made = {"input_ids": _padded(F.col(ids), width, pad), "labels": _padded(F.col(labels or ids), width, ignore), "attention_mask": _padded(F.col(mask) if mask else every, width, 0)}
    return told.withColumns(made).drop("_width")


def collate_preferences(df: DataFrame, by: str, chosen: str = "chosen_input_ids", rejected: str = "rejected_input_ids", pad: int = 0, most: int = 1024) -> DataFrame:
    """Chosen and rejected ids, each side made equally long within its batch, with attention masks chosen_attention_mask and rejected_attention_mask."""
    told = df.withColumns({"_chosen": _width(chosen, by, most), "_rejected": _width(rejected, by, most)})
    ones = lambda c: F.transform(F.col(c), lambda _: F.lit(1))
    made = {"chosen_input_ids": _padded(F.col(chosen), F.col("_chosen"), pad), "rejected_input_ids": _padded(F.col(rejected), F.col("_rejected"), pad)}
    made |= {"chosen_attention_mask": _padded(ones(chosen), F.col("_chosen"), 0), "rejected_attention_mask": _padded(ones(rejected), F.col("_rejected"), 0)}
    return told.withColumns(made).drop("_chosen", "_rejected")


def padded_example(ids: Column, starts: Column, spans: Column, most: int = 2048, pad: int = 0) -> Column:
    """(input_ids, labels, attention_mask) of length `most`: ids cut and padded, labels the ids whose token starts inside a span and -100 elsewhere."""
    width = F.lit(most)
    ids, starts = F.slice(ids, F.lit(1), width), F.slice(starts, F.lit(1), width)
    ones = F.transform(ids, lambda _: F.lit(1))
    return F.struct(_padded(ids, width, pad).alias("input_ids"), _padded(label_mask(ids, starts, spans), width, -100).alias("labels"), _padded(ones, width, 0).alias("attention_mask"))

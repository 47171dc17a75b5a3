"""BLEU, ROUGE, perplexity, multiple-choice and answer accuracy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from corpusmill.functions import text as T


def grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _all_grams(words: Column, orders: range) -> Column:
    """(n, gram) of all n-grams of all orders."""
    of = lambda n: F.transform(grams(words, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
    return F.flatten(F.array(*map(of, orders)))


def _matched(words: DataFrame, key: str, orders: range) -> DataFrame:
    """(key, n, gram, ch, cr) over (key, h, r: array of word arrays): how often the hypothesis has a gram, and the reference that has it most.

    One count of all grams meets in a group-by. Grams are far more than the rows they come from, so a join of counts must not be left to an estimate of size from the files, which would broadcast them.
    """
    texts = words.select(key, F.posexplode(F.concat(F.array("h"), F.coalesce("r", F.array().cast("array<array<string>>")))).alias("ref", "w"))
    each = texts.select(key, "ref", F.explode(_all_grams(F.col("w"), orders)).alias("g")).groupBy(key, "ref", "g.n", "g.gram").agg(F.count("*").alias("c"))
    said, other = F.when(F.col("ref") == 0, F.col("c")), F.when((F.col("ref") > 0) & F.col(key).isNotNull(), F.col("c"))
    return each.groupBy(key, "n", "gram").agg(F.coalesce(F.max(said), F.lit(0)).alias("ch"), F.coalesce(F.max(other), F.lit(0)).alias("cr"))


def _totals(words: DataFrame, key: str, order: int) -> DataFrame:
    """One row: of each order n the clipped matches m<n> and the grams h<n> of the hypotheses."""
    of = lambda n, c: F.coalesce(F.sum(F.when(F.col("n") == n, c)), F.lit(0))
    sums = [x for n in range(1, order + 1) for x in (of(n, F.least("ch", "cr")).alias(f"m{n}"), of(n, F.col("ch")).alias(f"h{n}"))]
    return _matched(words, key, range(1, order + 1)).agg(*sums)


def overlap(pairs: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Per row of (key, hyp, ref): clipped n-gram matches m, and the numbers h and r of n-grams. Gram counts meet in a group-by, not in arrays."""
    w = pairs.select(key, T.words(F.col("hyp")).alias("h"), T.words(F.col("ref")).alias("r"))
    both = _matched(w.withColumn("r", F.array("r")), key, range(n, n + 1)).groupBy(key).agg(F.sum(F.least("ch", "cr")).alias("m"))
    size = lambda c: F.greatest(F.size(c) - n + 1, F.lit(0)).cast("long")
    return w.select(key, size("h").alias("h"), size("r").alias("r")).join(both.hint("merge"), key, "left").select(key, F.coalesce("m", F.lit(0)).cast("long").alias("m"), "h", "r")


def bleu(pairs: DataFrame, key: str = "id", order: int = 4) -> DataFrame:
    """One row: corpus BLEU (0 to 100) of one reference a hypothesis. Orders with grams but no match count 1e-10; orders without grams are left out of the sum but not of its divisor."""
    total = _totals(pairs.select(key, T.words(F.col("hyp")).alias("h"), F.array(T.words(F.col("ref"))).alias("r")), key, order)
    lengths = pairs.agg(F.sum(F.size(T.words(F.col("hyp")))).alias("hyp"), F.sum(F.size(T.words(F.col("ref")))).alias("ref"))
    logs = sum((F.when(F.col(f"h{n}") > 0, F.log(F.greatest(F.col(f"m{n}") / F.greatest(F.col(f"h{n}"), F.lit(1)), F.lit(1e-10)))).otherwise(0.0) for n in range(1, order + 1)), F.lit(0.0))
    penalty = F.when(F.col("hyp") >= F.col("ref"), 1.0).when(F.col("hyp") == 0, 0.0).otherwise(F.exp(1 - F.col("ref") / F.greatest(F.col("hyp"), F.lit(1))))
    return total.crossJoin(lengths).select(F.when(F.coalesce("h1", F.lit(0)) == 0, 0.0).otherwise(100 * penalty * F.exp(logs / order)).alias("bleu"))


def bleu_report(rows: DataFrame, key: str = "id", hyp: str = "hyp", refs: str = "refs", order: int = 4) -> DataFrame:
    """One row over (key, hyp, refs: array of texts): bleu, bleu_1 to bleu_4 (0 to 100) and brevity_penalty.

    A gram counts as often as in the reference that has it most. A hypothesis is held against the length of its shortest reference.
    Orders with grams but no match count 1e-10; orders without grams are 0 and are left out of the sum but not of its divisor.
    """
    words = rows.select(key, T.words(F.col(hyp)).alias("h"), F.transform(F.col(refs), lambda r: T.words(r)).alias("r"))
    total = words.agg(F.sum(F.size("h")).alias("hyp"), F.sum(F.array_min(F.transform("r", lambda r: F.size(r)))).alias("ref")).crossJoin(_totals(words, key, order))  # one row each
    share = {n: F.when(F.col(f"h{n}") > 0, F.greatest(F.col(f"m{n}") / F.col(f"h{n}"), F.lit(1e-10))).otherwise(0.0) for n in range(1, order + 1)}
    logs = sum((F.when(p > 0, F.log(p)).otherwise(0.0) for p in share.values()), F.lit(0.0))
    penalty = F.when(F.col("hyp") >= F.col("ref"), 1.0).when(F.col("hyp") > 0, F.exp(1 - F.col("ref") / F.col("hyp"))).otherwise(0.0)
    none = F.greatest(*share.values()) == 0 if order > 1 else share[1] == 0
    return total.select(F.when(none, 0.0).otherwise(100 * penalty * F.exp(logs / order)).alias("bleu"), *((100 * p).alias(f"bleu_{n}") for n, p in share.items()), penalty.alias("brevity_penalty"))


def _f1(m: Column, h: Column, r: Column) -> Column:
    p, q = m / F.greatest(h, F.lit(1)), m / F.greatest(r, F.lit(1))
    return F.when(m > 0, 2 * p * q / (p + q)).otherwise(0.0)


def rouge_n(pairs: DataFrame, n: int, key: str = "id") -> DataFrame:
    return overlap(pairs, n, key).select(key, _f1(F.col("m"), F.col("h"), F.col("r")).alias(f"rouge{n}"))


@F.pandas_udf(t.LongType())
def _lcs(left: pd.Series, right: pd.Series) -> pd.Series:
    def one(a, b) -> int:
        """Bit-parallel: one big integer holds a row of the table."""
        where: dict[str, int] = {}
        for i, w in enumerate(a):
            where[w] = where.get(w, 0) | 1 << i
        full = (1 << len(a)) - 1
        row = full
        for w in b:
            hit = row & where.get(w, 0)
            row = (row + hit | row - hit) & full
        return len(a) - row.bit_count()

    return pd.Series([one(list(a), list(b)) for a, b in zip(left, right, strict=True)])


def rouge_l(pairs: DataFrame, key: str = "id") -> DataFrame:
    w = pairs.select(key, T.words(F.col("hyp")).alias("h"), T.words(F.col("ref")).alias("r")).withColumn("m", _lcs("h", "r"))
    return w.select(key, _f1(F.col("m"), F.size("h"), F.size("r")).alias("rougeL"))


def rouge(pairs: DataFrame, key: str = "id") -> DataFrame:
    """One row: mean F1 of 1, 2 and L, times 100."""
    whole = rouge_n(pairs, 1, key).join(rouge_n(pairs, 2, key), key).join(rouge_l(pairs, key), key)
    return whole.agg(*((100 * F.avg(c)).alias(c) for c in ("rouge1", "rouge2", "rougeL")))


def generation_report(pairs: DataFrame, key: str = "id") -> DataFrame:
    """One row over (key, hyp, ref): the columns of bleu_report and of rouge."""
    return bleu_report(pairs.withColumn("refs", F.array("ref")), key).crossJoin(rouge(pairs, key))  # one row each


def perplexity(nll: Column, tokens: Column) -> Column:
    """Aggregate: exp(min(20, sum of NLL / tokens))."""
    return F.exp(F.least(F.sum(nll) / F.sum(tokens), F.lit(20.0)))


def stride_windows(length: Column, size: int, stride: int) -> Column:
    """Windows of a sequence, an array of (window, begin, end, own): they begin `stride` apart, hold at most `size` tokens, and the first that reaches the end is the last. Each token is owned by the first window that holds it: a window owns `own` to `end`."""
    if not 0 < stride <= size:
        raise ValueError("the stride is at least 1 and at most the size")
    last = F.when(length <= size, 0).otherwise(F.ceil((length - size) / stride)).cast("int")
    begin = lambda k: k * stride
    end = lambda k: F.least(begin(k) + size, length)
    one = lambda k: F.struct(k.alias("window"), begin(k).cast("int").alias("begin"), end(k).cast("int").alias("end"), F.when(k == 0, 0).otherwise(end(k - 1)).cast("int").alias("own"))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array())


def strided_examples(rows: DataFrame, size: int = 1024, stride: int = 512, key: str = "doc_id", ids: str = "ids", ignore: int = -100) -> DataFrame:
    """(key, window, begin, input_ids, labels) of the windows of token sequences: labels are the ids that the window owns, `ignore` before them. Empty sequences have none."""
    w = F.col("w")
    cut = lambda a, b: F.slice(F.col(ids), a + 1, b - a)
    told = rows.select(key, ids, F.explode(stride_windows(F.size(ids), size, stride)).alias("w"))
    return told.select(key, "w.window", "w.begin", cut(w["begin"], w["end"]).alias("input_ids"), F.concat(F.array_repeat(F.lit(ignore), w["own"] - w["begin"]), cut(w["own"], w["end"])).alias("labels"))


def strided_perplexity(nll: DataFrame, lengths: DataFrame, size: int = 1024, stride: int = 512, key: str = "doc_id", weighted: bool = False, least: int = 1) -> DataFrame:
    """One row over token losses (key, window, pos, nll) and sequence lengths (key, length): nll a token, perplexity (exp of it, at most of 20) and sequences.

    Each token counts once, by the loss in the window that owns it. weighted: as the text evaluation does, a window's mean loss over the tokens that are not among its first `stride` ones (all, in
    the first window) counts for all its tokens, so overlaps count twice. Sequences under `least` tokens are left out; without any the perplexity is infinite.
    """
    longest = lengths.filter(F.col("length") >= least)
    windows = longest.select(key, "length", F.explode(stride_windows(F.col("length"), size, stride)).alias("w")).select(key, "length", "w.*")
    both = nll.join(windows, [key, "window"])
    if weighted:
        counts = (F.col("pos") >= F.col("begin") + F.when(F.col("window") > 0, stride).otherwise(0)) & (F.col("pos") < F.col("end"))
        means = both.filter(counts).groupBy(key, "window").agg((F.avg("nll") * F.first(F.col("end") - F.col("begin"))).alias("s"))
    else:
        means = both.filter((F.col("pos") >= F.col("own")) & (F.col("pos") < F.col("end"))).groupBy(key).agg(F.sum("nll").alias("s"))
    total = longest.agg(F.sum("length").alias("n"), F.count("*").alias("sequences"))
    out = means.agg(F.sum("s").alias("s")).crossJoin(total)  # one row each
    mean = F.when(F.col("sequences") > 0, F.coalesce("s", F.lit(0.0)) / F.col("n")).otherwise(float("inf"))
    return out.select(mean.alias("nll"), F.when(F.col("sequences") > 0, F.exp(F.least(mean, F.lit(20.0)))).otherwise(float("inf")).alias("perplexity"), "sequences")


def choose(scores: DataFrame, example: str = "example", choice: str = "choice", logp: str = "logp") -> DataFrame:
    """(example, pred): the choice of the highest mean token log-probability, the first of equals."""
    mean = scores.groupBy(example, choice).agg(F.avg(logp).alias("s"))
    return mean.groupBy(example).agg(F.max_by(choice, F.struct("s", -F.col(choice))).alias("pred"))


def accuracy(pred: DataFrame, gold: DataFrame, example: str = "example", group: str | None = None) -> DataFrame:
    """accuracy and n, by group if one is named."""
    both = gold.join(pred, example)
    what = [F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("accuracy"), F.count("*").alias("n")]
    return both.groupBy(group).agg(*what) if group else both.agg(*what)


def macro(by_group: DataFrame) -> DataFrame:
    return by_group.agg(F.avg("accuracy").alias("macro_accuracy"), F.count("*").alias("groups"))


def multiple_choice_prompt(question: Column, choices: Column, subject: Column | None = None) -> Column:
    """The question with lettered choices; before it a line that names the subject, if one is given."""
    letters = F.array(*(F.lit(x) for x in "ABCDEFGH"))
    head = F.concat(F.lit("The following is a multiple choice question about "), F.replace(subject, F.lit("_"), F.lit(" ")), F.lit(".\n\n")) if subject is not None else F.lit("")
    return F.concat(head, F.lit("Question: "), question, F.lit("\n"), F.array_join(F.transform(choices, lambda c, i: F.concat(F.element_at(letters, i + 1), F.lit(". "), c, F.lit("\n"))), ""), F.lit("Answer:"))


# Where answers stand, in order of preference.
ANSWERS = (r"(?i)####\s*([-+]?\d+\.?\d*)", r"(?i)(?:answer is|=)\s*([-+]?\d+\.?\d*)", r"(?i)\\boxed\{([-+]?\d+\.?\d*)\}")


def first_answer(text: Column, patterns=ANSWERS) -> Column:
    """The first pattern's first group, else the last number, else null."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.try_element_at(F.regexp_extract_all(text, F.lit(r"[-+]?\d+\.?\d*"), F.lit(0)), F.lit(-1)))


def answer_accuracy(df: DataFrame, response: str = "response", gold: str = "gold", skip: int = 0, most: int | None = None, order: str = "id") -> DataFrame:
    """String equality, commas aside, of extracted answers over an ordered slice of a benchmark."""
    rows = df.orderBy(order).limit(skip + most).offset(skip) if most else df
    return rows.agg(F.avg((F.coalesce(F.replace(first_answer(F.col(response)), F.lit(","), F.lit("")) == F.replace(gold, F.lit(","), F.lit("")), F.lit(False))).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def few_shot(df: DataFrame, order: str = "id", question: str = "question", answer: str = "answer", shots: int = 8, shown: int = 3, most: int | None = 100) -> DataFrame:
    """Rows behind the first `shots` by an order column, at most `most` of them, with `prompt`: the first `shown` rows with their answers, then the row's question. The report reads no more of a benchmark than this."""
    first = df.orderBy(order).limit(shots)
    head = first.orderBy(order).limit(min(shots, shown))
    line = F.concat(F.lit("Question: "), F.coalesce(question, F.lit("")), F.lit("\nAnswer: "))
    told = head.select(F.struct(F.col(order).alias("o"), F.concat(line, F.coalesce(answer, F.lit("")), F.lit("\n\n")).alias("t")).alias("x"))
    before = told.agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "").alias("_before"))  # of `shown` rows
    last = first.agg(F.max(order).alias("_last"))  # one row; the order column is a key
    rest = df.crossJoin(F.broadcast(last)).filter((F.col(order) > F.col("_last")) | F.lit(shots < 1)).drop("_last")
    return (rest.orderBy(order).limit(most) if most else rest).crossJoin(F.broadcast(before)).withColumn("prompt", F.concat("_before", line)).drop("_before")  # one row

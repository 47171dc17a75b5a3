"""Verifiable rewards: numbers, formats and the checkable part of code answers. Code is parsed, never run."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

from corpusmill.functions import text as T
from corpusmill.operators.metrics import first_answer

# Where a math answer stands.
MATH = (r"(?i)(?:the answer is|answer:|=)\s*([-+]?\d+\.?\d*)", r"(?i)\\boxed\{([-+]?\d+\.?\d*)\}", r"(?i)(?:therefore|thus|so),?\s*([-+]?\d+\.?\d*)\s*$", r"(?i)=\s*([-+]?\d+\.?\d*)\s*$")


def math_reward(response: Column, truth: Column) -> Column:
    """1 within less than one per cent (1e-6 near zero), else -0.5 * min(1, relative error); 0 without an answer or where either is no number. Commas in numbers don't count."""
    got = first_answer(response, MATH).try_cast("double")
    want = F.replace(truth, F.lit(","), F.lit("")).try_cast("double")
    off = F.abs(got - want)
    right = F.when(F.abs(want) < 1e-6, off < 1e-6).otherwise(off / F.abs(want) < 0.01)
    return F.when(want.isNull() | got.isNull(), 0.0).when(right, 1.0).otherwise(F.greatest(F.lit(-0.5), -0.5 * F.least(off / (F.abs(want) + 1e-8), F.lit(1.0))))


# Where the code of an answer stands.
FENCES = (r"(?s)```python\n(.*?)```", r"(?s)```\n(.*?)```", r"(?s)`(.*?)`")


def code_block(response: Column) -> Column:
    """The python fence, else a plain one, else inline code, else the whole answer; a fence may be empty."""
    out = None
    for pattern in FENCES:
        found = F.regexp_extract(response, pattern, 1)
        out = F.when(response.rlike(pattern), found) if out is None else out.when(response.rlike(pattern), found)
    return T.strip(out.otherwise(response))


@F.pandas_udf(t.BooleanType())
def parses(code: pd.Series) -> pd.Series:
    def one(c) -> bool:
        try:
            ast.parse(c or "")
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False

    return code.map(one)


@F.pandas_udf(t.BooleanType())
def valid_json(texts: pd.Series) -> pd.Series:
    """Strictly one JSON value and nothing after it; the built-in parsers stop at the first value's end."""

    def one(s) -> bool:
        try:
            json.loads(s)
            return True
        except (ValueError, TypeError, RecursionError):
            return False

    return texts.map(one)


def code_reward(response: Column, stdout: Column, truth: Column) -> Column:
    """-1 without code, -0.5 if it doesn't parse, -0.3 if the run failed (stdout is null); 1 for the true output, 0.5 if either holds the other, else 0.1."""
    code, out, want = code_block(response), T.strip(stdout), T.strip(F.coalesce(truth, F.lit("")))
    return F.when(F.coalesce(code, F.lit("")) == "", -1.0).when(~parses(code), -0.5).when(stdout.isNull(), -0.3).when(out == want, 1.0).when(F.contains(want, out) | F.contains(out, want), 0.5).otherwise(0.1)


def format_reward(response: Column, kind: Column) -> Column:
    rows = F.split(T.strip(response), "\n")
    bullets = F.size(F.filter(rows, lambda x: T.strip(x).rlike(r"^[-•*·]"))) / F.greatest(F.size(rows), F.lit(1))
    n = F.size(T.words(response))
    concise = F.when(n <= 50, 1.0).when(n <= 100, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - (n - 100) / 200))
    valid = valid_json(response)
    k = F.lower(kind)
    return F.when(k == "json", valid.cast("double")).when(k == "bullet_list", F.least(F.lit(1.0), bullets * 2)).when(k == "concise", concise).otherwise(0.0)


def passed(score: Column, task: Column) -> Column:
    """Whether an answer counts as right: a full reward, for formats 0.8 of it."""
    return score >= F.when(task == "format", 0.8).otherwise(1.0)


def reward(task: Column, response: Column, truth: Column, stdout: Column) -> Column:
    return F.when(task == "math", math_reward(response, truth)).when(task == "code", code_reward(response, stdout, truth)).when(task == "format", format_reward(response, truth)).otherwise(0.0)

"""Hooks for language-model steps. Without a model each step takes its deterministic branch, so every plan runs alone."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quire.operators.shared import with_python_column

# Fixed values of the task: words of an error after which a call is worth repeating.
RETRY = ["429", "503", "quota", "resource_exhausted", "unavailable", "connection", "timeout", "network", "reset", "refused", "broken pipe"]


def is_retriable(code: Column, message: Column) -> Column:
    return F.coalesce(code.isin(429, 503), F.lit(False)) | F.coalesce(F.lower(message).rlike("|".join(RETRY)), F.lit(False))


def first_json(text: str | None) -> str | None:
    """The first JSON object, else array, in an answer, code fences aside; null where there is none."""
    if not text:
        return None
    bare = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text.strip())).strip()
    try:
        return json.dumps(json.loads(bare))
    except ValueError:
        pass
    decoder = json.JSONDecoder()
    for sign in "{[":
        at = bare.find(sign)
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(bare, at)[0])
            except ValueError:
                at = bare.find(sign, at + 1)
    return None


def ask(df: DataFrame, prompt_col: str, out_col: str, schema: StructType, call: Callable[[str], str] | None = None, tries: int = 5) -> DataFrame:
    """`df` with `out_col`, the model's answer to each prompt as a struct; null for a null prompt, a failed call, an answer
    that is no JSON, and everywhere if there is no model."""

    def answer(prompt: str | None) -> str | None:
        if prompt is None or call is None:
            return None
        for _ in range(tries):
            try:
                return first_json(call(prompt))
            except Exception as e:
                if not any(w in str(e).lower() for w in RETRY):
                    return None
        return None

    return with_python_column(df, [prompt_col], out_col, StringType(), answer).withColumn(out_col, F.from_json(out_col, schema))


def known_link(links: Column, proposed: Column) -> Column:
    """A proposed address if the page links to it, else the first link: a model cannot invent one."""
    return F.when(F.array_contains(links, proposed), proposed).otherwise(F.try_element_at(links, F.lit(1)))


def accepted(text: Column, confidence: Column) -> Column:
    """Extracted text if it is long and sure enough, else null."""
    return F.when((F.length(F.trim(text)) >= 150) & (confidence >= 0.3), text)


def clamped(confidence: Column) -> Column:
    return F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))


def updated_selectors(current: Column, safe: Column, add: Column, dangerous: Column) -> Column:
    """(current and safe) or (add without dangerous), each once."""
    empty = F.array().cast("array<string>")
    c, s, a, d = (F.coalesce(x, empty) for x in (current, safe, add, dangerous))
    return F.array_union(F.array_intersect(c, s), F.array_except(a, d))

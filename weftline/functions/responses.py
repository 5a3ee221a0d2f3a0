"""Model responses and prompts: parsing with error classes, marks, blueprints, generation, counters."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.conversations import PROMPTS

#: Fixed error names.
EMPTY_RESPONSE, JSON_ERROR, EMPTY_OUTPUT, IMAGE_ERROR = "empty_response", "json_error", "empty_output", "image_load_error"


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("json", "text", "error")]))
def parse_response(response: pd.Series) -> pd.DataFrame:
    """Text behind the first </think>; error is null, empty_response or json_error: ..."""

    def one(text):
        text = (text or "").strip()
        if "</think>" in text:
            text = text.split("</think>", 1)[1].strip()
        if not text:
            return None, text, EMPTY_RESPONSE
        try:
            return _dump(json.loads(text)), text, None
        except ValueError as e:
            return None, text, f"{JSON_ERROR}: {e}"

    return pd.DataFrame([one(x) for x in response], columns=["json", "text", "error"])


def strip_marks(text: Column) -> Column:
    """The user's prompt without chat marks."""
    c = F.regexp_replace(text, r"(?s)^.*?<\|im_start\|>user", "")
    for mark in ("<|im_start|>assistant", "<|im_end|>"):
        c = F.substring_index(c, mark, 1)
    for mark in ("<|vision_start|>", "<|vision_end|>", "<|image_pad|>", "</s>", "<|endoftext|>"):
        c = F.replace(c, F.lit(mark), F.lit(""))
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def without_role(text: Column) -> Column:
    """A ground truth without the role line in front."""
    return F.regexp_replace(text, r"^assistant\n", "")


@F.pandas_udf(T.StringType())
def _json_or_null(text: pd.Series) -> pd.Series:
    def one(x):
        try:
            return None if x is None else _dump(json.loads(x))
        except ValueError:
            return None

    return text.map(one)


def blueprint_of(prompt: Column) -> Column:
    """The blueprint's JSON behind the mark of a prompt; null without the mark or if malformed."""
    at = F.instr(prompt, PROMPTS["blueprint"])
    return _json_or_null(F.when(at > 0, F.substring(prompt, at + len(PROMPTS["blueprint"]), F.length(prompt))))


def generate(samples: DataFrame, model: Callable[[pd.DataFrame], list], batch: int = 32) -> DataFrame:
    """Adds response, error, prompt_tokens and completion_tokens from a model, in batches within each task.

    model: called with up to ``batch`` rows, gives for each a text, or (text, prompt tokens,
    completion tokens), or an exception.  A row's failure is its own: a call that fails is
    repeated row by row.  Empty texts are errors; failures to load an image are named so.
    """
    added = ("response", "error", "prompt_tokens", "completion_tokens")
    samples_ = samples.drop(*added)  # given to the model, replaced in the result
    columns = samples_.columns
    schema = T.StructType(samples_.schema.fields + [T.StructField("response", T.StringType()), T.StructField("error", T.StringType()), T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType())])

    def told(x) -> tuple:
        if isinstance(x, Exception):
            name = IMAGE_ERROR if isinstance(x, OSError) else type(x).__name__
            return None, f"{name}: {x}", None, None
        text, *n = x if isinstance(x, tuple) else (x,)
        n = (*n, None, None)[:2]
        return (text, None, *n) if text and text.strip() else (text, EMPTY_OUTPUT, *n)

    def called(part: pd.DataFrame) -> list:
        try:
            return list(model(part))
        except Exception as e:  # the model is a plug-in; its errors become rows
            return [e] if len(part) == 1 else [x for i in range(len(part)) for x in called(part.iloc[i : i + 1])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                own = part.iloc[at : at + batch].reset_index(drop=True)
                got = pd.DataFrame([told(x) for x in called(own)], columns=list(added))
                yield pd.concat([own[columns], got.astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})], axis=1)

    return samples.mapInPandas(run, schema)


def run_counters(responses: DataFrame) -> DataFrame:
    """One row of a run from (json, text, error) and, where they exist, generation errors and token counts.

    successful: generated at all (no ``generation_error``); of these json_parsed, json_failed and empty.
    """
    has = lambda c: c in responses.columns
    fine = F.col("generation_error").isNull() if has("generation_error") else F.lit(True)
    ok, total = F.col("error").isNull(), lambda c: F.coalesce(F.sum(c), F.lit(0)) if has(c) else F.lit(0).cast("long")
    return responses.agg(F.count("*").alias("total"), F.count_if(fine).alias("successful"), F.count_if(~fine).alias("failed"), F.count_if(fine & ok).alias("json_parsed"), F.count_if(fine & F.col("error").startswith(JSON_ERROR)).alias("json_failed"), F.count_if(fine & (F.col("error") == EMPTY_RESPONSE)).alias("empty"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"))


def contour_report(responses: DataFrame, column: str = "response") -> DataFrame:
    """(format, n_slices, n_contours, error) of contour responses."""
    x = responses.withColumn("_p", parse_response(column))
    slices = F.from_json(F.get_json_object("_p.json", "$.slices"), "array<struct<y:double,contours:array<string>>>")
    n = F.aggregate(slices, F.lit(0), lambda a, s: a + F.greatest(F.size(s["contours"]), F.lit(0)))
    return x.withColumns({"format": F.get_json_object("_p.json", "$.format"), "n_slices": F.size(slices), "n_contours": n, "error": F.col("_p.error")}).drop("_p")


def preview(messages: Column) -> Column:
    """The text of the first message; of typed parts the texts, joined by spaces (P17). messages: array of (role, content parts)."""
    texts = F.filter(F.transform(F.get(messages, 0)["content"], lambda c: c["text"]), lambda t: F.coalesce(F.length(t) > 0, F.lit(False)))
    return F.when(F.size(messages) > 0, F.array_join(texts, " ")).otherwise("")

"""Sinks of an inference run."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.responses import parse_response, run_counters, without_role
from weftline.sinks.datasets import save_each, write_json


def with_blueprint(data: Column, blueprint: Column, compact: bool = True) -> Column:
    """A prediction's JSON, the blueprint put first where there is one and the prediction is an object."""

    @F.pandas_udf("string")
    def run(d: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for text, plan in zip(d, b, strict=True):
            if text is None:
                out.append(None)
                continue
            value = json.loads(text)
            if plan is not None and isinstance(value, dict):
                value = {"blueprint": json.loads(plan)} | value
            out.append(json.dumps(value, ensure_ascii=False, **({"separators": (",", ":")} if compact else {"indent": 2})))
        return pd.Series(out, dtype=object)

    return run(data, blueprint)


def condition_asset(rows: DataFrame) -> DataFrame:
    """(uid, suffix, asset): the condition of each sample as a file - a text or the blueprint's JSON; images keep their own file."""
    kind = F.col("condition_type")
    suffix = F.when(kind == "text", ".txt").when(kind == "blueprint", ".json").otherwise(".path")
    return rows.where(F.col("condition").isNotNull()).select("uid", suffix.alias("suffix"), F.col("condition").alias("asset"))


def save_run(responses: DataFrame, folder: str, settings: dict | None = None, compact: bool = True) -> dict:
    """Writes a run of generated rows (uid, response, error, and prompt_tokens, completion_tokens, condition, ground_truth if any).

    responses/: all rows as JSON lines; json/: parsed predictions; failed/: texts that are no JSON;
    ground_truth/: truths without their role line; conditions/: assets; generation_stats.json: the
    counters and settings, which are returned.
    """
    top = folder.rstrip("/")
    rows = responses.withColumnRenamed("error", "generation_error").withColumn("_p", parse_response("response"))
    rows = rows.select("*", F.col("_p.json").alias("json"), F.col("_p.text").alias("text"), F.col("_p.error").alias("error")).drop("_p")
    rows.write.mode("overwrite").json(f"{top}/responses")
    own = rows.withColumn("_out", with_blueprint(F.col("json"), F.when(F.col("condition_type") == "blueprint", F.col("condition")) if "condition_type" in rows.columns else F.lit(None).cast("string"), compact))
    save_each(own.where("json is not null"), f"{top}/json", "uid", "_out")
    save_each(rows.where("json is null and error is not null and generation_error is null"), f"{top}/failed", "uid", "text", ".txt")
    if "ground_truth" in rows.columns:
        save_each(rows.withColumn("_g", without_role(F.col("ground_truth"))), f"{top}/ground_truth", "uid", "_g")
    if "condition" in rows.columns:
        assets = condition_asset(rows)
        for suffix in (".txt", ".json"):
            save_each(assets.where(F.col("suffix") == suffix), f"{top}/conditions", "uid", "asset", suffix)
    counters = run_counters(rows).first().asDict() | (settings or {})
    write_json(rows.sparkSession, f"{top}/generation_stats.json", counters)
    return counters

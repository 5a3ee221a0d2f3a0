"""Scene documents to chat conversations, one builder for all modes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed prompt texts.
PROMPTS = {
    "caption": "Generate a 3D scene in JSON format based on the following description:\n",
    "blueprint": "Generate 3D objects for the following room blueprint:\n",
    "unconditional": "Generate a 3D scene in JSON format:",
    "contour": "Generate B-spline contour slices for a 3D shape in UDF contour token format:",
    "panorama": "Based on this panorama image, generate a 3D scene in JSON format:",
    "multi_view": "Based on these {n} multi-view images, generate a 3D scene in JSON format:",
    "multi_view_inference": "Based on these multi-view images, generate a 3D scene in JSON format:",
}
MULTI_VIEW = ("multi_view", "multi_view2", "multi_view3")
MODES = ("unconditional", "blueprint", "caption", "panorama", *MULTI_VIEW, "contour")
MESSAGES = "array<struct<role:string,content:string>>"


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def compact_json(raw: pd.Series) -> pd.Series:
    """Compact text of a JSON document, keys and number texts as a JSON round trip gives them; null if unparsable."""

    def one(text):
        try:
            return None if text is None else _dump(json.loads(text))
        except ValueError:
            return None

    return raw.map(one)


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("blueprint", "objects")]))
def blueprint_parts(raw: pd.Series) -> pd.DataFrame:
    """The blueprint and the object_* entries of a scene, in document order."""

    def one(text):
        try:
            scene = json.loads(text) if text is not None else None
        except ValueError:
            scene = None
        if not isinstance(scene, dict):
            return None, None
        objects = {k: v for k, v in scene.items() if k.startswith("object_")}
        return (_dump(scene["blueprint"]) if scene.get("blueprint") else None, _dump(objects) if objects else None)

    return pd.DataFrame([one(x) for x in raw], columns=["blueprint", "objects"])


def _filled(column: Column) -> Column:
    return column.isNotNull() & ~column.isin("", "{}", "[]", "null", '""', "0", "false")


def build(scenes: DataFrame, mode: str) -> DataFrame:
    """Adds ``messages``, and ``num_images`` in modes with images; rows whose condition or answer is empty go, but not in unconditional mode."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    kind = "multi_view" if mode in MULTI_VIEW else mode
    if kind == "blueprint":
        rows = scenes.withColumn("_p", blueprint_parts("raw"))
        rows = rows.where(_filled(F.col("_p.blueprint")) & _filled(F.col("_p.objects")))
        ask, answer = F.concat(F.lit(PROMPTS[kind]), F.col("_p.blueprint")), F.col("_p.objects")
    else:
        rows = scenes.withColumn("_p", compact_json("raw")).where(F.col("_p").isNotNull())
        answer, ask = F.col("_p"), F.lit(PROMPTS[kind])
        if kind in ("caption", "panorama", "multi_view"):
            rows = rows.where(_filled(F.col("_p")))
        if kind == "caption":
            rows = rows.where(F.coalesce(F.length("caption"), F.lit(0)) > 0)
            ask = F.concat(ask, F.col("caption"))
        elif kind == "panorama":
            rows = rows.where(F.coalesce(F.length("image_path"), F.lit(0)) > 0).withColumn("num_images", F.lit(1))
        elif kind == "multi_view":
            rows = rows.where(F.coalesce(F.size("image_paths"), F.lit(0)) > 0).withColumn("num_images", F.size("image_paths"))
            before, after = PROMPTS[kind].split("{n}")
            ask = F.concat(F.lit(before), F.size("image_paths").cast("string"), F.lit(after))
    turns = F.array(F.struct(F.lit("user").alias("role"), ask.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return rows.withColumn("messages", turns.cast(MESSAGES)).drop("_p")


def with_images(messages: Column, n: Column) -> Column:
    """Content of each message as typed parts; the first message, if it is the user's, gets ``n`` image parts in front."""
    part = "array<struct<type:string,text:string>>"
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))

    def one(m, i):
        text = F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"))).cast(part)
        return F.struct(m["role"].alias("role"), F.when((i == 0) & (m["role"] == "user"), F.concat(F.array_repeat(image, n).cast(part), text)).otherwise(text).alias("content"))

    return F.transform(messages, one)

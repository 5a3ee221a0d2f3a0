"""Inference records from files, prompts and images, and the samples built from them.

A record is a row of strings: messages (JSON), id, filename, prompt, instruction, caption,
description, blueprint, plan, image_path, image, image_file, tags, ground_truth, image_paths, and
its provenance __source_path, __source_dir and __row_id.  Fields of a file that are not among
these do not come along.  An empty text counts as missing, as do JSON's empty values.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.responses import preview
from weftline.operators.conversations import PROMPTS, with_images
from weftline.sources import files

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "webp")
TEXTS = ("messages", "id", "filename", "prompt", "instruction", "caption", "description", "blueprint", "plan", "image_path", "image", "image_file", "tags", "ground_truth")
MODES = ("unconditional", "caption", "blueprint", "panorama", "multi_view")
ITEM = "image_paths array<string>, " + ", ".join(f"{c} string" for c in TEXTS)


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _items(suffix: str, raw: str) -> list[dict]:
    if suffix == "txt":
        return [{"prompt": x.strip()} for x in raw.splitlines() if x.strip()]
    if suffix in ("jsonl", "ndjson"):
        return [json.loads(x) for x in raw.splitlines() if x.strip()]
    data = json.loads(raw)
    if not isinstance(data, (dict, list)):
        raise ValueError("a JSON file holds an object or a list")
    return data if isinstance(data, list) else [data]


def from_files(rows: DataFrame) -> DataFrame:
    """Records of files (path, raw), by suffix: .json an object or a list, .jsonl and .ndjson lines, .txt prompts.

    Malformed content and other suffixes fail the job: a lost record would not be seen.
    """
    columns = ["__source_path", "__source_dir", "_at", "image_paths", *TEXTS]

    def run(batches):
        for part in batches:
            out = []
            for path, raw in zip(part["path"], part["raw"], strict=True):
                suffix = path.rsplit(".", 1)[-1].lower()
                if suffix not in ("json", "jsonl", "ndjson", "txt"):
                    raise ValueError(f"unsupported file type: {path}")
                out += [(path, path.rsplit("/", 1)[0], i, x.get("image_paths"), *(_text(x.get(c)) for c in TEXTS)) for i, x in enumerate(_items(suffix, raw))]
            yield pd.DataFrame(out, columns=columns)

    return rows.select("path", "raw").mapInPandas(run, "__source_path string, __source_dir string, _at long, " + ITEM)


def from_prompt(spark: SparkSession, prompt: str) -> DataFrame:
    empty = [F.lit(None).cast("array<string>" if c == "image_paths" else "string").alias(c) for c in ("__source_path", "__source_dir", "image_paths", *TEXTS) if c != "prompt"]
    return spark.range(1).select(F.lit(prompt).alias("prompt"), F.lit(0).cast("long").alias("_at"), *empty)


def from_images(images: DataFrame, mode: str, prompt: str | None = None) -> DataFrame:
    """Records of image files (path): one an image for panorama, one a folder for multi_view; by the extension whitelist."""
    if mode not in ("panorama", "multi_view"):
        raise ValueError("images go with mode panorama or multi_view only")
    own = images.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_EXTENSIONS)).withColumn("__source_dir", F.regexp_extract("path", r"^(.*)/[^/]+$", 1))
    if mode == "multi_view":
        rows = own.groupBy("__source_dir").agg(F.array_sort(F.collect_list("path")).alias("image_paths"))
        rows = rows.select(F.col("__source_dir").alias("__source_path"), "__source_dir", "image_paths", F.regexp_extract("__source_dir", r"([^/]+)$", 1).alias("id"))
    else:
        rows = own.select(F.col("path").alias("__source_path"), "__source_dir", F.col("path").alias("image_path"), files.stem_of(F.col("path")).alias("filename"))
    rows = rows.withColumns({"prompt": F.lit(prompt).cast("string"), "_at": F.lit(0).cast("long")})
    return rows.withColumns({c: F.lit(None).cast("array<string>" if c == "image_paths" else "string") for c in ("image_paths", *TEXTS) if c not in rows.columns})


def load(spark: SparkSession, mode: str, input_path: str | None = None, prompt: str | None = None, image_path: str | None = None, image_dir: str | None = None) -> DataFrame:
    """Records of a file or folder (.json before .jsonl, by name), of a prompt, and of images, numbered in this order."""
    from weftline.operators.ranks import ranked

    parts = []
    if input_path:
        folder = files.exists(spark, input_path) and not input_path.rsplit("/", 1)[-1].count(".")
        found = files.texts(spark, input_path, "*.{json,jsonl}" if folder else "*")
        if found.isEmpty():
            raise ValueError(f"no JSON or JSONL files in {input_path}")
        parts.append(from_files(found))
    elif prompt is not None and not (image_path or image_dir):
        parts.append(from_prompt(spark, prompt))
    if image_path:
        parts.append(from_images(files.listing(spark, image_path, "*"), mode, prompt))
    if image_dir:
        parts.append(from_images(files.listing(spark, image_dir, "*"), mode, prompt))
    if not parts:
        raise ValueError("give an input path, a prompt, an image or a folder of images")
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    if out.isEmpty():
        raise ValueError("no valid records")
    suffix = F.when(F.lower("__source_path").endswith(".json"), 0).otherwise(1)
    out = out.withColumn("_suffix", F.when(F.col("_part") == 0, suffix).otherwise(0))
    return ranked(out, (), ["_part", "_suffix", "__source_path", "_at"], "__row_id").drop("_part", "_suffix", "_at")


def either(*names: str) -> Column:
    """The first of these fields that is not empty."""
    return F.coalesce(*[F.when(~F.coalesce(F.col(c), F.lit("")).isin("", "{}", "[]", "null", '""'), F.col(c)) for c in names])


def uid() -> Column:
    """id, or the stem of filename, or sample_ and the row's number in six digits."""
    return F.coalesce(either("id"), files.stem_of(either("filename")), F.format_string("sample_%06d", F.col("__row_id")))


def resolved(path: Column, image_root: str | None = None) -> Column:
    """An absolute path as it is; a relative one below the record's own folder, or below the image root."""
    base = F.coalesce(F.when(F.length("__source_dir") > 0, F.col("__source_dir")), F.lit(image_root))
    return F.when(path.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:/)"), path).otherwise(F.concat(F.coalesce(F.concat(base, F.lit("/")), F.lit("")), path))


def samples(records: DataFrame, mode: str, image_root: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """(uid, messages, prompt_preview, image_path, image_paths, num_images, condition_type, condition, ground_truth, metadata, reject).

    messages: array of (role, content parts).  reject says why a record cannot be used, and is null
    for samples; ``valid`` and ``rejected`` part them.  known: (path) of existing images; without it
    images are not looked for.
    """
    if mode not in MODES:
        raise ValueError(f"unsupported mode {mode!r}; known: {', '.join(MODES)}")
    given = F.from_json(either("messages"), "array<struct<role:string,content:string>>")
    kind = {"blueprint": "blueprint", "panorama": "panorama", "multi_view": "multi_view"}.get(mode, "text")
    image, plan = either("image_path", "image", "image_file"), either("blueprint", "plan")
    if mode == "unconditional":
        ask, fault = F.coalesce(either("prompt", "instruction"), F.lit(PROMPTS["unconditional"])), F.lit(None)
        raw = either("prompt", "instruction")
    elif mode == "caption":
        raw = either("caption", "description", "prompt")
        ask, fault = F.concat(F.lit(PROMPTS["caption"]), raw), F.when(raw.isNull(), "no caption, description or prompt to ask with")
    elif mode == "blueprint":
        raw = plan
        ask = F.concat(F.lit(PROMPTS["blueprint"]), raw)
        fault = F.when(raw.isNull(), "neither a blueprint nor a plan is given").when(~raw.startswith("{"), "the blueprint is no JSON object")
    elif mode == "panorama":
        raw = image
        ask, fault = F.coalesce(either("prompt"), F.lit(PROMPTS["panorama"])), F.when(raw.isNull(), "no image is named")
    else:
        raw = F.when(F.size("image_paths") > 0, F.to_json("image_paths"))
        ask, fault = F.coalesce(either("prompt"), F.lit(PROMPTS["multi_view_inference"])), F.lit(None)
    own = F.array(F.struct(F.lit("user").alias("role"), ask.alias("content")))
    at = resolved(image, image_root)
    paths = F.when(F.size("image_paths") > 0, F.transform("image_paths", lambda p: resolved(p, image_root)))
    rows = records.withColumns({"_given": given, "uid": uid(), "_image": F.when(image.isNotNull() if mode in ("panorama",) else image.isNotNull() & given.isNotNull(), at), "_paths": paths, "_raw": F.when(given.isNull(), ask).otherwise(raw) if kind == "text" else raw, "_fault": F.when(given.isNull(), fault)})
    rows = rows.withColumn("_m", F.coalesce("_given", own)).withColumn("num_images", F.when(F.size("_paths") > 0, F.size("_paths")).when(F.col("_image").isNotNull(), 1).otherwise(0))
    rows = rows.withColumn("messages", with_images(F.col("_m"), F.col("num_images")))
    rows = rows.withColumn("prompt_preview", preview(F.col("messages")))
    if known is not None:
        ours = F.array_compact(F.concat(F.coalesce("_paths", F.array().cast("array<string>")), F.array("_image")))
        there = known.select(F.regexp_replace("path", "^file:/+", "/").alias("_path")).distinct()
        asked = rows.select("__row_id", F.explode(ours).alias("_p")).withColumn("_path", F.regexp_replace("_p", "^file:/+", "/"))
        lost = asked.join(there, "_path", "left_anti").groupBy("__row_id").agg(F.min("_p").alias("_lost"))
        rows = rows.join(lost, "__row_id", "left").withColumn("_fault", F.coalesce("_fault", F.concat(F.lit("no such image: "), "_lost")))
    condition = F.coalesce("_raw", F.when(F.length("prompt_preview") > 0, F.col("prompt_preview"))) if kind == "text" else F.col("_raw")
    rows = rows.withColumn("condition", F.when(F.lit(kind == "panorama"), F.col("_image")).when(F.lit(kind == "multi_view"), F.to_json("_paths")).otherwise(condition))
    need = {"text": "there is no text to ask with", "blueprint": "the condition is no JSON object"}.get(kind)
    fault = F.coalesce("_fault", F.when(F.col("condition").isNull() | (F.lit(kind == "blueprint") & ~F.col("condition").startswith("{")), F.lit(need))) if need else F.col("_fault")
    metadata = F.map_filter(F.create_map(F.lit("source_path"), F.col("__source_path"), F.lit("extra_tags"), F.col("tags")), lambda k, v: v.isNotNull())
    return rows.select("uid", "messages", "prompt_preview", F.col("_image").alias("image_path"), F.col("_paths").alias("image_paths"), "num_images", F.lit(kind).alias("condition_type"), "condition", "ground_truth", metadata.alias("metadata"), fault.alias("reject"))


def valid(samples_: DataFrame) -> DataFrame:
    return samples_.where(F.col("reject").isNull()).drop("reject")


def rejected(samples_: DataFrame) -> DataFrame:
    return samples_.where(F.col("reject").isNotNull()).select("uid", "reject")


def resolution_of(text: Column) -> Column:
    """struct(width, height) of a text like 640x480, in either case; null if it is anything else (P20)."""
    w, h = (F.regexp_extract(text, r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$", i) for i in (1, 2))
    return F.when(F.length(w) > 0, F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))


def is_vision_model(name: str) -> bool:
    """Does a model's name say that it reads images?"""
    return any(x in name.lower() for x in ("vl", "vision"))

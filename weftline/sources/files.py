"""File scans and pairings (S1-S11, S31, J1-J4, O7), as DataFrames with stem, path and raw text.

A scan keeps whole texts and leaves key order and number texts as they are.  Malformed files are
left out by ``json_files`` and told by ``malformed``; nulls do not occur.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ranks import drawn
from weftline.scratch import hadoop_file

#: Fixed layouts of image folders by mode: the path below the image folder, from the scene's stem on.
LAYOUTS = {"panorama": r"([^/]+)/panorama/panorama_rgb\.png$", "multi_view": r"([^/]+)/orbit/orbit_[^/]*\.png$", "multi_view2": r"([^/]+)/[^/]+\.png$", "multi_view3": r"([^/]+)/front\.png$"}
#: Side-car files that are no scenes.
SIDE_CARS = ("processed.json", "categories_done.json")
VIEWS = (4, 8)


def stem_of(path) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def exists(spark: SparkSession, path: str) -> bool:
    at, files = hadoop_file(spark, path)
    return files.exists(at)


def texts(spark: SparkSession, folder: str, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """(path, stem, raw): whole files."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    rows = reader.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return rows.select("path", stem_of(F.col("path")).alias("stem"), "raw")


@F.pandas_udf(T.BooleanType())
def is_json(raw: pd.Series) -> pd.Series:
    """Is the text JSON as a lenient parser reads it (NaN and repeated keys pass)?"""

    def one(text):
        try:
            json.loads(text)
            return True
        except (ValueError, TypeError):
            return False

    return raw.map(one)


def json_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, stem, raw) of the readable JSON files of a folder; an error where it is missing or has none."""
    if not exists(spark, folder):
        raise FileNotFoundError(f"no folder {folder}")
    rows = texts(spark, folder, "*.json", recursive)
    if rows.isEmpty():
        raise ValueError(f"no JSON files in {folder}")
    return rows.where(is_json("raw"))


@F.pandas_udf(T.StringType())
def _fault(raw: pd.Series) -> pd.Series:
    """Why a text is no JSON; null if it is."""

    def one(text):
        try:
            json.loads(text)
            return None
        except (ValueError, TypeError) as e:
            return str(e) if text is not None else "no text"

    return raw.map(one)


def malformed(files: DataFrame) -> DataFrame:
    """(path): the files of ``texts`` that are no JSON."""
    return files.where(~is_json("raw")).select("path")


def first_errors(files: DataFrame, n: int = 10) -> DataFrame:
    """(path, reason): the first malformed files by path, and where their texts go wrong."""
    return files.select("path", _fault("raw").alias("reason")).where(F.col("reason").isNotNull()).orderBy("path").limit(n)


def listing(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(path, stem, parent, size) of files, contents unread."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return rows.select("path", stem_of(F.col("path")).alias("stem"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"), F.col("length").alias("size"))


def caption_pairs(captions: DataFrame, scenes: DataFrame) -> DataFrame:
    """Inner join on stem; captions stripped."""
    own = captions.select("stem", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("caption"))
    return scenes.join(own, "stem")


def scene_images(images: DataFrame, mode: str) -> DataFrame:
    """(stem, path) of the images that a mode's layout gives to scenes; images: (path) below the image folder."""
    if mode not in LAYOUTS:
        raise ValueError(f"mode {mode!r} has no images; known: {', '.join(LAYOUTS)}")
    stem = F.regexp_extract("path", LAYOUTS[mode], 1)
    return images.select(stem.alias("stem"), "path").where(F.length("stem") > 0)


def image_pairs(scenes: DataFrame, images: DataFrame, mode: str, views: tuple[int, int] = VIEWS, seed: int = 0) -> DataFrame:
    """Scenes with their images: ``image_path`` (panorama), or ``image_paths`` of the views.

    multi_view and multi_view2 need views[0] images; of more a number up to views[1] is drawn, and
    the views themselves, by keyed hashes of scene and path.  multi_view3 has its one front view.
    """
    own = scene_images(images, mode)
    if mode == "panorama":
        return scenes.join(own.groupBy("stem").agg(F.min("path").alias("image_path")), "stem")
    if mode == "multi_view3":
        return scenes.join(own.groupBy("stem").agg(F.array(F.min("path")).alias("image_paths")), "stem")
    sets = view_sets(own.withColumnRenamed("stem", "parent"), *views, seed).withColumnRenamed("parent", "stem")
    return scenes.join(sets, "stem")


def unpaired(scenes: DataFrame, paired: DataFrame) -> DataFrame:
    """(stem): scenes without a partner."""
    return scenes.select("stem").join(paired.select("stem"), "stem", "left_anti")


def view_sets(images: DataFrame, least: int = 4, most: int | None = None, seed: int = 0) -> DataFrame:
    """(parent, image_paths): sets of at least ``least`` images; from least to ``most`` of them by keyed hashes."""
    sets = images.groupBy("parent").agg(F.array_sort(F.collect_list("path")).alias("image_paths")).where(F.size("image_paths") >= least)
    if most is None:
        return sets
    order = F.array_sort(F.transform("image_paths", lambda p: F.struct(drawn(p, seed).alias("h"), p.alias("p"))))
    top = F.least(F.size("image_paths"), F.lit(most))
    n = F.pmod(F.conv(F.substring(drawn(F.col("parent"), seed), 1, 8), 16, 10).cast("long"), top - least + 1).cast("int") + least
    return sets.select("parent", F.slice(order["p"], F.lit(1), n).alias("image_paths"))


def eligible(scenes: DataFrame, mode: str, captions: DataFrame | None = None, images: DataFrame | None = None, least: int = VIEWS[0]) -> DataFrame:
    """The scenes that a mode can use, before they are numbered in batches: semi-joins on captions or images."""
    if mode == "caption":
        return scenes.join(captions.select("stem"), "stem", "left_semi")
    if mode not in LAYOUTS:
        return scenes
    own = scene_images(images, mode).groupBy("stem").agg(F.count("*").alias("n"))
    return scenes.join(own.where(F.col("n") >= (least if mode in ("multi_view", "multi_view2") else 1)), "stem", "left_semi")


def load_by_mode(spark: SparkSession, mode: str, json_dir: str, caption_dir: str | None = None, image_dir: str | None = None, views: tuple[int, int] = VIEWS, seed: int = 0) -> DataFrame:
    """The paired scenes of a mode: (stem, path, raw) and caption, image_path or image_paths; errors name what is missing."""
    scenes = json_files(spark, json_dir)
    if mode in ("unconditional", "blueprint", "contour"):
        return scenes
    if mode == "caption":
        if not caption_dir:
            raise ValueError("caption mode needs caption_dir")
        out = caption_pairs(texts(spark, caption_dir, "*.txt"), scenes)
    elif mode in LAYOUTS:
        if not image_dir:
            raise ValueError(f"{mode} mode needs image_dir")
        out = image_pairs(scenes, listing(spark, image_dir), mode, views, seed)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if out.isEmpty():
        raise ValueError(f"no pairs for mode {mode}")
    return out


def first_by_name(files: DataFrame, skip: tuple[str, ...] = SIDE_CARS) -> DataFrame:
    """One row a file name: the first path wins; side-car names go."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    order = Window.partitionBy("name").orderBy("path")
    return files.withColumn("name", name).where(~F.col("name").isin(*skip)).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """One prompt per non-blank line."""
    return spark.read.text(path).select(F.trim("value").alias("prompt")).where(F.length("prompt") > 0)


_FACTORY = re.compile(r"\d+_\w+Factory\Z")


def renamed_keys(scene):
    """Top-level keys like 12_BedFactory become object_1, object_2, ... in their order; all others stay."""
    if not isinstance(scene, dict):
        return scene
    numbers = iter(range(1, len(scene) + 1))
    return {f"object_{next(numbers)}" if _FACTORY.match(str(k)) else k: v for k, v in scene.items()}


def rounded(value, precision: int):
    """All floats rounded, half to even on their binary value; everything else as it is."""
    if isinstance(value, float):
        return round(value, precision)
    if isinstance(value, dict):
        return {k: rounded(v, precision) for k, v in value.items()}
    return [rounded(v, precision) for v in value] if isinstance(value, list) else value


def converted(files: DataFrame, precision: int | None = None, rename: bool = True, indent: int | None = 2) -> DataFrame:
    """Scenes in YAML (of which JSON is a part) as JSON text: (path, stem, raw), raw null where it cannot be read."""

    def one(text):
        import yaml

        try:
            scene = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
            scene = renamed_keys(scene) if rename else scene
            scene = scene if precision is None else rounded(scene, precision)
            return json.dumps(scene, ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"))
        except (yaml.YAMLError, TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(one)

    return files.select("path", "stem", run("raw").alias("raw"))


def yaml_files(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "*.{yaml,yml}")


def load_config(path: str, required: tuple[str, ...] = ()) -> dict:
    """A YAML file of settings, on the driver; dotted names of required keys that are missing are an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f) or {}
    return checked_config(config, required)


def checked_config(config: dict, required: tuple[str, ...]) -> dict:
    def held(name):
        at = config
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return False
            at = at[part]
        return True

    missing = [name for name in required if not held(name)]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return config

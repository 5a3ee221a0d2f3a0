"""Profiles of JSON files: rooms, keys, structure, quality, and matching by content."""

from __future__ import annotations

import hashlib
import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline import stores
from weftline.scratch import written

#: Files by name whose keys are compared for consistency, and keys that count as frequent.
FIRST, TOP = 100, 20


def room_count(raw: Column) -> Column:
    """Rooms of a scene's blueprint: 0 where there is none, null where the text is no JSON."""
    scene = F.try_parse_json(raw)
    rooms = F.try_variant_get(scene, "$.blueprint.rooms", "string")
    n = F.coalesce(F.size(F.json_object_keys(rooms)), F.json_array_length(rooms), F.lit(0))
    return F.when(scene.isNotNull(), n)


def single_room(files: DataFrame, most: int = 1) -> DataFrame:
    """Files of at most so many rooms; unreadable ones stay. The files themselves are not touched."""
    return files.where(~F.coalesce(room_count(F.col("raw")) > most, F.lit(False)))


def room_distribution(files: DataFrame) -> DataFrame:
    """(rooms, n, percent) over readable files."""
    by = files.select(room_count(F.col("raw")).alias("rooms")).where(F.col("rooms").isNotNull()).groupBy("rooms").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("all"))
    return by.crossJoin(F.broadcast(total)).select("rooms", "n", (100 * F.col("n") / F.col("all")).alias("percent"))  # one row


@F.pandas_udf(T.LongType())
def _length(raw: pd.Series) -> pd.Series:
    """The length of a text after a JSON round trip; null if it is malformed.  Only Python writes numbers as these lengths have them."""

    def one(text):
        try:
            return len(json.dumps(json.loads(text), ensure_ascii=False))
        except (ValueError, TypeError):
            return None

    return raw.map(one).astype("Int64")


def _keys(raw: Column) -> Column:
    """The top-level keys of a readable object, each once; null for anything else."""
    return F.when(F.get_json_object(raw, "$").isNotNull(), F.array_distinct(F.json_object_keys(raw)))


def profile(files: DataFrame, first: int = FIRST, top: int = TOP) -> DataFrame:
    """One row: files valid and not, sizes, JSON lengths, the most frequent keys, and how many of the keys all files share.

    files: (path, raw).  Consistency looks at the first files by path; without any it is null.
    """
    length = F.col("length")
    rows = files.select(F.octet_length("raw").alias("size"), _length("raw").alias("length"))
    valid, size = length.isNotNull(), F.col("size")
    one = rows.agg(F.count("*").alias("files"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"), F.avg(size).alias("avg_size"), F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.avg(length).alias("avg_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"))
    counts = key_counts(files).limit(top)
    keys = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "key"))).alias("k")).select(F.transform("k", lambda x: F.struct(x["key"].alias("key"), (-x["n"]).alias("n"))).alias("common_keys"))
    seen = files.select("path", _keys(F.col("raw")).alias("keys")).where(F.col("keys").isNotNull()).orderBy("path").limit(first)
    per = seen.select("path", F.explode("keys").alias("key")).groupBy("key").agg(F.countDistinct("path").alias("n"))
    shared = per.crossJoin(seen.agg(F.countDistinct("path").alias("k"))).agg(F.try_divide(F.count_if(F.col("n") == F.col("k")), F.count("*")).alias("consistency"))
    return one.crossJoin(keys).crossJoin(shared)  # one row each


def key_counts(files: DataFrame) -> DataFrame:
    """(key, n) of the top-level keys, most frequent first, ties by name."""
    rows = files.select(F.explode(_keys(F.col("raw"))).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


#: Fixed rating bounds in percent.
RATINGS = ((90, "excellent"), (80, "good"), (70, "medium"), (60, "passing"))


def quality(profiled: DataFrame) -> DataFrame:
    """Adds score, max_score, percent and rating: 30 validity, 30 consistency, 20 mean size of 1-100 KB, 20 for ten keys.

    A term whose figure is missing counts neither for the score nor for its maximum.
    """
    kb = F.col("avg_size") / 1024
    fit = F.when(kb < 1, kb * 20).when(kb <= 100, F.lit(20.0)).otherwise(20 * (100 / kb))
    rich = F.when(F.size("common_keys") > 0, F.least(F.size("common_keys") / 10, F.lit(1.0)) * 20)
    terms = [(F.try_divide("valid", "files") * 30, 30), (F.col("consistency") * 30, 30), (fit, 20), (rich, 20)]
    score = sum((F.coalesce(x, F.lit(0.0)) for x, _ in terms), F.lit(0.0))
    most = sum((F.when(x.isNotNull(), F.lit(n)).otherwise(0) for x, n in terms), F.lit(0))
    out = profiled.withColumns({"score": score, "max_score": most}).withColumn("percent", 100 * F.try_divide("score", "max_score"))
    rating = F.lit("to improve")
    for low, name in reversed(RATINGS):
        rating = F.when(F.col("percent") >= low, name).otherwise(rating)
    return out.withColumn("rating", F.when(F.col("percent").isNotNull(), rating))


#: Names of the kinds of values as read, by the beginning of their Spark type.
KINDS = {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BOOLEAN": "bool", "VOID": "NoneType"}


def _kind(value: Column) -> Column:
    """The kind of a variant: whole numbers beyond a long are decimals of 19 digits or more without a fraction."""
    told = F.schema_of_variant(value)
    whole = told.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | (F.regexp_extract(told, r"^DECIMAL\((\d+),0\)", 1).try_cast("int") > 18)
    out = F.when(F.coalesce(whole, F.lit(False)), "int").otherwise("float")
    for name, kind in KINDS.items():
        out = F.when(told.startswith(name), kind).otherwise(out)
    return out


def structure(files: DataFrame) -> DataFrame:
    """(path, at, type, depth, n): every object, list and value under dictionaries, by key path; n: keys or items.

    Type names are those of JSON as read: dict, list, str, int, float, bool, NoneType.  Lists are not entered.
    Texts become variants once; level by level objects are taken apart by the JVM, as deep as the deepest.
    Malformed texts, and objects that repeat a key, have no rows.
    """
    spark, out, depth = files.sparkSession, None, 0
    level = files.select("path", F.lit("$").alias("at"), F.try_parse_json("raw").alias("v")).where("v is not null")
    while True:
        level = written(level.select("path", "at", "v", _kind(F.col("v")).alias("type")))
        text = F.to_json("v")
        n = F.when(F.col("type") == "dict", F.size(F.json_object_keys(text))).when(F.col("type") == "list", F.json_array_length(text))
        rows = level.select("path", "at", "type", F.lit(depth).alias("depth"), n.cast("long").alias("n"))
        out, depth = rows if out is None else out.unionByName(rows), depth + 1
        objects = level.where("type = 'dict'")
        if objects.isEmpty():
            return out
        inner = objects.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "value"))
        level = inner.select("path", F.concat_ws(".", "at", "key").alias("at"), F.col("value").alias("v"))


@F.pandas_udf(T.StringType())
def content_md5(raw: pd.Series) -> pd.Series:
    """md5 of a JSON text with sorted keys and number texts as read, so layout and key order do not matter; null if malformed."""

    def one(text):
        try:
            return hashlib.md5(json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        except (ValueError, TypeError):
            return None

    return raw.map(one)


def content_index(files: DataFrame, name: str = "stem") -> DataFrame:
    """(md5, name): of files of equal content the first name; malformed ones are left out."""
    return files.select(content_md5("raw").alias("md5"), F.col(name).alias("name")).where(F.col("md5").isNotNull()).groupBy("md5").agg(F.min("name").alias("name"))


def content_match(files: DataFrame, sources: DataFrame, name: str = "stem") -> DataFrame:
    """(name, md5, source): for every file the first source of equal content; null where there is none or it is malformed."""
    own = files.select(F.col(name).alias("name"), content_md5("raw").alias("md5"))
    return own.join(content_index(sources, name).withColumnRenamed("name", "source"), "md5", "left").select("name", "md5", "source")


MAPPING = "filename_mapping"


def materialize(mapping: DataFrame, folder: str, how: str = "copy") -> int:
    """Copies, symlinks or hard-links files to ``folder/to``; mapping: (path, to). The number of files.

    Which file is whose goes to ``filename_mapping`` in the folder, as JSON lines (to, path).  Links are for shared local folders only.
    """
    if how not in ("copy", "symlink", "hardlink"):
        raise ValueError(f"unknown way {how!r}; known: copy, symlink, hardlink")
    spark = mapping.sparkSession
    at = stores.qualified(spark, folder).rstrip("/")
    if how != "copy" and not at.startswith("file:"):
        raise ValueError(f"no links in {at}")
    stores.make_folder(spark, at)
    held = written(mapping.select("path", F.regexp_extract("to", r"([^/]+)$", 1).alias("to")))

    def run(batches):
        for part in batches:
            for path, to in zip(part["path"], part["to"], strict=True):
                if how == "copy":
                    with stores.input_file(path) as file:
                        out = stores.Upload(f"{at}/{to}")
                        while data := file.read(8 << 20):
                            out.write(data)
                        out.close()
                    continue
                own, new = stores.opened(path)[1], stores.opened(f"{at}/{to}")[1]
                if os.path.lexists(new):
                    os.remove(new)
                (os.symlink if how == "symlink" else os.link)(own, new)
            yield pd.DataFrame({"n": [len(part)]})

    n = held.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held.select("to", "path").write.mode("overwrite").json(f"{at}/{MAPPING}")
    return n

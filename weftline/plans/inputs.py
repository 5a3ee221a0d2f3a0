"""Inputs of the reference's kinds - conversations, scenes, patterns, files - made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages): the turns of each conversation in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def turn_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, sequence_lengths): the characters of each turn."""
    n = F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(n.alias("m")).select("conv_id", F.col("m.n").alias("sequence_lengths"))


def json_object(pairs) -> F.Column:
    """The text of an object from an array of struct(key, value), values being JSON texts, in their order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["key"], F.lit('":'), p["value"])), ","), F.lit("}"))


def _object(kind, x, y) -> F.Column:
    rotation = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.5))
    return F.to_json(F.struct(kind.alias("class"), F.struct(F.array(x.cast("double"), y.cast("double"), F.lit(0.0)).alias("location"), rotation.alias("rotation")).alias("spatial")))


def order_scenes(spark: SparkSession, sf_dir: str, rooms: bool = True) -> DataFrame:
    """(file, stem, path, raw): a scene an order; its objects are the line items, its rooms the different line states.

    Without ``rooms`` a portal at the order's number takes their place.
    """
    own = F.struct("l_linenumber", "l_returnflag", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(own)).alias("o"), F.array_sort(F.collect_set("l_linestatus")).alias("rooms"))
    states = json_object(F.transform("rooms", lambda r: F.struct(r.alias("key"), F.lit('{"shape":{"coordinates":[[[0,0],[60,0],[60,8],[0,8]]]}}').alias("value"))))
    objects = F.transform("o", lambda x, i: F.struct(F.concat(F.lit("object_"), (i + 1).cast("string")).alias("key"), _object(x["l_returnflag"], x["l_quantity"], x["l_linenumber"]).alias("value")))
    plan = F.array(F.struct(F.lit("blueprint").alias("key"), F.concat(F.lit('{"rooms":'), states, F.lit("}")).alias("value")))
    if not rooms:
        seg = F.concat(F.lit('[{"seg":[['), (F.col("l_orderkey") % 40).cast("string"), F.lit(",3.5],["), (F.col("l_orderkey") % 30).cast("string"), F.lit(",-1]]}]"))
        plan = F.array(F.struct(F.lit("portal").alias("key"), seg.alias("value")))
    name = F.col("l_orderkey").cast("string")
    return rows.select(name.alias("file"), name.alias("stem"), name.alias("path"), json_object(F.concat(plan, objects)).alias("raw"))


def supplier_scenes(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    """(file, raw): a scene a nation in a room of 100 x 60; its suppliers stand on a lattice, in two classes."""
    s = table(spark, sf_dir, "supplier").where(F.lit(True) if keep is None else keep)
    x, y = F.col("s_suppkey") % 97 + 1, F.floor(F.col("s_suppkey") / 97) % 50 + 1
    own = F.struct("s_suppkey", F.concat(F.lit("object_"), F.col("s_suppkey").cast("string")).alias("key"), _object(F.when(F.col("s_suppkey") % 2 == 0, "Bed").otherwise("Chair"), x, y).alias("value"))
    rows = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(own)).alias("o"))
    room = F.array(F.struct(F.lit("blueprint").alias("key"), F.lit('{"rooms":{"r":{"shape":{"coordinates":[[[0,0],[100,0],[100,60],[0,60]]]}}}}').alias("value")))
    return rows.select(F.col("s_nationkey").cast("string").alias("file"), json_object(F.concat(room, F.transform("o", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))).alias("raw"))


def crowded_scenes(spark: SparkSession, sf_dir: str, predicted: bool = False) -> DataFrame:
    """(file, raw): a scene for each nation and market segment in a room of 10 x 6, with an object a customer in two classes.

    Predictions lack each seventh object, are off by up to 0.2, and have a rival beside each fifth;
    each object has parameters of all kinds, some of which predictions miss.
    """
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    x, y = k * 7919 % 100003 / F.lit(11111.3) + 0.4, k * 104729 % 99991 / F.lit(19999.7) + 0.4
    own = {"share": (k % 50) / 100.0, "count": k % 9, "wallThickness": 0.25 + (k % 3) / 8.0, "big": k % 2 == 0, "name": F.concat(F.lit("n"), (k % 4).cast("string"))}
    if predicted:
        c = c.where(k % 7 != 0)
        x, y = x + (k * 31 % 41 - 20) / 100.0, y + (k * 37 % 41 - 20) / 100.0
        own |= {"share": own["share"] + 0.125, "count": own["count"] + k % 2, "name": F.when(k % 3 != 0, own["name"]), "extra": F.lit(1)}
    params = F.struct(*[v.alias(n) for n, v in own.items()])
    thing = lambda x, y: F.to_json(F.struct(F.when(k % 2 == 0, "Bed").otherwise("Chair").alias("class"), F.struct(F.array(x, y, F.lit(0.0)).alias("location"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.25)).alias("rotation")).alias("spatial"), params.alias("params")))
    pairs = [F.struct(k.alias("at"), F.lit(0).alias("rival"), F.concat(F.lit("object_"), k.cast("string")).alias("key"), thing(x, y).alias("value"))]
    if predicted:
        pairs.append(F.when(k % 5 == 0, F.struct(k.alias("at"), F.lit(1).alias("rival"), F.concat(F.lit("object_r"), k.cast("string")).alias("key"), thing(x + 0.071, y - 0.053).alias("value"))))
    rows = c.groupBy("c_nationkey", "c_mktsegment").agg(F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array(*pairs))))).alias("o"))
    room = F.array(F.struct(F.lit("blueprint").alias("key"), F.lit('{"rooms":{"r":{"shape":{"coordinates":[[[0,0],[10,0],[10,6],[0,6]]]}}}}').alias("value")))
    things = F.transform("o", lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
    return rows.select(F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("file"), json_object(F.concat(room, things)).alias("raw"))


def patterns(spark: SparkSession, sf_dir: str, grown: int = 0) -> DataFrame:
    """(stem, raw): a garment a supplier, of two rectangles; ``grown`` changes their sides, and the stitch of every third."""
    w, h = F.col("s_suppkey") % 11 + 5 + grown, F.col("s_suppkey") % 7 + 5 + 2 * grown
    vertices = F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ((F.lit(0), F.lit(0)), (w * 275, F.lit(0)), (w * 275, h * 275), (F.lit(0), h * 275))])
    panel = lambda i: F.struct(F.lit(i).alias("panel_id"), F.lit(f"p{i}").alias("panel_label"), vertices.alias("vertices"))
    edge = F.when((F.col("s_suppkey") % 3 == 0) & F.lit(grown > 0), 7).otherwise(1)
    stitch = F.struct(F.lit(0).alias("from_panel_id"), edge.alias("from_edge_index"), F.lit(1).alias("to_panel_id"), F.lit(3).alias("to_edge_index"))
    raw = F.to_json(F.struct(F.struct(F.lit(2.75).alias("scale")).alias("meta"), F.array(panel(0), panel(1)).alias("panels"), F.array(stitch).alias("stitches")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("stem"), raw.alias("raw"))


#: The outlines of shaped patterns: a triangle and a convex pentagon.
SHAPES = (((0, 0), (9, 1), (3, 7)), ((0, 0), (8, -1), (11, 4), (5, 9), (-1, 5)))


def shaped_patterns(spark: SparkSession, sf_dir: str, grown: bool = False) -> DataFrame:
    """(stem, raw): a garment a supplier, of a triangle and a pentagon, curved edges and five stitches between them.

    ``grown``: the outlines grow by eighths and are moved, and the stitches run to other edges.
    """
    k = F.col("s_suppkey")
    factor, dx = (1 + k % 4 / 8.0, k % 3) if grown else (F.lit(1.0), F.lit(0))
    line = lambda p: F.array(*[F.array((F.lit(float(x)) * factor + dx) * 275, (F.lit(float(y)) * factor - dx) * 275) for x, y in p])
    curve = lambda i, kind, n: F.struct(i.cast("int").alias("edge_index"), F.lit(kind).alias("curve_type"), F.array(*[(k % 7 + j).cast("double") for j in range(n)]).alias("curve_params"))
    none = F.lit(None)
    curves = F.array(curve(none, "line", 0), curve(none, "quadratic", 2), curve(k % 5, "cubic", 4), curve(none, "circle", 3), curve(F.lit(1), "cubic", 3))
    panel = lambda i: F.struct(F.lit(i).alias("panel_id"), F.lit(f"p{i}").alias("panel_label"), F.lit("front" if i else "back").alias("side"), line(SHAPES[i]).alias("vertices"), curves.alias("edges"), (k % 10).cast("double").alias("translation_x"))
    stitch = lambda j: F.struct(F.lit(0).alias("from_panel_id"), ((k + j) % 3).cast("int").alias("from_edge_index"), F.when((k + j) % 11 == 0, 9).otherwise(1).alias("to_panel_id"), ((k * (2 if grown else 1) + j) % 6).cast("int").alias("to_edge_index"))
    raw = F.to_json(F.struct(F.struct(F.lit(2.75).alias("scale")).alias("meta"), F.array(panel(0), panel(1)).alias("panels"), F.array(*[stitch(j) for j in range(5)]).alias("stitches")))
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("stem"), raw.alias("raw"))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, stem, raw): a JSON file an event, keys in one of two orders; each tenth is cut short."""
    a, b = F.concat(F.lit('"k": '), F.get_json_object("props", "$.k")), F.concat(F.lit('"type": "'), F.col("event_type"), F.lit('"'))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("{"), a, F.lit(", "), b, F.lit("}"))).otherwise(F.concat(F.lit("{"), b, F.lit(","), a, F.lit(',"odd":null}')))
    name = F.format_string("scene_%09d", "event_id")
    return table(spark, sf_dir, "events").select(name.alias("path"), name.alias("stem"), F.when(F.col("event_id") % 10 == 9, F.substring(text, 1, 5)).otherwise(text).alias("raw"), "event_id")


def token_rows(spark: SparkSession, sf_dir: str, size: int = 500) -> DataFrame:
    """(batch_id, row_id, n_tokens): documents by length, in batches of a fixed number of rows by id."""
    from weftline.operators.ranks import batches

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("n_chars").alias("n_tokens"))
    return batches(rows, size, ["row_id"])

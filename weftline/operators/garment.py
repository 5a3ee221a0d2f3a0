"""Garment patterns: panels, edges and stitches as tables, and the metrics of a prediction against its truth.

A pattern is one JSON text.  ``panels`` gives a row a panel, ``edges`` a row an edge and ``stitches`` a
row a stitch, all read by the JVM; stitches get their geometry from the edges by a join, and two
patterns are compared by joins of their panels and of their stitches.  Numpy only measures two outlines.

Lengths of the encoded form are divided by 100 times the scale.  Polygons are those of the
vertices (edges are straight; curvature is decoded but not followed).  Areas of overlap are
exact: both outlines are cut into horizontal slabs at every vertex and crossing, between which
widths change linearly.

Odd patterns: a text that is no JSON object, a scale of 0 or a vertex of less than two numbers makes a
pattern unreadable; it has no panels, and its samples have no figures.  Of panels with one id the last
counts; a stitch whose panel is unknown is none, and one whose edge is unknown has no geometry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.scratch import written

SCALE, TEMPLATE_WIDTH, SIDE_Z = 2.75, 640.0, 30.0
#: A stitch matches up to this distance of midpoints and relative difference of lengths, inclusive.
DISTANCE, LENGTH_SHARE = 8.0, 0.6
SAMPLES = 20
#: Fixed names: the kinds of curves and the lengths of the lists that their numbers form in the decoded form.
CURVES = {"quadratic": (2,), "cubic": (2, 2), "circle": (1, 1, 1)}
PROPERTIES = {"curvature_coords": "relative", "normalize_panel_translation": False, "normalized_edge_loops": True, "units_in_meter": 100}

_EDGE = "struct<edge_index: int, curve_type: string, curve_params: array<double>>"
_MOVES = ", ".join(f"{kind}_{axis}: double" for kind in ("translation", "rotation") for axis in "xyz")
_PANEL = f"struct<panel_id: string, panel_label: string, side: string, vertices: array<array<double>>, edges: array<{_EDGE}>, {_MOVES}>"
_STITCH = "struct<from_panel_id: string, from_edge_index: int, to_panel_id: string, to_edge_index: int>"
PATTERN = f"meta struct<scale: double>, panels array<{_PANEL}>, stitches array<{_STITCH}>"


def _name(panel_id: Column) -> Column:
    return F.concat(F.lit("panel_"), panel_id)


def parsed(patterns: DataFrame, *key: str) -> DataFrame:
    """(key, scale, panels, ids, stitches) of readable patterns; the last panel of each id."""
    own = patterns.select(*key, F.from_json("raw", PATTERN).alias("p"), F.get_json_object("raw", "$").startswith("{").alias("ok")).where("ok")
    scale = F.coalesce("p.meta.scale", F.lit(SCALE))
    all_ = F.coalesce("p.panels", F.array().cast(f"array<{_PANEL}>"))
    number = lambda x: F.coalesce(x["panel_id"], F.lit("0"))
    rows = own.select(*key, scale.alias("scale"), all_.alias("all"), F.transform(all_, number).alias("known"), F.coalesce("p.stitches", F.array().cast(f"array<{_STITCH}>")).alias("stitches"))
    last = F.filter("all", lambda x, i: i == F.size("all") - F.array_position(F.reverse("known"), number(x)))
    rows = rows.select(*key, "scale", last.alias("panels"), F.array_distinct("known").alias("ids"), "stitches")
    whole = F.forall("panels", lambda x: F.coalesce(F.forall(x["vertices"], lambda v: (F.size(v) >= 2) & F.get(v, 0).isNotNull() & F.get(v, 1).isNotNull()), F.lit(True)))
    return rows.where((F.col("scale") != 0) & whole)


def panels(patterns: DataFrame, *key: str) -> DataFrame:
    """(key, panel, label, vertices, coded, translation, rotation): the decoded panels; ``coded`` are their edges as they come."""
    rows = parsed(patterns, *key).select(*key, (100 * F.col("scale")).alias("unit"), F.explode("panels").alias("x"))
    own = lambda name, default=0.0: F.coalesce(f"x.{name}", F.lit(default))
    z = F.coalesce("x.translation_z", F.when(own("side", "front") == "front", SIDE_Z).otherwise(-SIDE_Z))
    vertices = F.transform(F.coalesce("x.vertices", F.array().cast("array<array<double>>")), lambda v: F.array(F.get(v, 0) / F.col("unit"), F.get(v, 1) / F.col("unit")))
    return rows.select(
        *key, _name(own("panel_id", "0")).alias("panel"), own("panel_label", "").alias("label"), vertices.alias("vertices"), F.coalesce("x.edges", F.array().cast(f"array<{_EDGE}>")).alias("coded"),
        F.array(*[own(f"translation_{a}") * TEMPLATE_WIDTH / F.col("unit") for a in "xy"], z).alias("translation"), F.array(*[own(f"rotation_{a}") for a in "xyz"]).alias("rotation"),
    )


def edges(panel_rows: DataFrame, *key: str) -> DataFrame:
    """(key, panel, label, edge, x, y, mid_x, mid_y, dir_x, dir_y, length): edge i runs from vertex i to the next, the last to the first."""
    rows = panel_rows.select(*key, "panel", "label", "vertices", F.posexplode("vertices").alias("edge", "a")).withColumn("b", F.get("vertices", (F.col("edge") + 1) % F.size("vertices")))
    x, y, u, v = (F.get(c, i) for c in "ab" for i in (0, 1))
    n = F.sqrt((u - x) ** 2 + (v - y) ** 2)
    unit = lambda d: F.when(n > 0, d / n).otherwise(d)
    return rows.select(*key, "panel", "label", "edge", x.alias("x"), y.alias("y"), ((x + u) / 2).alias("mid_x"), ((y + v) / 2).alias("mid_y"), unit(u - x).alias("dir_x"), unit(v - y).alias("dir_y"), n.alias("length"))


def curves(panel_rows: DataFrame, *key: str) -> DataFrame:
    """(key, panel, edge, kind, params): the curved edges, by ``edge_index`` or, without one, by the number of edges known so far; the last of one edge counts.

    A curve with too few numbers, or of a kind that is none of CURVES, is a straight line.
    """
    blank = F.array().cast("array<struct<edge: int, kind: string, params: array<double>>>")
    known = F.aggregate("coded", blank, lambda a, e: F.array_append(a, F.struct(F.coalesce(e["edge_index"], F.size(F.array_distinct(a["edge"]))).alias("edge"), e["curve_type"].alias("kind"), e["curve_params"].alias("params"))))
    rows = panel_rows.select(*key, "panel", F.size("vertices").alias("n"), F.posexplode(known).alias("place", "c"))
    last = rows.groupBy(*key, "panel", "n", "c.edge").agg(F.max_by("c", "place").alias("c")).where(F.col("edge").between(0, F.col("n") - 1))
    needs = F.create_map(*[F.lit(x) for kind, parts in CURVES.items() for x in (kind, sum(parts))])
    enough = F.size("c.params") >= F.try_element_at(needs, F.col("c.kind"))
    return last.where(F.coalesce(enough, F.lit(False))).select(*key, "panel", "edge", "c.kind", F.slice("c.params", F.lit(1), F.try_element_at(needs, F.col("c.kind"))).alias("params"))


def stitches(patterns: DataFrame, *key: str) -> DataFrame:
    """(key, stitch, panels, edges): the two ends of stitches between known panels, numbered from 0 in their order."""
    held = parsed(patterns, *key)
    known = lambda s: F.coalesce(F.array_contains("ids", s["from_panel_id"]) & F.array_contains("ids", s["to_panel_id"]), F.lit(False))
    rows = held.select(*key, F.posexplode(F.filter("stitches", known)).alias("stitch", "s"))
    return rows.select(*key, "stitch", F.array(_name(F.col("s.from_panel_id")), _name(F.col("s.to_panel_id"))).alias("panels"), F.array("s.from_edge_index", "s.to_edge_index").alias("edges"))


def stitch_geometry(stitch_rows: DataFrame, edge_rows: DataFrame, *key: str) -> DataFrame:
    """(key, stitch, ends): the ends by panel, each (panel, end, mid_x, mid_y, length); stitches with an unknown edge are left out."""
    ends = stitch_rows.select(*key, "stitch", F.posexplode(F.arrays_zip("panels", "edges")).alias("end", "e")).select(*key, "stitch", "end", F.col("e.panels").alias("panel"), F.col("e.edges").alias("edge"))
    met = ends.join(edge_rows.select(*key, "panel", "edge", "mid_x", "mid_y", "length"), [*key, "panel", "edge"])
    by = met.groupBy(*key, "stitch").agg(F.array_sort(F.collect_list(F.struct("panel", "end", "mid_x", "mid_y", "length"))).alias("ends"))
    return by.where(F.size("ends") == 2)


def _alike(own: Column, other: Column) -> Column:
    """Does each end of a stitch lie beside the first end of the other on its panel, with an edge about as long?"""

    def one(e):
        o = F.get(F.filter(other, lambda x: x["panel"] == e["panel"]), 0)
        near = F.sqrt((e["mid_x"] - o["mid_x"]) ** 2 + (e["mid_y"] - o["mid_y"]) ** 2) <= DISTANCE
        return near & ((o["length"] <= 0) | (F.abs(e["length"] - o["length"]) <= LENGTH_SHARE * o["length"]))

    return F.coalesce(F.forall(own, one), F.lit(False))


def matched_stitches(preds: DataFrame, truths: DataFrame, *key: str) -> DataFrame:
    """(key, correct): each prediction in order takes the first free truth between the same panels that it is like.

    preds, truths: as from ``stitch_geometry``.
    """
    side = lambda rows, name: rows.select(*key, F.array_distinct("ends.panel").alias("between"), F.col("stitch").alias(name), F.col("ends").alias(f"{name}_ends"))
    pairs = side(preds, "own").join(side(truths, "other"), [*key, "between"]).where(_alike(F.col("own_ends"), F.col("other_ends")))
    by = pairs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("own", "other"))).alias("pairs"))
    start = F.struct(F.array().cast("array<int>").alias("own"), F.array().cast("array<int>").alias("other"))
    free = lambda a, p: ~F.array_contains(a["own"], p["own"]) & ~F.array_contains(a["other"], p["other"])
    taken = F.aggregate("pairs", start, lambda a, p: F.when(free(a, p), F.struct(F.array_append(a["own"], p["own"]).alias("own"), F.array_append(a["other"], p["other"]).alias("other"))).otherwise(a))
    return by.select(*key, F.size(taken["own"]).alias("correct"))


def boundary(v: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Points along every edge, ``samples`` of it with both ends, the last left to the next edge."""
    if len(v) < 2:
        return v
    t = np.linspace(0, 1, samples)[:-1, None]
    return (v[:, None] + t * (np.roll(v, -1, 0) - v)[:, None]).reshape(-1, 2)


def chamfer(a: np.ndarray, b: np.ndarray) -> float:
    """Mean of the two directed mean distances to the nearest point, both sets centred."""
    a, b = a - a.mean(0), b - b.mean(0)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    return float((d.min(1).mean() + d.min(0).mean()) / 2)


def _area_centre(v: np.ndarray) -> np.ndarray:
    """Centroid of a polygon's area; the mean of its points where it has none."""
    w = np.roll(v, -1, 0)
    cross = v[:, 0] * w[:, 1] - w[:, 0] * v[:, 1]
    return ((v + w) * cross[:, None]).sum(0) / (3 * cross.sum()) if abs(cross.sum()) > 1e-15 else v.mean(0)


def _levels(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Heights of all vertices and of all crossings between the edges of both outlines, in order."""
    a = np.concatenate([v, w])
    d = np.concatenate([np.roll(v, -1, 0), np.roll(w, -1, 0)]) - a
    den = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    gap = a[None] - a[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * d[None, :, 1] - gap[..., 1] * d[None, :, 0]) / den
        u = (gap[..., 0] * d[:, None, 1] - gap[..., 1] * d[:, None, 0]) / den
    i, j = np.nonzero((den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1))
    return np.unique(np.concatenate([a[:, 1], a[i, 1] + t[i, j] * d[i, 1]]))


def _spans(v: np.ndarray, y: float) -> np.ndarray:
    """Where the line at height y enters and leaves the polygon (even-odd rule)."""
    w = np.roll(v, -1, 0)
    over = (v[:, 1] > y) != (w[:, 1] > y)
    a, b = v[over], w[over]
    return np.sort(a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])).reshape(-1, 2)


def overlap(v: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Areas of the first polygon, the second, and of what they share."""
    levels = _levels(v, w)
    out = np.zeros(3)
    for low, high in zip(levels[:-1], levels[1:], strict=True):
        a, b = _spans(v, (low + high) / 2), _spans(w, (low + high) / 2)
        both = np.minimum(a[:, None, 1], b[None, :, 1]) - np.maximum(a[:, None, 0], b[None, :, 0])
        out += (high - low) * np.array([(a[:, 1] - a[:, 0]).sum(), (b[:, 1] - b[:, 0]).sum(), np.maximum(both, 0).sum()])
    return tuple(map(float, out))


def iou(v: np.ndarray, w: np.ndarray) -> float:
    """Overlap over union of two outlines laid centre on centre; 0 where one is no polygon."""
    if len(v) < 3 or len(w) < 3:
        return 0.0
    own, other, both = overlap(v - _area_centre(v), w - _area_centre(w))
    return both / (own + other - both) if own + other - both > 0 else 0.0


@F.pandas_udf(T.StructType([T.StructField("chamfer", T.DoubleType()), T.StructField("iou", T.DoubleType())]))
def _measured(own: pd.Series, other: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(own, other, strict=True):
        v, w = (np.array([list(p) for p in x], float).reshape(-1, 2) for x in (a, b))
        out.append((10 * chamfer(boundary(v), boundary(w)) if len(v) and len(w) else None, iou(v, w)))
    return pd.DataFrame(out, columns=["chamfer", "iou"])


METRICS = ("sample", "panel_count_match", "pred_panels", "gt_panels", "chamfer_mm", "iou", "stitch_accuracy", "stitch_precision", "stitches_correct", "stitches_pred", "stitches_gt")


def pair_counts(truths: DataFrame, predictions: DataFrame, key: str = "stem") -> DataFrame:
    """One row: names on both sides, in the truth only, and in the predictions only."""
    a = truths.select(key).distinct().withColumn("_a", F.lit(True))
    b = predictions.select(key).distinct().withColumn("_b", F.lit(True))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return a.join(b, key, "full_outer").agg(F.count_if(both).alias("matching"), F.count_if(F.col("_b").isNull()).alias("gt_only"), F.count_if(F.col("_a").isNull()).alias("pred_only"))


def evaluate(truths: DataFrame, predictions: DataFrame) -> DataFrame:
    """The METRICS of every sample that has both sides; truths, predictions: (stem, raw).

    Figures are null, and panels do not match, where a side is unreadable; repeated stems are paired each with each.
    """
    both = truths.select(F.col("stem").alias("sample"), F.col("raw").alias("gt")).join(predictions.select(F.col("stem").alias("sample"), F.col("raw").alias("pred")), "sample")
    both = written(both.withColumn("pair", F.monotonically_increasing_id()))
    side = lambda c: both.select("pair", F.lit(c).alias("side"), F.col(c).alias("raw"))
    rows, key = side("gt").unionByName(side("pred")), ("pair", "side")
    held = parsed(rows, *key).select(*key, F.array_sort("ids").alias("ids"))
    sewn = stitches(rows, *key)
    own = written(panels(rows, *key).select(*key, "panel", "label", "vertices"))
    geometry = written(stitch_geometry(sewn, edges(own, *key), *key))
    of = lambda table, c: table.where(F.col("side") == c).drop("side")
    known = of(held, "gt").withColumnRenamed("ids", "gt_ids").join(of(held, "pred").withColumnRenamed("ids", "pred_ids"), "pair")
    met = of(own, "gt").select("pair", "panel", F.col("vertices").alias("v")).join(of(own, "pred").select("pair", "panel", F.col("vertices").alias("w")), ["pair", "panel"])
    shape = met.select("pair", _measured("w", "v").alias("m")).groupBy("pair").agg(F.avg("m.chamfer").alias("chamfer"), F.avg(F.when(F.col("m.iou") > 0, 100 * F.col("m.iou"))).alias("iou"))
    listed = sewn.groupBy("pair").pivot("side", ["gt", "pred"]).count().withColumnsRenamed({"gt": "gt_listed", "pred": "pred_listed"})
    counted = geometry.groupBy("pair").pivot("side", ["gt", "pred"]).count().withColumnsRenamed({"gt": "n_gt", "pred": "n_pred"})
    correct = matched_stitches(of(geometry, "pred"), of(geometry, "gt"), "pair")
    out = both.select("pair", "sample").join(known, "pair", "left")
    for part in (shape, listed, counted, correct):
        out = out.join(part, "pair", "left")
    read = F.col("gt_ids").isNotNull()
    number = lambda c: F.when(read, F.coalesce(c, F.lit(0)))
    some = (number("gt_listed") > 0) & (number("pred_listed") > 0)
    share = lambda n: F.when(read, F.when(some, F.coalesce(F.try_divide(100.0 * number("correct"), number(n)), F.lit(0.0))).otherwise(0.0))
    return out.select(
        "sample", F.coalesce(F.col("gt_ids") == F.col("pred_ids"), F.lit(False)).alias("panel_count_match"), F.when(read, F.size("pred_ids")).alias("pred_panels"), F.when(read, F.size("gt_ids")).alias("gt_panels"),
        F.when(read, F.coalesce("chamfer", F.lit(0.0))).alias("chamfer_mm"), F.when(read, F.coalesce("iou", F.lit(0.0))).alias("iou"), share("n_gt").alias("stitch_accuracy"), share("n_pred").alias("stitch_precision"),
        number("correct").cast("int").alias("stitches_correct"), number("n_pred").cast("int").alias("stitches_pred"), number("n_gt").cast("int").alias("stitches_gt"),
    )


def summary(scores: DataFrame) -> DataFrame:
    """One row: samples, valid ones, share of equal panel sets, means and population deviations over valid ones."""
    spread = [f(c).alias(f"{n}_{c}") for c in ("chamfer_mm", "iou", "stitch_accuracy") for n, f in (("avg", F.avg), ("std", F.stddev_pop))]
    return scores.agg(F.count("*").alias("samples"), F.count("chamfer_mm").alias("valid"), (100 * F.avg(F.col("panel_count_match").cast("int"))).alias("panel_match_rate"), *spread)


def panel_table(patterns: DataFrame) -> DataFrame:
    """(stem, panel, label, vertex, x, y, length): decoded vertices and the length of the edge that each begins."""
    return edges(panels(patterns, "stem"), "stem").select("stem", "panel", "label", F.col("edge").alias("vertex"), "x", "y", "length")


def _curvature(kind: Column, params: Column) -> Column:
    """The numbers of a curve in the decoded form: a bare list, or their lists under the kind."""
    told = F.lit(None).cast("string")
    for name, parts in CURVES.items():
        at = [sum(parts[:i]) for i in range(len(parts))]
        lists = [F.slice(params, a + 1, n) if n > 1 else F.get(params, a) for a, n in zip(at, parts, strict=True)]
        text = F.to_json(lists[0]) if len(parts) == 1 else F.to_json(F.struct(F.lit(name).alias("type"), F.array(*lists).alias("params")))
        told = F.when(kind == name, text).otherwise(told)
    return F.parse_json(told)


def specification(patterns: DataFrame) -> DataFrame:
    """(stem, spec): the decoded form of readable patterns as JSON (G14): panels with edges and curves, stitches, and fixed properties."""
    own = panels(patterns, "stem")
    bent = curves(own, "stem").select("stem", "panel", F.struct("edge", _curvature(F.col("kind"), F.col("params")).cast("string").alias("text")).alias("c"))
    bent = bent.groupBy("stem", "panel").agg(F.collect_list("c").alias("bent"))
    met = own.join(bent, ["stem", "panel"], "left")
    count = F.size("vertices")
    curve = lambda i: F.parse_json(F.get(F.filter("bent", lambda c: c["edge"] == i), 0)["text"])
    loop = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.array(i, (i + 1) % count).alias("endpoints"), curve(i).alias("curvature")))
    panel = F.struct("vertices", F.when(count > 0, loop).otherwise(F.array()).alias("edges"), "label", "translation", "rotation")
    by = met.groupBy("stem").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("panel", F.to_json(panel).alias("p"))))).alias("panels"))
    ends = F.transform(F.arrays_zip("panels", "edges"), lambda e: F.struct(e["panels"].alias("panel"), e["edges"].alias("edge")))
    sewn = stitches(patterns, "stem").groupBy("stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("stitch", ends.alias("e")))), lambda x: x["e"]).alias("stitches"))
    rows = parsed(patterns, "stem").select("stem").join(by, "stem", "left").join(sewn, "stem", "left")
    panels_ = F.transform_values(F.coalesce("panels", F.create_map().cast("map<string,string>")), lambda k, v: F.parse_json(v))
    whole = F.struct(
        F.create_map().cast("map<string,string>").alias("parameters"), F.array().cast("array<string>").alias("parameter_order"),
        F.struct(panels_.alias("panels"), F.coalesce("stitches", F.array()).alias("stitches")).alias("pattern"), F.struct(*[F.lit(v).alias(k) for k, v in PROPERTIES.items()]).alias("properties"),
    )
    return rows.select("stem", F.to_json(whole).alias("spec"))

"""Scene geometry and evaluation.

A scene is a JSON object: ``blueprint.rooms`` with rings of corners, objects with class and
spatial entries, and ``portal`` segments.  Every move of a scene is one affine map of the plane
and one map of angles, which is applied to all of these at once.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import params
from weftline.operators.stats import ratio_columns

ANGLES, MIRRORS = (0, 90, 180, 270), ("none", "horizontal", "vertical")
NO_OBJECT = ("blueprint", "portal")
#: Tasks that evaluate scenes, for each core, at least.
TASKS_A_CORE = 4
#: Pairs of a truth and a prediction nearby that are compared together.
PAIRS = 1 << 12


def spatial_items(scene: dict) -> list[tuple[str, dict]]:
    return [(k, v) for k, v in scene.items() if k not in NO_OBJECT and isinstance(v, dict) and isinstance(v.get("spatial"), dict)]


def objects(scene: dict) -> list[tuple[str, str, list[float]]]:
    """(id, class, location) in document order; what lacks a class or a place is no object."""
    return [(k, v["class"], list(v["spatial"].get("location") or [0, 0, 0])) for k, v in spatial_items(scene) if "class" in v]


def locations(scene: dict) -> list[list[float]]:
    return [at for _, _, at in objects(scene)]


def _rings(scene: dict):
    for room in ((scene.get("blueprint") or {}).get("rooms") or {}).values():
        shape = room.get("shape") or {}
        yield from ((shape, i) for i in range(len(shape.get("coordinates") or [])))


def points(scene: dict) -> np.ndarray:
    """All xy points: room corners, object places, portal ends."""
    out = [p[:2] for shape, i in _rings(scene) for p in shape["coordinates"][i] if len(p) >= 2]
    out += [at[:2] for v in (v["spatial"].get("location") or [0, 0, 0] for _, v in spatial_items(scene)) if len(at := v) >= 2]
    out += [p[:2] for portal in scene.get("portal") or [] for p in portal.get("seg") or [] if len(p) >= 2]
    return np.array(out, float).reshape(-1, 2)


@dataclass(frozen=True)
class Move:
    """p -> matrix p + shift, and an object's angle a -> sign a + turn."""

    matrix: np.ndarray
    shift: np.ndarray
    sign: float = 1.0
    turn: float = 0.0

    def __call__(self, xy: np.ndarray) -> np.ndarray:
        return xy @ self.matrix.T + self.shift


STAY = Move(np.eye(2), np.zeros(2))


def _centre(xy: np.ndarray) -> np.ndarray:
    return (xy.min(0) + xy.max(0)) / 2 if len(xy) else np.zeros(2)


def turned(xy: np.ndarray, degrees: float) -> Move:
    """Rotation about the centre of the bounding box of these points; 0 degrees leaves all as it is."""
    if not degrees or not len(xy):
        return STAY
    a, c = math.radians(degrees), _centre(xy)
    m = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    return Move(m, c - m @ c, 1.0, a)


def mirrored(xy: np.ndarray, kind: str) -> Move:
    """Reflection about the centre: horizontal negates x, vertical y."""
    if kind not in MIRRORS:
        raise ValueError(f"unknown mirror {kind!r}; known: {', '.join(MIRRORS)}")
    if kind == "none" or not len(xy):
        return STAY
    x = kind == "horizontal"
    m = np.diag([-1.0, 1.0] if x else [1.0, -1.0])
    c = _centre(xy)
    return Move(m, c - m @ c, -1.0, math.pi if x else 0.0)


def to_origin(xy: np.ndarray) -> Move:
    """Translation that brings the least x and y to 0."""
    return Move(np.eye(2), -xy.min(0)) if len(xy) else STAY


def offset(dx: float, dy: float) -> Move:
    return Move(np.eye(2), np.array([dx, dy]))


def moved(scene: dict, move: Move) -> dict:
    """A copy of the scene with rooms, objects and portals moved."""
    return move_all(json.loads(json.dumps(scene)), move)


def move_all(out: dict, move: Move) -> dict:
    """The scene itself, with rooms, objects and portals moved, all points together."""
    rings, items, portals = list(_rings(out)), [v["spatial"] for _, v in spatial_items(out)], out.get("portal") or []
    here = [p for shape, i in rings for p in shape["coordinates"][i]] + [x.get("location") or [0, 0, 0] for x in items] + [p for portal in portals for p in portal.get("seg") or []]
    there = iter(move(np.array([p[:2] for p in here if len(p) >= 2], float).reshape(-1, 2)).tolist())
    one = lambda p: [*next(there), *p[2:]] if len(p) >= 2 else p
    for shape, i in rings:
        shape["coordinates"][i] = [one(p)[:2] for p in shape["coordinates"][i]]
    angle = (lambda a: move.sign * a + move.turn) if move.sign != 1 or move.turn else (lambda a: a)
    for spatial in items:
        spatial["location"] = one(spatial.get("location") or [0, 0, 0])
        rotation = spatial.get("rotation") or [0, 0, 0]
        if len(rotation) >= 3:
            spatial["rotation"] = [*rotation[:2], angle(rotation[2])]
    for portal in portals:
        if "seg" in portal:
            portal["seg"] = [one(p)[:2] for p in portal["seg"]]
        if "rot" in portal:
            portal["rot"] = angle(portal["rot"])
    return out


def placements(scene: dict, moves) -> list[tuple[list[str], np.ndarray]]:
    """Classes and xy of the objects for each (angle, mirror): turned, mirrored, and the corner of all points moved to 0."""
    own, whole, out = objects(scene), points(scene), []
    kinds, at = [o[1] for o in own], np.array([o[2][:2] for o in own], float).reshape(-1, 2)
    for angle, mirror in moves:
        xy, all_ = at, whole
        for step in (lambda p: turned(p, angle), lambda p: mirrored(p, mirror), to_origin):  # noqa: B023
            move = step(all_)
            all_, xy = move(all_), move(xy)
        out.append((kinds, xy))
    return out


def placed(scene: dict, angle: int = 0, mirror: str = "none") -> tuple[list[str], np.ndarray]:
    """The placement of one angle and mirror."""
    return placements(scene, [(angle, mirror)])[0]


def transform(scenes: DataFrame, angle: float = 0, mirror: str = "none", origin: bool = False, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """The scenes with ``raw`` turned, mirrored, moved to the origin and shifted, in this order; null where it is no scene."""
    if mirror not in MIRRORS:
        raise ValueError(f"unknown mirror {mirror!r}; known: {', '.join(MIRRORS)}")

    def one(text):
        try:
            scene = json.loads(text)
            for step in (lambda p: turned(p, angle), lambda p: mirrored(p, mirror), to_origin if origin else lambda p: STAY, lambda p: offset(dx, dy)):
                move = step(points(scene))
                scene = scene if move is STAY else move_all(scene, move)  # the last step always moves
            return json.dumps(scene, ensure_ascii=False, separators=(",", ":"))
        except (ValueError, TypeError, AttributeError):
            return None

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(one)

    return scenes.withColumn("raw", run("raw"))


def object_table(scenes: DataFrame, key: str = "file") -> DataFrame:
    """(file, pos, id, class, location): the objects of each scene in document order, read by the JVM's JSON parser.

    Malformed scenes have none.
    """
    items = F.from_json("raw", "map<string,string>")
    rows = scenes.select(F.col(key), F.posexplode(F.map_entries(items)).alias("pos", "x")).where(~F.col("x.key").isin(*NO_OBJECT))
    rows = rows.withColumn("o", F.from_json("x.value", "class string, spatial struct<location: array<double>>"))  # one parse an object
    rows = rows.where(F.col("o.class").isNotNull() & F.col("o.spatial").isNotNull())
    at = F.coalesce("o.spatial.location", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    return rows.select(key, "pos", F.col("x.key").alias("id"), F.col("o.class").alias("class"), at.alias("location"))


def object_lookup(scenes: DataFrame, wanted: DataFrame, key: str = "file") -> DataFrame:
    """(file, id, object): the whole JSON of objects asked for by (file, id); null where there is none (P10)."""
    asked = wanted.groupBy(F.col(key).alias("_k")).agg(F.collect_set("id").alias("_ids"))
    known = scenes.join(asked, F.col(key) == F.col("_k"))  # only scenes and objects that are asked for are taken apart
    entries = F.map_filter(F.from_json("raw", "map<string,string>"), lambda k, v: F.array_contains("_ids", k))
    return wanted.join(known.select(key, F.explode(entries).alias("id", "object")), [key, "id"], "left")


_OUTLINE = "blueprint struct<rooms: map<string, struct<shape: struct<coordinates: array<array<array<double>>>>>>>, portal array<struct<seg: array<array<double>>>>"


def bounds(scenes: DataFrame, key: str = "file") -> DataFrame:
    """(file, min_x, max_x, min_y, max_y, centre_x, centre_y) over all points of a scene, read by the JVM; nulls where it has none."""
    none = F.array().cast("array<array<double>>")
    rows = scenes.select(key, F.from_json("raw", _OUTLINE).alias("s"), F.from_json("raw", "map<string,string>").alias("items"))
    rings = F.flatten(F.flatten(F.array_compact(F.transform(F.map_values("s.blueprint.rooms"), lambda r: r["shape"]["coordinates"]))))
    ends = F.flatten(F.array_compact(F.transform("s.portal", lambda p: p["seg"])))
    own = F.transform(F.map_values(F.map_filter("items", lambda k, v: ~k.isin(*NO_OBJECT))), lambda v: F.from_json(v, "spatial struct<location: array<double>>")["spatial"])
    places = F.transform(F.filter(own, lambda x: x.isNotNull()), lambda x: F.coalesce(x["location"], F.array(F.lit(0.0), F.lit(0.0))))
    all_ = F.concat(*[F.coalesce(x, none) for x in (rings, ends, places)])
    rows = rows.select(key, F.filter(all_, lambda p: F.size(p) >= 2).alias("p"))
    axis = lambda i: F.transform("p", lambda p: F.get(p, i))
    rows = rows.select(key, F.array_min(axis(0)).alias("min_x"), F.array_max(axis(0)).alias("max_x"), F.array_min(axis(1)).alias("min_y"), F.array_max(axis(1)).alias("max_y"))
    return rows.withColumns({"centre_x": (F.col("min_x") + F.col("max_x")) / 2, "centre_y": (F.col("min_y") + F.col("max_y")) / 2})


def grid(n: int, reach: float) -> np.ndarray:
    return np.zeros(1) if n == 1 else -reach + 2 * reach * np.arange(n) / (n - 1)


def match_counts(gt: tuple, pred: tuple, offsets: np.ndarray, thresholds) -> np.ndarray:
    """Greedy matches for every threshold and offset, thresholds x offsets.

    Each truth in document order takes its nearest free prediction of its class, strictly within
    the threshold; the first of equals.  All offsets go through the greedy steps together; what no
    offset brings within the largest threshold is not looked at.
    """
    reach = max(thresholds) + np.sqrt((offsets**2).sum(1)).max()
    out = np.zeros((len(thresholds), len(offsets)), np.int64)
    kinds, truth = np.array(gt[0], object), np.asarray(gt[1], float)
    own_kinds = np.array(pred[0], object)
    for kind in dict.fromkeys(gt[0]):
        own = np.asarray(pred[1], float)[own_kinds == kind] if len(own_kinds) else np.zeros((0, 2))
        if not len(own):
            continue
        used = np.zeros((len(thresholds), len(offsets), len(own)), bool)
        for at in truth[kinds == kind]:
            near = np.flatnonzero(((own - at) ** 2).sum(1) <= reach**2 * (1 + 1e-9))
            if not len(near):
                continue
            d = own[near][None] + offsets[:, None] - at
            d = np.sqrt(d[..., 0] ** 2 + d[..., 1] ** 2)
            for k, t in enumerate(thresholds):
                free = np.where(used[k][:, near], np.inf, d)
                j = free.argmin(1)
                hit = np.flatnonzero(free[np.arange(len(j)), j] < t)
                used[k, hit, near[j[hit]]] = True
                out[k, hit] += 1
    return out


def near(truth: np.ndarray, own: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(truths, points) whose x and y are both within ``reach``, and some more: all of a stretch of truths at a time, in order.

    Points are sorted into cells of at least the reach, so that only those of adjacent cells meet.
    """
    if not len(truth) or not len(own):
        return
    low = np.minimum(truth.min(0), own.min(0))
    side = max(reach, float((np.maximum(truth.max(0), own.max(0)) - low).max()) / 2**30, 1e-300) * (1 + 1e-9)
    a, b = (np.floor((x - low) / side).astype(np.int64) for x in (truth, own))
    key = b[:, 0] << 32 | b[:, 1] + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    rows = [(a[:, 0] + d) << 32 | a[:, 1] for d in (-1, 0, 1)]
    first = np.stack([np.searchsorted(key, r) for r in rows], 1)
    count = np.stack([np.searchsorted(key, r + 2, "right") for r in rows], 1) - first
    before = np.cumsum(count.sum(1)) - count.sum(1)
    for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(before // PAIRS)) + 1).tolist(), len(truth)]):
        n = count[i:j].ravel()
        at = np.repeat(first[i:j].ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield np.repeat(np.repeat(np.arange(i, j), 3), n), order[at]


def greedy(truth: np.ndarray, own: np.ndarray, shift, threshold: float) -> list[tuple[int, int]]:
    """The pairs of truths, which in order take the nearest free point strictly within the threshold; the first of equals."""
    some, mine = (np.flatnonzero(np.isfinite(x).all(1)) for x in (truth, own))
    at, moved_ = truth[some], own[mine] + np.asarray(shift, float)
    used, out = np.zeros(len(mine), bool), []
    for i, j in near(at, moved_, threshold):
        free = ~used[j]
        i, j = i[free], j[free]
        d = moved_[j] - at[i]
        d = np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2)
        hit = d < threshold
        i, j, d = i[hit], j[hit], d[hit]
        order = np.lexsort((j, d, i))
        i, j = i[order], j[order].tolist()
        edge = np.flatnonzero(np.diff(i, prepend=-1)).tolist()
        taken = set()
        for a, b in itertools.pairwise([*edge, len(j)]):
            for k in range(a, b):
                if j[k] not in taken:
                    taken.add(j[k])
                    out.append((int(some[i[a]]), int(mine[j[k]])))
                    break
        used[np.fromiter(taken, np.int64, len(taken))] = True
    return out


def match(gt: tuple, pred: tuple, shift=(0.0, 0.0), threshold: float = 0.5) -> list[tuple[int, int]]:
    """The pairs (truth, prediction) of one offset and threshold."""
    kinds, own_kinds = np.array(gt[0], object), np.array(pred[0], object)
    truth, own, out = np.asarray(gt[1], float).reshape(-1, 2), np.asarray(pred[1], float).reshape(-1, 2), []
    for kind in dict.fromkeys(gt[0]):
        g, p = np.flatnonzero(kinds == kind), np.flatnonzero(own_kinds == kind)
        out += [(int(g[i]), int(p[j])) for i, j in greedy(truth[g], own[p], shift, threshold)]
    return sorted(out)


def main_threshold(thresholds) -> float:
    return 0.5 if 0.5 in thresholds else thresholds[len(thresholds) // 2]


def _ratios(tp, n_pred: int, n_gt: int) -> tuple:
    p, r = (tp / n if n else np.zeros_like(tp, float) for n in (n_pred, n_gt))
    both = p + r
    return p, r, np.divide(2 * p * r, both, out=np.zeros_like(both), where=both > 0)


def _covered(group: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """For each point of the grid the number of groups with an interval low:high of its row over it."""
    order = np.lexsort((low, row, group))
    group, row, low, high = group[order], row[order], low[order], high[order]
    key = (group * n + row) * (n + 2)  # intervals of one group and row stand together
    upto = np.maximum.accumulate(high + key)
    begin = low.copy()
    begin[1:] = np.maximum(low[1:], upto[:-1] - key[1:])  # what is left of an interval by those before it
    left = begin < high
    edges = np.bincount(row[left] * (n + 1) + begin[left], minlength=n * (n + 1)) - np.bincount(row[left] * (n + 1) + high[left], minlength=n * (n + 1))
    return np.cumsum(edges.reshape(n, n + 1), 1)[:, :n]


def most_matches(gt: tuple, pred: tuple, line: np.ndarray, threshold: float) -> np.ndarray:
    """For each offset of the grid line x line a bound of the matches: no more than truths, or predictions, that have a partner there.

    A truth and a prediction of its class match at the offsets of a disc, which cuts an interval from each row of the grid.
    """
    n, out = len(line), np.zeros((len(line), len(line)), np.int64)
    slack = threshold * 1e-9 + 1e-12
    kinds, own_kinds = np.array(gt[0], object), np.array(pred[0], object)
    truth, own = np.asarray(gt[1], float).reshape(-1, 2), np.asarray(pred[1], float).reshape(-1, 2)
    for kind in dict.fromkeys(gt[0]):
        g, p = (x[np.isfinite(x).all(1)] for x in (truth[kinds == kind], own[own_kinds == kind]))
        if not len(p):
            continue
        reach, parts = threshold + np.abs(line).max() + slack, [(np.zeros(0, np.int64),) * 2]
        for i, j in near(g, p, reach):
            close = (np.abs(g[i] - p[j]) < reach).all(1)
            parts.append((i[close], j[close]))
        i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
        centre = g[i] - p[j]
        rest = (threshold + slack) ** 2 - (line[None] - centre[:, :1]) ** 2
        pair, row = np.nonzero(rest > 0)
        half = np.sqrt(rest[pair, row]) + slack
        low, high = np.searchsorted(line, centre[pair, 1] - half), np.searchsorted(line, centre[pair, 1] + half, "right")
        some = low < high
        pair, row, low, high = pair[some], row[some], low[some], high[some]
        if len(pair):
            out += np.minimum(_covered(i[pair], row, low, high, n), _covered(j[pair], row, low, high, n))
    return out


def best_place(truth: tuple, preds: list[tuple], line: np.ndarray, threshold: float, block: int = 64) -> tuple[int, int, int]:
    """(matches, transform, offset) with the most greedy matches; the first transform, then the first offset, of equals.

    Offsets are tried from the greatest bound on, until no other can be better or as good and earlier.
    A single offset is tried without bounds, which take as long.
    """
    if len(line) == 1:
        counts = [len(match(truth, p, (line[0], line[0]), threshold)) for p in preds]
        return max(counts), counts.index(max(counts)), 0
    offsets = np.stack(np.meshgrid(line, line, indexing="ij"), -1).reshape(-1, 2)
    bounds = [most_matches(truth, p, line, threshold).ravel() for p in preds]
    best = (-1, 0, 0)  # matches, and transform and offset below zero, so that greater is better
    for k in sorted(range(len(preds)), key=lambda k: -bounds[k].max()):
        order = np.lexsort((np.arange(len(offsets)), -bounds[k]))
        size = block
        while len(order):
            bound = bounds[k][order]
            order = order[(bound > best[0]) | (bound == best[0]) & ((-k > best[1]) | (-k == best[1]) & (-order > best[2]))]
            tried, order = order[:size], order[size:]
            if len(tried):
                counts = match_counts(truth, preds[k], offsets[tried], (threshold,))[0]
                best = max(best, max(zip(counts.tolist(), [-k] * len(tried), (-tried).tolist(), strict=True)))
            size = min(2 * size, 4096)
    return best[0], -best[1], -best[2]


def best_scores(gt: dict, pred: dict, thresholds, n: int, reach: float) -> list[dict]:
    """For each threshold the best score over transforms and offsets; the earliest of equals (angle, mirror, x, y)."""
    truth, line = placed(gt), grid(n, reach)
    moves = list(itertools.product(ANGLES, MIRRORS))
    preds = placements(pred, moves)
    n_pred, n_gt, out = len(preds[0][0]), len(truth[0]), []
    for t in thresholds:
        tp, k, at = best_place(truth, preds, line, t)
        p, r, f1 = (float(x[0]) for x in _ratios(np.array([float(tp)]), n_pred, n_gt))
        out.append({"f1": f1, "precision": p, "recall": r, "tp": tp, "fp": n_pred - tp, "fn": n_gt - tp, "angle": moves[k][0], "mirror": moves[k][1], "dx": float(line[at // n]), "dy": float(line[at % n])})
    return out


def matched_pairs(gt: dict, pred: dict, score: dict, threshold: float) -> list[tuple]:
    """(class, truth's params, prediction's params) of the pairs behind a score."""
    pairs = match(placed(gt), placed(pred, score["angle"], score["mirror"]), (score["dx"], score["dy"]), threshold)
    ids, own = [o[0] for o in objects(gt)], [o[0] for o in objects(pred)]
    text = lambda scene, k: json.dumps(scene[k].get("params") or {}, ensure_ascii=False)
    return [(gt[ids[i]]["class"], text(gt, ids[i]), text(pred, own[j])) for i, j in pairs]


SCORES = "file string, threshold double, main boolean, status string, f1 double, precision double, recall double, tp long, fp long, fn long, angle int, mirror string, dx double, dy double, n_gt long, pairs array<struct<class:string,gt:string,pred:string>>"


def evaluate(truths: DataFrame, predictions: DataFrame, thresholds=(0.1, 0.25, 0.5), n: int = 100, reach: float = 0.5) -> DataFrame:
    """The best score of each scene and threshold, over 12 transforms and n x n offsets; ``pairs`` at the main threshold.

    truths, predictions: (file, raw).  status: ok, missing_pred, or error (malformed); only ok has scores.
    Predictions without a truth are left out; repeated files are scored each.
    """
    rows = truths.select("file", F.col("raw").alias("gt"), F.lit(True).alias("_t")).join(predictions.select("file", F.col("raw").alias("pred"), F.lit(True).alias("_p")), "file", "left")
    spark = truths.sparkSession
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism))  # small rows, long work: a fixed number of tasks
    main = main_threshold(thresholds)
    columns = [c.split()[0] for c in SCORES.split(", ")[:-1]] + ["pairs"]

    def run(batches):
        for part in batches:
            out = []
            for file, gt, pred, there in zip(part["file"], part["gt"], part["pred"], part["_p"], strict=True):
                status, got, n_gt, pairs = "ok" if there is True or there == 1 else "missing_pred", [{} for _ in thresholds], None, None
                try:
                    gt = json.loads(gt)
                    n_gt = len(objects(gt))
                    if status == "ok":
                        pred = json.loads(pred)
                        got = best_scores(gt, pred, thresholds, n, reach)
                        pairs = matched_pairs(gt, pred, got[list(thresholds).index(main)], main)
                except (ValueError, TypeError, KeyError, AttributeError):
                    status, got, pairs = "error", [{} for _ in thresholds], None
                out += [{"file": file, "threshold": t, "main": t == main, "status": status, "n_gt": n_gt, "pairs": pairs if t == main else None} | s for t, s in zip(thresholds, got, strict=True)]
            rows_ = [[x.get(c) for c in columns] for x in out]  # what none of them has is null, not a number
            yield pd.DataFrame(rows_, columns=columns, dtype=object).astype(dict.fromkeys(("tp", "fp", "fn", "n_gt"), "Int64") | {"angle": "Int32"})

    return rows.mapInPandas(run, SCORES)


def summary(scores: DataFrame, missing_as_misses: bool = False) -> DataFrame:
    """Macro means and micro ratios for each threshold, with the numbers of scenes by status.

    Over the scenes that were scored; with ``missing_as_misses`` those without a valid prediction
    count as well, with score 0 and all their objects missed.
    """
    ok = F.col("status") == "ok"
    counted = scores.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("f1", "precision", "recall", "tp", "fp")}).withColumn("fn", F.coalesce("fn", "n_gt", F.lit(0))) if missing_as_misses else scores
    own = (lambda c: F.col(c)) if missing_as_misses else (lambda c: F.when(ok, F.col(c)))
    by = counted.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(F.col("status") == "missing_pred").alias("n_missing"), F.count_if(F.col("status") == "error").alias("n_error"), *[F.avg(own(c)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[F.coalesce(F.sum(own(c)), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return by.withColumns(ratio_columns(F.col("tp"), F.col("fp"), F.col("fn"), "micro_"))


def over_thresholds(summed: DataFrame) -> DataFrame:
    """One row: the means of the micro figures over the thresholds."""
    return summed.agg(*[F.avg(f"micro_{c}").alias(f"mean_{c}") for c in ("precision", "recall", "f1")])


def matched_params(scores: DataFrame) -> DataFrame:
    """Parameter sums of the matched objects, by class and kind of value and in total."""
    return params.compare(scores.where("main").select(F.explode("pairs").alias("x")).select("x.*"))

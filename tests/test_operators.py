"""Operators against plain versions of themselves, and their odd inputs."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import images
from weftline.operators import garment, packing, params, profile, ranks, scene, stats, tokens, vision

ROOM = {
    "blueprint": {"rooms": {"r/0": {"shape": {"coordinates": [[[0, 0], [4, 0], [4, 2], [0, 2]]]}}}},
    "object_1": {"class": "Bed", "spatial": {"location": [1.0, 0.5, 0.0], "rotation": [0, 0, 0]}, "params": {"w": 0.5}},
    "object_2": {"class": "Chair", "spatial": {"location": [3.0, 1.5, 0.0], "rotation": [0, 0, 0]}, "params": {}},
    "portal": [{"seg": [[4, 0], [4, 1]], "rot": 0.0}],
}


def test_stretches_of_bins_are_those_of_plain_first_fit():
    rng = np.random.default_rng(7)
    for _ in range(300):
        capacity = int(rng.choice([1, 5, 10, 50, 200]))
        lengths = sorted(rng.integers(0, capacity + 1, rng.integers(0, 100)).tolist() + [capacity, capacity // 2] * int(rng.integers(0, 4)), reverse=True)
        bins, got = packing.Bins(capacity), []
        for n in dict.fromkeys(lengths):
            got += [first + i // k for m, first, k in bins.place(n, lengths.count(n)) for i in range(m)]
        assert got == packing.first_fit(lengths, capacity)


def test_structure_is_that_of_a_walk(spark):
    def walk(value, at="$", depth=0):
        yield at, type(value).__name__, depth, len(value) if isinstance(value, (dict, list)) else None
        for k, v in value.items() if isinstance(value, dict) else ():
            yield from walk(v, f"{at}.{k}", depth + 1)

    texts = ['{"a": 1, "b": 1.0, "c": 1e5, "d": -0.5, "e": 9223372036854775807, "f": 92233720368547758080, "g": 123456789012345678.25}', '{"x": {"y": {"z": {}, "l": [], "m": [1, {"q": 1}]}}, "t": true, "n": null, "s": "1"}', "[1, 2]", "3", '"text"', "null", "{", "", '{"é b": {"": 0}}']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("none", None)], "path string, raw string")
    want = sorted((str(i), *x) for i, t in enumerate(texts) if t not in ("{", "") for x in walk(json.loads(t)))
    assert sorted(tuple(r) for r in profile.structure(df).collect()) == want
    assert "Python" not in profile.structure(df)._jdf.queryExecution().executedPlan().toString()
    assert profile.structure(df.where("false")).count() == 0
    assert [tuple(r) for r in profile.key_counts(df).limit(2).collect()] == [("a", 1), ("b", 1)]


def test_order_statistics_of_many_values_in_one_group(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=300_000) * 10.0 ** rng.integers(-200, 200, 300_000), np.full(50_000, 0.25), [-0.0, 1e308, -1e308]])
    df = spark.createDataFrame(pd.DataFrame({"x": values, "g": np.where(np.arange(len(values)) % 1000 == 7, "few", "many")})).repartition(6)
    few, many = (np.sort(values[(np.arange(len(values)) % 1000 == 7) == own]) for own in (True, False))
    shares = {"a": 0.0, "b": 0.123456, "c": 0.5, "d": 0.999999, "e": 1.0}
    got = {r["g"]: r for r in ranks.percentiles(df, "x", shares, ["g"]).collect()}
    index = {r["g"]: r for r in ranks.index_quantiles(df, "x", {k: p for k, p in shares.items() if p < 1}, ["g"]).collect()}
    for g, own in (("few", few), ("many", many)):
        for k, p in shares.items():
            assert got[g][k] == pytest.approx(np.percentile(own, 100 * p), rel=1e-12)
            assert p == 1 or index[g][k] == own[int(len(own) * p)]
    assert ranks.percentiles(df.where("false"), "x", shares).collect()[0]["a"] is None
    assert ranks.percentiles(df.select(F.lit(None).cast("double").alias("x"), "g"), "x", shares, ["g"]).count() == 0


def test_samples_are_those_of_the_least_hashes(spark):
    import hashlib

    rows = [(i, "a" if i % 10 else ("b" if i % 20 else None)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(5)
    least = lambda own, n: sorted(own, key=lambda k: hashlib.md5(f"{k}-4".encode()).hexdigest())[:n]
    for n in (1, 40, 149, 150, 151, 5000):
        got = {}
        for r in ranks.sample(df, "k", n, 4, ["g"]).collect():
            got.setdefault(r["g"], []).append(r["k"])
        assert {g: sorted(v) for g, v in got.items()} == {g: sorted(least([k for k, h in rows if h == g], n)) for g in ("a", "b", None)}
    assert sorted(r["k"] for r in ranks.sample(df, "k", 7, 4).collect()) == sorted(least([k for k, _ in rows], 7))
    assert ranks.sample(df.where("false"), "k", 7).count() == 0
    order = [r["k"] for r in ranks.shuffled(df, "k", 4).orderBy("place").collect()]
    assert order == least([k for k, _ in rows], 3000)


def test_samples_where_the_hashes_are_uneven(spark, monkeypatch):
    """Hashes that all lie high: too few rows are below the bound, and all of the group are ranked."""
    monkeypatch.setattr(ranks, "drawn", lambda key, seed: F.concat(F.lit("ffff"), F.md5(key.cast("string").cast("binary"))))
    assert ranks.sample(spark.range(1000), "id", 3).count() == 3
    assert ranks.sample(spark.range(1000).withColumn("g", F.col("id") % 2), "id", 3, 0, ["g"]).count() == 6


def _brute_scores(gt, pred, thresholds, n, reach):
    """The best of all transforms and offsets, each offset tried."""
    truth, line = scene.placed(gt), scene.grid(n, reach)
    offsets = np.stack(np.meshgrid(line, line, indexing="ij"), -1).reshape(-1, 2)
    best = [(-1, None) for _ in thresholds]
    for move in itertools.product(scene.ANGLES, scene.MIRRORS):
        counts = scene.match_counts(truth, scene.placed(pred, *move), offsets, thresholds)
        for k, tp in enumerate(counts):
            if tp.max() > best[k][0]:
                best[k] = (int(tp.max()), (*move, *offsets[tp.argmax()].tolist()))
    return best


def test_scenes_without_predictions_in_a_task_of_their_own(spark):
    text = json.dumps(ROOM)
    truths = spark.createDataFrame([("a", text), ("b", "{"), ("c", "{}")], "file string, raw string").repartition(3, "file")
    for preds in ([], [("b", text)], [("c", text)]):
        got = {r["file"]: r["status"] for r in scene.evaluate(truths, spark.createDataFrame(preds, "file string, raw string"), n=1).where("main").collect()}
        assert got == {"a": "missing_pred", "b": "error", "c": "ok" if ("c", text) in preds else "missing_pred"}


def test_best_places_are_those_of_all_places():
    draw = np.random.default_rng(4)

    def made(xy, kinds):
        things = {f"object_{i + 1}": {"class": str(k), "spatial": {"location": [float(x), float(y), 0.0]}} for i, ((x, y), k) in enumerate(zip(xy, kinds))}
        return {"blueprint": {"rooms": {"r": {"shape": {"coordinates": [[[0, 0], [5, 0], [5, 3], [1, 4]]]}}}}} | things

    for _ in range(40):
        side = draw.choice([0.7, 2, 5])
        a = draw.random((draw.integers(0, 30), 2)) * [side, 0.6 * side]
        kinds = draw.choice(["Bed", "Chair"], len(a))
        b, own = a + draw.normal(0, 0.08, a.shape) + draw.uniform(-0.3, 0.3, 2), kinds
        if draw.random() < 0.5:  # rivals of each second object
            b, own = np.concatenate([b, b[::2] + 0.04]), np.concatenate([own, own[::2]])
        if draw.random() < 0.3:  # equal distances
            a, b = np.round(a, 1), np.round(b, 1)
        gt, pred = made(a, kinds), made(b, own)
        if draw.random() < 0.5:
            pred = scene.moved(pred, scene.turned(scene.points(pred), float(draw.choice(scene.ANGLES))))
        n, thresholds = int(draw.choice([1, 6, 25])), (0.1, 0.25, 0.5)
        got = scene.best_scores(gt, pred, thresholds, n, 0.5)
        assert [(s["tp"], (s["angle"], s["mirror"], s["dx"], s["dy"])) for s in got] == _brute_scores(gt, pred, thresholds, n, 0.5)
        assert all(s["tp"] + s["fn"] == len(a) and s["tp"] + s["fp"] == len(b) for s in got)


def test_a_batch_of_a_whole_corpus(spark):
    """One batch (its number null) with a hot length, rows beyond the capacity and rows without a length; no task holds it."""
    length = F.when(F.col("id") % 3 == 0, 512).when(F.col("id") % 97 == 0, None).otherwise(F.pmod(F.hash("id"), F.lit(600)))
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("batch_id"), F.col("id").alias("row_id"), length.cast("long").alias("n_tokens"))
    got = {r["row_id"]: (r["bin_id"], r["place"]) for r in packing.assign_bins(rows, 512).collect()}
    own = [(r["row_id"], r["n_tokens"] or 0) for r in rows.collect()]
    alone = [i for i, n in own if n > 512]
    rest = sorted((x for x in own if x[1] <= 512), key=lambda x: (-x[1], x[0]))
    want = {i: (k, k) for k, i in enumerate(alone)}
    for k, ((i, _), b) in enumerate(zip(rest, packing.first_fit([n for _, n in rest], 512))):
        want[i] = (len(alone) + b, len(alone) + k)
    assert got == want and len(alone) > 1000


def test_bins_are_those_of_plain_first_fit(spark):
    rng = np.random.default_rng(1)
    rows = [(b, i, int(n)) for b in range(3) for i, n in enumerate(rng.integers(1, 130, 80))]
    got = {(r["batch_id"], r["row_id"]): r["bin_id"] for r in packing.assign_bins(spark.createDataFrame(rows, "batch_id long, row_id long, n_tokens long"), 100).collect()}
    for b in range(3):
        own = [(i, n) for c, i, n in rows if c == b]
        bins, want = [], {}
        for i, n in own:
            if n > 100:
                want[i] = len(want)
        first = len(want)
        for i, n in sorted((x for x in own if x[1] <= 100), key=lambda x: (-x[1], x[0])):
            at = next((k for k, room in enumerate(bins) if room >= n), len(bins))
            if at == len(bins):
                bins.append(100)
            bins[at] -= n
            want[i] = first + at
        assert {i: got[b, i] for i, _ in own} == want


def test_ranks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), None if g == 3 else f"g{g}", int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 4, 500), rng.integers(0, 50, 500)))]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    want = {}
    for g in {r[1] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))):
            want[r[0]] = k
    assert {r["id"]: r["rank"] for r in ranks.ranked(df, ["g"], ["v", "id"]).collect()} == want
    assert [r["id"] for r in ranks.positions(df, ["id"], 10, 13).orderBy("id").collect()] == [10, 11, 12]
    assert {(r["g"], r["m"]) for r in ranks.index_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()} == {(g, sorted(r[2] for r in rows if r[1] == g)[sum(r[1] == g for r in rows) // 2]) for g in {r[1] for r in rows}}
    assert ranks.ranked(df.where("false"), ["g"], ["v"]).count() == 0
    assert ranks.split(df, "id", 0.1).groupBy("split").count().where("split = 'test'").first()["count"] == 50


def _greedy(gt, pred, shift, t):
    used, n = set(), 0
    for kind, at in gt:
        near = sorted((math.dist((x + shift[0], y + shift[1]), at), j) for j, (k, (x, y)) in enumerate(pred) if k == kind and j not in used)
        if near and near[0][0] < t:
            used.add(near[0][1])
            n += 1
    return n


def test_matches_of_all_offsets():
    rng = np.random.default_rng(3)
    sides = [([*rng.choice(["a", "b"], n)], rng.random((n, 2)) * 2) for n in (9, 7)]
    offsets = np.array(list(itertools.product(scene.grid(4, 0.5), repeat=2)))
    got = scene.match_counts(*sides, offsets, (0.2, 0.6))
    gt, pred = ([(k, tuple(p)) for k, p in zip(*s)] for s in sides)
    assert got.tolist() == [[_greedy(gt, pred, o, t) for o in offsets] for t in (0.2, 0.6)]
    assert len(scene.match(*sides, (0.1, 0.0), 0.6)) == _greedy(gt, pred, (0.1, 0.0), 0.6)


def test_scene_moves(spark):
    turned = scene.moved(ROOM, scene.turned(scene.points(ROOM), 90))
    assert np.allclose(turned["object_1"]["spatial"]["location"][:2], [2.5, 0.0]) and turned["portal"][0]["rot"] == pytest.approx(math.pi / 2)
    flipped = scene.moved(ROOM, scene.mirrored(scene.points(ROOM), "horizontal"))
    assert flipped["object_1"]["spatial"]["location"] == [3.0, 0.5, 0.0] and flipped["object_1"]["spatial"]["rotation"][2] == math.pi
    assert scene.moved(ROOM, scene.mirrored(scene.points(ROOM), "vertical"))["object_2"]["spatial"]["location"][:2] == [3.0, 0.5]
    away = scene.moved(ROOM, scene.offset(5, -7))
    assert np.allclose(scene.points(scene.moved(away, scene.to_origin(scene.points(away)))), scene.points(ROOM))
    back = ROOM
    for _ in range(4):
        back = scene.moved(back, scene.turned(scene.points(back), 90))
    assert np.allclose(scene.points(back), scene.points(ROOM))
    df = spark.createDataFrame([("a", json.dumps(ROOM)), ("b", "{bad"), ("c", None), ("d", "{}")], "file string, raw string")
    assert [r["raw"] is None for r in scene.transform(df, 90, origin=True).orderBy("file").collect()] == [False, True, True, False]
    assert [r["id"] for r in scene.object_table(df).orderBy("pos").collect()] == ["object_1", "object_2"]
    assert {r["file"]: r["max_x"] for r in scene.bounds(df).collect()} == {"a": 4.0, "b": None, "c": None, "d": None}


def test_scene_scores(spark):
    less = {k: v for k, v in ROOM.items() if k != "object_1"}
    gt = spark.createDataFrame([(f, json.dumps(ROOM)) for f in "abcd"], "file string, raw string")
    pred = spark.createDataFrame([("a", json.dumps(ROOM)), ("b", json.dumps(less)), ("d", "{"), ("z", "{}")], "file string, raw string")
    scores = scene.evaluate(gt, pred, n=5)
    got = {(r["file"], r["threshold"]): r for r in scores.collect()}
    assert got["a", 0.25]["f1"] == 1 and got["b", 0.25]["tp"] == 1 and abs(got["b", 0.25]["f1"] - 2 / 3) < 1e-9
    assert [got[f, 0.5]["status"] for f in "abcd"] == ["ok", "ok", "missing_pred", "error"] and got["c", 0.5]["f1"] is None and got["c", 0.5]["n_gt"] == 2
    one = {r["threshold"]: r for r in scene.summary(scores).collect()}[0.5]
    assert (one["n_ok"], one["n_missing"], one["n_error"], one["tp"], one["fn"]) == (2, 1, 1, 3, 1) and one["macro_f1"] == pytest.approx(5 / 6)
    hard = {r["threshold"]: r for r in scene.summary(scores, missing_as_misses=True).collect()}[0.5]
    assert (hard["tp"], hard["fn"]) == (3, 5) and hard["macro_f1"] == pytest.approx(5 / 12)
    sums = {(r["class"], r["kind"]): r for r in scene.matched_params(scores).collect()}
    assert sums[None, "object"]["n"] == 3 and sums["Bed", "float"]["n"] == 1 and sums["Chair", "object"]["ok"] == 2


def test_params():
    truth = {"width": 0.5, "depth": 0.3, "n": 5, "big": True, "small": False, "name": "x", "shift": [0.1, 0.2], "more": {"a": 0.4, "b": None}, "Thickness": 7.5}
    pred = {"width": 0.6, "depth": 0.3, "n": 6.4, "big": True, "small": 0, "name": "x", "shift": [0.1], "more": {"a": 0.4, "b": None}, "Thickness": 8, "extra": 1}
    got = {k: x for k, *x in params.sums(pred, truth)}
    assert got["keys"][:3] == [11, 11, 1] and got["float"][0] == 4 and got["float"][3] - 0.1 < 1e-9
    assert got["int"][0] == 1 and got["int"][3] == 1 and got["bool"][:2] == [2, 1] and got["str"][:2] == [2, 2] and got["list"][0] == 1
    assert got["thickness"][3] == 0.5 and got["thickness"][5:] == [7.5, 7.5] and got["object"][:2] == [1, 0]
    assert {k: x for k, *x in params.sums({"n": "x"}, {"n": 9, "m": 40, "f": 3.0})} == {"keys": [3, 1, 0, 0.0, 0.0, None, None], "int": [1, 0, 0, 9.0, 0.0, 9.0, 9.0], "object": [1, 0, 0, 0.0, 0.0, None, None]}
    assert params.holds_keys({"a": [{"b": 1}]}, {"a": [{"b": 2}]}) and not params.holds_keys({"a": []}, {"a": [1]})
    assert params.equal_values({"a": [1.0, "x"]}, {"a": [1.0 + 1e-9, "x"]}) and not params.equal_values(1, True)


def test_garments(spark):
    rng = np.random.default_rng(4)
    star = lambda n: (lambda r, a: np.stack([r * np.cos(a), r * np.sin(a)], 1))(rng.uniform(1, 3, n), np.sort(rng.uniform(0, 2 * np.pi, n)))
    grid = np.stack(np.meshgrid(*[np.linspace(-3, 3, 600)] * 2), -1).reshape(-1, 2)

    def inside(v):
        w, out = np.roll(v, -1, 0), np.zeros(len(grid), bool)
        for (x0, y0), (x1, y1) in zip(v, w):
            over = (y0 > grid[:, 1]) != (y1 > grid[:, 1])
            out ^= over & (grid[:, 0] < x0 + (grid[:, 1] - y0) * (x1 - x0) / (y1 - y0 if y1 != y0 else 1))
        return out

    for n in (5, 9, 14):
        v, w = star(n), star(n + 2)
        own, other, both = garment.overlap(v, w)
        a, b = inside(v), inside(w)
        cell = (6 / 599) ** 2
        assert own == pytest.approx(a.sum() * cell, rel=0.02) and other == pytest.approx(b.sum() * cell, rel=0.02) and both == pytest.approx((a & b).sum() * cell, rel=0.03)
    square = {"panel_id": 1, "vertices": [[0, 0], [275, 0], [275, 275], [0, 275]], "edges": [{"curve_type": "quadratic", "curve_params": [0.5, 0.1]}, {"edge_index": 2, "curve_type": "cubic", "curve_params": [1, 2, 3, 4]}]}
    whole = {"meta": {"scale": 2.75}, "panels": [square, square | {"panel_id": 2}], "stitches": [{"from_panel_id": 1, "from_edge_index": 0, "to_panel_id": 2, "to_edge_index": 1}, {"from_panel_id": 9, "to_panel_id": 1}]}
    made = json.loads(garment.specification(spark.createDataFrame([("a", json.dumps(whole))], "stem string, raw string")).first()["spec"])["pattern"]
    assert made["panels"]["panel_1"]["vertices"][2] == [1.0, 1.0] and len(made["stitches"]) == 1
    assert made["panels"]["panel_1"]["edges"][0]["curvature"] == [0.5, 0.1] and made["panels"]["panel_1"]["edges"][2]["curvature"]["type"] == "cubic"
    text = json.dumps(whole)
    df = spark.createDataFrame([("a", text), ("b", "{"), ("c", text)], "stem string, raw string")
    other = spark.createDataFrame([("a", text), ("b", text), ("z", text)], "stem string, raw string")
    rows = {r["sample"]: r for r in garment.evaluate(df, other).collect()}
    assert (rows["a"]["chamfer_mm"], rows["a"]["iou"], rows["a"]["stitch_accuracy"], rows["a"]["panel_count_match"]) == (0.0, pytest.approx(100.0), 100.0, True)
    assert rows["b"]["iou"] is None and rows["b"]["panel_count_match"] is False
    assert garment.summary(garment.evaluate(df, other)).first()["valid"] == 1
    assert garment.pair_counts(df, other).first().asDict() == {"matching": 2, "gt_only": 1, "pred_only": 1}


def _axes(ids, grids, start, image, merge):
    """Token by token."""
    out, at, k, text = [], 0, 0, 0
    while at < len(ids):
        if ids[at] == image and at and ids[at - 1] == start:
            t, h, w = grids[k][0], grids[k][1] // merge, grids[k][2] // merge
            k += 1
            out += [(text + a, text + b, text + c) for a in range(t) for b in range(h) for c in range(w)]
            at += t * h * w
            text = max(map(max, out)) + 1
        else:
            out.append((text,) * 3)
            text += 1
            at += 1
    return np.array(out).T


def test_vision_positions(spark):
    start, image = 100, 101
    ids = [1, 2, start, *[image] * 6, 3, start, *[image] * 4, 4, 5]
    grids = [(1, 4, 6), (1, 4, 4)]
    assert vision.axes(ids, grids, start, image).tolist() == _axes(ids, grids, start, image, 2).tolist()
    assert vision.axes([1, 2, 3], [], start, image).tolist() == [[0, 1, 2]] * 3 and vision.axes([], [], start, image).shape == (3, 0)
    both = np.concatenate([_axes(ids, grids, start, image, 2), _axes(ids[:10], grids, start, image, 2)], 1)
    assert vision.packed_axes(ids + ids[:10], [len(ids), 10], grids + grids[:1], start, image).tolist() == both.tolist()
    df = spark.createDataFrame([(1, ids + ids[:10], [len(ids), 10], [[1, 4, 6], [1, 4, 4], [1, 4, 6]]), (2, [7, 8], None, None)], "k int, input_ids array<int>, sequence_lengths array<int>, image_grids array<array<int>>")
    got = {r["k"]: r["positions"] for r in vision.position_ids(df, start, image, to=20).collect()}
    assert got[1][0] == [*range(len(ids)), *range(20 - len(ids))] and got[1][1:] == both[:, :20].tolist() and got[2] == [[0, 1]] * 4


def test_positions_of_the_jvm_are_those_of_each_sequence(spark):
    start, image, draw, rows = 100, 101, np.random.default_rng(2), []
    for k in range(200):
        ids, lengths, grids = [], [], []
        for _ in range(draw.integers(0, 4)):
            own = []
            for _ in range(draw.integers(0, 4)):
                if draw.random() < 0.6:
                    t, h, w = map(int, draw.integers(1, 4, 3))
                    grids.append([t, 2 * h, 2 * w])
                    own += [start] + [image] * (t * h * w)
                own += draw.choice([1, 2, 3], draw.integers(0, 5)).tolist() + ([start, 1] if draw.random() < 0.2 else [])
            lengths.append(len(own))
            ids += own
        ids += [0] * int(draw.integers(0, 5))
        rows.append((k, ids, lengths if draw.random() < 0.9 else None, grids[:-1] if draw.random() < 0.1 else grids))
    df = spark.createDataFrame(rows, "k int, input_ids array<int>, sequence_lengths array<int>, image_grids array<array<int>>")
    for to in (None, 7, 20):
        got = {r["k"]: r["positions"] for r in vision.position_ids(df, start, image, to).collect()}
        for k, ids, lengths, grids in rows:
            x = ids[:to]
            n = np.diff([0, *np.minimum(np.cumsum(lengths), len(x))]).tolist() if lengths else [len(x)]
            run = [i for m in (*n, len(x) - sum(n)) for i in range(m)]
            assert got[k] == [run, *vision.packed_axes(x, n, [tuple(g) for g in grids], start, image).tolist()], (to, k)


def test_image_tokens(spark):
    df = spark.createDataFrame([([9, 100, 101, 101, 8, 100, 101, 7], [3, 1]), ([100, 5], [2]), ([5], [2])], "ids array<int>, n array<int>")
    rows = df.select(vision.expand(F.col("ids"), F.col("n"), 100, 101).alias("x"), vision.image_count(F.col("ids"), 100, 101).alias("c")).collect()
    assert [r["x"] for r in rows] == [[9, 100, 101, 101, 101, 8, 100, 101, 7], [100, 101, 101, 5], [5]] and [r["c"] for r in rows] == [2, 0, 0]
    for r in df.collect():
        assert vision.expanded(r["ids"], r["n"], 100, 101) == next(x["x"] for x, y in zip(rows, df.collect()) if y == r)
    talk = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "ok")], 1)], "id int, messages array<struct<role:string,content:string>>, num_images int")
    row = vision.tokenize(talk, 1000, fixed=4).first()
    assert row["has_image"] and len(row["labels"]) == len(row["input_ids"]) and row["labels"][-1] != -100 and row["labels"][0] == -100
    assert vision.tokenize(talk, 10, fixed=4).count() == 0 and vision.tokenize(talk, 10, fixed=4, truncate=True).first()["n_tokens"] == 10


def test_tokenizers(spark):
    text = "Hi  there <|im_end|> é\n"
    for path in (None, "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/byte_bpe_50k.tiktoken"):
        tok = tokens.load_tokenizer(path)
        assert tok.decode(tok.encode(text)) == text and tok.encode("<|im_end|>") == [tok.size + 1] and tok.pad_id == tok.special("<|endoftext|>")
        assert tok.decode(tok.encode(text), skip_marks=True) == text.replace("<|im_end|>", "")
    df = spark.createDataFrame([(1, [("system", "s"), ("user", "a b"), ("assistant", "c")])], "row_id long, messages array<struct<role:string,content:string>>")
    row = tokens.decoded(tokens.tokenize(df, 100, tokens.load_tokenizer("/opt/tokenizers/piece_bpe_32k.model")), tokens.load_tokenizer("/opt/tokenizers/piece_bpe_32k.model")).first()
    assert "assistant" in row["label_text"] and "user" not in row["label_text"]
    with pytest.raises(ValueError):
        tokens.load_tokenizer("x.bin")
    with pytest.raises(ValueError):
        tokens.tokenize_mode(df, "nothing", 10)
    got = tokens.collate(tokens.tokenize(df, 100), 2, 0, ["row_id"], 8, fixed=True).first()
    assert len(got["input_ids"]) == len(got["labels"]) == len(got["attention_mask"]) == 8


def test_images(spark):
    rng = np.random.default_rng(5)
    rgb = rng.integers(0, 256, (33, 47, 3), dtype=np.uint8)
    data = images.encode_png(rgb)
    assert images.header_size(data) == (47, 33) and (images.decode_png(data) == rgb).all()
    lines = [bytes([0]) + rgb[0].tobytes()]
    for y in range(1, 33):  # all filters
        kind, raw, up = y % 5, rgb[y].astype(int).ravel(), rgb[y - 1].astype(int).ravel()
        left, corner = np.concatenate([[0] * 3, raw[:-3]]), np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        near = np.stack([abs(p - left), abs(p - up), abs(p - corner)]).argmin(0)
        guess = [0 * raw, left, up, (left + up) // 2, np.choose(near, [left, up, corner])][kind]
        lines.append(bytes([kind]) + ((raw - guess) % 256).astype(np.uint8).tobytes())
    import struct
    import zlib

    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    other = images.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", 47, 33, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")
    assert (images.decode_png(other) == rgb).all()
    flat = np.full((20, 30, 3), 77, np.uint8)
    assert (images.resize(flat, 13, 41) == 77).all() and images.fit_square(rgb, 64, 32).shape == (32, 64, 3)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 480, 640) + b"\x03" + b"\0" * 9
    assert images.header_size(jpeg) == (640, 480) and images.header_size(b"GIF") is None and images.header_size(None) is None
    df = spark.createDataFrame([("a", data), ("b", b"junk"), ("c", None)], "path string, content binary")
    got = {r["path"]: r for r in images.encoded(df, (16, 8)).collect()}
    assert (got["a"]["width"], got["a"]["height"]) == (16, 8) and got["b"]["image"] is None and got["c"]["image"] is None
    drawn = df.withColumn("s", images.drawn_size(F.col("path"), (64, 32), (128, 96))).withColumns({"want_width": F.col("s.width"), "want_height": F.col("s.height")})
    row = images.encoded(drawn).where("path = 'a'").first()
    assert row["width"] == row["want_width"] and row["width"] % 32 == 0 and 64 <= row["width"] <= 128
    assert df.select(images.resolution("content").alias("r")).orderBy("path").first()["r"]["width"] == 47


def test_statistics(spark):
    df = spark.createDataFrame([([3, 4],), ([],), (None,), ([5],)], "sequence_lengths array<int>")
    one = stats.packed_stats(df).first()
    assert (one["sequences"], one["packed_rows"], one["tokens"], one["least_per_row"], one["most_per_row"], one["ratio"]) == (3, 4, 12, 0, 2, 0.75)
    assert stats.packed_stats(df.where("false")).first()["ratio"] is None
    bins = spark.range(1).select(*[stats.bin_of(F.lit(x)).alias(f"b{i}") for i, x in enumerate((0, 255, 256, 32768, 10**6))]).first()
    assert list(bins) == [0, 0, 1, 8, 8]
    assert stats.perplexity(spark.createDataFrame([(0.0,), (2.0,)], "loss double")).first()["perplexity"] == pytest.approx(math.e)


def test_profiles(spark, tmp_path):
    rows = [("a", '{"blueprint":{"rooms":{"r":1,"s":2}},"x":[1]}'), ("b", '{"blueprint":{}}'), ("c", "{bad"), ("d", "[1]"), ("e", None)]
    df = spark.createDataFrame(rows, "path string, raw string").withColumn("stem", F.col("path"))
    assert {r["path"]: r["n"] for r in df.select("path", profile.room_count(F.col("raw")).alias("n")).collect()} == {"a": 2, "b": 0, "c": None, "d": 0, "e": None}
    assert sorted(r["path"] for r in profile.single_room(df).collect()) == ["b", "c", "d", "e"]
    one = profile.quality(profile.profile(df)).first()
    assert (one["files"], one["valid"], one["invalid"], one["consistency"]) == (5, 3, 2, 0.5) and one["rating"] in ("to improve", "passing", "medium", "good", "excellent")
    assert profile.profile(df.where("false")).first()["files"] == 0
    assert ("a", "$.blueprint.rooms", "dict", 2, 2) in {tuple(r) for r in profile.structure(df).collect()}
    got = {r["name"]: r["source"] for r in profile.content_match(df, df.withColumn("stem", F.concat(F.lit("s"), "stem"))).collect()}
    assert got == {"a": "sa", "b": "sb", "c": None, "d": "sd", "e": None}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.json").write_text("{}")
    mapping = spark.createDataFrame([(str(tmp_path / "in" / "q.json"), "p.json")], "path string, to string")
    for how in ("copy", "symlink", "hardlink", "copy"):
        assert profile.materialize(mapping, str(tmp_path / "out"), how) == 1 and [r["to"] for r in spark.read.json(str(tmp_path / "out" / profile.MAPPING)).collect()] == ["p.json"] and (tmp_path / "out" / "p.json").read_text() == "{}"


def test_nearest_in_tiles(spark):
    from weftline.operators.nearest import nearest

    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=3)], int(i % 2)) for i in range(40)]
    rows += [(40, rows[3][1], 1), (41, rows[3][1], 1), (42, None, 1), (43, [], 0), (44, [1.0, 2.0], 0), (45, [0.0] * 3, None), (46, [1.0] * 3, None), (47, [0.0] * 3, 9)]
    df = spark.createDataFrame(rows, "id long, v array<double>, c int")
    want = {}
    for i, v, c in rows:
        far = sorted((math.dist(v, w), j) for j, w, d in rows if v and w and j != i and d == c and len(v) == len(w))
        if far:
            want[i] = far[0][1]
    for tile in (4, 2048):
        assert {r["id"]: r["nearest"] for r in nearest(df, "id", "v", "c", tile).collect()} == want


def test_packed_images_come_back(spark):
    tok = tokens.ByteTokenizer()
    rows = [(0, i, [("user", f"q{i}"), ("assistant", f"a{i}")], k, [3, 2][:k] or None, [f"s.tar::d{i}/v{j}.png" for j in range(k)]) for i, k in enumerate((1, 0, 2))]
    df = spark.createDataFrame(rows, "batch_id long, row_id long, messages array<struct<role:string,content:string>>, num_images int, image_token_counts array<int>, image_refs array<string>")
    own = vision.tokenize(df, 1000)
    packed = packing.pack(own.withColumn("n_tokens", F.col("n_tokens").cast("long")), 1000)
    assert len(packed.first()["image_refs"]) == 3 and sorted(packed.first()["has_image"]) == [False, True, True]
    got = {r["prompt"]: r for r in packing.prompt_records(packed, tok, "multi_view").collect()}
    assert {p: (r["id"][:2], r["image_refs"], r["ground_truth"]) for p, r in got.items() if p != "q1"} == {"q0": ("d0", ["s.tar::d0/v0.png"], "a0"), "q2": ("d2", ["s.tar::d2/v0.png", "s.tar::d2/v1.png"], "a2")}
    assert got["q1"]["id"].startswith("arrow_") and got["q1"]["image_refs"] == []
    one = {r["prompt"]: (r["id"], len(r["image_refs"])) for r in packing.prompt_records(packed, tok, "panorama").collect()}
    assert one["q2"] == ("v0", 1)
    assert packing.prompt_records(packed, tok, offset=1, count=1).count() == 1


def test_token_arrays_come_in_small_parts(spark):
    from weftline.session import BATCH, MOST_ROWS, ship

    sizes = np.array([5, 0, 3, 40, 1, 1, 8])
    spans = tokens.pieces(sizes, 10)
    assert [k for a, b in spans for k in range(a, b)] == list(range(7)) and all(sizes[a : b - 1].sum() < 10 for a, b in spans) and not tokens.pieces(sizes[:0])
    parts = tokens.mapped(spark.createDataFrame([("x" * 2**20,)] * 8, "t string").coalesce(1), lambda batch: np.full(batch.num_rows, 2**20), lambda part: [pa.array([part.num_rows] * part.num_rows, pa.int64())], ("t",), n="long")
    assert {r["n"] for r in parts.collect()} == {1}  # whatever the rows of a batch
    held = {key: spark.conf.get(key) for key in MOST_ROWS}
    try:
        for key, rows in MOST_ROWS.items():
            spark.conf.set(key, "10000")
            ship(spark)
            assert int(spark.conf.get(key)) == rows
        spark.conf.set(BATCH, "7")
        ship(spark)
        assert spark.conf.get(BATCH) == "7"
    finally:
        for key, rows in held.items():
            spark.conf.set(key, rows)


def test_tokens_of_odd_conversations(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [("assistant", None)]), (3, [("user", "é<|im_end|>"), ("tool", "")])], "k int, messages array<struct<role:string,content:string>>").coalesce(1)
    got = {r["k"]: r for r in tokens.decoded(tokens.tokenize(df, 100, all_roles=True)).collect()}
    assert sorted(got) == [2, 3] and got[2]["text"] == got[2]["label_text"] == "<|im_start|>assistant\n<|im_end|>\n"
    assert got[3]["text"] == "<|im_start|>user\né<|im_end|><|im_end|>\n<|im_start|>tool\n<|im_end|>\n" and got[3]["label_text"] == "<|im_start|>tool\n<|im_end|>\n"
    rows = spark.createDataFrame([(None, None), ([65, 256], [-100, 256])], "input_ids array<int>, labels array<int>")
    assert [(r["text"], r["label_text"]) for r in tokens.decoded(rows).collect()] == [(None, None), ("A<|im_start|>", "<|im_start|>")]


def test_matches_of_crowded_places(monkeypatch):
    """Thousands of objects: pairs nearby alone are compared, stretch by stretch, with the result of all pairs."""
    draw = np.random.default_rng(6)
    for n, pairs in ((60, 7), (300, 100), (300, 1 << 18)):
        monkeypatch.setattr(scene, "PAIRS", pairs)
        gt = ([*draw.choice(["a", "b", "c"], n)], draw.random((n, 2)) * 2)
        pred = ([*draw.choice(["a", "b"], n)], np.round(draw.random((n, 2)) * 2, 1))
        gt[1][5], pred[1][7] = [1e12, -1e12], [np.nan, 0]
        used, want = set(), []
        for i, (kind, at) in enumerate(zip(*gt)):
            d = sorted((math.sqrt((x + 0.1 - at[0]) ** 2 + (y - at[1]) ** 2), j) for j, (k, (x, y)) in enumerate(zip(*pred)) if k == kind and j not in used and x == x)
            if d and d[0][0] < 0.25:
                used.add(d[0][1])
                want.append((i, d[0][1]))
        assert scene.match(gt, pred, (0.1, 0.0), 0.25) == want and len(want) > n / 3
        assert scene.best_place(gt, [pred, pred], np.zeros(1), 0.25) == (int(scene.match_counts(gt, pred, np.zeros((1, 2)), (0.25,))[0, 0]), 0, 0)
    many = (["a"] * 30_000, draw.random((30_000, 2)) * 40)  # all pairs would be 9e8
    assert len(scene.match(many, (many[0], many[1][::-1] + 1e-9), threshold=0.01)) == 30_000
    assert scene.match(([], []), many) == scene.match(many, ([], [])) == []


def test_params_are_compared_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    pairs = spark.createDataFrame([("a", '{"w": 0.5}'), (None, '{"w": 1}'), ("b", "{}")], "class string, gt string").withColumn("pred", counted("gt"))
    got = {(r["class"], r["kind"]): r["n"] for r in params.compare(pairs).collect()}
    assert got == {("a", "keys"): 1, ("a", "float"): 1, ("a", "object"): 1, ("b", "keys"): 0, ("b", "object"): 1, (None, "keys"): 2, (None, "float"): 1, (None, "int"): 1, (None, "object"): 3}
    assert seen.value == 3


def test_rows_are_cut_before_they_are_numbered(spark, monkeypatch):
    held, own = [], ranks.written
    monkeypatch.setattr(ranks, "written", lambda df: held.append(df) or own(df))
    rows = spark.createDataFrame([(i, [i] * (3 * i), [-100] * (3 * i)) for i in range(1, 6)], "row_id long, input_ids array<int>, labels array<int>")
    got = {r["row_id"]: r for r in tokens.collate(rows, 2, 0, ["row_id"], 7).collect()}
    assert max(len(r[c]) for r in held[0].collect() for c in ("input_ids", "labels")) == 7  # not 15
    assert {k: (r["batch_id"], r["input_ids"], r["labels"], sum(r["attention_mask"])) for k, r in got.items()} == {
        k: (b, [k] * n + [0] * (to - n), [-100] * to, n) for k, b, n, to in ((1, 0, 3, 6), (2, 0, 6, 6), (3, 1, 7, 7), (4, 1, 7, 7), (5, 2, 7, 7))
    }


def test_counts_and_texts_of_tokens_equal_those_of_the_arrays(spark):
    turns = "array<struct<role:string,content:string>>"
    rows = [(1, [("system", "sé"), ("user", "a b"), ("assistant", "c")], 2), (2, [("user", None), ("assistant", "x" * 50)], 1), (3, [], 0), (4, None, 1), (5, [("assistant", "<|vision_start|> \n")], None), (None, [("user", "z")], 0)]
    df = spark.createDataFrame(rows, f"k long, messages {turns}, num_images int").withColumn("image_token_counts", F.array(F.lit(3), F.lit(5)))
    size = lambda own: own.select("k", F.size("input_ids").alias("n_tokens"), F.size("labels").alias("n_labels"), F.size(F.filter("labels", lambda x: x != tokens.IGNORE)).alias("n_supervised"))
    told = lambda own, *c: sorted(map(repr, own.select("k", *c).collect()))
    counts = list(tokens.COUNTS)
    for mode, more in (("caption", {}), ("panorama", {}), ("panorama", {"truncate": True}), ("multi_view", {"fixed": 9})):
        for most in (10**9, 20):
            assert told(tokens.tokenize_mode(df, mode, most, counted=True, **more), *counts) == told(size(tokens.tokenize_mode(df, mode, most, **more)), *counts)
    assert told(tokens.tokenize(df, 10**9, all_roles=True, counted=True), *counts) == told(size(tokens.tokenize(df, 10**9, all_roles=True)), *counts)
    for most in (10**9, 20):
        assert told(tokens.rendered(df, most), "n_tokens", "text", "label_text") == told(tokens.decoded(tokens.tokenize(df, most)), "n_tokens", "text", "label_text")
    assert told(tokens.tokenize(df, 10**9, counted=True)) == ["Row(k=1)", "Row(k=2)", "Row(k=5)", "Row(k=None)"]


def test_packing_keeps_rows_without_numbers_however_many_tasks_gather_them(spark, monkeypatch):
    rows = [(b, i, [i or 0] * n, [-100] * n, n) for b, i, n in ((0, 1, 5), (0, None, 3), (None, 2, 4), (None, None, 7), (1, 3, 30), (0, 4, 2))]
    df = spark.createDataFrame(rows, "batch_id long, row_id long, input_ids array<int>, labels array<int>, n_tokens long")
    told = lambda own: sorted((str(r["batch_id"]), r["bin_id"], r["sequence_lengths"], r["input_ids"]) for r in own.collect())
    got = told(packing.pack(df, 10))
    assert [x[:3] for x in got] == [("0", 0, [5, 3, 2]), ("1", 0, [10]), ("None", 0, [7]), ("None", 1, [4])]
    monkeypatch.setattr(packing, "GATHERED", 20)
    assert packing.tasks(df) == 3 and packing.tasks(df.limit(0)) == 1
    assert told(packing.pack(df, 10, packing.tasks(df))) == got

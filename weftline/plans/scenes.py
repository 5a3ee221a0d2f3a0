
from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import garment, params, profile, scene
from weftline.plans import inputs
from weftline.plans.inputs import table
from weftline.sources import files


def _round(rows, digits=6):
    return rows.withColumns({c: F.round(c, digits) for c in rows.columns if rows.schema[c].dataType.simpleString() == "double"})


def scene_objects(spark, sf_dir):  # P9, P11
    rows = scene.object_table(inputs.order_scenes(spark, sf_dir))
    return rows.select("file", F.col("pos").cast("long").alias("pos"), "id", "class", F.get("location", 0).alias("x"), F.get("location", 1).alias("y"))


def object_lookup(spark, sf_dir):  # P10
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"), F.lit("object_2").alias("id"))
    got = scene.object_lookup(inputs.order_scenes(spark, sf_dir), wanted)
    return got.select("file", F.get_json_object("object", "$.class").alias("class"))


def scene_bounds(spark, sf_dir):  # A29
    return scene.bounds(inputs.order_scenes(spark, sf_dir))


def open_bounds(spark, sf_dir):  # A29: boxes of objects and portals, each scene its own
    return scene.bounds(inputs.order_scenes(spark, sf_dir, rooms=False))


def _placed(rows):
    rows = scene.object_table(rows)
    return _round(rows.select("file", "id", F.get("location", 0).alias("x"), F.get("location", 1).alias("y")))


def scene_turned(spark, sf_dir):  # G1-G3: a quarter turn, corner to the origin
    return _placed(scene.transform(inputs.supplier_scenes(spark, sf_dir), 90, origin=True))


def scene_mirrored(spark, sf_dir):  # G4, G5
    return _placed(scene.transform(inputs.supplier_scenes(spark, sf_dir), mirror="horizontal", dx=2.5, dy=-1.0))


def _scores(spark, sf_dir):
    truth = inputs.supplier_scenes(spark, sf_dir)
    pred = scene.transform(inputs.supplier_scenes(spark, sf_dir, F.col("s_suppkey") % 4 != 1), 90, dx=3.0).where(F.col("file") != "0")
    return scene.evaluate(truth, pred)


def scene_f1(spark, sf_dir):  # J5, J9, J12, A12, A13: predictions lack each fourth object and are turned
    return _round(scene.summary(_scores(spark, sf_dir)))


def scene_status(spark, sf_dir):  # J5
    return _scores(spark, sf_dir).where("main").select("file", "status", "n_gt")


def scene_f1_mean(spark, sf_dir):  # A14
    return _round(scene.over_thresholds(scene.summary(_scores(spark, sf_dir))))


def scene_params(spark, sf_dir):  # A16: objects of the two classes that were matched
    got = scene.matched_params(_scores(spark, sf_dir)).where("kind = 'object'")
    return got.select(F.coalesce("class", F.lit("all")).alias("class"), "n", "ok")


def _crowded(spark, sf_dir):
    pred = scene.transform(inputs.crowded_scenes(spark, sf_dir, predicted=True), 90, "vertical", dx=3.0)
    return scene.evaluate(inputs.crowded_scenes(spark, sf_dir), pred, thresholds=(0.3,), n=1)


def scene_rivals(spark, sf_dir):  # J9, G2-G4, G7: rivals within a threshold; predictions are turned and mirrored
    got = _crowded(spark, sf_dir).select("file", "f1", "precision", "recall", "tp", "fp", "fn", F.col("angle").cast("long").alias("angle"), "mirror")
    return _round(got)


def scene_pair_params(spark, sf_dir):  # A15, A16: the parameters of matched objects, by class and kind
    got = scene.matched_params(_crowded(spark, sf_dir))
    return _round(got.select(F.coalesce("class", F.lit("all")).alias("class"), "kind", "n", "ok", "extra", "abs_error", "least", "most"))


def _part_params(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    whole = F.col("p_size").cast("int")
    gt = F.to_json(F.struct(whole.alias("size"), (F.col("p_size") / 100.0).alias("share"), (F.col("p_size") / 4.0 + 100.5).alias("wallThickness"), F.col("p_brand").alias("brand"), (F.col("p_size") > 25).alias("big"), F.struct((F.col("p_size") / 64.0).alias("a")).alias("more"), F.array(F.lit("x"), F.col("p_type")).alias("tags")))
    odd = F.col("p_partkey") % 5 == 0
    pred = F.to_json(F.struct((whole + 1).alias("size"), (F.col("p_size") / 100.0 + 0.25).alias("share"), (F.col("p_size") / 4.0 + 101.0).alias("wallThickness"), F.when(odd, "none").otherwise(F.col("p_brand")).alias("brand"), F.when(~odd, F.lit(True)).alias("big"), F.struct(F.lit(0.5).alias("a"), F.lit(1).alias("b")).alias("more"), F.array(F.lit("x")).alias("tags")))
    return p.select(gt.alias("gt"), pred.alias("pred"), F.col("p_brand").alias("class"))


def params_accuracy(spark, sf_dir):  # A15-A18
    rows = params.summary(params.compare(_part_params(spark, sf_dir)))
    out = rows.where("class is null").select("kind", "n", "ok", "extra", "abs_error", "mean_abs_error", "least", "most", "accuracy")
    return _round(out)


def params_report(spark, sf_dir):  # A20: the printed table, line by line
    text = params.report(params.compare(_part_params(spark, sf_dir)))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "n long, line string")


def equal_params(spark, sf_dir):  # A19: deep equality with a tolerance, whatever the order of keys
    k = F.col("p_partkey")
    a = F.to_json(F.struct(k.alias("k"), F.array(F.col("p_size") / 4.0, F.lit(1)).alias("l"), F.struct(F.col("p_name").alias("n")).alias("o")))
    b = F.to_json(F.struct(F.struct(F.col("p_name").alias("n")).alias("o"), F.when(k % 5 == 0, k + 1).otherwise(k).alias("k"), F.array(F.col("p_size") / 4.0 + F.when(k % 3 == 0, 1e-3).otherwise(1e-8), F.lit(1)).alias("l")))
    return table(spark, sf_dir, "part").select("p_partkey", params.equal(a, F.when(k % 7 != 0, b).otherwise("{")).alias("same"))


def garment_panels(spark, sf_dir):  # G8-G11, G13
    rows = garment.panel_table(inputs.patterns(spark, sf_dir))
    return _round(rows.select("stem", "panel", F.col("vertex").cast("long").alias("vertex"), "x", "y", "length"))


def garment_metrics(spark, sf_dir):  # G12, G14, J8, J14, A21-A24
    out = garment.evaluate(inputs.patterns(spark, sf_dir), inputs.patterns(spark, sf_dir, 1))
    return _round(out.select("sample", "panel_count_match", F.col("gt_panels").cast("long").alias("gt_panels"), "iou", "stitch_accuracy", "stitch_precision"))


def garment_same(spark, sf_dir):  # A21, A25: a pattern against itself
    own = inputs.patterns(spark, sf_dir)
    return _round(garment.summary(garment.evaluate(own, own)))


def garment_curves(spark, sf_dir):  # G9: curves by number and by place, with too few numbers, of straight edges
    rows = garment.curves(garment.panels(inputs.shaped_patterns(spark, sf_dir), "stem"), "stem")
    return rows.select("stem", "panel", F.col("edge").cast("long").alias("edge"), "kind", F.array_join(F.transform("params", lambda x: x.cast("long").cast("string")), ",").alias("params"))


def garment_spec(spark, sf_dir):  # G8-G10, G14: figures read from the decoded form
    rows = garment.specification(inputs.shaped_patterns(spark, sf_dir))
    at = lambda path: F.get_json_object("spec", f"$.pattern.{path}")
    return rows.select("stem", at("panels.panel_1.vertices[2][0]").cast("double").alias("x"), F.round(at("panels.panel_0.translation[0]").cast("double"), 6).alias("tx"), at("panels.panel_0.translation[2]").cast("double").alias("tz"), F.json_array_length(at("panels.panel_1.edges")).cast("long").alias("n_edges"), at("panels.panel_1.edges[4].endpoints").alias("last"), F.json_array_length(at("stitches")).cast("long").alias("n_stitches"), F.get_json_object("spec", "$.properties.units_in_meter").cast("long").alias("units"))


def garment_shapes(spark, sf_dir):  # G11-G13, J8, J14, A21-A24: shapes that grow, and stitches with rivals
    out = garment.evaluate(inputs.shaped_patterns(spark, sf_dir), inputs.shaped_patterns(spark, sf_dir, grown=True))
    return _round(out.select("sample", "chamfer_mm", "iou", "stitch_accuracy", "stitch_precision", *[F.col(c).cast("long").alias(c) for c in ("stitches_correct", "stitches_pred", "stitches_gt")]))


def garment_pairs(spark, sf_dir):  # J6
    s = table(spark, sf_dir, "supplier")
    side = lambda k: s.where(F.col("s_suppkey") % k != 0).select(F.col("s_suppkey").cast("string").alias("stem"))
    return garment.pair_counts(side(3), side(2))


def room_counts(spark, sf_dir):  # P8, A7
    return _round(profile.room_distribution(inputs.order_scenes(spark, sf_dir)))


def single_rooms(spark, sf_dir):  # K15 without deleting
    return profile.single_room(inputs.order_scenes(spark, sf_dir)).select("file")


def file_profile(spark, sf_dir):  # A8, P21
    out = profile.profile(inputs.event_files(spark, sf_dir))
    keys = F.array_join(F.transform("common_keys", lambda k: F.concat(k["key"], F.lit("="), k["n"].cast("string"))), ",")
    return _round(out.withColumn("common_keys", keys))


def file_quality(spark, sf_dir):  # A9
    out = profile.quality(profile.profile(inputs.event_files(spark, sf_dir)))
    return _round(out.select("score", "max_score", "percent", "rating"), 4)


def key_counts(spark, sf_dir):  # O5
    return profile.key_counts(inputs.event_files(spark, sf_dir)).limit(2)


def json_structure(spark, sf_dir):  # P21
    rows = profile.structure(inputs.event_files(spark, sf_dir))
    return rows.groupBy("at", "type").agg(F.count("*").alias("n"), F.max("depth").cast("long").alias("depth"))


def malformed_files(spark, sf_dir):  # S1
    return files.malformed(inputs.event_files(spark, sf_dir))


def first_errors(spark, sf_dir):  # O6: the first ten files that cannot be read, and why
    return files.first_errors(inputs.event_files(spark, sf_dir))


def content_match(spark, sf_dir):  # J7, J7b: events by content, whatever the order of their keys
    rows = inputs.event_files(spark, sf_dir).withColumn("raw", F.regexp_replace("raw", ',"odd":null', ""))
    return profile.content_match(rows, rows).select("name", "source")


def first_by_name(spark, sf_dir):  # S11
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/f"), (F.col("doc_id") % 50).cast("string"), F.lit(".json")).alias("path"))
    return files.first_by_name(rows).select("name", "path")


def converted_yaml(spark, sf_dir):  # S10, O15, K4
    raw = F.concat(F.col("p_partkey").cast("string"), F.lit("_BedFactory:\n  w: "), (F.col("p_retailprice") / 7).cast("string"), F.lit("\nblueprint: {}\n12_XFactory: [1, true, null]\n"))
    rows = files.converted(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_partkey").cast("string").alias("stem"), raw.alias("raw")), 2)
    own = F.from_json("raw", "map<string,string>")
    return rows.select("stem", F.array_join(F.map_keys(own), ",").alias("keys"), F.get_json_object(F.element_at(own, "object_1"), "$.w").cast("double").alias("w"))


QUERIES = {f.__name__: f for f in (scene_objects, object_lookup, scene_bounds, open_bounds, scene_turned, scene_mirrored, scene_f1, scene_status, scene_f1_mean, scene_params, scene_rivals, scene_pair_params, params_accuracy, params_report, equal_params, garment_panels, garment_metrics, garment_same, garment_curves, garment_spec, garment_shapes, garment_pairs, room_counts, single_rooms, file_profile, file_quality, key_counts, json_structure, malformed_files, first_errors, content_match, first_by_name, converted_yaml)}

_X, _Y = "s_suppkey % 97 + 1", "s_suppkey // 97 % 50 + 1"
_SCORED = "s AS (SELECT s_nationkey AS f, count(*) AS n, count(*) FILTER (WHERE s_suppkey % 4 <> 1) AS tp FROM supplier GROUP BY s_nationkey), k AS (SELECT *, f <> 0 AND tp > 0 AS ok FROM s), t AS (SELECT unnest([0.1::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE]) AS threshold)"
_MICRO = "coalesce(sum(tp) FILTER (WHERE ok), 0)::DOUBLE AS tp, coalesce(sum(n - tp) FILTER (WHERE ok), 0)::DOUBLE AS fn"
_EVENT = "CASE WHEN event_id % 2 = 0 THEN '{\"k\": ' || (props->>'$.k') || ', \"type\": \"' || event_type || '\"}' ELSE '{\"type\": \"' || event_type || '\",\"k\": ' || (props->>'$.k') || ',\"odd\":null}' END"
_FILES = f"e AS (SELECT printf('scene_%09d', event_id) AS path, event_id % 2 = 0 AS even, event_id % 10 <> 9 AS valid, CASE WHEN event_id % 10 = 9 THEN substr(raw, 1, 5) ELSE raw END AS raw, event_type, props->>'$.k' AS k, event_id FROM (SELECT *, {_EVENT} AS raw FROM events))"
#: The length of the text that a JSON round trip gives, with blanks behind colons and commas.
_DUMP = "length('{\"k\": ' || k || ', \"type\": \"' || event_type || '\"}') + CASE WHEN even THEN 0 ELSE length(', \"odd\": null') END"
_PROFILE = f"""p AS (SELECT count(*) AS files, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE NOT valid) AS invalid, avg(length(raw)) AS avg_size, CAST(min(length(raw)) AS INT) AS min_size, CAST(max(length(raw)) AS INT) AS max_size,
  avg({_DUMP}) FILTER (WHERE valid) AS avg_length, min({_DUMP}) FILTER (WHERE valid) AS min_length, max({_DUMP}) FILTER (WHERE valid) AS max_length,
  'k=' || count(*) FILTER (WHERE valid) || ',type=' || count(*) FILTER (WHERE valid) || ',odd=' || count(*) FILTER (WHERE valid AND NOT even) AS common_keys, 2 / 3.0::DOUBLE AS consistency FROM e)"""

#: Crowded scenes, and greedy matches row by row: of each truth in order the nearest free prediction of its class, for each of the twelve moves.
_RIVALS = """WITH RECURSIVE c AS (SELECT c_custkey AS k, c_nationkey || '/' || c_mktsegment AS f, c_custkey % 2 AS kind, c_custkey * 7919 % 100003 / 11111.3::DOUBLE + 0.4::DOUBLE AS x, c_custkey * 104729 % 99991 / 19999.7::DOUBLE + 0.4::DOUBLE AS y FROM customer),
  g AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY k) AS i FROM c),
  p AS (SELECT f, k, kind, 0 AS rival, x + (k * 31 % 41 - 20) / 100.0::DOUBLE AS x, y + (k * 37 % 41 - 20) / 100.0::DOUBLE AS y FROM c WHERE k % 7 <> 0),
  q AS (SELECT * FROM p UNION ALL SELECT f, k, kind, 1, x + 0.071::DOUBLE, y - 0.053::DOUBLE FROM p WHERE k % 5 = 0),
  r AS (SELECT f, k, kind, row_number() OVER (PARTITION BY f ORDER BY k, rival) AS i, 6 - y AS x, 10 - x AS y FROM q),
  a AS (SELECT * FROM (VALUES (0, 0), (1, 90), (2, 180), (3, 270)) t(a, angle)), m AS (SELECT * FROM (VALUES (0, 'none'), (1, 'horizontal'), (2, 'vertical')) t(m, mirror)),
  t AS (SELECT r.*, a.a, CASE a.a WHEN 0 THEN x WHEN 1 THEN 10 - y WHEN 2 THEN 6 - x ELSE y END AS u, CASE a.a WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 10 - y ELSE 6 - x END AS v, CASE WHEN a.a % 2 = 0 THEN 6 ELSE 10 END AS w, CASE WHEN a.a % 2 = 0 THEN 10 ELSE 6 END AS h FROM r, a),
  s AS (SELECT f, a, m, list({'i': i, 'k': k, 'kind': kind, 'x': CASE WHEN m = 1 THEN w - u ELSE u END, 'y': CASE WHEN m = 2 THEN h - v ELSE v END}) AS p FROM t, m GROUP BY f, a, m),
  z AS (SELECT f, a, m, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS pk, CAST(NULL AS BIGINT) AS kind FROM s
        UNION ALL
        SELECT f, a, m, i, CASE WHEN b.i IS NULL THEN used ELSE list_append(used, b.i) END, k, b.k, kind FROM (
          SELECT z.f, z.a, z.m, g.i, z.used, g.k, g.kind, list_sort(list_transform(list_filter(s.p, lambda o: o.kind = g.kind AND NOT list_contains(z.used, o.i) AND sqrt((o.x - g.x) ** 2 + (o.y - g.y) ** 2) < 0.3), lambda o: {'d': sqrt((o.x - g.x) ** 2 + (o.y - g.y) ** 2), 'i': o.i, 'k': o.k}))[1] AS b
          FROM z JOIN g ON g.f = z.f AND g.i = z.i + 1 JOIN s ON s.f = z.f AND s.a = z.a AND s.m = z.m)),
  e AS (SELECT z.f, z.a, z.m, count(pk) AS tp FROM z GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY tp DESC, a, m) AS place FROM e),
  n AS (SELECT f, (SELECT count(*) FROM g WHERE g.f = x.f) AS n_gt, (SELECT count(*) FROM r WHERE r.f = x.f) AS n_pred FROM (SELECT DISTINCT f FROM g) x)"""

_SHAPES = ", ".join(f"({p}, {i}, {float(x)}::DOUBLE, {float(y)}::DOUBLE)" for p, shape in enumerate(inputs.SHAPES) for i, (x, y) in enumerate(shape))
#: Outlines of both sides, their sampled points, the geometry of edges and stitches, and greedy matches of stitches, prediction by prediction.
_SEWN = f"""WITH RECURSIVE o AS (SELECT * FROM (VALUES {_SHAPES}) t(p, i, x, y)), k AS (SELECT s_suppkey AS k, grown, CASE WHEN grown THEN 1 + s_suppkey % 4 / 8.0::DOUBLE ELSE 1 END AS f, CASE WHEN grown THEN s_suppkey % 3 ELSE 0 END AS d FROM supplier, (SELECT unnest([false, true]) AS grown)),
  v AS (SELECT k, grown, f, p, i, x * f + d AS x, y * f - d AS y FROM k, o), n AS (SELECT p, count(*) AS n FROM o GROUP BY p),
  e AS (SELECT a.k, a.grown, a.p, a.i, a.x, a.y, b.x AS u, b.y AS w, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS len FROM v a JOIN n USING (p) JOIN v b ON b.k = a.k AND b.grown = a.grown AND b.p = a.p AND b.i = (a.i + 1) % n.n),
  b AS (SELECT k, grown, p, x + t / 19.0::DOUBLE * (u - x) AS x, y + t / 19.0::DOUBLE * (w - y) AS y FROM e, (SELECT unnest(range(19)) AS t)),
  c AS (SELECT k, grown, p, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM b WINDOW w AS (PARTITION BY k, grown, p)),
  d AS (SELECT a.k, a.p, a.grown, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM c a JOIN c b ON a.k = b.k AND a.p = b.p AND a.grown <> b.grown GROUP BY a.k, a.p, a.grown, a.x, a.y),
  ch AS (SELECT k, avg(c) AS chamfer FROM (SELECT k, p, 10 * (avg(d) FILTER (WHERE grown) + avg(d) FILTER (WHERE NOT grown)) / 2 AS c FROM d GROUP BY k, p) GROUP BY k),
  l AS (SELECT k, grown, j, (k + j) % 3 AS a, (k * CASE WHEN grown THEN 2 ELSE 1 END + j) % 6 AS b FROM k, (SELECT unnest(range(5)) AS j) WHERE (k + j) % 11 <> 0),
  g AS (SELECT l.*, row_number() OVER (PARTITION BY l.k, l.grown ORDER BY j) AS place, x.mx AS ax, x.my AS ay, x.len AS al, y.mx AS bx, y.my AS by_, y.len AS bl FROM l JOIN e x ON x.k = l.k AND x.grown = l.grown AND x.p = 0 AND x.i = l.a JOIN e y ON y.k = l.k AND y.grown = l.grown AND y.p = 1 AND y.i = l.b),
  t AS (SELECT k.k, coalesce(list(g ORDER BY place) FILTER (WHERE g.k IS NOT NULL), []) AS t FROM k LEFT JOIN g ON g.k = k.k AND NOT g.grown WHERE NOT k.grown GROUP BY k.k),
  z AS (SELECT k, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS used, t FROM t
        UNION ALL
        SELECT z.k, z.place + 1, CASE WHEN len(hit) > 0 THEN list_append(used, hit[1].place) ELSE used END, t
        FROM (SELECT z.*, list_filter(z.t, lambda o: NOT list_contains(z.used, o.place) AND sqrt((o.ax - g.ax) ** 2 + (o.ay - g.ay) ** 2) <= 8 AND sqrt((o.bx - g.bx) ** 2 + (o.by_ - g.by_) ** 2) <= 8 AND abs(g.al - o.al) / o.al <= 0.6 AND abs(g.bl - o.bl) / o.bl <= 0.6) AS hit
              FROM z JOIN g ON g.k = z.k AND g.grown AND g.place = z.place + 1) z),
  r AS (SELECT k, max(len(used)) AS correct FROM z GROUP BY k),
  m AS (SELECT k.k, count(g.k) FILTER (WHERE g.grown) AS n_pred, count(g.k) FILTER (WHERE NOT g.grown) AS n_gt FROM (SELECT DISTINCT k FROM k) k LEFT JOIN g ON g.k = k.k GROUP BY k.k)"""

_PARAMS = """
WITH p AS (SELECT p_size::DOUBLE AS s, p_partkey % 5 = 0 AS odd, p_size > 25 AS big FROM part), n AS (SELECT count(*) AS n FROM part),
  r AS (SELECT 'keys' AS kind, 8 * n AS n, 8 * n - (SELECT count(*) FROM p WHERE odd) AS ok, n AS extra, 0.0::DOUBLE AS e, NULL::DOUBLE AS least, NULL::DOUBLE AS most FROM n
    UNION ALL SELECT 'float', 2 * n, 0, 0, (SELECT sum(0.25 + abs(0.5 - s / 64)) FROM p), (SELECT min(least(s / 100, s / 64)) FROM p), (SELECT max(greatest(s / 100, s / 64)) FROM p) FROM n
    UNION ALL SELECT 'thickness', n, 0, 0, n * 0.5, (SELECT min(s / 4 + 100.5) FROM p), (SELECT max(s / 4 + 100.5) FROM p) FROM n
    UNION ALL SELECT 'int', count(*), 0, 0, count(*), min(s), max(s) FROM p WHERE s < 32
    UNION ALL SELECT 'bool', n, (SELECT count(*) FROM p WHERE big AND NOT odd), 0, 0, NULL, NULL FROM n
    UNION ALL SELECT 'str', 3 * n, n + (SELECT count(*) FROM p WHERE NOT odd), 0, 0, NULL, NULL FROM n
    UNION ALL SELECT 'list', n, 0, 0, 0, NULL, NULL FROM n
    UNION ALL SELECT 'object', n, 0, 0, 0, NULL, NULL FROM n)
"""
#: Relative errors: a quarter of the share, half of the thickness, and one half against a 64th of the size.
_RELATIVE = "CASE kind WHEN 'float' THEN (SELECT sum(0.25 / (s / 100) + abs(0.5 - s / 64) / (s / 64)) FROM p) WHEN 'thickness' THEN (SELECT sum(0.5 / (s / 4 + 100.5)) FROM p) ELSE 0 END"

ORACLE = {
    "params_report": _PARAMS + f""", l AS (SELECT list_position(['keys', 'float', 'int', 'bool', 'str', 'list', 'thickness', 'object'], kind) AS i, printf('%-10s%10d%10.4f%12.6f%12.6f', kind, n::BIGINT, ok / n::DOUBLE, e::DOUBLE / n, {_RELATIVE}::DOUBLE / n) AS line FROM r WHERE n > 0)
      SELECT row_number() OVER (ORDER BY i) AS n, line FROM l UNION ALL SELECT 0, printf('%-10s%10s%10s%12s%12s', 'kind', 'n', 'accuracy', 'abs error', 'rel error')""",
    "equal_params": "SELECT p_partkey, p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS same FROM part",
    "garment_shapes": f"{_SEWN} SELECT CAST(r.k AS VARCHAR) AS sample, round(chamfer, 6) AS chamfer_mm, round(100 / ((1 + r.k % 4 / 8.0::DOUBLE) ** 2), 6) AS iou, round(CASE WHEN n_gt > 0 THEN 100.0::DOUBLE * correct / n_gt ELSE 0 END, 6) AS stitch_accuracy, round(CASE WHEN n_pred > 0 THEN 100.0::DOUBLE * correct / n_pred ELSE 0 END, 6) AS stitch_precision, CAST(correct AS BIGINT) AS stitches_correct, n_pred AS stitches_pred, n_gt AS stitches_gt FROM r JOIN ch USING (k) JOIN m USING (k)",
    # the edges 0 line, 1 quadratic, k % 5 cubic, then a circle at the number of different edges so far, at last a cubic without its numbers at 1
    "garment_curves": """WITH s AS (SELECT s_suppkey AS k FROM supplier), e AS (SELECT k, 0 AS pl, 0 AS edge, 'line' AS kind, 0 AS n FROM s UNION ALL SELECT k, 1, 1, 'quadratic', 2 FROM s UNION ALL SELECT k, 2, k % 5, 'cubic', 4 FROM s UNION ALL SELECT k, 3, CASE WHEN k % 5 < 2 THEN 2 ELSE 3 END, 'circle', 3 FROM s UNION ALL SELECT k, 4, 1, 'cubic', 3 FROM s),
      l AS (SELECT k, edge, arg_max(kind, pl) AS kind, arg_max(n, pl) AS n FROM e GROUP BY k, edge), p AS (SELECT unnest([0, 1]) AS p)
      SELECT CAST(k AS VARCHAR) AS stem, 'panel_' || p AS panel, CAST(edge AS BIGINT) AS edge, kind, array_to_string(list_transform(range(n), lambda j: CAST(k % 7 + j AS VARCHAR)), ',') AS params FROM l, p WHERE edge < CASE p WHEN 0 THEN 3 ELSE 5 END AND n = CASE kind WHEN 'quadratic' THEN 2 WHEN 'cubic' THEN 4 WHEN 'circle' THEN 3 ELSE -1 END""",
    "garment_spec": "SELECT CAST(s_suppkey AS VARCHAR) AS stem, 11.0::DOUBLE AS x, round(s_suppkey % 10 * 640 / 275.0::DOUBLE, 6) AS tx, -30.0::DOUBLE AS tz, 5::BIGINT AS n_edges, '[4,0]' AS last, len(list_filter(range(5), lambda j: (s_suppkey + j) % 11 <> 0))::BIGINT AS n_stitches, 100::BIGINT AS units FROM supplier",
    "scene_rivals": f"{_RIVALS} SELECT f AS file, round(2 * tp / (n_gt + n_pred)::DOUBLE, 6) AS f1, round(tp / n_pred::DOUBLE, 6) AS precision, round(tp / n_gt::DOUBLE, 6) AS recall, tp, n_pred - tp AS fp, n_gt - tp AS fn, CAST(angle AS BIGINT) AS angle, mirror FROM n LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (f) LEFT JOIN a USING (a) LEFT JOIN m USING (m)",
    "scene_pair_params": f"""{_RIVALS}, u AS (SELECT CASE WHEN z.kind = 0 THEN 'Bed' ELSE 'Chair' END AS class, z.k, z.pk FROM z JOIN best USING (f, a, m) WHERE place = 1 AND pk IS NOT NULL),
  o AS (SELECT class, 'object' AS kind, 1 AS n, CASE WHEN pk % 3 <> 0 THEN 1 ELSE 0 END AS ok, 0 AS extra, 0.0::DOUBLE AS e, NULL::DOUBLE AS v FROM u
    UNION ALL SELECT class, 'keys', 5, CASE WHEN pk % 3 <> 0 THEN 5 ELSE 4 END, 1, 0, NULL FROM u
    UNION ALL SELECT class, 'float', 1, 0, 0, abs(pk % 50 / 100.0::DOUBLE + 0.125 - k % 50 / 100.0::DOUBLE), k % 50 / 100.0::DOUBLE FROM u
    UNION ALL SELECT class, 'thickness', 1, 0, 0, abs(pk % 3 / 8.0::DOUBLE - k % 3 / 8.0::DOUBLE), 0.25 + k % 3 / 8.0::DOUBLE FROM u
    UNION ALL SELECT class, 'int', 1, 0, 0, abs(pk % 9 + pk % 2 - k % 9), k % 9 FROM u
    UNION ALL SELECT class, 'bool', 1, CASE WHEN pk % 2 = k % 2 THEN 1 ELSE 0 END, 0, 0, NULL FROM u
    UNION ALL SELECT class, 'str', 1, CASE WHEN pk % 3 <> 0 AND pk % 4 = k % 4 THEN 1 ELSE 0 END, 0, 0, NULL FROM u),
  x AS (SELECT * FROM o UNION ALL SELECT 'all', kind, n, ok, extra, e, v FROM o)
SELECT class, kind, CAST(sum(n) AS BIGINT) AS n, CAST(sum(ok) AS BIGINT) AS ok, CAST(sum(extra) AS BIGINT) AS extra, round(sum(e), 6) AS abs_error, round(min(v), 6) AS least, round(max(v), 6) AS most FROM x GROUP BY class, kind""",
    "scene_objects": "SELECT CAST(l_orderkey AS VARCHAR) AS file, row_number() OVER w AS pos, 'object_' || row_number() OVER w AS id, l_returnflag AS class, l_quantity AS x, l_linenumber::DOUBLE AS y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity)",
    "object_lookup": "WITH l AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity) AS i FROM lineitem) SELECT CAST(o_orderkey AS VARCHAR) AS file, l_returnflag AS class FROM orders LEFT JOIN l ON o_orderkey = l_orderkey AND i = 2",
    "scene_bounds": "SELECT CAST(l_orderkey AS VARCHAR) AS file, 0.0::DOUBLE AS min_x, 60.0::DOUBLE AS max_x, 0.0::DOUBLE AS min_y, 8.0::DOUBLE AS max_y, 30.0::DOUBLE AS centre_x, 4.0::DOUBLE AS centre_y FROM lineitem GROUP BY l_orderkey",
    "open_bounds": "WITH p AS (SELECT l_orderkey AS k, l_quantity::DOUBLE AS x, l_linenumber::DOUBLE AS y FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, (l_orderkey % 40)::DOUBLE, 3.5::DOUBLE FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, (l_orderkey % 30)::DOUBLE, -1.0::DOUBLE FROM lineitem) SELECT CAST(k AS VARCHAR) AS file, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, (min(x) + max(x)) / 2 AS centre_x, (min(y) + max(y)) / 2 AS centre_y FROM p GROUP BY k",
    "scene_turned": f"SELECT CAST(s_nationkey AS VARCHAR) AS file, 'object_' || s_suppkey AS id, (60 - ({_Y}))::DOUBLE AS x, ({_X})::DOUBLE AS y FROM supplier",
    "scene_mirrored": f"SELECT CAST(s_nationkey AS VARCHAR) AS file, 'object_' || s_suppkey AS id, (102.5 - ({_X}))::DOUBLE AS x, ({_Y} - 1)::DOUBLE AS y FROM supplier",
    "scene_f1": f"WITH {_SCORED}, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_missing, count(*) FILTER (WHERE false) AS n_error, avg(1.0::DOUBLE) FILTER (WHERE ok) AS macro_precision, round(avg(tp / n::DOUBLE) FILTER (WHERE ok), 6) AS macro_recall, round(avg(2 * tp / (n + tp)::DOUBLE) FILTER (WHERE ok), 6) AS macro_f1, {_MICRO} FROM k) SELECT threshold, n, n_ok, n_missing, n_error, macro_precision, macro_recall, macro_f1, tp::BIGINT AS tp, 0::BIGINT AS fp, fn::BIGINT AS fn, CASE WHEN tp > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS micro_precision, round(tp / (tp + fn), 6) AS micro_recall, round(2 * tp / (2 * tp + fn), 6) AS micro_f1 FROM a, t",
    "scene_status": f"WITH {_SCORED} SELECT CAST(f AS VARCHAR) AS file, CASE WHEN ok THEN 'ok' ELSE 'missing_pred' END AS status, n AS n_gt FROM k",
    "scene_f1_mean": f"WITH {_SCORED}, a AS (SELECT {_MICRO} FROM k) SELECT 1.0::DOUBLE AS mean_precision, round(tp / (tp + fn), 6) AS mean_recall, round(2 * tp / (2 * tp + fn), 6) AS mean_f1 FROM a",
    "scene_params": "WITH m AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Bed' ELSE 'Chair' END AS class FROM supplier WHERE s_nationkey <> 0 AND s_suppkey % 4 <> 1) SELECT class, count(*) AS n, count(*) AS ok FROM m GROUP BY class UNION ALL SELECT 'all', count(*), count(*) FROM m",
    "params_accuracy": _PARAMS + """SELECT kind, n::BIGINT AS n, ok::BIGINT AS ok, extra::BIGINT AS extra, round(e::DOUBLE, 6) AS abs_error, round(e::DOUBLE / n, 6) AS mean_abs_error, round(least, 6) AS least, round(most, 6) AS most, round(ok / n::DOUBLE, 6) AS accuracy FROM r WHERE n > 0""",
    "garment_panels": "WITH s AS (SELECT s_suppkey, s_suppkey % 11 + 5 AS w, s_suppkey % 7 + 5 AS h FROM supplier) SELECT CAST(s_suppkey AS VARCHAR) AS stem, 'panel_' || p AS panel, v::BIGINT AS vertex, (CASE WHEN v IN (1, 2) THEN w ELSE 0 END)::DOUBLE AS x, (CASE WHEN v IN (2, 3) THEN h ELSE 0 END)::DOUBLE AS y, (CASE WHEN v % 2 = 0 THEN w ELSE h END)::DOUBLE AS length FROM s, (SELECT unnest([0, 1]) AS p), (SELECT unnest([0, 1, 2, 3]) AS v)",
    "garment_metrics": "WITH s AS (SELECT s_suppkey, (s_suppkey % 11 + 5)::DOUBLE AS w, (s_suppkey % 7 + 5)::DOUBLE AS h FROM supplier) SELECT CAST(s_suppkey AS VARCHAR) AS sample, true AS panel_count_match, 2::BIGINT AS gt_panels, round(100 * w * h / ((w + 1) * (h + 2)), 6) AS iou, CASE WHEN s_suppkey % 3 = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS stitch_accuracy, CASE WHEN s_suppkey % 3 = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS stitch_precision FROM s",
    "garment_same": "SELECT count(*) AS samples, count(*) AS valid, 100.0::DOUBLE AS panel_match_rate, 0.0::DOUBLE AS avg_chamfer_mm, 0.0::DOUBLE AS std_chamfer_mm, 100.0::DOUBLE AS avg_iou, 0.0::DOUBLE AS std_iou, 100.0::DOUBLE AS avg_stitch_accuracy, 0.0::DOUBLE AS std_stitch_accuracy FROM supplier",
    "garment_pairs": "SELECT count(*) FILTER (WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 <> 0) AS matching, count(*) FILTER (WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0) AS gt_only, count(*) FILTER (WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 <> 0) AS pred_only FROM supplier",
    "room_counts": "WITH r AS (SELECT CAST(count(DISTINCT l_linestatus) AS INT) AS rooms FROM lineitem GROUP BY l_orderkey) SELECT rooms, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM r)::DOUBLE, 6) AS percent FROM r GROUP BY rooms",
    "single_rooms": "SELECT CAST(l_orderkey AS VARCHAR) AS file FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) <= 1",
    "file_profile": f"WITH {_FILES}, {_PROFILE} SELECT files, valid, invalid, round(avg_size, 6) AS avg_size, min_size, max_size, round(avg_length, 6) AS avg_length, min_length, max_length, common_keys, round(consistency, 6) AS consistency FROM p",
    "file_quality": f"WITH {_FILES}, {_PROFILE}, s AS (SELECT valid / files::DOUBLE * 30 + consistency * 30 + least(avg_size / 1024, 1) * 20 + 6 AS s FROM p) SELECT round(s, 4) AS score, 100 AS max_score, round(s, 4) AS percent, CASE WHEN s >= 90 THEN 'excellent' WHEN s >= 80 THEN 'good' WHEN s >= 70 THEN 'medium' WHEN s >= 60 THEN 'passing' ELSE 'to improve' END AS rating FROM s",
    "key_counts": "SELECT unnest(['k', 'type']) AS key, n FROM (SELECT count(*) FILTER (WHERE event_id % 10 <> 9) AS n FROM events)",
    "json_structure": "WITH v AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 1) AS odd FROM events WHERE event_id % 10 <> 9) SELECT '$' AS at, 'dict' AS type, n, 0::BIGINT AS depth FROM v UNION ALL SELECT '$.k', 'int', n, 1 FROM v UNION ALL SELECT '$.type', 'str', n, 1 FROM v UNION ALL SELECT '$.odd', 'NoneType', odd, 1 FROM v WHERE odd > 0",
    "malformed_files": "SELECT printf('scene_%09d', event_id) AS path FROM events WHERE event_id % 10 = 9",
    "first_errors": "SELECT printf('scene_%09d', event_id) AS path, 'Unterminated string starting at: line 1 column 2 (char 1)' AS reason FROM events WHERE event_id % 10 = 9 ORDER BY event_id LIMIT 10",
    "content_match": "WITH e AS (SELECT printf('scene_%09d', event_id) AS name, event_type || '/' || (props->>'$.k') AS c, event_id % 10 <> 9 AS valid FROM events), f AS (SELECT c, min(name) AS source FROM e WHERE valid GROUP BY c) SELECT name, CASE WHEN valid THEN source END AS source FROM e LEFT JOIN f USING (c)",
    "first_by_name": "WITH f AS (SELECT 'f' || (doc_id % 50) || '.json' AS name, '/d' || doc_id || '/f' || (doc_id % 50) || '.json' AS path FROM labels) SELECT name, min(path) AS path FROM f GROUP BY name",
    "converted_yaml": "SELECT CAST(p_partkey AS VARCHAR) AS stem, 'object_1,blueprint,object_2' AS keys, round(p_retailprice / 7, 2) AS w FROM part",
}

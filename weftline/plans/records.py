
from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import responses
from weftline.operators import conversations, nearest, ranks, stats
from weftline.plans import inputs
from weftline.plans.inputs import table
from weftline.scratch import scratch
from weftline.sinks import datasets as sinks
from weftline.sources import archives, datasets, files, records


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.lit('{"a":1}').alias("raw"), "text")


def caption_pairs(spark, sf_dir):  # S2, J1
    captions = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("stem"), F.concat(F.lit(" \n"), F.col("quality").cast("string"), F.lit("\t")).alias("raw"))
    return files.caption_pairs(captions, _docs(spark, sf_dir)).select("stem", "caption")


def unpaired(spark, sf_dir):  # J2
    return files.unpaired(_docs(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("stem")))


def _images(spark, sf_dir):
    """Orbit views, a panorama and a front view for documents, by their numbers."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 7).cast("int"))).alias("v"))
    at = F.concat(F.lit("file:/img/"), F.col("doc_id").cast("string"))
    orbit = rows.select(F.concat(at, F.lit("/orbit/orbit_"), F.col("v").cast("string"), F.lit(".png")).alias("path"))
    wide = rows.where("v = 0 and doc_id % 2 = 0").select(F.concat(at, F.lit("/panorama/panorama_rgb.png")).alias("path"))
    return orbit.unionByName(wide).unionByName(rows.where("v = 0 and doc_id % 3 = 0").select(F.concat(at, F.lit("/front.png")).alias("path")))


def panorama_pairs(spark, sf_dir):  # S3, J2
    return files.image_pairs(_docs(spark, sf_dir), _images(spark, sf_dir), "panorama").select("stem", "image_path")


def view_pairs(spark, sf_dir):  # S4, S5, J3, O7: how many views, within the range
    got = files.image_pairs(_docs(spark, sf_dir), _images(spark, sf_dir), "multi_view", (4, 4))
    return got.select("stem", F.size("image_paths").cast("long").alias("views"))


def drawn_views(spark, sf_dir):  # S4, J3, O7: the very views that are drawn, two to four of up to seven
    got = files.image_pairs(_docs(spark, sf_dir), _images(spark, sf_dir), "multi_view", (2, 4), 9)
    return got.select("stem", F.array_join("image_paths", ",").alias("paths"))


def flat_views(spark, sf_dir):  # S6
    got = files.image_pairs(_docs(spark, sf_dir), _images(spark, sf_dir), "multi_view2", (1, 1))
    return got.select("stem", F.array_join("image_paths", ",").alias("paths"))


def front_views(spark, sf_dir):  # S7
    got = files.image_pairs(_docs(spark, sf_dir), _images(spark, sf_dir), "multi_view3")
    return got.select("stem", F.array_join("image_paths", ",").alias("paths"))


def eligible_views(spark, sf_dir):  # J4
    return files.eligible(_docs(spark, sf_dir), "multi_view", images=_images(spark, sf_dir)).select("stem")


def built_conversations(spark, sf_dir):  # P1, P1a, P2
    rows = _docs(spark, sf_dir).withColumn("caption", F.when(F.col("stem") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("doc "), "stem")))
    m = conversations.build(rows, "caption")
    return m.select("stem", F.get("messages", 0)["content"].alias("ask"), F.get("messages", 1)["content"].alias("answer"))


def built_views(spark, sf_dir):  # P1f
    rows = files.image_pairs(_docs(spark, sf_dir), _images(spark, sf_dir), "multi_view", (4, 4))
    return conversations.build(rows, "multi_view").select("stem", F.get("messages", 0)["content"].alias("ask"))


def built_blueprints(spark, sf_dir):  # P1b
    m = conversations.build(inputs.order_scenes(spark, sf_dir), "blueprint")
    keys = F.json_object_keys(F.get("messages", 1)["content"])
    return m.select("file", F.size(keys).cast("long").alias("objects"), F.size(F.json_object_keys(F.get_json_object(F.substring_index(F.get("messages", 0)["content"], "\n", -1), "$.rooms"))).cast("long").alias("rooms"))


def _records(spark, sf_dir):
    own = {c: F.lit(None).cast("string") for c in (*records.TEXTS, "__source_path", "__source_dir")}
    own |= {"image_paths": F.lit(None).cast("array<string>"), "__row_id": F.col("doc_id")}
    n = F.col("doc_id") % 4
    own |= {"caption": F.when(n == 0, F.lit("")).when(n == 1, F.concat(F.lit("c"), F.col("doc_id").cast("string"))), "description": F.when(n == 2, F.lit("d")), "id": F.when(n == 1, F.lit("")).when(n == 2, F.col("doc_id").cast("string")), "filename": F.when(n == 1, F.lit("x/y/seed.v1.json")), "tags": F.when(n == 2, F.lit("t"))}
    return table(spark, sf_dir, "labels").select("doc_id").withColumns(own)


def samples(spark, sf_dir):  # P13-P15, P17, P18
    return records.valid(records.samples(_records(spark, sf_dir), "caption")).select("uid", "prompt_preview", "condition", F.col("num_images").cast("long").alias("num_images"), F.array_join(F.map_keys("metadata"), ",").alias("tags"))


def rejected_records(spark, sf_dir):  # P13
    return records.rejected(records.samples(_records(spark, sf_dir), "caption"))


def resolutions(spark, sf_dir):  # P20
    text = F.when(F.col("p_size") % 4 == 0, "none").otherwise(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "X").otherwise("x"), F.lit("48")))
    r = table(spark, sf_dir, "part").select("p_partkey", records.resolution_of(text).alias("r"))
    return r.select("p_partkey", F.col("r.width").cast("long").alias("width"), F.col("r.height").cast("long").alias("height"))


def _responses(spark, sf_dir):
    n = F.col("event_id") % 5
    text = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("<think>{</think> "), "props")).when(n == 2, F.lit(" \n")).when(n == 3, F.lit('{"a":')).otherwise(F.lit('{"a":NaN}'))
    return table(spark, sf_dir, "events").select("event_id", text.alias("response"))


def parsed_responses(spark, sf_dir):  # R7
    rows = _responses(spark, sf_dir).withColumn("p", responses.parse_response("response"))
    return rows.select("event_id", F.coalesce(F.substring_index("p.error", ":", 1), F.lit("ok")).alias("status"), F.get_json_object("p.json", "$.k").cast("long").alias("k"))


def run_counters(spark, sf_dir):  # R9-R11, S23: a run of a plug-in model that fails on some rows
    rows = _responses(spark, sf_dir)

    def model(part):
        return [ValueError("no") if i % 7 == 0 else (text, len(text), 1) for i, text in zip(part["event_id"], part["response"], strict=True)]

    got = responses.generate(rows.repartition(8), model).withColumnRenamed("error", "generation_error").drop("response").join(rows, "event_id")
    return responses.run_counters(got.select("*", responses.parse_response("response").alias("p")).select("generation_error", "prompt_tokens", "completion_tokens", "p.*"))


def contour_report(spark, sf_dir):  # R12
    one = '{"y":0.5,"contours":[{"closed":true},{"closed":false}]}'
    text = F.concat(F.lit('</think>{"format":"'), F.col("event_type"), F.lit('","slices":['), F.array_join(F.array_repeat(F.lit(one), (F.col("event_id") % 3).cast("int")), ","), F.lit("]}"))
    got = responses.contour_report(table(spark, sf_dir, "events").select("event_id", text.alias("response")))
    return got.select("event_id", "format", F.col("n_slices").cast("long").alias("n_slices"), F.col("n_contours").cast("long").alias("n_contours"))


def prompt_blueprints(spark, sf_dir):  # R6
    text = F.concat(F.when(F.col("event_id") % 3 == 0, "Other:\n").otherwise(conversations.PROMPTS["blueprint"]), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{"))
    rows = table(spark, sf_dir, "events").select("event_id", responses.blueprint_of(text).alias("b"))
    return rows.select("event_id", F.get_json_object("b", "$.k").cast("long").alias("k"))


def archive_refs(spark, sf_dir):  # S26, J15
    ref = F.concat(F.lit("images_shard_0000.tar::d/"), F.col("doc_id").cast("string"), F.lit(".png"))
    rows = table(spark, sf_dir, "labels").select("doc_id", ref.alias("ref"), F.concat(F.lit("base"), (F.col("doc_id") % 2).cast("string")).alias("image_base"))
    known = spark.createDataFrame([("base0", "/a"), ("base1", "/b")], "base_key string, root string")
    shard, member = archives.parts(F.col("ref"))
    return archives.with_root(rows, known).select("doc_id", "root", shard.alias("shard"), member.alias("member"), archives.materialized_name(F.col("ref")).alias("file"))


def saved_splits(spark, sf_dir):  # K1, S14, O9: a dataset written by split and read for training
    folder = scratch(spark)
    sinks.save(ranks.split(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 0.1), folder, "caption", "none")
    train, test = datasets.training(spark, folder)
    count = lambda df, name: df.agg(F.lit(name).alias("split"), F.count("*").alias("n"))
    return count(train, "train").unionByName(count(test, "test"))


def saved_batches(spark, sf_dir):  # K2, S13, S15, S16: batches written twice and read by a range
    folder = scratch(spark)
    rows = ranks.batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 50, ["doc_id"])
    for _ in range(2):
        sinks.save_batches(rows, folder)
    got = datasets.from_batches(spark, [folder], [0, "2-3"])
    return got.select("doc_id", F.col("batch_id").cast("long").alias("batch_id"))


def saved_filtered(spark, sf_dir):  # K3, P3b
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("n_chars").alias("n_tokens"))
    return sinks.save_filtered(rows, scratch(spark), 500, 2000, batch_size=100)


def saved_statistics(spark, sf_dir):  # K12
    folder = scratch(spark)
    out = sinks.save_statistics(table(spark, sf_dir, "documents"), folder, length="n_chars", by="source")
    listed = spark.read.json(f"{folder}/{sinks.BATCHES}").count()
    return spark.createDataFrame([(out["total_batches"], out["total_samples"], out["total_tokens"], round(out["weighted_mean_length"], 6), listed)], "total_batches long, total_samples long, total_tokens long, weighted_mean_length double, listed long")


def merged_splits(spark, sf_dir):  # O10, O14: new rows without a test split
    old = ranks.split(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id", 0.1)
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("train").alias("split"))
    return datasets.merged(new, old).groupBy("split", "lang").agg(F.count("*").alias("n"))


def union_fill(spark, sf_dir):  # O10
    rows = datasets.union([table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))])
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def key_set_ops(spark, sf_dir):  # O11
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    side = lambda df, name: df.select("doc_id", F.lit(name).alias("side"))
    return side(docs.intersect(labels), "both").unionByName(side(docs.exceptAll(labels), "docs")).unionByName(side(docs.union(labels).distinct(), "any"))


def json_field_agg(spark, sf_dir):  # 2.11
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"))


def confusion_f1(spark, sf_dir):  # A11
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    c = table(spark, sf_dir, "labels").agg(F.count_if(q & t).alias("tp"), F.count_if(q & ~t).alias("fp"), F.count_if(~q & t).alias("fn"))
    out = c.withColumns(stats.ratio_columns(F.col("tp"), F.col("fp"), F.col("fn")))
    return out.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


def strip_text(spark, sf_dir):  # R4, 2.11
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(responses.strip_marks(F.concat(F.lit("<|im_start|>user\n"), "text", F.lit("<|im_end|>\n"))).cast("binary")).alias("stripped_md5"))


def nearest_match(spark, sf_dir):  # J13: every vector to its nearest of the same class
    got = nearest.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return got.select(F.col("vec_id").alias("q"), "nearest", F.round("distance", 5).alias("distance"))


QUERIES = {f.__name__: f for f in (caption_pairs, unpaired, panorama_pairs, view_pairs, drawn_views, flat_views, front_views, eligible_views, built_conversations, built_views, built_blueprints, samples, rejected_records, resolutions, parsed_responses, run_counters, contour_report, prompt_blueprints, archive_refs, saved_splits, saved_batches, saved_filtered, saved_statistics, merged_splits, union_fill, key_set_ops, json_field_agg, confusion_f1, strip_text, nearest_match)}

_R = "CASE event_id % 5 WHEN 2 THEN 'empty_response' WHEN 3 THEN 'json_error' ELSE 'ok' END"
_RESPONSE = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '<think>{</think> ' || props WHEN 2 THEN ' ' || chr(10) WHEN 3 THEN '{\"a\":' ELSE '{\"a\":NaN}' END"
_SPLIT = "row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42')) <= floor(count(*) OVER () * 0.1)"

ORACLE = {
    "caption_pairs": "SELECT CAST(d.doc_id AS VARCHAR) AS stem, CAST(quality AS VARCHAR) AS caption FROM documents d JOIN labels USING (doc_id)",
    "unpaired": "SELECT CAST(doc_id AS VARCHAR) AS stem FROM documents ANTI JOIN labels USING (doc_id)",
    "panorama_pairs": "SELECT CAST(doc_id AS VARCHAR) AS stem, 'file:/img/' || doc_id || '/panorama/panorama_rgb.png' AS image_path FROM documents WHERE doc_id % 2 = 0",
    "view_pairs": "SELECT CAST(doc_id AS VARCHAR) AS stem, 4::BIGINT AS views FROM documents WHERE doc_id % 7 >= 3",
    "drawn_views": """WITH v AS (SELECT doc_id, 'file:/img/' || doc_id || '/orbit/orbit_' || unnest(range(doc_id % 7 + 1)) || '.png' AS path FROM documents),
      s AS (SELECT doc_id, list(path ORDER BY md5(path || '-9')) AS p, ('0x' || substr(md5(doc_id || '-9'), 1, 8))::BIGINT AS h FROM v GROUP BY doc_id HAVING count(*) >= 2)
      SELECT CAST(doc_id AS VARCHAR) AS stem, array_to_string(p[1:2 + h % (least(len(p), 4) - 1)], ',') AS paths FROM s""",
    "flat_views": "SELECT CAST(doc_id AS VARCHAR) AS stem, 'file:/img/' || doc_id || '/front.png' AS paths FROM documents WHERE doc_id % 3 = 0",
    "front_views": "SELECT CAST(doc_id AS VARCHAR) AS stem, 'file:/img/' || doc_id || '/front.png' AS paths FROM documents WHERE doc_id % 3 = 0",
    "eligible_views": "SELECT CAST(doc_id AS VARCHAR) AS stem FROM documents WHERE doc_id % 7 >= 3",
    "built_conversations": "SELECT CAST(doc_id AS VARCHAR) AS stem, 'Generate a 3D scene in JSON format based on the following description:' || chr(10) || 'doc ' || doc_id AS ask, '{\"a\":1}' AS answer FROM documents WHERE doc_id % 3 <> 0",
    "built_views": "SELECT CAST(doc_id AS VARCHAR) AS stem, 'Based on these 4 multi-view images, generate a 3D scene in JSON format:' AS ask FROM documents WHERE doc_id % 7 >= 3",
    "built_blueprints": "SELECT CAST(l_orderkey AS VARCHAR) AS file, count(*) AS objects, count(DISTINCT l_linestatus) AS rooms FROM lineitem GROUP BY l_orderkey",
    "samples": "SELECT CASE doc_id % 4 WHEN 1 THEN 'seed.v1' ELSE CAST(doc_id AS VARCHAR) END AS uid, 'Generate a 3D scene in JSON format based on the following description:' || chr(10) || c AS prompt_preview, 'Generate a 3D scene in JSON format based on the following description:' || chr(10) || c AS condition, 0::BIGINT AS num_images, CASE doc_id % 4 WHEN 2 THEN 'extra_tags' ELSE '' END AS tags FROM (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'c' || doc_id WHEN 2 THEN 'd' END AS c FROM labels) WHERE c IS NOT NULL",
    "rejected_records": "SELECT printf('sample_%06d', doc_id) AS uid, 'no caption, description or prompt to ask with' AS reject FROM labels WHERE doc_id % 4 IN (0, 3)",
    "resolutions": "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size::BIGINT END AS width, CASE WHEN p_size % 4 <> 0 THEN 48::BIGINT END AS height FROM part",
    "parsed_responses": f"SELECT event_id, {_R} AS status, CASE WHEN event_id % 5 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
    "run_counters": f"WITH r AS (SELECT event_id, {_RESPONSE} AS t, {_R} AS s, event_id % 7 <> 0 AND event_id % 5 <> 2 AS ok, event_id % 7 <> 0 AS called FROM events) SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok AND s = 'ok') AS json_parsed, count(*) FILTER (WHERE ok AND s = 'json_error') AS json_failed, count(*) FILTER (WHERE ok AND s = 'empty_response') AS empty, CAST(coalesce(sum(length(t)) FILTER (WHERE called), 0) AS BIGINT) AS prompt_tokens, count(*) FILTER (WHERE called) AS completion_tokens FROM r",
    "contour_report": "SELECT event_id, event_type AS format, event_id % 3 AS n_slices, 2 * (event_id % 3) AS n_contours FROM events",
    "prompt_blueprints": "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
    "archive_refs": "SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN '/a' ELSE '/b' END AS root, 'images_shard_0000.tar' AS shard, 'd/' || doc_id || '.png' AS member, sha256('images_shard_0000.tar::d/' || doc_id || '.png') || '.png' AS file FROM labels",
    "saved_splits": f"WITH s AS (SELECT {_SPLIT} AS test FROM documents) SELECT 'test' AS split, count(*) FILTER (WHERE test) AS n FROM s UNION ALL SELECT 'train', count(*) FILTER (WHERE NOT test) FROM s",
    "saved_batches": "WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch_id FROM documents) SELECT * FROM b WHERE batch_id IN (0, 2, 3)",
    "saved_filtered": "SELECT count(*) AS before, count(*) FILTER (WHERE n_chars BETWEEN 500 AND 2000) AS after, count(*) FILTER (WHERE NOT n_chars BETWEEN 500 AND 2000) AS discarded FROM documents",
    "saved_statistics": "SELECT count(DISTINCT source) AS total_batches, count(*) AS total_samples, CAST(sum(n_chars) AS BIGINT) AS total_tokens, round(avg(n_chars), 6) AS weighted_mean_length, count(DISTINCT source) AS listed FROM documents",
    "merged_splits": f"WITH s AS (SELECT lang, {_SPLIT} AS test FROM documents) SELECT CASE WHEN test THEN 'test' ELSE 'train' END AS split, lang, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'train', NULL, count(*) FROM benchmark",
    "union_fill": "SELECT lang, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT doc_id AS id, lang FROM documents UNION ALL SELECT item_id, NULL FROM benchmark) GROUP BY lang",
    "key_set_ops": "SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'docs' FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'any' FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)",
    "json_field_agg": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type",
    "confusion_f1": "WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fn FROM labels) SELECT *, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0.0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM c",
    "strip_text": r"SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS stripped_md5 FROM documents",
    "nearest_match": "WITH p AS (SELECT q.vec_id AS q, e.vec_id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS d FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id) SELECT q, arg_min(vec_id, d) AS nearest, round(sqrt(min(d)), 5) AS distance FROM p GROUP BY q",
}

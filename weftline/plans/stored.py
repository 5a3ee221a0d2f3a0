
from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import images, responses
from weftline.operators import conversations, profile, tokens
from weftline.plans import inputs
from weftline.plans.inputs import table
from weftline.plans.lengths import _FFD
from weftline.scratch import scratch, written
from weftline.sinks import datasets as sinks
from weftline.sinks import inference
from weftline.sources import archives, datasets, files, records


def _md5(text):
    return F.md5(text.cast("binary"))


def record_files(spark, sf_dir):  # S17-S20, S23: a JSON object, a JSON list or lines for each nation, and their numbers
    folder = scratch(spark)
    s = table(spark, sf_dir, "supplier")
    one = F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("caption")))
    by = s.groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", one.alias("x")))), lambda r: r["x"]).alias("x"))
    stem = F.format_string("n%02d", "s_nationkey")
    sinks.save_each(by.where("s_nationkey % 3 = 0").select(stem.alias("stem"), F.get("x", 0).alias("raw")), folder)
    sinks.save_each(by.where("s_nationkey % 3 = 1").select(stem.alias("stem"), F.concat(F.lit("["), F.array_join("x", ","), F.lit("]")).alias("raw")), folder)
    sinks.save_each(by.where("s_nationkey % 3 = 2").select(stem.alias("stem"), F.concat(F.array_join("x", "\n\n"), F.lit("\n")).alias("raw")), folder, suffix=".jsonl")
    rows = records.load(spark, "caption", folder)
    return rows.select(F.regexp_extract("__source_path", r"([^/]+)$", 1).alias("source"), "id", "caption", F.col("__row_id").cast("long").alias("row"))


def prompt_lines(spark, sf_dir):  # S21
    folder = scratch(spark)
    table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("value")).write.text(folder)
    return files.prompts(spark, folder).groupBy("prompt").agg(F.count("*").alias("n"))


def image_records(spark, sf_dir):  # S22: folders of images by their extensions
    kinds = F.element_at(F.array(*map(F.lit, ("png", "JPG", "webp", "txt", "jpeg", "gif"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("file:/i/"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit("."), kinds).alias("path"))
    many = records.from_images(rows, "multi_view", "look")
    single = records.from_images(rows, "panorama")
    return many.select("id", F.size("image_paths").cast("long").alias("n"), "prompt").unionByName(single.groupBy(F.lit("all").alias("id")).agg(F.count("filename").alias("n"), F.max("prompt").alias("prompt")))


def image_paths(spark, sf_dir):  # P19: absolute and relative paths
    k = F.col("doc_id")
    path = F.when(k % 3 == 0, F.concat(F.lit("/abs/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("s3:/b/"), k.cast("string"))).otherwise(k.cast("string"))
    rows = table(spark, sf_dir, "labels").select("doc_id", path.alias("p"), F.when(k % 2 == 0, F.lit("/own")).otherwise("").alias("__source_dir"))
    return rows.select("doc_id", records.resolved(F.col("p"), "/root").alias("path"))


def mode_scenes(spark, sf_dir):  # S8, S2: scenes and captions from folders
    scenes, captions = scratch(spark), scratch(spark)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("stem"), F.to_json(F.struct(F.col("s_suppkey").alias("k"))).alias("raw"), F.concat(F.col("s_name"), F.lit("\n")).alias("text"), "s_suppkey")
    sinks.save_each(s.withColumn("raw", F.when(F.col("s_suppkey") % 9 == 4, "{").otherwise(F.col("raw"))), scenes)
    sinks.save_each(s.where("s_suppkey % 4 <> 0"), captions, text="text", suffix=".txt")
    return files.load_by_mode(spark, "caption", scenes, captions).select("stem", "caption", F.get_json_object("raw", "$.k").cast("long").alias("k"))


def _archived(spark, sf_dir, **options):
    root, k = archives.fresh_root(spark, scratch(spark)), F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.format_string("c%06d", "s_suppkey").alias("stem"), F.concat(F.lit("/x/"), k.cast("string")).alias("path"), F.when(k % 10 != 3, F.repeat("s_name", (k % 50).cast("int")).cast("binary")).alias("image"))
    return root, written(archives.write_archives(rows, root, **options))


def archived_images(spark, sf_dir):  # K5, S25, S29, J15: images written to shards and read by the index
    root, refs = _archived(spark, sf_dir, shard_size=25)
    known = spark.createDataFrame([("own", root)], "base_key string, root string")
    rows = archives.with_root(refs.select("path", F.col("ref").alias("image_ref"), F.lit("own").alias("image_base")), known)
    got = archives.load_images(rows, archives.known_index(spark, root))
    return got.select("path", F.col("image_ref").alias("ref"), F.md5("content").alias("content_md5"))


def cut_images(spark, sf_dir):  # S27, K7, K8: shards read whole, by an index made from them
    root, refs = _archived(spark, sf_dir, shard_size=40)
    archives.write_info(spark, root, "own", ".", "png")
    top = archives.roots(spark, [f"{root}/a/b"]).first()
    rows = refs.select("path", F.col("ref").alias("image_ref"), F.lit(top["root"].removesuffix("/.")).alias("root"))
    got = archives.cut_images(rows, archives.index(spark, root, recursive=True) if archives.create_index(spark, root) else archives.known_index(spark, root))
    return got.select("path", F.coalesce(F.octet_length("content"), F.lit(-1)).cast("long").alias("size"), F.md5("content").alias("content_md5"))


def laid_images(spark, sf_dir):  # S26: images as files named by their references; Spark's reader leaves empty files out
    root, refs = _archived(spark, sf_dir, shard_size=25)
    rows = refs.select(F.col("ref").alias("image_ref"), F.lit(root).alias("root"))
    folder = scratch(spark)
    laid = archives.materialize(archives.load_images(rows, archives.known_index(spark, root)), folder).where("image_path is not null")
    names = laid.agg(F.count("*").alias("n")).first()["n"]
    found = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.md5("content").alias("content_md5"))
    return found.where(F.lit(names) > 0)


def arrow_rows(spark, sf_dir):  # S30: Arrow files, columns and filters within the scan
    folder = scratch(spark)
    sinks.save_arrow(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text"), folder)
    return datasets.arrow_files(spark, folder, ["doc_id", "lang"], [("n_chars", ">", 900), ("lang", "in", ["en", "de"])])


def built_corpus(spark, sf_dir):  # S32, K1, P3-P5, T12, O9: the whole build, packed over the corpus and split
    folder = scratch(spark)
    scenes = table(spark, sf_dir, "documents").select(F.format_string("d%08d", "doc_id").alias("stem"), F.lit('{"a": 1}').alias("raw"), F.col("text").alias("caption"))
    sinks.prepare(scenes, "caption", folder, 9000, pack=True, test_share=0.1)
    rows = datasets.read(spark, folder)
    return rows.groupBy("split").agg(F.count("*").alias("bins"), F.sum(F.size("sequence_lengths")).alias("sequences"), F.sum("n_tokens").alias("tokens"))


def built_batches(spark, sf_dir):  # S32, K2, S13: the build by batches of scenes, batch by batch
    folder = scratch(spark)
    scenes = table(spark, sf_dir, "documents").select(F.format_string("d%08d", "doc_id").alias("stem"), F.lit('{"a": 1}').alias("raw"))
    sinks.prepare(scenes, "unconditional", folder, 9000, batch_size=100)
    rows = datasets.read(spark, folder).groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    return rows.where(F.col("batch_id").isin(datasets.batch_ids(spark, folder))).select(F.col("batch_id").cast("long").alias("batch_id"), "n", "tokens")


def _answers(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.when(k % 5 == 0, F.concat(F.lit('<think>.</think>{"object_1": '), k.cast("string"), F.lit(', "b": [1, 2.50]}'))).when(k % 5 == 1, "no json").when(k % 5 == 2, "").when(k % 5 == 3, '{"x":"é"}').otherwise(None)
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("uid"), text.alias("response"), F.when(k % 5 == 4, "model: lost").when(k % 5 == 2, responses.EMPTY_OUTPUT).alias("error"), F.when(k % 2 == 0, "blueprint").otherwise("text").alias("condition_type"), F.when(k % 2 == 0, F.concat(F.lit('{"rooms":{"n":'), k.cast("string"), F.lit("}}"))).otherwise(F.col("s_name")).alias("condition"), F.concat(F.lit("assistant\n"), F.col("s_name")).alias("ground_truth"), (k % 7).alias("prompt_tokens"), (k % 11).alias("completion_tokens"))


def run_files(spark, sf_dir):  # K9-K11, R8, R11: a run's files, folder by folder
    folder = scratch(spark)
    inference.save_run(_answers(spark, sf_dir), folder)
    rows = None
    for name, pattern in (("json", "*.json"), ("failed", "*.txt"), ("ground_truth", "*.json"), ("conditions", "*.txt"), ("conditions", "*.json")):
        part = files.texts(spark, f"{folder}/{name}", pattern).select(F.lit(name).alias("folder"), F.col("stem").alias("uid"), _md5(F.col("raw")).alias("raw_md5"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def run_statistics(spark, sf_dir):  # R11, K11, K13: the counters of a run, and results as JSON
    folder = scratch(spark)
    told = inference.save_run(_answers(spark, sf_dir), folder)
    sinks.save_result(spark, {"run": spark.createDataFrame([told])}, f"{folder}/result.json")
    back = datasets.side_car(spark, folder, "result.json")["run"][0]
    names = ("total", "successful", "failed", "json_parsed", "json_failed", "prompt_tokens", "completion_tokens")
    return spark.createDataFrame([tuple(back[n] for n in names)], ", ".join(f"{n} long" for n in names))


def text_dump(spark, sf_dir):  # K16: a line a row
    folder = scratch(spark)
    sinks.save_texts(tokens.rendered(inputs.conversations(spark, sf_dir), 10**9), folder)
    return spark.read.text(folder).select(_md5(F.col("value")).alias("line_md5")).groupBy("line_md5").agg(F.count("*").alias("n"))


def copied_files(spark, sf_dir):  # K14, J7: files copied under the names of their sources
    folder, out = scratch(spark), scratch(spark)
    sinks.save_each(table(spark, sf_dir, "nation").select(F.concat(F.lit("made_"), F.col("n_nationkey").cast("string")).alias("stem"), F.concat(F.lit('{"b": 1, "a": '), F.col("n_nationkey").cast("string"), F.lit("}")).alias("raw")), folder)
    made = files.texts(spark, folder)
    own = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("stem"), F.concat(F.lit('{"a":'), F.col("n_nationkey").cast("string"), F.lit(',"b":1}')).alias("raw"))
    match = profile.content_match(made, own).join(made.select(F.col("stem").alias("name"), "path"), "name")
    profile.materialize(match.select("path", F.concat("source", F.lit(".json")).alias("to")), out)
    mapped = spark.read.json(f"{out}/{profile.MAPPING}").select("to", F.regexp_extract("path", r"([^/]+)$", 1).alias("made"))
    return mapped.join(files.texts(spark, out).select(F.concat("stem", F.lit(".json")).alias("to"), "raw"), "to")


def built_modes(spark, sf_dir):  # P1c-P1f, P16: what each mode asks, and its images
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.to_json(F.struct(F.col("n_chars").alias("n"))).alias("raw"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("/i/"), F.col("doc_id").cast("string"))).alias("image_path"), F.transform(F.sequence(F.lit(1), F.col("doc_id") % 4 + 1), lambda i: i.cast("string")).alias("image_paths"))
    rows = None
    for mode in ("unconditional", "contour", "panorama", "multi_view", "multi_view2", "multi_view3"):
        built = conversations.build(docs, mode)
        n = F.col("num_images").cast("long") if "num_images" in built.columns else F.lit(0).cast("long")
        part = built.select(F.lit(mode).alias("mode"), "stem", _md5(F.get("messages", 0)["content"]).alias("ask_md5"), F.get("messages", 1)["content"].alias("answer"), n.alias("images"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def mode_tokens(spark, sf_dir):  # T10, T4: tokens by mode, rows with images cut instead of dropped
    rows = inputs.conversations(spark, sf_dir).withColumns({"num_images": (F.col("conv_id") % 3).cast("int"), "image_token_counts": F.array(F.lit(7), F.lit(5)).cast("array<int>")})
    told = lambda mode, **more: tokens.tokenize_mode(rows, mode, 300, counted=True, **more).select(F.lit(mode).alias("mode"), "conv_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_labels").cast("long").alias("n_labels"))
    return told("caption").unionByName(told("panorama", truncate=True))


def label_alignment(spark, sf_dir):  # T5: labels cut at the right or filled at the left
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sequence(F.lit(1), (F.col("doc_id") % 7 + 1).cast("int")).alias("ids"), F.sequence(F.lit(101), (F.col("doc_id") % 5 + 101).cast("int")).alias("labels"))
    return rows.select("doc_id", F.array_join(F.transform(tokens.aligned_labels(F.col("ids"), F.col("labels")), lambda x: x.cast("string")), ",").alias("labels"))


def image_headers(spark, sf_dir):  # I3, I4: sizes from the headers of PNG and JPEG bytes, and of bytes that are neither
    k = F.col("c_custkey")
    word = lambda x, n: F.lpad(F.hex(x), n, "0")
    w, h = k % 4000 + 1, k * 7 % 3000 + 1
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(w, 8), word(h, 8), F.lit("0802000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), word(h, 4), word(w, 4), F.lit("03"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.unhex(F.when(k % 3 == 0, png).when(k % 3 == 1, jpeg).otherwise(word(k, 16))).alias("content"))
    return rows.select("c_custkey", images.resolution("content").alias("r")).select("c_custkey", F.col("r.width").cast("long").alias("width"), F.col("r.height").cast("long").alias("height"))


def converted_files(spark, sf_dir):  # K4, S10, O15: YAML files as JSON files
    folder, out = scratch(spark), scratch(spark)
    raw = F.concat(F.col("n_nationkey").cast("string"), F.lit("_BedFactory: {w: 0.12345, n: "), F.lower(F.col("n_name")), F.lit("}\nblueprint: [1, 2.5]\n"))
    sinks.save_each(table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("stem"), F.when(F.col("n_nationkey") % 6 != 5, raw).otherwise("a: [").alias("raw")), folder, suffix=".yaml")
    sinks.save_each(files.converted(files.yaml_files(spark, folder), 3), out)
    return files.texts(spark, out).select("stem", "raw")


def saved_profile(spark, sf_dir):  # A10: a profile and its rating written as JSON and read back
    folder = scratch(spark)
    sinks.save_result(spark, {"profile": profile.quality(profile.profile(inputs.event_files(spark, sf_dir)))}, f"{folder}/analysis.json")
    back = datasets.side_car(spark, folder, "analysis.json")["profile"][0]
    return spark.createDataFrame([(back["files"], back["valid"], back["invalid"], back["rating"], len(back["common_keys"]))], "files long, valid long, invalid long, rating string, keys long")


QUERIES = {f.__name__: f for f in (record_files, prompt_lines, image_records, image_paths, mode_scenes, archived_images, cut_images, laid_images, arrow_rows, built_corpus, built_batches, run_files, run_statistics, text_dump, copied_files, built_modes, mode_tokens, label_alignment, image_headers, converted_files, saved_profile)}

_TURN = "(4 + octet_length(encode(role)) + octet_length(encode(coalesce(text, ''))))"
_SHARDS = "WITH c AS (SELECT *, repeat(s_name, (s_suppkey % 50)::INT) AS image, row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier WHERE s_suppkey % 10 <> 3), r AS (SELECT s_suppkey, image, printf('images_shard_%04d.tar::c%06d_%08d.png', n // 25, s_suppkey, n) AS ref FROM c)"
_RUN = """WITH s AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '{"rooms":{"n":' || s_suppkey || '}}' END AS plan FROM supplier), j AS (SELECT *, CASE k % 5 WHEN 0 THEN '"object_1":' || k || ',"b":[1,2.5]}' WHEN 3 THEN '"x":"é"}' END AS x FROM s)"""


def _built(rows: str, length: str) -> str:
    return f"SELECT 0 AS batch_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id, {length} AS n FROM documents WHERE {rows}"


#: A caption's turns: role, text and marks of the two, a byte a token, a mark a token.
_CAPTIONED = f"4 + 4 + {len(conversations.PROMPTS['caption'].encode())} + octet_length(encode(text)) + 4 + 9 + 7"
_CAPTION_ROWS = _built(f"length(coalesce(text, '')) > 0 AND {_CAPTIONED} <= 9000", _CAPTIONED)

ORACLE = {
    "record_files": """WITH s AS (SELECT *, printf('n%02d', s_nationkey) || CASE WHEN s_nationkey % 3 = 2 THEN '.jsonl' ELSE '.json' END AS source, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)
      SELECT source, CAST(s_suppkey AS VARCHAR) AS id, s_name AS caption, row_number() OVER (ORDER BY s_nationkey % 3 = 2, source, i) - 1 AS "row" FROM s WHERE s_nationkey % 3 <> 0 OR i = 1""",
    "prompt_lines": "SELECT trim(p_name) AS prompt, count(*) AS n FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1",
    "image_records": "WITH c AS (SELECT * FROM customer WHERE c_custkey % 6 NOT IN (3, 5)) SELECT CAST(c_nationkey AS VARCHAR) AS id, count(*) AS n, 'look' AS prompt FROM c GROUP BY c_nationkey UNION ALL SELECT 'all', count(*), NULL FROM c",
    "image_paths": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/abs/' || doc_id WHEN 1 THEN 's3:/b/' || doc_id ELSE CASE WHEN doc_id % 2 = 0 THEN '/own/' ELSE '/root/' END || doc_id END AS path FROM labels",
    "mode_scenes": "SELECT CAST(s_suppkey AS VARCHAR) AS stem, s_name AS caption, s_suppkey AS k FROM supplier WHERE s_suppkey % 9 <> 4 AND s_suppkey % 4 <> 0",
    "archived_images": f"{_SHARDS} SELECT '/x/' || c.s_suppkey AS path, ref, md5(image) AS content_md5 FROM supplier c LEFT JOIN r USING (s_suppkey)",
    "cut_images": "SELECT '/x/' || s_suppkey AS path, CASE WHEN s_suppkey % 10 <> 3 THEN length(s_name) * (s_suppkey % 50) ELSE -1 END AS size, CASE WHEN s_suppkey % 10 <> 3 THEN md5(repeat(s_name, (s_suppkey % 50)::INT)) END AS content_md5 FROM supplier",
    "laid_images": f"{_SHARDS} SELECT sha256(ref) || '.png' AS name, md5(image) AS content_md5 FROM r WHERE image <> ''",
    "arrow_rows": "SELECT doc_id, lang FROM documents WHERE n_chars > 900 AND lang IN ('en', 'de')",
    "built_corpus": f"{_FFD.format(rows=_CAPTION_ROWS, capacity=9000)}, b AS (SELECT bin - 1 AS b, count(*) AS k, CAST(sum(n) AS BIGINT) AS n FROM f WHERE bin > 0 GROUP BY bin), t AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(b AS VARCHAR) || '-42')) <= floor(count(*) OVER () * 0.1) AS test FROM b) SELECT CASE WHEN test THEN 'test' ELSE 'train' END AS split, count(*) AS bins, CAST(sum(k) AS BIGINT) AS sequences, CAST(sum(n) AS BIGINT) AS tokens FROM t GROUP BY test",
    "built_batches": f"SELECT batch_id, count(*) AS n, CAST(count(*) * {4 + 4 + len(conversations.PROMPTS['unconditional']) + 4 + 9 + 7} AS BIGINT) AS tokens FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch_id FROM documents) GROUP BY batch_id",
    "run_files": f"{_RUN} SELECT 'json' AS folder, CAST(k AS VARCHAR) AS uid, md5('{{' || coalesce('\"blueprint\":' || plan || ',', '') || x) AS raw_md5 FROM j WHERE x IS NOT NULL UNION ALL SELECT 'failed', CAST(k AS VARCHAR), md5('no json') FROM s WHERE k % 5 = 1 UNION ALL SELECT 'ground_truth', CAST(k AS VARCHAR), md5(name) FROM s UNION ALL SELECT 'conditions', CAST(k AS VARCHAR), md5(coalesce(plan, name)) FROM s",
    "run_statistics": "SELECT count(*) AS total, count(*) FILTER (WHERE s_suppkey % 5 NOT IN (2, 4)) AS successful, count(*) FILTER (WHERE s_suppkey % 5 IN (2, 4)) AS failed, count(*) FILTER (WHERE s_suppkey % 5 IN (0, 3)) AS json_parsed, count(*) FILTER (WHERE s_suppkey % 5 = 1) AS json_failed, CAST(sum(s_suppkey % 7) AS BIGINT) AS prompt_tokens, CAST(sum(s_suppkey % 11) AS BIGINT) AS completion_tokens FROM supplier",
    "text_dump": "WITH c AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id) SELECT md5(replace(t, chr(10), '\\n')) AS line_md5, count(*) AS n FROM c GROUP BY 1",
    "copied_files": "SELECT lower(n_name) || '.json' AS \"to\", 'made_' || n_nationkey || '.json' AS made, '{\"b\": 1, \"a\": ' || n_nationkey || '}' AS raw FROM nation",
    "built_modes": f"""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS stem, '{{"n":' || n_chars || '}}' AS answer, doc_id % 4 + 1 AS n FROM documents), m AS (SELECT unnest(['multi_view', 'multi_view2', 'multi_view3']) AS mode)
      SELECT 'unconditional' AS mode, stem, md5('{conversations.PROMPTS["unconditional"]}') AS ask_md5, answer, 0::BIGINT AS images FROM d UNION ALL SELECT 'contour', stem, md5('{conversations.PROMPTS["contour"]}'), answer, 0 FROM d
      UNION ALL SELECT 'panorama', stem, md5('{conversations.PROMPTS["panorama"]}'), answer, 1 FROM d WHERE doc_id % 3 <> 0 UNION ALL SELECT mode, stem, md5(replace('{conversations.PROMPTS["multi_view"]}', '{{n}}', CAST(n AS VARCHAR))), answer, n FROM d, m""",
    "mode_tokens": f"WITH l AS (SELECT conv_id, CAST(sum({_TURN}) AS BIGINT) AS n, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id), k AS (SELECT *, n + CASE WHEN role = 'user' THEN CASE conv_id % 3 WHEN 1 THEN 9 WHEN 2 THEN 16 ELSE 0 END ELSE 0 END AS v FROM l) SELECT 'caption' AS mode, conv_id, n AS n_tokens, n AS n_labels FROM l WHERE n <= 300 UNION ALL SELECT 'panorama', conv_id, least(v, 300), least(v, 300) FROM k",
    "image_headers": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN c_custkey % 4000 + 1 END AS width, CASE WHEN c_custkey % 3 <> 2 THEN c_custkey * 7 % 3000 + 1 END AS height FROM customer",
    "converted_files": """SELECT 's' || n_nationkey AS stem, '{' || chr(10) || '  "object_1": {' || chr(10) || '    "w": 0.123,' || chr(10) || '    "n": "' || lower(n_name) || '"' || chr(10) || '  },' || chr(10) || '  "blueprint": [' || chr(10) || '    1,' || chr(10) || '    2.5' || chr(10) || '  ]' || chr(10) || '}' AS raw FROM nation WHERE n_nationkey % 6 <> 5""",
    "saved_profile": "WITH e AS (SELECT count(*) AS files, count(*) FILTER (WHERE event_id % 10 <> 9) AS valid, count(*) FILTER (WHERE event_id % 10 = 9) AS invalid FROM events) SELECT *, 'to improve' AS rating, 3::BIGINT AS keys FROM e",
    "label_alignment": "WITH d AS (SELECT doc_id, doc_id % 7 + 1 AS n, doc_id % 5 + 1 AS m FROM documents) SELECT doc_id, array_to_string(list_concat(list_transform(range(greatest(n - m, 0)), lambda i: '-100'), list_transform(range(least(n, m)), lambda i: CAST(101 + i AS VARCHAR))), ',') AS labels FROM d",
}

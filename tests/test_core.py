import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions.responses import parse_response, run_counters, strip_marks
from weftline.operators import conversations, packing, tokens
from weftline.plans.queries import ORACLE, QUERIES
from weftline.sources import files

SF = "/root/testdata/sf0.001"
ROOM = {
    "blueprint": {"rooms": {"r/0": {"shape": {"coordinates": [[[0, 0], [4, 0], [4, 2], [0, 2]]]}}}},
    "object_1": {"class": "Bed", "spatial": {"location": [1.0, 0.5, 0.0], "rotation": [0, 0, 0]}, "params": {"w": 0.5}},
    "object_2": {"class": "Chair", "spatial": {"location": [3.0, 1.5, 0.0], "rotation": [0, 0, 0]}, "params": {}},
    "portal": [{"seg": [[4, 0], [4, 1]], "rot": 0.0}],
}


def _cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return round(float(v), 4) if not isinstance(v, bool) and (isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "fiu") else v


def _rows(frame, columns):
    return sorted((tuple(map(_cell, r)) for r in frame[columns].astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "events", "embeddings", "benchmark", "lineitem", "orders", "supplier", "part", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["chat_render", "label_mask_counts", "vision_tokens", "collate", "prefix_offsets", "unpack_positions", "length_index_percentile", "hash_split", "packed_lengths", "pack_gate", "pack_ffd", "pack_corpus", "pack_totals", "batch_assign", "prompt_records", "scene_objects", "scene_f1", "scene_params", "scene_rivals", "scene_pair_params", "params_accuracy", "garment_metrics", "file_profile", "content_match", "samples", "run_counters", "saved_batches", "nearest_match", "garment_shapes", "garment_curves", "vision_grids", "price_percentiles", "group_sample", "drawn_views", "record_files", "archived_images", "cut_images", "arrow_rows", "built_corpus", "run_files", "copied_files", "json_structure", "flagship"])
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert list(map(repr, _rows(got, sorted(got)))) == list(map(repr, _rows(want, sorted(got)))) or _rows(got, sorted(got)) == _rows(want, sorted(got))


@pytest.mark.parametrize("name", ["pack_gate", "over_length", "labels_all_roles", "chat_render", "text_dump", "mode_tokens"])
def test_query_with_tokens_in_many_parts_equals_sql(spark, duck, monkeypatch, name):
    own, seen = tokens.pieces, spark.sparkContext.accumulator(0)

    def small(sizes):
        out = own(sizes, 5000)
        seen.add(len(out))
        return out

    monkeypatch.setattr(tokens, "pieces", small)
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).fetchdf()
    assert _rows(got, sorted(got)) == _rows(want, sorted(got)) and seen.value > duck.execute("SELECT sum(length(text)) FROM conversations").fetchone()[0] // 15000


@pytest.mark.parametrize("name", ["over_length", "labels_all_roles", "chat_render", "text_dump", "mode_tokens"])
def test_no_token_array_leaves_a_worker(spark, duck, monkeypatch, name):
    made, frame = [], type(spark.range(1))
    own = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema, *a, **b: made.append(schema) or own(self, run, schema, *a, **b))
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).fetchdf()
    assert _rows(got, sorted(got)) == _rows(want, sorted(got))
    assert made and not any({"input_ids", "labels"} & set(x.names) for x in made)


def test_pack_gate_makes_tokens_once(spark, duck, monkeypatch):
    own, seen = tokens.turn_sizes, spark.sparkContext.accumulator(0)

    def counted(batch):
        seen.add(batch.num_rows)
        return own(batch)

    monkeypatch.setattr(tokens, "turn_sizes", counted)
    got, want = QUERIES["pack_gate"](spark, SF).toPandas(), duck.execute(ORACLE["pack_gate"]).fetchdf()
    assert _rows(got, sorted(got)) == _rows(want, sorted(got))
    assert seen.value == duck.execute("SELECT count(DISTINCT conv_id) FROM conversations").fetchone()[0]


def test_every_query_is_held_against_something():
    assert set(QUERIES) == set(ORACLE)


def test_conversations(spark):
    raw = json.dumps(ROOM)
    df = spark.createDataFrame([("s", raw, "a bed", ["a", "b"]), ("t", "{bad", "x", ["a"]), ("u", raw, "", [])], "stem string, raw string, caption string, image_paths array<string>")
    got = conversations.build(df, "caption").collect()
    assert [r["stem"] for r in got] == ["s"]
    assert got[0]["messages"][0]["content"].endswith("description:\na bed")
    assert got[0]["messages"][1]["content"] == json.dumps(ROOM, separators=(",", ":"))
    assert "Based on these 2 multi-view" in conversations.build(df, "multi_view").first()["messages"][0]["content"]
    assert set(json.loads(conversations.build(df, "blueprint").first()["messages"][1]["content"])) == {"object_1", "object_2"}
    with pytest.raises(ValueError):
        conversations.build(df, "nothing")


def test_tokens_and_positions(spark):
    df = spark.createDataFrame([(1, [("system", "s"), ("user", "a b"), ("assistant", "c")])], "row_id long, messages array<struct<role:string,content:string>>")
    row = tokens.tokenize(df, 100).first()
    assert len(row["input_ids"]) == len(row["labels"]) == row["n_tokens"]
    assert tokens.tokenize(df, 3).count() == 0
    lens = F.array(*[F.lit(x) for x in (3, 4, 2)])
    r = spark.range(1).select(tokens.position_ids(lens, F.lit(12)).alias("p"), tokens.boundaries(lens).alias("b"), tokens.aligned_labels(F.array(F.lit(1), F.lit(2)), F.array(F.lit(7))).alias("l")).first()
    assert r["p"] == [0, 1, 2, 0, 1, 2, 3, 0, 1, 0, 1, 2] and r["b"] == [0, 3, 7, 9] and r["l"] == [-100, 7]
    assert tokens.parse_batches([0, "5-10", 15]) == [0, 5, 6, 7, 8, 9, 10, 15] and tokens.parse_batches(5) == [5]


def test_pack_and_unpack(spark):
    rows = [(0, i, [i] * n, [-100] + [i] * (n - 1), n) for i, n in enumerate([3, 9, 4, 2, 7])]
    df = spark.createDataFrame(rows, "batch_id long, row_id long, input_ids array<int>, labels array<int>, n_tokens int")
    got = packing.pack(df, 8).orderBy("bin_id")
    assert [r["sequence_lengths"] for r in got.collect()] == [[8], [7], [4, 3], [2]]
    parts = packing.unpack(got).orderBy("id").collect()
    assert [len(p["input_ids"]) for p in parts] == [8, 7, 4, 3, 2]
    assert all(len(p["prompt_ids"]) == 1 for p in parts)
    assert packing.first_fit([5, 5, 3, 3], 8) == [0, 1, 0, 1]


def test_responses(spark):
    df = spark.createDataFrame([('{"a":1}',), ('<think>x</think>{"a":1}',), ("",), ('{"a":',), ('{"a":NaN}',)], "r string").withColumn("p", parse_response("r")).select("p.*")
    assert [(e or "").split(":")[0] for e in (r["error"] for r in df.collect())] == ["", "", "empty_response", "json_error", ""]
    assert run_counters(df).first()["json_parsed"] == 3
    text = "<|im_start|>user\n<|vision_start|><|image_pad|><|vision_end|>hi<|im_end|>\n<|im_start|>assistant\nx"
    assert spark.range(1).select(strip_marks(F.lit(text))).first()[0] == "hi"


def test_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s{i}.json").write_text('{"a": 1}')
    (tmp_path / "s0.txt").write_text(" cap \n")
    pairs = files.caption_pairs(files.texts(spark, str(tmp_path), "*.txt"), files.texts(spark, str(tmp_path)))
    assert [(r["stem"], r["caption"]) for r in pairs.collect()] == [("s0", "cap")]

"""Scans and sinks on files: round trips and errors."""

import json
import os
import signal
import subprocess
import sys
import tarfile
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import snapshots, stores
from weftline.functions import images, responses
from weftline.operators import tokens
from weftline.scratch import result, scratch, written
from weftline.sinks import datasets as sinks
from weftline.sinks import inference
from weftline.sources import archives, datasets, files, records
from weftline.streaming import append


def test_scratch_tables_are_deleted(spark):
    made = []

    def make():
        made.append(written(spark.range(3)))
        return made[0].where("id > 0")

    assert result(make, spark).count() == 2
    with pytest.raises(Exception, match="(?i)exist|found"):
        made[0].count()


def test_modes_from_folders(spark, tmp_path):
    for i in range(4):
        (tmp_path / "json").mkdir(exist_ok=True)
        (tmp_path / "json" / f"s{i}.json").write_text('{"a": 1}' if i < 3 else "{bad")
        at = tmp_path / "img" / f"s{i}"
        (at / "panorama").mkdir(parents=True)
        (at / "orbit").mkdir()
        for k in range(3 + i):
            (at / "orbit" / f"orbit_{k}.png").write_bytes(b"x")
        if i:
            (at / "panorama" / "panorama_rgb.png").write_bytes(b"x")
            (at / "front.png").write_bytes(b"x")
    (tmp_path / "cap").mkdir()
    (tmp_path / "cap" / "s1.txt").write_text(" words \n")
    own = lambda mode, **k: files.load_by_mode(spark, mode, str(tmp_path / "json"), str(tmp_path / "cap"), str(tmp_path / "img"), **k)
    assert [r["stem"] for r in own("unconditional").orderBy("stem").collect()] == ["s0", "s1", "s2"]
    assert [(r["stem"], r["caption"]) for r in own("caption").collect()] == [("s1", "words")]
    assert sorted(r["stem"] for r in own("panorama").collect()) == ["s1", "s2"]
    assert sorted(r["stem"] for r in own("multi_view3").collect()) == ["s1", "s2"]
    views = {r["stem"]: r["image_paths"] for r in own("multi_view", views=(4, 5)).collect()}
    assert sorted(views) == ["s1", "s2"] and all(4 <= len(set(v)) <= 5 for v in views.values())
    assert [r["path"][-7:] for r in files.malformed(files.texts(spark, str(tmp_path / "json"))).collect()] == ["s3.json"]
    for bad in (lambda: files.load_by_mode(spark, "caption", str(tmp_path / "json")), lambda: files.json_files(spark, str(tmp_path / "cap")), lambda: files.load_by_mode(spark, "x", str(tmp_path / "json"))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileNotFoundError):
        files.json_files(spark, str(tmp_path / "nowhere"))


def test_yaml_and_config(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("696816_BedFactory: {w: 0.01983328167140487}\nblueprint: {}\n12_XFactory: [2.675, true, null]\n")
    (tmp_path / "b.yml").write_text("a: [")
    got = {r["stem"]: r["raw"] for r in files.converted(files.yaml_files(spark, str(tmp_path)), 4, indent=None).collect()}
    assert got == {"a": '{"object_1":{"w":0.0198},"blueprint":{},"object_2":[2.675,true,null]}', "b": None}
    assert [files.rounded(x, 2) for x in (2.675, 0.125, 1.005, True, 3)] == [2.67, 0.12, 1.0, True, 3]
    assert sinks.save_each(files.converted(files.yaml_files(spark, str(tmp_path))), str(tmp_path / "out")) == 1
    assert json.loads((tmp_path / "out" / "a.json").read_text())["object_1"]["w"] == 0.01983328167140487
    (tmp_path / "c.conf").write_text("model: {name: x}\n")
    assert files.load_config(str(tmp_path / "c.conf"), ("model.name",)) == {"model": {"name": "x"}}
    with pytest.raises(ValueError, match="data"):
        files.load_config(str(tmp_path / "c.conf"), ("model.name", "data.path"))


def test_records(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"caption": "one"}, {"description": "two", "id": 7}]')
    (tmp_path / "a.json").write_text('{"caption": "zero", "tags": ["t"]}')
    (tmp_path / "a.jsonl").write_text('{"prompt": "three"}\n\n{"x": 1}\n')
    rows = records.load(spark, "caption", str(tmp_path)).orderBy("__row_id").collect()
    assert [r["caption"] or r["description"] or r["prompt"] for r in rows] == ["zero", "one", "two", "three", None] and [r["__row_id"] for r in rows] == list(range(5))
    own = records.samples(records.load(spark, "caption", str(tmp_path)), "caption")
    assert [r["uid"] for r in records.valid(own).orderBy("uid").collect()] == ["7", "sample_000000", "sample_000001", "sample_000003"]
    assert [r["uid"] for r in records.rejected(own).collect()] == ["sample_000004"]
    assert records.load(spark, "unconditional", prompt="hi").first()["prompt"] == "hi"
    (tmp_path / "p.txt").write_text("x\n\n y \n")
    assert [r["prompt"] for r in records.load(spark, "unconditional", str(tmp_path / "p.txt")).orderBy("__row_id").collect()] == ["x", "y"]
    (tmp_path / "img" / "s").mkdir(parents=True)
    for n in ("b.PNG", "a.jpg", "c.md"):
        (tmp_path / "img" / "s" / n).write_bytes(b"x")
    many = records.load(spark, "multi_view", image_dir=str(tmp_path / "img")).first()
    assert many["id"] == "s" and [p[-5:] for p in many["image_paths"]] == ["a.jpg", "b.PNG"]
    wide = records.load(spark, "panorama", image_dir=str(tmp_path / "img"))
    known = files.listing(spark, str(tmp_path / "img"), "*")
    got = records.samples(wide, "panorama", known=known.where("stem = 'a'"))
    assert {r["uid"]: (r["num_images"], r["reject"] is None) for r in got.collect()} == {"a": (1, True), "b": (1, False)}
    assert [c["type"] for c in got.where("uid = 'a'").first()["messages"][0]["content"]] == ["image", "text"]
    for bad in (dict(), dict(image_dir=str(tmp_path / "img"))):
        with pytest.raises(ValueError):
            records.load(spark, "caption", **bad)


def test_archives(spark, tmp_path):
    rng = np.random.default_rng(6)
    pictures = {f"/x/{s}/{i}.png": images.encode_png(rng.integers(0, 256, (4, 5, 3), dtype=np.uint8)) for s in "ab" for i in range(3)}
    df = spark.createDataFrame([(p.split("/")[2], p, d) for p, d in pictures.items()] + [("z", "/x/z/0.png", None)], "stem string, path string, image binary")
    root = archives.fresh_root(spark, str(tmp_path / "data" / "images"))
    refs = written(archives.write_archives(df, root, shard_size=4))
    held = {r["path"]: r["ref"] for r in refs.collect()}
    assert held["/x/z/0.png"] is None and held["/x/a/0.png"] == "images_shard_0000.tar::a_00000000.png" and held["/x/b/2.png"].startswith("images_shard_0001.tar::b_0000000")
    assert archives.known_index(spark, root).count() == 6 and archives.create_index(spark, root) == 0
    archives.write_info(spark, str(tmp_path / "data"), "base", "images", "png")
    (tmp_path / "data" / "x" / "y").mkdir(parents=True)
    known = archives.roots(spark, [str(tmp_path / "data" / "x" / "y"), "/"])
    rows = archives.with_root(refs.select("path", F.col("ref").alias("image_ref")).withColumn("image_base", F.lit("base")), known)
    for index in (archives.known_index(spark, root), None):
        got = {r["path"]: r["content"] and bytes(r["content"]) for r in archives.load_images(rows, index).collect()}
        assert got == pictures | {"/x/z/0.png": None}
    laid = archives.materialize(archives.load_images(rows, archives.known_index(spark, root)), str(tmp_path / "laid")).where("path = '/x/a/1.png'").first()
    with open(laid["image_path"], "rb") as f:
        assert f.read() == pictures["/x/a/1.png"]
    with pytest.raises(Exception, match="unknown image base"):
        archives.with_root(rows.drop("root").withColumn("image_base", F.lit("no")), known).collect()
    more = archives.write_archives(df, archives.fresh_root(spark, root, merge=True), shard_size=4)
    assert more.where("path = '/x/a/0.png'").first()["ref"].startswith("images_shard_0002")
    import shutil

    shutil.rmtree(tmp_path / "data" / "images" / "_index")
    assert archives.create_index(spark, root) == 12


def test_archives_of_a_store_that_only_spark_opens(spark, tmp_path):
    """Written and read through a path with another scheme: view file systems are none that tasks open."""
    (tmp_path / "far").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.weft.link./far", f"file://{tmp_path}/far")
    rng = np.random.default_rng(8)
    sizes = [0, 1, 511, 512, 513, 1024, *rng.integers(0, 3000, 60).tolist()]
    rows = [(f"s{i % 7}" if i % 9 else "län" * 60, f"/x/{i:03d}.png", bytes(rng.integers(0, 256, n, dtype=np.uint8))) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([*rows, rows[3], ("n", "/x/none.png", None)], "stem string, path string, image binary").repartition(5)
    root = "viewfs://weft/far/images"
    assert not stores.reachable(root)
    refs = written(archives.write_archives(df, archives.fresh_root(spark, root), shard_size=8))
    held = {r["path"]: r["ref"] for r in refs.collect()}
    assert len(held) == 67 and held["/x/none.png"] is None and sorted(p.name for p in (tmp_path / "far" / "images").iterdir() if p.suffix == ".tar") == [f"images_shard_{i:04d}.tar" for i in range(9)]
    own = refs.select("path", F.col("ref").alias("image_ref"), F.lit(root).alias("root"))
    got = {r["path"]: r["content"] and bytes(r["content"]) for r in archives.cut_images(own, archives.known_index(spark, root)).collect()}
    assert {p: d or b"" for p, d in got.items()} == {p: d for _, p, d in rows} | {"/x/none.png": b""}
    near = own.withColumn("root", F.lit(str(tmp_path / "far" / "images")))  # the same shards, opened by tasks and by tar
    assert {r["path"]: r["content"] and bytes(r["content"]) for r in archives.load_images(near, archives.known_index(spark, root)).collect()} == got
    order = sorted((s, p) for s, p, _ in rows)
    for shard in range(9):
        with tarfile.open(tmp_path / "far" / "images" / f"images_shard_{shard:04d}.tar") as tar:
            want = [f"{s}_{8 * shard + i:08d}.png" for i, (s, _) in enumerate(order[8 * shard : 8 * shard + 8])]
            assert tar.getnames() == want and {m.mode for m in tar} == {0o644}
    again = written(archives.write_archives(df.where("stem = 's1'"), root, shard_size=8)).where("path = '/x/001.png'").first()
    assert again["ref"].startswith("images_shard_0009.tar::") and archives.create_index(spark, root) == 0
    archives.write_info(spark, "viewfs://weft/far", "far", "images", "png")
    assert archives.roots(spark, [f"{root}/a/b", "viewfs://weft/"]).collect() == [("far", root)]
    assert archives.write_archives(df.where("image is null"), root).collect() == [("/x/none.png", None, None, None, None, None)]


def test_a_task_that_fails_leaves_no_shards(spark, tmp_path):
    root = archives.fresh_root(spark, str(tmp_path / "images"))
    bad = F.when(F.col("id") == 7, F.raise_error(F.lit("no image"))).otherwise(F.lit("x")).cast("binary")
    with pytest.raises(Exception, match="no image"):
        archives.write_archives(spark.range(9).select(F.lit("s").alias("stem"), F.col("id").cast("string").alias("path"), bad.alias("image")), root)
    assert not [n for n in stores.names(spark, root) if n.endswith(".tar")]


def test_datasets(spark, tmp_path):
    top = str(tmp_path / "d")
    rows = spark.range(10).select("id", F.when(F.col("id") < 2, "test").otherwise("train").alias("split"))
    sinks.save(rows, top, "caption", "m")
    sinks.save(rows.where("split = 'train'").withColumn("id", F.col("id") + 100), top, "caption", "m", merge=True)
    train, test = datasets.training(spark, top)
    assert (train.count(), test.count()) == (16, 2) and datasets.side_car(spark, top, sinks.MODE_INFO)["mode"] == "caption" and datasets.side_car(spark, top, "no.json") is None
    some = str(tmp_path / "b")
    sinks.save_batches(spark.range(6).withColumn("batch_id", F.col("id") % 3), some)
    assert datasets.batch_ids(spark, some) == [0, 1, 2] and sorted(r["id"] for r in datasets.from_batches(spark, [some], "0-1").collect()) == [0, 1, 3, 4]
    with pytest.raises(ValueError, match="no batches"):
        datasets.from_batches(spark, [some], [7])
    with pytest.raises(ValueError):
        datasets.union([])
    counts = sinks.save_filtered(spark.range(6).select(F.col("id").alias("row_id"), F.col("id").alias("n_tokens")), str(tmp_path / "f"), 1, 4, batch_size=2).first()
    assert (counts["before"], counts["after"]) == (6, 4) and datasets.batch_ids(spark, str(tmp_path / "f")) == [0, 1]
    sinks.save_result(spark, {"x": spark.range(2)}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"x": [{"id": 0}, {"id": 1}]}
    sinks.save_texts(spark.createDataFrame([("a\nb",)], "text string"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "a\\nb"


def _ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions_of_a_dataset(spark, tmp_path):
    top = str(tmp_path / "d")
    rows = lambda a, b, n=3: spark.range(a, b).select("id", (F.col("id") % n).alias("batch_id"))
    assert snapshots.commit(rows(0, 6), top, "batch_id", "partitions") == 1
    assert snapshots.commit(rows(6, 12).where("batch_id < 2"), top, "batch_id", "partitions", {"a": 1}) == 2
    assert _ids(snapshots.read(spark, top)) == [2, 5, 6, 7, 9, 10] and _ids(snapshots.read(spark, top, 1)) == list(range(6))
    assert snapshots.commit(rows(20, 21).withColumn("text", F.lit("x")), top, "batch_id", "append") == 3
    got = snapshots.read(spark, top)
    assert got.columns == ["id", "batch_id", "text"] and got.where("text = 'x'").count() == 1 and dict(got.dtypes)["batch_id"] == "bigint"
    plan = got.where("batch_id = 2 and id > 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan and "PartitionFilters: [isnotnull(batch_id" in plan
    assert snapshots.values(spark, top) == ["0", "1", "2"] and snapshots.manifest(spark, top)["info"] == {"a": 1}
    with pytest.raises(ValueError, match="column id"):
        snapshots.commit(rows(0, 3).withColumn("id", F.lit("x")), top, "batch_id", "append")
    with pytest.raises(ValueError, match="partitioned by"):
        snapshots.commit(rows(0, 3), top, None, "append")
    with pytest.raises(ValueError, match="no version 9"):
        snapshots.read(spark, top, 9)
    assert snapshots.commit(rows(0, 0), top, "batch_id") == 4 and snapshots.read(spark, top).count() == 0
    assert snapshots.vacuum(spark, top, keep=2) >= 2 and snapshots.versions(spark, top) == [3, 4] and _ids(snapshots.read(spark, top, 3)) == [2, 5, 6, 7, 9, 10, 20]


def test_jobs_that_end_at_once_keep_each_others_rows(spark, tmp_path):
    top = str(tmp_path / "d")
    parts = [snapshots.write_part(spark.range(10 * i, 10 * i + 3).withColumn("batch_id", F.lit(i).cast("long")), top, "batch_id") for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda p: snapshots.publish(spark, top, p, "partitions"), parts))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6] and _ids(snapshots.read(spark, top)) == sorted(10 * i + k for i in range(6) for k in range(3))


def test_a_job_that_fails_or_is_killed_leaves_the_old_rows(spark, tmp_path):
    top = str(tmp_path / "d")
    sinks.save(spark.range(5), top, "caption", "m")
    bad = spark.range(100, 200).repartition(8).withColumn("id", F.when(F.col("id") == 150, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        sinks.save(bad, top, "caption", "m")
    assert _ids(datasets.read(spark, top)) == list(range(5))
    code = """
import sys, time
from weftline.session import session
from weftline.sinks import datasets as sinks
from pyspark.sql import functions as F
spark = session("killed", "local[2]")

@F.udf("long")
def slow(x):
    time.sleep(0 if x < 150 else 3600)
    return x

sinks.save(spark.range(100, 200, 1, 10).select(slow("id").alias("id")), sys.argv[1], "caption", "m")
"""
    before = set((tmp_path / "d" / "_data").iterdir())
    run = subprocess.Popen([sys.executable, "-c", code, top], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        for _ in range(600):
            new = set((tmp_path / "d" / "_data").iterdir()) - before
            if any(p.rglob("*.parquet") and list(p.rglob("*.parquet")) for p in new):
                break
            time.sleep(0.1)
        else:
            raise AssertionError("it wrote nothing")
    finally:
        os.killpg(run.pid, signal.SIGKILL)
        run.wait()
    assert _ids(datasets.read(spark, top)) == list(range(5)) and snapshots.versions(spark, top) == [1]
    sinks.save(spark.range(7), top, "caption", "m")
    assert _ids(datasets.read(spark, top)) == list(range(7)) and snapshots.vacuum(spark, top) >= 2 and _ids(datasets.read(spark, top)) == list(range(7))


def test_a_tokenizer_is_told_by_its_vocabulary(tmp_path):
    own = tokens.load_tokenizer("/opt/tokenizers/piece_bpe_32k.model")
    told = own.told()
    assert tokens.told_tokenizer(told).told() == told
    (tmp_path / "other.model").write_bytes(b"other")
    with pytest.raises(Exception):
        tokens.told_tokenizer(told, str(tmp_path / "other.model"))
    with pytest.raises(ValueError, match="not the vocabulary"):
        tokens.told_tokenizer(told | {"sha256": "0"})


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"input_ids": [[1, 2], [3]], "text": ["a", None]})
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    with pa.OSFile(str(tmp_path / "b.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    got = datasets.arrow_files(spark, str(tmp_path))
    assert sorted((tuple(r["input_ids"]), r["text"]) for r in got.where("text is not null").collect()) == [((1, 2), "a")] * 2 and got.count() == 4
    with pytest.raises(FileNotFoundError):
        datasets.arrow_paths(str(tmp_path / "none"))


def test_one_large_arrow_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    n = 4000
    table = pa.table({"id": range(n), "text": [None if i % 7 == 0 else f"t{i % 10}" for i in range(n)], "x": [float("nan") if i % 5 == 0 else i / 2 for i in range(n)], "wide": [[i] * 20 for i in range(n)]})
    path = str(tmp_path / "a b.arrow")
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        for b in table.to_batches(max_chunksize=100):
            w.write_batch(b)
    monkeypatch.setattr(datasets, "ARROW_SPLIT", os.path.getsize(path) // 8)
    rows = datasets.arrow_files(spark, path)
    assert rows.count() == n
    parts = datasets.ArrowReader(path, rows.schema, False, []).partitions()
    assert len(parts) >= 8 and [p.first for p in parts[1:]] == [p.last for p in parts[:-1]] and (parts[0].first, parts[-1].last) == (0, 40)
    assert datasets.arrow_files(spark, path, ["text", "id"]).columns == ["text", "id"]
    for condition, filters in FILTERS.items():
        got = datasets.arrow_files(spark, path, ["id"], filters)
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in rows.where(condition).select("id").collect()), condition
    few = datasets.arrow_files(spark, path, ["text"], [("id", "<", 10)])
    assert few.where("text is not null").count() == 8 and few.count() == 10
    with pytest.raises(Exception, match="no columns"):
        datasets.arrow_files(spark, path, ["none"]).count()
    with pytest.raises(ValueError, match="unknown comparison"):
        datasets.arrow_files(spark, path, filters=[("id", "~", 1)])


FILTERS = {
    "id > 3900": [("id", ">", 3900)], "id >= 10 and id < 20 and text is not null": [("id", ">=", 10), ("id", "<", 20), ("text", "is not null")], "text in ('t1', 't2') and id <= 500": [("text", "in", ["t1", "t2"]), ("id", "<=", 500)],
    "text != 't3'": [("text", "!=", "t3")], "text is null": [("text", "is null")], "text like 't1%'": [("text", "startswith", "t1")], "text not in ('t1')": [("text", "not in", ["t1"])], "x > 1900": [("x", ">", 1900)], "x < 3 or isnan(x) and false": [("x", "<", 3)], "x = 1.0": [("x", "=", 1.0)],
}


def test_build_to_dataset(spark, tmp_path):
    scenes = spark.createDataFrame([(f"s{i}", json.dumps({"blueprint": {"rooms": {}}, "object_1": {"n": i}}) if i % 4 else "{bad", f"words {i}") for i in range(12)], "stem string, raw string, caption string")
    counts = sinks.prepare(scenes, "caption", str(tmp_path / "a"), 400, pack=True, test_share=0.5).first()
    assert counts["before"] == counts["after"] == 9
    train, test = datasets.training(spark, str(tmp_path / "a"))
    n = lambda df: df.agg(F.sum(F.size("sequence_lengths"))).first()[0]
    assert n(train) + n(test) == 9
    sinks.prepare(scenes, "unconditional", str(tmp_path / "b"), 400, batch_size=4)
    assert datasets.batch_ids(spark, str(tmp_path / "b")) == [0, 1, 2]
    text = tokens.decoded(datasets.read(spark, str(tmp_path / "b"))).where("stem = 's1'").first()["label_text"]
    assert '{"blueprint":{"rooms":{}},"object_1":{"n":1}}' in text
    totals, per = sinks.statistics(datasets.read(spark, str(tmp_path / "b")))
    assert set(totals) >= {"total_batches", "total_samples", "total_tokens"} and per.count() == totals["total_batches"] == 3
    told = datasets.side_car(spark, str(tmp_path / "b"), sinks.MODE_INFO)["tokenizer"]
    assert tokens.told_tokenizer(told).told() == told


def test_inference_run(spark, tmp_path):
    rows = spark.createDataFrame([("a", '{"rooms":{}}', "assistant\n{}"), ("b", "x", None), ("c", "y", None), ("d", "z", None)], "uid string, condition string, ground_truth string").withColumn("condition_type", F.when(F.col("uid") == "a", "blueprint").otherwise("text"))
    answers = {"a": '<think>.</think>{"object_1": 1.50}', "b": "no json", "c": ""}

    def model(part):
        if "d" in set(part["uid"]):
            raise OSError("no image")
        return [(answers[u], 3, 2) for u in part["uid"]]

    got = responses.generate(rows.coalesce(1), model)
    stats = inference.save_run(got, str(tmp_path), {"mode": "blueprint"})
    assert {k: stats[k] for k in ("total", "successful", "failed", "json_parsed", "json_failed", "completion_tokens", "mode")} == {"total": 4, "successful": 2, "failed": 2, "json_parsed": 1, "json_failed": 1, "completion_tokens": 6, "mode": "blueprint"}
    assert (tmp_path / "json" / "a.json").read_text() == '{"blueprint":{"rooms":{}},"object_1":1.5}' and (tmp_path / "failed" / "b.txt").read_text() == "no json"
    assert (tmp_path / "ground_truth" / "a.json").read_text() == "{}" and (tmp_path / "conditions" / "b.txt").read_text() == "x"
    assert {r["uid"]: r["error"] for r in got.collect()}["d"] == "image_load_error: no image"
    assert spark.read.json(str(tmp_path / "responses")).count() == 4


def test_streaming_append(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for turn in range(2):
        for i in range(3):
            (tmp_path / "in" / f"s{turn}{i}.json").write_text('{"a": 1}')
        append.append(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "unconditional", 1000).awaitTermination()
    rows = datasets.read(spark, str(tmp_path / "out"))
    assert rows.count() == 6 and rows.select("stem").distinct().count() == 6 and datasets.batch_ids(spark, str(tmp_path / "out")) == [0, 1]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert append.event_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"

    class Session:
        sparkContext = Elsewhere()
        conf = type("C", (), {"get": lambda self, k, d=None: ""})()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch(Session())

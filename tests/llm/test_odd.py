"""Defined cases: values on odd rows, clashing names, empty tables, very long texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import ctw, decontaminate, langid, linededup, mergedropout, neardup, secrets, substrdedup, topk
from weftline.llm.components import components

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_search_on_odd_tables(spark):
    rows = [(1, [1.0, 0.0], 5, "a"), (1, [0.5, 0.5], 5, "b"), (2, [1.0, 0.0], 6, None), (3, [0.0, 2.0], 7, "c"), (4, None, None, None), (None, [1.0, 1.0], 1, "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id long, score string")
    got = [tuple(r) for r in topk.top_k(df.where("vec_id = 1"), df, 5).orderBy("rank").collect()]
    # the id asks once, with its smallest vector, and its own rows are no candidates
    assert got == [(1, 1, 3, 32 * 128), (1, 2, 2, 32 * 64)]
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df, df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id = 4"), df).count() == 0


def test_decoding_odd_rows(spark):
    rows = [(1, None, "old", "x"), (2, [], "old", "y"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, text string, key string")
    assert {r["doc_id"]: r["text"] for r in mergedropout.decode(df, MODEL).collect()} == {1: None, 2: "", 3: None}
    docs = spark.createDataFrame([(None, "a b", [1]), (1, None, None), (1, "", [2]), (2, "a b", [3])], "doc_id long, text string, ids array<int>")
    enc = mergedropout.encode(docs, MODEL, dropout=0.5)
    back = [(r["doc_id"], r["text"]) for r in mergedropout.decode(enc, MODEL).collect()]
    assert sorted(back, key=str) == sorted([(None, "a b"), (1, None), (1, ""), (2, "a b")], key=str)
    assert mergedropout.encode(docs.where("false"), MODEL).count() == 0


def test_components_on_odd_edges(spark):
    rows = [(1, 2), (2, 1), (2, 2), (None, 3), (4, None), (5, 6), (6, 7), (7, 8)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 5: 5, 6: 5, 7: 5, 8: 5}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_values_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 ... 456"), (None, "the end"), (4, " \n\t\n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    empty = hashlib.sha256(b"").hexdigest()
    lang = {r["doc_id"]: r for r in langid.report(df).collect()}
    assert all((lang[i]["lang_pred"], lang[i]["score"], lang[i]["accepted"]) == ("und", 0.0, False) for i in (1, 2, 3, 4))
    found = {r["doc_id"]: r for r in secrets.scan_secrets(df).collect()}
    assert all((r["n_assign"], r["base_sha256"], r["spans"]) == (0, empty, "") for r in found.values())
    scored = {r["doc_id"]: r for r in ctw.report(df).collect()}
    assert scored[1]["n_tokens"] == scored[2]["n_tokens"] == scored[4]["n_tokens"] == 1 and scored[1]["score"] == pytest.approx(scored[2]["score"]) and scored[None]["held_out"] is False
    lines = {r["doc_id"]: r for r in linededup.report(df).collect()}
    assert (lines[1]["n_lines"], lines[1]["kept_sha256"]) == (1, empty) and lines[4]["n_lines"] == 3 and lines[4]["kept_sha256"] == hashlib.sha256(b" \n\t\n ").hexdigest()
    cut = {r["doc_id"]: r for r in substrdedup.report(df).collect()}
    assert (cut[3]["n_words"], cut[3]["n_removed"], cut[1]["kept_sha256"]) == (3, 0, empty)


def test_very_long_texts(spark):
    words = [f"w{i % 977}x{i % 1009}" for i in range(150_000)]
    long_, other = " ".join(words), " ".join(words[40_000:])
    df = spark.createDataFrame([(1, long_), (2, f"{other} tail"), (3, long_)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrdedup.report(df).collect()}
    assert got == {1: 0, 2: 110_000, 3: 150_000}
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.report(df).collect()}
    assert near[1] == near[3] == (len(set(zip(words, words[1:]))), 1)
    item = spark.createDataFrame([(7, " ".join(words[100_000:100_030]))], "item_id long, text string")
    assert sorted((r["doc_id"], r["score"], r["doc_from"]) for r in decontaminate.leaks(df, item).collect()) == [(1, 30, 100_000), (2, 30, 60_000), (3, 30, 100_000)]
    assert mergedropout.encode(df, MODEL).where("lossless and n_tokens > 150000").count() == 3
    assert secrets.scan_secrets(df.withColumn("text", F.concat(F.col("text"), F.lit(" password=abcdef1")))).agg(F.sum("n_assign")).first()[0] == 3

"""Substring dedup by seed and extend.

Seeds: of every window of ``length`` words the smallest hash of its (length // 2)-word grams is
its anchor (winnowing), so equal windows have equal anchors at equal places.  Documents are
joined on anchors: only anchors that two documents hold go on.

Extension: from an anchor the match is followed both ways as far as a window through it can
reach (the neighbourhood).  Occurrences with equal neighbourhoods form a class; all but the
class's smallest document repeat the whole neighbourhood, without any pair being listed.  What
is left - the smallest documents of anchors that have several classes - is extended word by
word: each window through the anchor is looked up by its hash, and repeats if a smaller
document holds it.  Overlapping repeated windows run together into the maximal repeats.

Each step is a minimum over hashes (with map-side partial minima), written out, and a join back.
Both sides of such a join are bare shuffles, which AQE splits where a hash is hot, so a passage
that a third of the documents share costs no task more than its part.  The texts meet their
anchors, and later their repeats, in shuffled joins at every size.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Defined cases: null or blank texts have no words;
texts of fewer than ``length`` words have no windows.  Rows with a null doc_id are neither
compared nor changed.  Rows that repeat a doc_id do not count against each other; each is
judged against smaller ids by itself.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import arrow_batches, result, written
from weftline.llm._text import Spans, U, Words, mix, slices

SEEDS = "doc_id long, th long, at long, ah long, nh long"


def _arrays(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names)


def anchors(words: Words, spans: Spans, length: int) -> np.ndarray:
    """Word positions of the winnowed anchors of all texts."""
    size = length // 2
    n, width = len(words), length - size + 1
    if n < length:
        return np.zeros(0, np.int64)
    at = np.arange(n - size + 1)
    value, place = spans.hash(at, at + size), at
    done = 1
    while done < width:  # smallest of the next `done` grams, the last of equals; doubled, then overlapped
        step = min(done, width - done)
        right_value, right_place = value[step:], place[step:]
        left_value, left_place = value[: len(right_value)], place[: len(right_value)]
        later = right_value <= left_value
        value, place = np.where(later, right_value, left_value), np.where(later, right_place, left_place)
        done += step
    first = words.first
    room = np.diff(first)
    start = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, a + m - length + 1) for a, m in zip(first[:-1], room, strict=True) if m >= length)])
    return np.unique(place[start])


def _seeds(length: int):
    def run(batches):
        for batch, data, offsets in slices(batches):
            words = Words(data, offsets)
            spans = Spans(words.hashes())
            p = anchors(words, spans, length)
            text = np.searchsorted(words.first, p, "right") - 1
            begin, end = words.first[text], words.first[text + 1]
            size = length // 2
            lo, hi = np.maximum(begin, p - (length - size)), np.minimum(end, p + length)
            near = mix(spans.hash(lo, hi) ^ mix((p - lo).astype(U)))
            ids, th = (batch.column(i).to_numpy()[text] for i in (0, 2))
            yield _arrays([ids, th, (p - begin) << 32 | (end - begin), spans.hash(p, p + size), near], ["doc_id", "th", "at", "ah", "nh"])

    return run


def _windows(length: int):
    def run(batches):
        size = length // 2
        for batch, data, offsets in slices(batches):
            words = Words(data, offsets)
            hashes = words.hashes()
            spans, spans2 = Spans(hashes), Spans(mix(hashes ^ U(0x77)), second=True)
            start, text = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, at in enumerate(batch.column(3).to_pylist()):
                a, b = words.first[i], words.first[i + 1]
                p = a + np.array(at, np.int64)
                own = np.unique(np.concatenate([np.arange(max(a, x - (length - size)), min(b - length, x) + 1) for x in p]))
                start.append(own)
                text.append(np.full(len(own), i))
            start, text = np.concatenate(start), np.concatenate(text)
            ids, th = (batch.column(i).to_numpy()[text] for i in (0, 2))
            yield _arrays([ids, th, start - words.first[text], spans.hash(start, start + length), spans2.hash(start, start + length)], ["doc_id", "th", "start", "w1", "w2"])

    return run


def repeats(documents: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, th, spans array<struct<lo int, hi int>>): stretches of words that smaller documents hold.

    th is xxhash64(text); spans of one document may overlap.
    """
    spark = documents.sparkSession
    arrow_batches(spark)
    docs = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    seeds = docs.mapInArrow(_seeds(length), SEEDS)
    shared = written(seeds.groupBy("ah").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("ah"))
    met = written(seeds.join(shared, "ah"))
    classes = written(met.groupBy("ah", "nh").agg(F.min("doc_id").alias("d0")))
    split = written(classes.groupBy("ah").agg(F.count("*").alias("kinds")).where("kinds > 1").select("ah"))
    judged = met.join(classes, ["ah", "nh"])
    p, n = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    reach = length - length // 2
    whole = judged.where("doc_id > d0").select("doc_id", "th", F.struct(F.greatest(F.lit(0), p - reach).alias("lo"), F.least(n, p + length).alias("hi")).alias("span"))
    left = judged.where("doc_id = d0").join(split, "ah")
    left = written(left.select("doc_id", "th", p.alias("p")).groupBy("doc_id", "th").agg(F.collect_set("p").alias("at")))
    asked = docs.join(left.hint("merge"), ["doc_id", "th"]).select("doc_id", "text", "th", "at")
    windows = written(asked.mapInArrow(_windows(length), "doc_id long, th long, start long, w1 long, w2 long"))
    held = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    held = written(held)
    single = windows.join(held, ["w1", "w2"]).where("doc_id > lo").select("doc_id", "th", F.struct(F.col("start").cast("int").alias("lo"), (F.col("start") + length).cast("int").alias("hi")).alias("span"))
    return whole.unionByName(single).groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans"))


def _cut(text: bytes, spans) -> tuple[int, int, bytes]:
    words = text.split()
    if spans is None:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["lo"] for s in spans], 1)
    np.add.at(edge, [s["hi"] for s in spans], -1)
    stay = np.cumsum(edge[:-1]) == 0
    return len(words), int((~stay).sum()), b" ".join(compress(words, stay.tolist()))


def _apply(want_text: bool):
    def run(batches):
        for batch, data, offsets in slices(batches):
            view, spans = memoryview(data), batch.column(2).to_pylist()
            rows = [_cut(bytes(view[offsets[i] : offsets[i + 1]]), spans[i]) for i in range(batch.num_rows)]
            n, gone, kept = zip(*rows, strict=True)
            last = pa.array([k.decode() for k in kept]) if want_text else pa.array([hashlib.sha256(k).hexdigest() for k in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), last], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def without_repeats(documents: DataFrame, length: int = 50, want_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text of the words that stay, or its SHA-256."""
    spans = result(lambda: repeats(documents, length), documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    met = docs.join(spans.hint("merge"), ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    return met.mapInArrow(_apply(want_text), "doc_id long, n_words long, n_removed long, kept string")


def report(documents: DataFrame) -> DataFrame:
    return without_repeats(documents, want_text=False).withColumnRenamed("kept", "kept_sha256")

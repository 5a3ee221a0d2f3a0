"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query with integer inner products.  The candidates'
partitions send histograms of their scores, not the scores; the histograms are summed and the
bin that holds a query's k-th highest score is found on the executors, so the driver gets one
row a query, and the next pass divides that bin alone.
When the bins are single values, the k-th score is known exactly, and a last pass keeps the
candidates that reach it.  Ties at the k-th score are settled towards smaller ids, first
within each task, so that a query never gets more than k rows from one task.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no
part; nor do rows with a null id.  Vectors of different lengths have no score with each other.
Rows that repeat an id are candidates each; as a query the id counts once (its smallest
vector).  A query without candidates has no rows.  Components are rounded down to
``floor(scale * x)``; scores outside the range of a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._spark import arrow_batches, written

#: A pass broadcasts so many bytes of query vectors at most; more queries take more passes.
QUERY_BYTES = 8 << 20
#: Scores held at a time (queries times candidates), and bins that a pass divides a range into.
SCORES, BINS = 1 << 20, 256
#: Rows of a histogram that a task gives out at a time.
GIVEN = 1 << 18
LOW, HIGH = -(2**63), 2**63 - 1


def integer_matrix(rows: list, scale: int) -> np.ndarray:
    """Rows of floor(scale * x): float64 where all inner products stay exact in it, else Python integers."""
    x = np.floor(np.asarray(rows, np.float64) * scale)
    if x.size == 0 or x.shape[1] * float(np.abs(x).max()) ** 2 < 2**53:
        return x
    return np.array([[int(v) for v in r] for r in x], object)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, as int64."""
    if a.dtype != object and b.dtype != object:
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
        if most < 2**53:
            return (a @ b.T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, LOW, HIGH).astype(np.int64)


def clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part, as (id long, v array<double>)."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))


def _blocks(batches: Iterator[pa.RecordBatch], queries: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    dim, block = queries.shape[1], max(1, SCORES // len(queries))
    for batch in batches:
        ids, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        flat = v.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1])
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        own = np.flatnonzero(lengths == dim)
        for at in range(0, len(own), block):
            rows = own[at : at + block]
            yield ids[rows], integer_matrix(flat[first[rows][:, None] + np.arange(dim)], scale)


def _queries_of(rows: list, scale: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["id"] for r in rows], np.int64), integer_matrix([r["v"] for r in rows], scale)


def _histogram(held, scale: int):
    """Counts, for each query, the scores in each of BINS bins of its present range."""

    def run(batches):
        ids, vectors, low, high, width = held.value
        n = np.zeros((len(ids), BINS), np.int64)
        for own, block in _blocks(batches, vectors, scale):
            score = inner(vectors, block)
            at = (score.astype(object) - low[:, None]) // width[:, None] if low.dtype == object else (score - low[:, None]) // width[:, None]
            inside = (score >= low[:, None]) & (score <= high[:, None]) & (own[None, :] != ids[:, None])
            q, c = np.nonzero(inside)
            n += np.bincount(q * BINS + at[q, c].astype(np.int64), minlength=n.size).reshape(n.shape)
        for first in range(0, len(ids), GIVEN // BINS):
            part = n[first : first + GIVEN // BINS]
            q, b = np.nonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array(ids[first + q]), pa.array(b.astype(np.int32)), pa.array(part[q, b])], ["q", "bin", "n"])

    return run


def _extent(held, scale: int):
    """The least and the greatest score of each query."""

    def run(batches):
        ids, vectors = held.value
        low, high = np.full(len(ids), HIGH), np.full(len(ids), LOW)
        for own, block in _blocks(batches, vectors, scale):
            score, other = inner(vectors, block), own[None, :] != ids[:, None]
            low = np.minimum(low, np.where(other, score, HIGH).min(1))
            high = np.maximum(high, np.where(other, score, LOW).max(1))
        some = low <= high
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(low[some]), pa.array(high[some])], ["q", "low", "high"])

    return run


def _reach(held, scale: int, k: int):
    """The candidates that reach the k-th score of a query: at most k of each task, by score and then id."""

    def run(batches):
        ids, vectors, kth = held.value
        best_q, best_c, best_s = (np.zeros(0, np.int64) for _ in range(3))
        for own, block in _blocks(batches, vectors, scale):
            score = inner(vectors, block)
            q, c = np.nonzero((score >= kth[:, None]) & (own[None, :] != ids[:, None]))
            best_q, best_c, best_s = np.concatenate([best_q, q]), np.concatenate([best_c, own[c]]), np.concatenate([best_s, score[q, c]])
            order = np.lexsort((best_c, -best_s, best_q))
            best_q, best_c, best_s = best_q[order], best_c[order], best_s[order]
            rank = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
            best_q, best_c, best_s = best_q[rank < k], best_c[rank < k], best_s[rank < k]
        yield pa.RecordBatch.from_arrays([pa.array(ids[best_q]), pa.array(best_c), pa.array(best_s)], ["query_id", "vec_id", "score"])

    return run


def _kth_bins(histograms: DataFrame, need: DataFrame) -> DataFrame:
    """(q, bin, above): for each query the bin that holds its k-th score, or its last one, and the scores in the bins above.

    histograms (q, bin, n) of all tasks; need (q, need).  A query has BINS rows here at most.
    """
    order = Window.partitionBy("q").orderBy(F.desc("bin"))
    sums = histograms.groupBy("q", "bin").agg(F.sum("n").alias("n"))
    sums = sums.withColumns({"upto": F.sum("n").over(order), "below": F.lead("bin").over(order)}).join(F.broadcast(need), "q")
    hit = sums.where((F.col("upto") >= F.col("need")) | F.col("below").isNull())
    return hit.groupBy("q").agg(F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("x")).select("q", "x.*")


def _chunk(spark, candidates: DataFrame, rows: list, k: int, scale: int) -> DataFrame:
    """The result for one bounded set of queries of one vector length; what the driver gets is a row a query and pass."""
    ids, vectors = _queries_of(rows, scale)
    held = spark.sparkContext.broadcast((ids, vectors))
    found = candidates.mapInArrow(_extent(held, scale), "q long, low long, high long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row for each query of the chunk
    place = {int(i): n for n, i in enumerate(ids)}
    low, high, need = [0] * len(ids), [0] * len(ids), [k] * len(ids)
    open_ = set()
    for r in found:
        low[place[r["q"]]], high[place[r["q"]]] = r["low"], r["high"]
        open_.add(place[r["q"]])
    width = [max(1, -(-(high[i] - low[i] + 1) // BINS)) for i in range(len(ids))]
    kth = [HIGH] * len(ids)
    while open_:
        at = sorted(open_)
        big = max(high[i] for i in at) - min(low[i] for i in at) >= 2**62
        as_ = (lambda x: np.array(x, object)) if big else (lambda x: np.array(x, np.int64))
        held = spark.sparkContext.broadcast((ids[at], vectors[at], as_([low[i] for i in at]), as_([high[i] for i in at]), as_([width[i] for i in at])))
        wanted = spark.createDataFrame([(int(ids[i]), need[i]) for i in at], "q long, need long")
        for r in _kth_bins(candidates.mapInArrow(_histogram(held, scale), "q long, bin int, n long"), wanted).collect():  # a row for each query of the chunk
            i = place[r["q"]]
            need[i] -= r["above"]
            low[i] = low[i] + r["bin"] * width[i]
            if width[i] == 1:
                kth[i] = low[i]
                open_.discard(i)
            high[i], width[i] = low[i] + width[i] - 1, max(1, -(-width[i] // BINS))
    held = spark.sparkContext.broadcast((ids, vectors, np.array(kth, np.int64)))
    return candidates.mapInArrow(_reach(held, scale, k), "query_id long, vec_id long, score long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query, ties to the smaller id."""
    spark = queries.sparkSession
    arrow_batches(spark, 4096)
    asked = clean(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(asked.withColumn("dim", F.size("v")))
    candidates = clean(candidates, id_col, vec_col)
    parts = []
    for dim, n in sorted(map(tuple, asked.groupBy("dim").count().collect())):
        step = max(1, QUERY_BYTES // (8 * dim))
        chunks = -(-n // step)
        own = asked.where(F.col("dim") == dim).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
        for chunk in range(chunks):
            rows = own.where(F.col("chunk") == chunk).select("id", "v").collect()  # QUERY_BYTES, give or take the hash's evenness
            if rows:
                parts.append(_chunk(spark, candidates, rows, k, scale))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for more in parts[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

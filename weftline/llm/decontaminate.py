"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask such as 110101011 hashes the tokens of a window at its ones and ignores the others, so
a substituted token breaks only the seeds that look at it.  Seeds of the documents meet seeds
of the benchmark items; around each hit the item is laid along the document, and the best
stretch of that diagonal (a match counts 1, a substitution -1) is the overlap.

An item of 9 tokens or more is leaked if the overlap scores at least ``min_score``, or
``min_share`` of the item where that is less; a shorter one if the document holds all its tokens
in place but one of each five (so items under 5 tokens without a change).

What the masks find: items under 9 tokens - every such overlap (each token is left out once);
items of 9 to 13 tokens - every such overlap (it has four tokens in a row, or two and two around
one); longer items - every overlap with one or two substitutions, every regular one (each third,
fourth, ... token replaced), and others unless a substitution hits all four masks at every
place.  tests/llm measures the recall by pattern against a scan of all diagonals.

Only hashes, ids and positions of the documents meet the benchmark's seeds.  The distinct
diagonals that are hit are written out and joined back to the texts, so each is verified once.
A side is broadcast only if its size, counted first, is at most ``broadcast_rows``; beyond that
the joins are shuffled ones, between bare exchanges, which AQE splits where a seed, an item or a
document is hot.

Tokens: ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case.  Defined cases: null or empty texts have no
tokens and no leaks.  Items under ``min_tokens`` tokens are reported, but too common to remove a
document for.  Rows with a null id are not reported (and stay when filtering).  Repeated rows
give one result row for a pair of ids, that with the highest score; ties go to the first stretch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import result, written
from weftline.llm.linededup import ascii_lower

#: Masks of items of LONG tokens or more, and of those from SHORT tokens on.
MASKS = ("110101011", "111001101", "101110011", "11011011")
MIDDLE_MASKS = ("1111", "11011")
LONG, SHORT = 14, 9
BROADCAST_ROWS = 1_000_000


def masks_of(n: int) -> tuple[str, ...]:
    """The masks that seek items of n tokens."""
    if n >= SHORT:
        return MASKS if n >= LONG else MIDDLE_MASKS
    if n < 5:
        return ("1" * n,)
    return ("1" * (n - 1), *("1" * i + "0" + "1" * (n - 1 - i) for i in range(1, n - 1)))


def token_hashes(text: Column) -> Column:
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


#: Masks hashed in one pass over the tokens: the code of more would be too large for the JVM to compile.
MASKS_AT_ONCE = 4


def _seed(mask: str) -> Column:
    """The hash of a window's tokens at the mask's ones; where the text ends within the window, of those that it has."""
    return F.xxhash64(F.lit(int(mask, 2)), *[F.get(F.col("wh"), F.col("pos") + i) for i, one in enumerate(mask) if one == "1"])


def seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """Each row once for every mask and place, with ``pos`` and ``h`` instead of ``wh``."""
    parts = []
    for at in range(0, len(masks), MASKS_AT_ONCE):
        own = masks[at : at + MASKS_AT_ONCE]
        span = min(map(len, own))
        each = rows.where(F.size("wh") >= span).withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("wh") - span)))
        parts.append(each.withColumn("h", F.explode(F.array(*map(_seed, own)))).drop("wh"))
    return reduce(DataFrame.unionByName, parts)


def _overlap() -> Column:
    """Best stretch of the item along the document: (score, matches, from, to) with positions in the item; same: all matches."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("same"), F.lit(0).alias("run"), F.lit(0).alias("run_at"), F.lit(0).alias("hits"), F.lit(0).alias("score"), F.lit(0).alias("matches"), F.lit(0).alias("from"), F.lit(0).alias("to"))

    def step(a, item_token):
        same = F.coalesce(F.get(F.col("wh"), F.when(F.col("diag") + a["i"] >= 0, F.col("diag") + a["i"])) == item_token, F.lit(False))
        fresh = a["run"] <= 0
        run = F.when(fresh, F.lit(0)).otherwise(a["run"]) + F.when(same, F.lit(1)).otherwise(F.lit(-1))
        run_at = F.when(fresh, a["i"]).otherwise(a["run_at"])
        hits = F.when(fresh, F.lit(0)).otherwise(a["hits"]) + same.cast("int")
        better = run > a["score"]
        return F.struct((a["i"] + 1).alias("i"), (a["same"] + same.cast("int")).alias("same"), run.alias("run"), run_at.alias("run_at"), hits.alias("hits"), F.when(better, run).otherwise(a["score"]).alias("score"), F.when(better, hits).otherwise(a["matches"]).alias("matches"), F.when(better, run_at).otherwise(a["from"]).alias("from"), F.when(better, a["i"] + 1).otherwise(a["to"]).alias("to"))

    return F.aggregate(F.col("item_wh"), start, step)


def _diagonals(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame:
    """(doc_id, th, item_id, diag): the distinct diagonals that a seed hits."""
    kinds = [r["n"] for r in items.select(F.least(F.size("wh"), F.lit(LONG)).alias("n")).distinct().collect()]  # LONG rows at most
    own = [seeds(items.where(F.least(F.size("wh"), F.lit(LONG)) == n), list(masks_of(n))) for n in sorted(kinds)]
    sought = written(reduce(DataFrame.unionByName, own).select("item_id", F.col("pos").alias("item_pos"), "h").distinct())
    met = seeds(docs, sorted({m for n in kinds for m in masks_of(n)}))
    few = sought.count() <= broadcast_rows
    hits = met.join(F.broadcast(sought) if few else sought, "h")
    return hits.select("doc_id", "th", "item_id", (F.col("pos") - F.col("item_pos")).alias("diag")).distinct()


def leaks(documents: DataFrame, benchmark: DataFrame, min_score: int = 12, min_share: float = 0.6, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, score, matches, overlap, doc_from, item_from, item_tokens): the best overlap of each pair."""
    return result(lambda: _leaks(documents, benchmark, min_score, min_share, broadcast_rows), documents.sparkSession)


def _leaks(documents: DataFrame, benchmark: DataFrame, min_score: int, min_share: float, broadcast_rows: int) -> DataFrame:
    items = written(benchmark.where(F.col("item_id").isNotNull()).select("item_id", token_hashes(F.col("text")).alias("wh")).where(F.size("wh") > 0).distinct())
    docs = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), token_hashes(F.col("text")).alias("wh"))
    found = "doc_id long, item_id long, score int, matches int, overlap int, doc_from int, item_from int, item_tokens int"
    if items.isEmpty():
        return documents.sparkSession.createDataFrame([], found)
    hits = written(_diagonals(docs, items, broadcast_rows))
    asked = hits.join(items.withColumnRenamed("wh", "item_wh"), "item_id")
    few = 8 * hits.count() <= broadcast_rows  # a diagonal comes with its item
    best = docs.join(F.broadcast(asked) if few else asked, ["doc_id", "th"]).withColumn("best", _overlap())
    n = F.size("item_wh")
    enough = F.col("best.score") >= F.least(F.lit(min_score), F.ceil(n * min_share))
    held = F.when(n < SHORT, F.col("best.same") >= n - F.floor(n / 5)).otherwise(enough)
    rows = best.where(held).select("doc_id", "item_id", F.col("best.score").alias("score"), F.col("best.matches").alias("matches"), (F.col("best.to") - F.col("best.from")).alias("overlap"), (F.col("diag") + F.col("best.from")).alias("doc_from"), F.col("best.from").alias("item_from"), n.alias("item_tokens"))
    first = F.max_by(F.struct("matches", "overlap", "doc_from", "item_from", "item_tokens"), F.struct("score", -F.col("doc_from"), -F.col("item_from")))
    return rows.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), first.alias("x")).select("doc_id", "item_id", "score", "x.*")


def decontaminate(documents: DataFrame, benchmark: DataFrame, min_tokens: int = 5, **options) -> DataFrame:
    """The documents without those that hold a leak of an item of ``min_tokens`` tokens or more."""
    found = leaks(documents, benchmark, **options).where(F.col("item_tokens") >= min_tokens)
    bad = found.select(F.col("doc_id").alias("__weft_bad")).distinct()
    return documents.join(bad, F.col("doc_id") == F.col("__weft_bad"), "left_anti")

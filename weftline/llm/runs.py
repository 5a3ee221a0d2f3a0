"""Periodic runs of words, and texts without their repetitions.

A run is a stretch of words with a smallest period q, at least ``least`` words and 2q long, which
no neighbouring word extends with period q.  The stretch overlaps itself shifted by q in
length - q >= ceil(least / 2) words, and the two copies cover it; so with k = ceil(least / 2) each
of its words lies in a k-gram that occurs again in the document.  Words outside such k-grams are
masked, and what is left falls into segments that hold every run whole: a run that touched the edge
of its segment and could be extended would be covered beyond it.

Only segments are searched, by the divide and conquer of Main and Lorentz: a run is cut by the
middle c of some block, and one of its periods lies wholly beside c, so that comparing c with
c + q and c - q - how far do the words agree to the right and to the left? - finds it for each q up
to half a block: O(n log n) comparisons.  They are answered from the ranks of the 2^j-grams of the
segments, exactly and all at once.  A multiple of a period gives the same stretch; the least stays.

No row leaves its task and nothing is shuffled.  Memory follows a slice of about a megabyte of text,
or the longest text where that is more (about 8 log2(n) bytes for each of its words in segments).

Odd rows: a null or empty text has no words and no runs, and its collapsed text is empty; repeated
rows and null ids are handled like any other row; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import arrow_batches
from weftline.llm._text import Spans, U, Words, mix, slices

#: Pairs of positions that are compared at once.
PAIRS = 1 << 20


def segments(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that k-grams cover which occur again in their text."""
    hashes, text = words.hashes(), words.texts()
    at = np.arange(max(0, len(words) - k + 1))
    at = at[text[at] == text[at + k - 1]]
    grams = Spans(hashes).hash(at, at + k) ^ mix(text[at].astype(U) + U(1))
    again = at[pd.Index(grams).duplicated(keep=False)]  # equal hashes of other grams would only keep more
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + k, -1)
    covered = np.cumsum(edge[:-1]) > 0
    first = np.ones(len(words), bool)
    first[1:] = (text[1:] != text[:-1]) | ~covered[:-1]
    last = np.ones(len(words), bool)
    last[:-1] = first[1:] | ~covered[1:]
    return np.flatnonzero(covered & first), np.flatnonzero(covered & last) + 1


class Grams:
    """Ranks of the 2^j-grams of a sequence: how far two places agree, to the right or to the left."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.ranks = [np.append(symbols, -1)]
        size = 1
        while 2 * size <= longest:
            held = self.ranks[-1]
            pairs = held[: len(symbols) - 2 * size + 1].astype(np.int64) * len(held) + held[size : len(symbols) - size + 1]
            ranks = np.full(len(held), -1, np.int32)
            ranks[: len(pairs)] = pd.factorize(pairs)[0]
            self.ranks.append(ranks)
            size *= 2

    def agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The number of equal symbols from a and b on, or before them, up to ``most``."""
        out = np.zeros(len(a), np.int64)
        for j in reversed(range(len(self.ranks))):
            step = 1 << j
            may = np.flatnonzero(out + step <= most)
            shift = -out[may] - step if back else out[may]
            out[may[self.ranks[j][a[may] + shift] == self.ranks[j][b[may] + shift]]] += step
        return out


def _pairs(low: np.ndarray, high: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, u, v): the places to compare, for each middle of a block and each period on its two sides."""
    block, left, right = np.arange(len(low)), low, high
    while True:
        large = right - left >= max(2, least)
        block, left, right = block[large], left[large], right[large]
        if not len(block):
            return
        middle = (left + right) // 2
        before = np.concatenate([[0], np.cumsum(right - left)])
        for at in range(0, int(before[-1]), PAIRS):
            flat = np.arange(at, min(at + PAIRS, int(before[-1])))
            own = np.searchsorted(before, flat, "right") - 1
            n, c = flat - before[own], middle[own]  # the block's places before its middle, then behind it
            back = n < c - left[own]
            q = np.where(back, n + 1, n - (c - left[own]) + 1)
            yield block[own], np.where(back, c - q, c), np.where(back, c, c + q)
        block, left, right = np.concatenate([block, block]), np.concatenate([left, middle]), np.concatenate([middle, right])


def runs(symbols: np.ndarray, low: np.ndarray, high: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs within the segments low[i]:high[i], in order of start and period."""
    none = np.zeros(0, np.int64)
    if not len(low):
        return none, none, none
    grams, found = Grams(symbols, int((high - low).max())), []
    j = min(len(grams.ranks) - 1, (-(-max(1, least) // 2) + 1).bit_length() - 2)  # one side agrees in half the overlap or more
    step, near = 1 << max(0, j), grams.ranks[max(0, j)]
    for own, u, v in _pairs(low, high, least):
        may = (near[u] == near[v]) | ((u >= step) & (near[u - step] == near[v - step]))
        own, u, v = own[may], u[may], v[may]
        start = u - grams.agree(u, v, u - low[own], back=True)
        end = v + grams.agree(u, v, high[own] - v)
        full = (end - start >= least) & (end - start >= 2 * (v - u))
        found.append(np.stack([start[full], end[full], (v - u)[full]]))
    start, end, period = np.concatenate(found, 1) if found else (none, none, none)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        new = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
        start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def text_runs(words: Words, raw: bytes, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of several texts laid end to end, in word numbers over all of them."""
    k = max(1, -(-least // 2))
    low, high = segments(words, k)
    long_ = high - low >= max(2, least)
    low, high = low[long_], high[long_]
    size = high - low
    base = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.arange(base[-1]) + np.repeat(low - base[:-1], size)  # the words of the segments, end to end
    known: dict[bytes, int] = {}
    symbols = np.fromiter((known.setdefault(raw[s:e], len(known)) for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)), np.int32, len(at))
    start, end, period = runs(symbols, base[:-1], base[1:], least)
    shift = (low - base[:-1])[np.searchsorted(base, start, "right") - 1] if len(start) else start
    return start + shift, end + shift, period


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _search(least: int):
    def run(batches):
        for batch, data, offsets in slices(batches):
            raw, words = bytes(data), Words(data, offsets)
            start, end, period = text_runs(words, raw, least)
            own = np.searchsorted(words.first, start, "right") - 1 if len(start) else start
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, end, -1)
            kept = np.cumsum(gone[:-1]) == 0
            count = np.bincount(own, minlength=batch.num_rows)
            out = []
            for i in range(batch.num_rows):
                if count[i]:
                    stay = words.first[i] + np.flatnonzero(kept[words.first[i] : words.first[i + 1]])
                    out.append(b" ".join([raw[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]))
                else:
                    out.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
            each = pa.StructArray.from_arrays([pa.array(start - words.first[own] if len(start) else start, pa.int64()), pa.array(end - start, pa.int64()), pa.array(period, pa.int64())], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words.first), pa.int64()), lists, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(documents: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: its runs by start and period, and the words that repeat nothing, joined by one space.

    A word is left out of ``collapsed`` if a run holds it behind the run's first period.
    """
    arrow_batches(documents.sparkSession)
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_search(least), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text): in documents whose crc32 is divisible by 10 the words from one place on repeat with one period; null ids stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10).cast("long"), F.size("w")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice("w", a + 1, p)
    again = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.when(n > 0, F.array_join(F.concat(F.slice("w", F.lit(1), a), again), " "))
    words = F.when(h % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return documents.select("doc_id", "text", words.alias("w")).select("doc_id", F.when(F.size("w") > 0, changed).otherwise(F.col("text")).alias("text"))


def longest(runs_: Column) -> Column:
    """The run of greatest length, then smallest start, then period; null without runs."""
    return F.array_min(F.transform(runs_, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))


def report(documents: DataFrame, least: int = 12) -> DataFrame:
    """One row a document with planted repetitions: its runs counted, the longest, and digests of all runs and of the collapsed text."""
    found = periodic_runs(planted(documents), least).withColumn("best", longest(F.col("runs")))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    length, period = -F.col("best.less"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )

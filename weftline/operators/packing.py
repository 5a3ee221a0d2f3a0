"""First-fit-decreasing packing and its inverse.

Bins are assigned within a batch, which may be the whole corpus.  First fit treats rows of one length
alike, so it runs on the counts of lengths - no more of them than the capacity has tokens - and on
stretches of bins with the same room; a row finds its bin by its place in the order of placement.
Token arrays never enter Python and are gathered by bin afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.responses import blueprint_of, strip_marks, without_role
from weftline.operators.ranks import ranked
from weftline.scratch import written

#: Places that are looked up together.
CHUNK = 256
#: Tokens that a task gathers into bins.
GATHERED = 1 << 23


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """The plain form of first fit, for a list in order of placement: the bin of each.  ``Bins`` is held against it."""
    room: list[int] = []
    out = []
    for n in lengths:
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= n
        out.append(at)
    return out


class Bins:
    """Bins in the order in which they opened, as stretches (number of bins, room left in each)."""

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.size, self.room = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def place(self, length: int, count: int) -> list[tuple[int, int, int]]:
        """Puts ``count`` items of one length where each fits first; stretches (items, first bin, items a bin) in order."""
        if not length:
            if not self.opened:
                self._open([(1, self.capacity)])
            return [(count, 0, count)]
        out = []
        fits = np.flatnonzero(self.room >= length)
        if len(fits):
            first = np.cumsum(self.size) - self.size
            per = self.room[fits] // length
            upto = np.cumsum(per * self.size[fits])
            whole = int(np.searchsorted(upto, count, "right"))  # stretches that are filled up
            for i in range(whole):
                out.append((int(per[i] * self.size[fits[i]]), int(first[fits[i]]), int(per[i])))
            self.room[fits[:whole]] -= per[:whole] * length
            count -= int(upto[whole - 1]) if whole else 0
            if whole < len(fits):
                if count:
                    at, k = int(fits[whole]), int(per[whole])
                    out.append((count, int(first[at]), k))
                    self._cut(at, count, k, length)
                count = 0
        if count:
            k = self.capacity // length
            out.append((count, self.opened, k))
            self._open(self._filled(-(-count // k), count, k, length, self.capacity))
        return out

    @staticmethod
    def _filled(bins: int, count: int, k: int, length: int, room: int) -> list[tuple[int, int]]:
        """A stretch of bins with this room after ``count`` items went into it, k a bin."""
        full, rest = divmod(count, k)
        parts = [(full, room - k * length), (min(1, rest), room - rest * length), (bins - full - min(1, rest), room)]
        return [(n, r) for n, r in parts if n]

    def _cut(self, at: int, count: int, k: int, length: int) -> None:
        parts = self._filled(int(self.size[at]), count, k, length, int(self.room[at]))
        self.size, self.room = (np.concatenate([own[:at], [p[i] for p in parts], own[at + 1 :]]) for i, own in enumerate((self.size, self.room)))

    def _open(self, parts: list[tuple[int, int]]) -> None:
        self.opened += sum(n for n, _ in parts)
        size, room = (np.concatenate([own, [p[i] for p in parts]]).astype(np.int64) for i, own in enumerate((self.size, self.room)))
        edge = np.flatnonzero(np.concatenate([[True], room[1:] != room[:-1]]))  # stretches of the same room become one
        self.size, self.room = np.add.reduceat(size, edge), room[edge]


STRETCHES = "batch_id long, first long, last long, first_bin long, per_bin long"


def bin_stretches(counts: DataFrame, capacity: int) -> DataFrame:
    """(batch_id, first, last, first_bin, per_bin): the places first to last, exclusive, lie ``per_bin`` a bin from ``first_bin`` on.

    counts: (batch_id, length, n), lengths of up to the capacity, and those beyond it as capacity + 1, which are placed alone.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("length", ascending=False)
        bins, out, at, alone = Bins(capacity), [], 0, 0
        for length, n in zip(part["length"].tolist(), part["n"].tolist(), strict=True):
            if length > capacity:
                alone, pieces = n, [(n, 0, 1)]
            else:
                pieces = [(m, first + alone, k) for m, first, k in bins.place(length, n)]
            for m, first, k in pieces:
                out.append((at, at + m, first, k))
                at += m
        return pd.DataFrame(out, columns=["first", "last", "first_bin", "per_bin"]).assign(batch_id=part["batch_id"].iloc[0])[[c.split()[0] for c in STRETCHES.split(", ")]]

    return counts.groupBy("batch_id").applyInPandas(run, STRETCHES)


def assign_bins(rows: DataFrame, capacity: int) -> DataFrame:
    """(batch_id, row_id, bin_id, place): rows beyond the capacity first, each alone, then bins as they open, longest rows first.

    A row without a length counts as empty.
    """
    length = F.least(F.coalesce("n_tokens", F.lit(0)), F.lit(capacity + 1)).cast("long")
    keys = rows.select("batch_id", "row_id", length.alias("length"))
    stretches = written(bin_stretches(keys.groupBy("batch_id", "length").agg(F.count("*").alias("n")), capacity))
    chunks = F.sequence(F.expr(f"first div {CHUNK}"), F.expr(f"(last - 1) div {CHUNK}"))
    wanted = stretches.select(F.col("batch_id").alias("_b"), "first", "last", "first_bin", "per_bin", F.explode(chunks).alias("_c"))
    placed = ranked(keys, ["batch_id"], [F.desc("length"), "row_id"], "place").withColumn("_k", F.expr(f"place div {CHUNK}"))
    met = placed.join(wanted, F.col("batch_id").eqNullSafe(F.col("_b")) & (F.col("_k") == F.col("_c")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last")))
    return met.select("batch_id", "row_id", (F.col("first_bin") + F.expr("(place - first) div per_bin")).alias("bin_id"), "place")


#: Optional columns of the rows and their names in packed ones; arrays of the rows are laid end to end.
FLAT = {"image_refs": "image_refs", "image_bases": "image_bases", "image_token_counts": "image_token_counts"}
LISTED = {"has_image": "has_image", "image_ref": "image_refs", "image_base": "image_bases"}


def tasks(tokens: DataFrame) -> int:
    """How many tasks should gather these rows, so that each holds some 64 MB of token arrays at most, or one bin."""
    return 1 + (tokens.agg(F.sum("n_tokens")).first()[0] or 0) // GATHERED


def pack(tokens: DataFrame, capacity: int, gathered_by: int | None = None) -> DataFrame:
    """(batch_id, bin_id, input_ids, labels, sequence_lengths, n_tokens), and the image columns of the rows, if any.

    has_image, image_ref and image_base become arrays; image_refs, image_bases and
    image_token_counts are concatenated, uncut, so no image is lost.  The rows are read several
    times, so what is costly to make should be written first.  ``gathered_by``: tasks that gather
    the bins, else as the session has it.
    """
    more = [c for c in (*LISTED, *FLAT) if c in tokens.columns]
    cut = lambda c: F.slice(F.col(c), 1, capacity)
    own = tokens.select("batch_id", "row_id", cut("input_ids").alias("ids"), cut("labels").alias("labels"), *more)
    bins = assign_bins(tokens, capacity).select(F.col("batch_id").alias("_b"), F.col("row_id").alias("_r"), "bin_id", "place")
    rows = own.join(bins.hint("shuffle_hash"), F.col("batch_id").eqNullSafe(F.col("_b")) & F.col("row_id").eqNullSafe(F.col("_r")))
    parts = F.array_sort(F.collect_list(F.struct("place", "ids", "labels", *more)))
    dealt = rows.repartition(*[gathered_by] * bool(gathered_by), "batch_id", "bin_id")  # before they are grouped, which would collect and sort arrays on both sides
    out = dealt.groupBy("batch_id", "bin_id").agg(parts.alias("p"))
    images = [F.col(f"p.{c}").alias(to) for c, to in LISTED.items() if c in more] + [F.flatten(F.filter(F.col(f"p.{c}"), lambda x: x.isNotNull())).alias(to) for c, to in FLAT.items() if c in more]
    out = out.select("batch_id", "bin_id", F.flatten("p.ids").alias("input_ids"), F.flatten("p.labels").alias("labels"), F.transform("p", lambda x: F.size(x["ids"])).alias("sequence_lengths"), *images)
    return out.withColumn("n_tokens", F.size("input_ids"))


def packed_if(tokens: DataFrame, packing: bool, capacity: int, gathered_by: int | None = None) -> DataFrame:
    """The gate of the build: packed rows, or the rows as they are."""
    return pack(tokens, capacity, gathered_by) if packing else tokens


def first_label(labels: Column) -> Column:
    """1-based place of the first label, 0 where all are -100."""
    return F.array_position(F.transform(labels, lambda x: x != -100), True).cast("int")


def unpack(packed: DataFrame) -> DataFrame:
    """One row a sub-sequence: (batch_id, bin_id, seg, id, input_ids, labels, prompt_ids, answer_ids)."""
    before = F.aggregate(F.slice("sequence_lengths", F.lit(1), F.col("seg")), F.lit(0), lambda a, n: a + n)
    rows = packed.select("*", F.posexplode("sequence_lengths").alias("seg", "n")).withColumn("at", before + 1)
    rows = rows.select("batch_id", "bin_id", "seg", F.format_string("arrow_%06d_seg%02d", "bin_id", "seg").alias("id"), F.slice("input_ids", F.col("at"), F.col("n")).alias("input_ids"), F.slice("labels", F.col("at"), F.col("n")).alias("labels"))
    rows = rows.withColumn("_f", first_label(F.col("labels")))
    return rows.withColumns({"prompt_ids": F.when(F.col("_f") > 1, F.slice("input_ids", F.lit(1), F.col("_f") - 1)).otherwise(F.col("input_ids")), "answer_ids": F.when(F.col("_f") > 0, F.slice("input_ids", F.col("_f"), F.size("input_ids")))}).drop("_f")


def image_name(refs: Column, mode: str) -> Column:
    """The name that a sample takes from its first image's member: its stem, or for views the folder it lies in, if any."""
    member = F.regexp_replace(F.get(refs, 0), "^.*?::", "")
    stem = F.regexp_extract(member, r"([^/]+?)(\.[^./]*)?$", 1)
    folder = F.regexp_extract(member, r"([^/]+)/[^/]+$", 1)
    return F.when(F.size(refs) > 0, F.when(F.length(folder) > 0, folder).otherwise(stem) if mode == "multi_view" else stem)


def prompt_records(packed: DataFrame, tokenizer, mode: str = "", offset: int = 0, count: int | None = None) -> DataFrame:
    """(id, prompt, ground_truth, blueprint, image_refs): the decoded sub-sequences that have a prompt, from ``offset`` on, ``count`` of them.

    Numbers run over decodable sub-sequences in the order of batch, bin and segment.  ground_truth
    is null without labels, and without its role line; blueprint is read from the prompt in that mode only.  In panorama and
    multi_view mode each gets its part of the row's image references - one, or all of its images -
    and the id is the name of the image.
    """

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else tokenizer.decode(x))

    @F.pandas_udf("string")
    def plain(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else tokenizer.decode(x, skip_marks=True))

    images = mode in ("panorama", "multi_view") and "image_refs" in packed.columns
    rows = unpack(packed)
    if images:
        from weftline.operators.vision import segment_refs

        own = segment_refs(packed, tokenizer.special("<|vision_start|>"), tokenizer.special("<|image_pad|>")).select("batch_id", "bin_id", "seg", "image_refs")
        rows = rows.join(own, ["batch_id", "bin_id", "seg"])
        rows = rows.withColumn("id", F.coalesce(image_name(F.col("image_refs"), mode), "id"))
        if mode == "panorama":
            rows = rows.withColumn("image_refs", F.slice("image_refs", 1, 1))
    else:
        rows = rows.withColumn("image_refs", F.array().cast("array<string>"))
    own = F.regexp_replace(text("prompt_ids"), r"^\s+|\s+$", "")
    rows = rows.withColumns({"prompt": F.coalesce(F.nullif(strip_marks(own), F.lit("")), own), "ground_truth": without_role(F.regexp_replace(plain("answer_ids"), r"^\s+|\s+$", ""))})
    rows = rows.where(F.length("prompt") > 0).withColumn("blueprint", blueprint_of(F.col("prompt")) if mode == "blueprint" else F.lit(None).cast("string"))
    out = rows.select("batch_id", "bin_id", "seg", "id", "prompt", "ground_truth", "blueprint", "image_refs")
    if offset or count is not None:
        from weftline.operators.ranks import positions

        out = positions(out, ["batch_id", "bin_id", "seg"], offset, 2**62 if count is None else offset + count)
    return out.drop("batch_id", "bin_id", "seg")

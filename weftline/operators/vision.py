"""Image tokens, their labels and position ids, and rows with image references."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import tokens

#: Tokens of an image that cannot be read.
UNREADABLE = 256


def image_count(ids: Column, start: int, image: int) -> Column:
    """Images of a sequence: start marks that an image token follows at once."""
    pairs = F.arrays_zip(ids.alias("a"), F.slice(ids, F.lit(2), F.greatest(F.size(ids), F.lit(1))).alias("b"))
    return F.size(F.filter(pairs, lambda p: (p["a"] == start) & (p["b"] == image)))


def expand(ids: Column, counts: Column, start: int, image: int) -> Column:
    """Behind each start mark the run of image tokens becomes as many as counts says; images beyond it take the last count."""
    begin = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("k"), F.lit(False).alias("run"))

    def step(a, x):
        n = F.element_at(counts, F.least(a["k"] + 1, F.size(counts)))
        opened = F.concat(a["out"], F.array(x), F.array_repeat(F.lit(image), n))
        out = F.when(x == start, opened).when(a["run"] & (x == image), a["out"]).otherwise(F.concat(a["out"], F.array(x)))
        run = (x == start) | (a["run"] & (x == image))
        return F.struct(out.alias("out"), (a["k"] + (x == start).cast("int")).alias("k"), run.alias("run"))

    return F.aggregate(ids, begin, step, lambda a: a["out"])


def expanded(ids, counts, start: int, image: int) -> list[int]:
    """``expand`` for one sequence in Python, for use within a vectorised function."""
    x = np.asarray(ids, np.int64)
    begins = np.flatnonzero(x == start)
    counts = list(counts)
    keep = np.ones(len(x), bool)
    size = np.ones(len(x), np.int64)
    for k, b in enumerate(begins):
        e = b + 1
        while e < len(x) and x[e] == image:
            e += 1
        keep[b + 1 : e] = False
        size[b] += counts[min(k, len(counts) - 1)]
    out = np.repeat(np.where(keep, x, 0), np.where(keep, size, 0))
    at = np.cumsum(np.where(keep, size, 0)) - np.where(keep, size, 0)
    for b in begins:
        out[at[b] + 1 : at[b] + size[b]] = image
    return out.tolist()


def tokenize(conversations: DataFrame, max_length: int, tokenizer=None, fixed: int | None = None, truncate: bool = False, counted: bool = False) -> DataFrame:
    """Adds input_ids, labels, has_image and n_tokens from ``messages`` with image counts in ``num_images`` (without it one each).

    The images stand in front of the first message, if it is the user's; else there are none.
    Every image takes ``fixed`` tokens, or its count in ``image_token_counts``.  All roles but the
    user's are labelled; where the text's own labels are shorter than the expanded ids they are
    filled up at the left.  Rows beyond ``max_length`` go, or are cut with ``truncate``.
    With ``counted`` the rows get n_tokens, n_labels and n_supervised in place of the arrays.
    """
    tok, none = tokenizer or tokens.ByteTokenizer(), np.zeros(0, np.int32)
    start, end, image = (tok.special(x) for x in ("<|vision_start|>", "<|vision_end|>", "<|image_pad|>"))

    def encoded(part, some):
        for turns, k, own in zip(tokens.turns(part), part.column("_n").to_pylist(), part.column("_counts").to_pylist(), strict=True):
            k = int(k) if k is not None and k == k and turns and turns[0][0] == "user" else 0
            parts = [tok.array(tokens.turn_text(*turn)) for turn in turns]
            told = [np.full(len(x), tokens.IGNORE, np.int32) if role == "user" else x for x, (role, _) in zip(parts, turns, strict=True)]
            if k:
                head = tok.array(f"{tokens.START}user\n")
                parts[0] = np.concatenate([head, np.tile(np.array([start, image, end], np.int32), k), parts[0][len(head) :]])
            row, told = (np.concatenate([none, *x]) for x in (parts, told))
            if k:
                per = [fixed] * k if fixed is not None else own or [UNREADABLE] * k
                row = np.array(expanded(row, per, start, image), np.int32)
            row = row[:max_length] if truncate else row
            some.append(k > 0)
            yield row, told[: len(row)] if len(told) >= len(row) else np.concatenate([np.full(len(row) - len(told), tokens.IGNORE, np.int32), told])

    def make(part):
        some: list[bool] = []
        own = (tokens.count_columns if counted else tokens.array_columns)(encoded(part, some))
        return *own, pa.array(some, pa.bool_())

    n = F.col("num_images") if "num_images" in conversations.columns else F.lit(1)
    counts = F.col("image_token_counts") if "image_token_counts" in conversations.columns else F.lit(None).cast("array<int>")
    rows = tokens.mapped(conversations.withColumns({"_n": n, "_counts": counts}), tokens.turn_sizes, make, ("messages", "_n", "_counts"), **(tokens.COUNTS if counted else tokens.ARRAYS), has_image="boolean")
    return tokens.length_filter(rows if counted else rows.withColumn("n_tokens", F.size("input_ids")), 1, max_length)


def token_count(width: Column, height: Column, patch: int = 16, merge: int = 2, least: int = 65_536, most: int = 16_777_216) -> Column:
    """Image tokens of a resolution: sides rounded to patch * merge, scaled into the range of pixels, one token a merged patch.

    null where a side is null; a plug-in processor may be put in its place.
    """
    unit = patch * merge
    side = lambda x: F.greatest(F.round(x / unit) * unit, F.lit(unit))
    w, h = side(width), side(height)
    pixels, area = w * h, width.cast("double") * height
    down, up = F.sqrt(area / most), F.sqrt(least / area)
    fit = lambda x, own: F.when(pixels > most, F.greatest(F.floor(x / down / unit) * unit, F.lit(unit))).when(pixels < least, F.ceil(x * up / unit) * unit).otherwise(own)
    return ((fit(width, w) / unit) * (fit(height, h) / unit)).cast("int")


def with_token_counts(images: DataFrame, count=token_count) -> DataFrame:
    """Adds ``image_tokens`` to rows (width, height): counted once for each distinct resolution, 256 for unreadable images."""
    sizes = images.select("width", "height").where("width is not null and height is not null").distinct()
    sizes = sizes.withColumn("image_tokens", count(F.col("width"), F.col("height")))
    return images.join(sizes, ["width", "height"], "left").withColumn("image_tokens", F.coalesce("image_tokens", F.lit(UNREADABLE))).select(*images.columns, "image_tokens")


def rows_with_images(rows: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Joins (path, ref, image_tokens) onto each row's ``image_paths``, in their order.

    Adds image_refs, image_token_counts and num_images; rows without images or with one that
    failed (no ref) go.
    """
    parts = rows.select(F.col(key).alias("_k"), F.posexplode("image_paths").alias("pos", "path")).join(images.select("path", "ref", "image_tokens"), "path", "left")
    sets = parts.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "image_tokens"))).alias("x"))
    sets = sets.where(F.forall("x", lambda p: p["ref"].isNotNull()))
    out = rows.join(sets, rows[key] == sets["_k"]).withColumns({"image_refs": F.col("x.ref"), "image_token_counts": F.col("x.image_tokens"), "num_images": F.size("x")})
    return out.drop("_k", "x")


def segment_refs(packed: DataFrame, start: int, image: int) -> DataFrame:
    """(.., seg, num_images, image_refs): each sub-sequence of packed rows with its own part of the row's flat references."""
    at = lambda k: F.aggregate(F.slice("sequence_lengths", F.lit(1), k), F.lit(0), lambda a, n: a + n)
    counts = F.transform("sequence_lengths", lambda n, i: image_count(F.slice("input_ids", at(i) + 1, n), start, image))
    rows = packed.withColumn("_c", counts).select("*", F.posexplode("_c").alias("seg", "num_images"))
    before = F.aggregate(F.slice("_c", F.lit(1), F.col("seg")), F.lit(0), lambda a, n: a + n)
    return rows.withColumn("image_refs", F.slice("image_refs", before + 1, F.col("num_images"))).drop("_c")


def axes(ids, grids, start: int, image: int, merge: int = 2) -> np.ndarray:
    """3 x n positions of one sequence: text moves all axes together, image tokens take their place in the grid.

    grids: (t, h, w) for each image, in patches before merging.  Text behind an image goes on from the largest position.
    """
    x = np.asarray(ids, np.int64)
    out = np.zeros((3, len(x)), np.int64)
    starts = np.flatnonzero(x[:-1] == start) if len(x) else np.zeros(0, np.int64)
    firsts = [b + 1 for b in starts if x[b + 1] == image]
    at = top = 0
    for first, (t, h, w) in zip(firsts, grids, strict=False):
        h, w = h // merge, w // merge
        n = min(t * h * w, len(x) - first)
        out[:, at:first] = top + np.arange(first - at)
        base = top + first - at
        place = np.stack(np.unravel_index(np.arange(t * h * w), (t, h, w)))[:, :n] if t * h * w else np.zeros((3, 0), np.int64)
        out[:, first : first + n] = base + place
        at, top = first + n, base + (int(place.max()) + 1 if place.size else 0)
    out[:, at:] = top + np.arange(len(x) - at)
    return out


def packed_axes(ids, lengths, grids, start: int, image: int, merge: int = 2) -> np.ndarray:
    """``axes`` of each sub-sequence; the images are taken in order, a rest behind the last one counts from 0 like padding."""
    x = np.asarray(ids, np.int64)
    parts, at, used = [], 0, 0
    for n in [*lengths, len(x) - int(np.sum(lengths))]:
        own = x[at : at + n]
        k = int(((own[:-1] == start) & (own[1:] == image)).sum())
        parts.append(axes(own, grids[used : used + k], start, image, merge))
        at, used = at + n, used + k
    return np.concatenate(parts, 1) if parts else np.zeros((3, 0), np.int64)


_RUN = "struct<text: int, top: int, cells: int, base: int, h: int, w: int>"


def _runs(ids: Column, lengths: Column, grids: Column, start: int, image: int, merge: int) -> Column:
    """Stretches of text and of an image's cells behind it, from one pass over the starts of sub-sequences and of images.

    ``top`` is the position of a stretch's first text token, ``base`` that of its first cell.
    """
    total = F.size(ids)
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.least(F.element_at(a, -1) + n, total)))
    begins = F.transform(F.array_append(ends, total), lambda x, i: F.struct(F.get(F.concat(F.array(F.lit(0)), ends), i).alias("at"), F.lit(0).alias("kind"), x.alias("end")))
    sequences = F.slice(begins, F.lit(2), F.size(begins) - 1)
    firsts = F.filter(F.transform(F.arrays_zip(ids.alias("x"), F.slice(ids, F.lit(2), F.greatest(total, F.lit(1))).alias("y")), lambda p, i: F.when((p["x"] == start) & (p["y"] == image), i + 1)), lambda i: i.isNotNull() & ~F.array_contains(ends, i))
    events = F.array_sort(F.concat(sequences, F.transform(firsts, lambda i: F.struct(i.alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("end")))))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"), F.lit(0).alias("end"), F.lit(0).alias("used"), F.array().cast(f"array<{_RUN}>").alias("runs"))
    run = lambda text, top, cells, base, h, w: F.struct(text.alias("text"), top.alias("top"), cells.alias("cells"), base.alias("base"), h.alias("h"), w.alias("w"))
    none = F.lit(0)

    def step(a, e):
        text = e["at"] - a["at"]
        sequence = F.struct(e["at"].alias("at"), none.alias("top"), e["end"].alias("end"), a["used"].alias("used"), F.array_append(a["runs"], run(text, a["top"], none, none, none, none)).alias("runs"))
        grid = F.get(grids, a["used"])
        h, w = (F.floor(F.get(grid, i) / merge).cast("int") for i in (1, 2))
        n = F.least(F.get(grid, 0) * h * w, a["end"] - e["at"])
        last = n - 1
        most = F.greatest(F.floor(last / (h * w)).cast("int"), F.least(F.floor(last / w).cast("int"), h - 1), F.least(last, w - 1))
        base = a["top"] + text
        pictured = F.struct((e["at"] + n).alias("at"), (base + F.when(n > 0, most + 1).otherwise(0)).alias("top"), a["end"].alias("end"), (a["used"] + 1).alias("used"), F.array_append(a["runs"], run(text, a["top"], n, base, h, w)).alias("runs"))
        return F.when(e["kind"] == 0, sequence).when((a["used"] < F.size(grids)) & (e["at"] >= a["at"]), pictured).otherwise(a)

    return F.aggregate(events, begin, step, lambda a: F.array_append(a["runs"], run(total - a["at"], a["top"], none, none, none, none)))


def _counted(n: Column, value) -> Column:
    """An array of ``value(0)`` to ``value(n - 1)``."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array().cast("array<int>"))


def position_ids(packed: DataFrame, start: int, image: int, to: int | None = None, merge: int = 2) -> DataFrame:
    """Adds ``positions``: four arrays a row - the running position within each sub-sequence, then time, height and width.

    packed: input_ids, sequence_lengths (null: one sequence) and image_grids (arrays of t, h, w).
    Rows are cut to ``to`` tokens, the lengths with them.  The same as ``packed_axes``, by expressions of the JVM.
    """
    lengths = F.col("sequence_lengths") if "sequence_lengths" in packed.columns else F.lit(None).cast("array<int>")
    ids = F.col("input_ids") if to is None else F.slice("input_ids", 1, to)
    rows = packed.withColumn("_ids", F.coalesce(ids, F.array().cast("array<int>")))
    rows = rows.withColumn("_n", F.when(F.size(lengths) > 0, lengths.cast("array<int>")).otherwise(F.array(F.size("_ids"))))
    rows = rows.withColumn("_g", F.coalesce(F.col("image_grids").cast("array<array<int>>"), F.array().cast("array<array<int>>")))
    rows = rows.withColumn("_r", _runs(F.col("_ids"), F.col("_n"), F.col("_g"), start, image, merge))
    cell = (lambda r, k: F.floor(k / (r["h"] * r["w"])), lambda r, k: F.floor(k / r["w"]) % r["h"], lambda r, k: k % r["w"])
    axis = lambda of: F.flatten(F.transform("_r", lambda r: F.concat(_counted(r["text"], lambda k: r["top"] + k), _counted(r["cells"], lambda k: (r["base"] + of(r, k)).cast("int")))))
    ends = F.aggregate("_n", F.array(F.lit(0)), lambda a, n: F.array_append(a, F.least(F.element_at(a, -1) + n, F.size("_ids"))))
    own = F.zip_with(F.array_append(ends, F.size("_ids")), F.concat(F.array(F.lit(0)), ends), lambda b, a: b - a)
    running = F.flatten(F.transform(own, lambda n: _counted(n, lambda k: k.cast("int"))))
    return rows.withColumn("positions", F.array(F.filter(running, lambda x: x.isNotNull()), *[axis(c) for c in cell])).select(*packed.columns, "positions")

"""Writing datasets, their side-cars and statistics."""

from __future__ import annotations

import json

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import snapshots, stores
from weftline.operators import conversations, packing, ranks, stats, tokens
from weftline.scratch import written

MODE_INFO, STATISTICS, BATCHES = "mode_info.json", "dataset_statistics.json", "batch_statistics"


def write_json(spark: SparkSession, path: str, value) -> None:
    stores.write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2))


def save(rows: DataFrame, folder: str, mode: str, model_name: str, is_vl: bool = False, merge: bool = False, tokenizer: tokens.Tokenizer | None = None) -> int:
    """Writes rows by split with the mode's side-car, as the next version, whose number it gives; rows without a split are training rows.

    With ``merge`` the rows are added to those that are there, whose splits all stay; without it
    they take their place.  The side-car also names the tokenizer, if given, by its vocabulary's hash.
    """
    split = F.coalesce("split", F.lit("train")) if "split" in rows.columns else F.lit("train")
    info = {"mode": mode, "model_name": model_name, "is_vl": is_vl} | ({"tokenizer": tokenizer.told()} if tokenizer else {})
    number = snapshots.commit(rows.withColumn("split", split), folder, "split", "append" if merge else "replace", info)
    write_json(rows.sparkSession, f"{folder.rstrip('/')}/{MODE_INFO}", info)
    return number


def save_batches(rows: DataFrame, folder: str, info: dict | None = None) -> int:
    """Writes rows by ``batch_id`` as the next version; batches that are there are replaced, others stay, so a batch can be run again."""
    return snapshots.commit(rows, folder, "batch_id", "partitions", info)


def save_filtered(rows: DataFrame, folder: str, least: int = 0, most: int | None = None, order: list[str] | None = None, batch_size: int | None = None) -> DataFrame:
    """Writes the rows of ``least`` to ``most`` tokens, by batches of ``batch_size`` if given; (before, after, discarded)."""
    if "n_tokens" not in rows.columns:
        rows = rows.withColumn("n_tokens", F.size("input_ids"))
    kept = written(tokens.length_filter(rows, least, most))
    if batch_size:
        save_batches(ranks.batches(kept.drop("batch_id"), batch_size, order or ["row_id"]), folder)
    else:
        snapshots.commit(kept, folder)
    return tokens.discarded(rows, kept)


def statistics(rows: DataFrame, length: str = "n_tokens", by: str = "batch_id") -> tuple[dict, DataFrame]:
    """Totals over all batches, and a row of figures for each."""
    per = written(stats.batch_stats(rows, length, by))
    total = stats.rollup(per).first()
    return {"total_batches": total["batches"], "total_samples": total["n"], "total_tokens": total["total"], "weighted_mean_length": total["weighted_mean"], "global_min_length": total["least"], "global_max_length": total["most"]}, per


def save_statistics(rows: DataFrame, folder: str, **columns) -> dict:
    """Writes the totals as one JSON file and the batches' figures beside it as JSON lines; gives the totals."""
    out, per = statistics(rows, **columns)
    per.write.mode("overwrite").json(f"{folder.rstrip('/')}/{BATCHES}")
    write_json(rows.sparkSession, f"{folder.rstrip('/')}/{STATISTICS}", out | {"batches": BATCHES})
    return out


def save_result(spark: SparkSession, frames: dict[str, DataFrame], path: str) -> None:
    """Summaries of an evaluation as one JSON object, each a list of rows; they are small by their nature."""
    write_json(spark, path, {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in frames.items()})


def save_each(rows: DataFrame, folder: str, name: str = "stem", text: str = "raw", suffix: str = ".json") -> int:
    """One file a row in a folder; rows without text are left out. The number of files.

    A file appears when it is whole, so that a task may be lost or run twice.
    """
    at = stores.qualified(rows.sparkSession, folder).rstrip("/")

    def run(batches):
        for part in batches:
            for stem, value in zip(part[name], part[text], strict=True):
                stores.upload(f"{at}/{stem}{suffix}", value.encode())
            yield pd.DataFrame({"n": [len(part)]})

    return rows.where(F.col(text).isNotNull()).select(name, text).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def save_arrow(rows: DataFrame, folder: str) -> int:
    """Writes rows as Arrow IPC files, one a task that has rows, each of which appears when it is whole; the number of rows."""
    import pyarrow as pa

    at = stores.qualified(rows.sparkSession, folder).rstrip("/")

    def run(batches):
        file = writer = None
        n = 0
        for batch in batches:
            if writer is None:
                file = stores.Upload(f"{at}/part-{TaskContext.get().partitionId():06d}.arrow")
                writer = pa.ipc.new_file(pa.PythonFile(file, "w"), batch.schema)
            writer.write_batch(batch)
            n += batch.num_rows
        if writer:
            writer.close()
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def save_texts(rows: DataFrame, folder: str, text: str = "text") -> None:
    """Decoded rows as text files, a line a row; line breaks within a row are written as \\n."""
    rows.select(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit("\\n")).alias("value")).write.mode("overwrite").text(folder)


def prepare(scenes: DataFrame, mode: str, folder: str, max_length: int, tokenizer=None, pack: bool = False, batch_size: int | None = None, test_share: float = 0.0, seed: int = 42, merge: bool = False, model_name: str = "") -> DataFrame:
    """The build from paired scenes to a saved dataset: conversations, tokens, packing, split and sinks; gives the discard counts.

    With ``batch_size`` scenes are numbered in batches by stem, packed within each and written by
    batch; else the whole corpus is one batch for packing and is written by split.
    """
    tokenizer = tokenizer or tokens.load_tokenizer()
    built = ranks.ranked(conversations.build(scenes, mode), (), ["stem"], "row_id")
    size = batch_size or 2**62
    built = built.withColumn("batch_id", F.floor(F.col("row_id") / size).cast("long"))
    own = written(tokens.tokenize_mode(built.select("batch_id", "row_id", "stem", "messages", *[c for c in ("num_images", "image_token_counts", "image_refs") if c in built.columns]), mode, max_length, tokenizer))
    counts = tokens.discarded(built, own)
    vision = mode == "panorama" or mode in conversations.MULTI_VIEW
    if batch_size:
        info = {"mode": mode, "model_name": model_name, "is_vl": vision, "tokenizer": tokenizer.told()}
        save_batches(packing.packed_if(own, pack, max_length), folder, info)
        write_json(scenes.sparkSession, f"{folder.rstrip('/')}/{MODE_INFO}", info)
        return counts
    rows = packing.packed_if(own, pack, max_length).drop("batch_id")
    if test_share:
        rows = ranks.split(rows, "bin_id" if pack else "row_id", test_share, seed)
    save(rows, folder, mode, model_name, vision, merge, tokenizer)
    return counts

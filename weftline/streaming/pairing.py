"""Pairing as files arrive: scenes, captions and images that come apart, in any order (S2-S7, S9, J1-J4 over streams).

Each stem keeps what has come of it in state.  A scene and its caption, its panorama or its front
view are given out as soon as both are there.  Sets of views may grow, so they are given out when no
file of the stem has come for ``wait`` of event time (the files' own times): the views are then those that
the batch form draws from the same files.  What has no partner by then is given out as unpaired, with
what it lacks, and its state is dropped; a file that comes later begins anew.  A micro-batch that is run
again starts from the same state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftline.sinks.datasets import save_batches
from weftline.sources.files import LAYOUTS, VIEWS, stem_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PART = "stem string, kind string, at timestamp, path string, raw string"
PAIR = "stem string, status string, lacks string, path string, raw string, caption string, image_path string, image_paths array<string>"
SETS = ("multi_view", "multi_view2")


def _hash(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def views_of(stem: str, paths: list[str], least: int, most: int, seed: int) -> list[str]:
    """The views that ``files.view_sets`` draws."""
    top = min(len(paths), most)
    n = int(_hash(f"{stem}-{seed}")[:8], 16) % (top - least + 1) + least
    return sorted(paths, key=lambda p: (_hash(f"{p}-{seed}"), p))[:n]


class Pairing(StatefulProcessor):
    """The state of a stem: its scene, its caption, its images, and when it was last heard of."""

    def __init__(self, mode: str, views: tuple[int, int], seed: int, wait_ms: int):
        self.mode, self.views, self.seed, self.wait_ms = mode, views, seed, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scene = handle.getValueState("scene", "path string, raw string")
        self.caption = handle.getValueState("caption", "text string")
        self.images = handle.getMapState("images", "path string", "seen boolean")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        heard = 0
        for r in rows:
            heard = max(heard, int(r["at"].timestamp() * 1000))
            if r["kind"] == "scene":
                if not self.scene.exists() or r["path"] <= self.scene.get()[0]:
                    self.scene.update((r["path"], r["raw"]))
            elif r["kind"] == "caption":
                self.caption.update((r["raw"].strip(),))
            else:
                self.images.updateValue((r["path"],), (True,))
        if self.mode not in SETS and not self._lacks():
            yield self._pair(key[0])
            self._forget()
            return
        due = max(heard, self.due.get()[0] - self.wait_ms if self.due.exists() else 0) + self.wait_ms
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((due,))
        self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        lacks = self._lacks()
        yield self._pair(key[0]) if not lacks else self._row(key[0], "unpaired", lacks)
        self._forget()

    def _paths(self) -> list[str]:
        return sorted(k[0] for k in self.images.keys())

    def _lacks(self) -> str:
        """What the mode still needs, by name."""
        out = [] if self.scene.exists() else ["scene"]
        if self.mode == "caption" and not self.caption.exists():
            out.append("caption")
        need = self.views[0] if self.mode in SETS else int(self.mode in LAYOUTS)
        if need and len(self._paths()) < need:
            out.append("images")
        return ",".join(out)

    def _pair(self, stem: str) -> Row:
        paths = self._paths()
        if self.mode in SETS:
            return self._row(stem, "paired", image_paths=views_of(stem, paths, *self.views, self.seed))
        if self.mode == "multi_view3":
            return self._row(stem, "paired", image_paths=paths[:1])
        return self._row(stem, "paired", image_path=paths[0] if paths else None)

    def _row(self, stem: str, status: str, lacks: str | None = None, image_path: str | None = None, image_paths: list[str] | None = None) -> Row:
        path, raw = self.scene.get() if self.scene.exists() else (None, None)
        caption = self.caption.get()[0] if self.caption.exists() else None
        return Row(stem=stem, status=status, lacks=lacks, path=path, raw=raw, caption=caption, image_path=image_path, image_paths=image_paths)

    def _forget(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        for state in (self.scene, self.caption, self.images, self.due):
            state.clear()

    def close(self) -> None:
        pass


def arrivals(spark: SparkSession, mode: str, json_dir: str, caption_dir: str | None = None, image_dir: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """A stream of (stem, kind, at, path, raw): the files of a mode as they come; images without their contents."""

    def texts(folder: str, pattern: str, kind: str) -> DataFrame:
        rows = spark.readStream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).text(folder, wholetext=True)
        path = F.col("_metadata.file_path")
        return rows.select(stem_of(path).alias("stem"), F.lit(kind).alias("kind"), F.col("_metadata.file_modification_time").alias("at"), path.alias("path"), F.col("value").alias("raw"))

    out = texts(json_dir, "*.json", "scene")
    out = out.where(F.get_json_object("raw", "$").isNotNull())
    if mode == "caption":
        out = out.unionByName(texts(caption_dir, "*.txt", "caption"))
    if mode in LAYOUTS:
        schema = "path string not null, modificationTime timestamp not null, length long not null, content binary"
        rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(image_dir)
        images = rows.select(F.regexp_extract("path", LAYOUTS[mode], 1).alias("stem"), F.lit("image").alias("kind"), F.col("modificationTime").alias("at"), "path", F.lit(None).cast("string").alias("raw")).where(F.length("stem") > 0)
        out = out.unionByName(images)
    return out


def paired(parts: DataFrame, mode: str, views: tuple[int, int] = VIEWS, seed: int = 0, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The PAIR rows of a stream of PART rows."""
    spark = parts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # what such state is kept in
    wait_ms = spark.sql(f"SELECT CAST(1000 * (unix_seconds(timestamp_seconds(0) + INTERVAL {wait}) - unix_seconds(timestamp_seconds(0))) AS LONG)").first()[0]
    own = parts.withWatermark("at", late).groupBy("stem")
    return own.transformWithState(Pairing(mode, views, seed, wait_ms), PAIR, "Append", "EventTime")


def pair_files(spark: SparkSession, out: str, checkpoint: str, mode: str, json_dir: str, caption_dir: str | None = None, image_dir: str | None = None, once: bool = True, per_trigger: int = 1000, **options) -> StreamingQuery:
    """Adds pairs, and what stays without a partner, to a versioned dataset as they are known; micro-batches replace their own rows."""

    def write(rows: DataFrame, number: int) -> None:
        save_batches(rows.withColumn("batch_id", F.lit(number).cast("long")), out)

    rows = paired(arrivals(spark, mode, json_dir, caption_dir, image_dir, per_trigger), mode, **options)
    stream = rows.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()

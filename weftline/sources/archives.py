"""Image archives: tar shards, their indexes, and access by reference.

A reference is ``shard::member``.  Shards are written by Spark's own text writer, whose lines are
the bytes between the ends of the members' headers, so that any file system that Spark knows can
hold them and its commit protocol decides whose output counts.  The index of a shard is a table
(shard, member, offset, size), kept as Parquet beside the shards.  Tasks read members by range in
the stores that they reach (``weftline.stores``); elsewhere Spark reads whole shards and cuts them.
"""

from __future__ import annotations

import io
import json
import re
import tarfile
import uuid
from bisect import bisect_right
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline import stores
from weftline.operators.ranks import ranked
from weftline.scratch import hadoop_file, written

#: Fixed names: the side-car of an archive root, and the pattern of its shards.
INFO = "image_archives_info.json"
SHARD = "images_shard_{:04d}.tar"
INDEX = "_index"
#: Groups of shards that tasks write, at most: so many bounds are sent to all tasks.
GROUPS = 10_000
MEMBERS = "shard string, member string, offset long, size long"


def write_info(spark: SparkSession, folder: str, base_key: str, archives: str, format: str) -> None:
    stores.make_folder(spark, folder)
    stores.write_text(spark, f"{folder.rstrip('/')}/{INFO}", json.dumps({"base_key": base_key, "archives_relpath": archives, "format": format}))


def read_info(spark: SparkSession, folder: str) -> dict | None:
    """The side-car of a dataset folder, or None."""
    text = stores.read_text(spark, f"{folder.rstrip('/')}/{INFO}")
    return None if text is None else json.loads(text)


def find_info(spark: SparkSession, folder: str, levels: int = 3) -> str | None:
    """The nearest folder with a side-car: this one or up to ``levels`` above it."""
    at, files = hadoop_file(spark, stores.qualified(spark, folder))
    for _ in range(levels + 1):
        if at is None:
            return None
        if stores.exists(spark, f"{str(at.toString()).rstrip('/')}/{INFO}"):
            return str(at.toString())
        at = at.getParent()
    return None


def fresh_root(spark: SparkSession, root: str, merge: bool = False) -> str:
    """The root of archives, emptied unless ``merge``."""
    if not merge:
        stores.delete(spark, root)
    stores.make_folder(spark, root)
    return root


def parts(ref: Column) -> tuple[Column, Column]:
    """Shard and member of a reference."""
    return F.substring_index(ref, "::", 1), F.regexp_replace(ref, "^.*?::", "")


@F.pandas_udf(T.StructType([*(T.StructField(c, T.BinaryType()) for c in ("more", "head", "time", "rest")), T.StructField("total", T.IntegerType())]))
def _template(member: pd.Series) -> pd.DataFrame:
    """The header of an empty file: what stands before it for long names, its parts around size and checksum, and the sum of their bytes."""
    out = []
    for name in member:
        data = tarfile.TarInfo(name).tobuf(tarfile.PAX_FORMAT)
        own = data[-512:]
        held = own[:124], own[136:148], own[156:]
        out.append((data[:-512], *held, sum(map(sum, held))))
    return pd.DataFrame(out, columns=["more", "head", "time", "rest", "total"])


def _header(t: str, size: Column) -> Column:
    """All bytes in front of a member's content."""
    octal = F.lpad(F.conv(size.cast("string"), 10, 8), 11, "0")
    digits = F.aggregate(F.split(octal, ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.ascii(c)))
    check = F.lpad(F.conv((F.col(f"{t}.total") + digits + 8 * 32).cast("string"), 10, 8), 6, "0")
    end = lambda text, after: F.concat(text.cast("binary"), F.lit(after))
    return F.concat(F.col(f"{t}.more"), F.col(f"{t}.head"), end(octal, bytearray(1)), F.col(f"{t}.time"), end(check, bytearray(b"\0 ")), F.col(f"{t}.rest"))


def _zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def _member(n: Column, format: str) -> Column:
    return F.format_string(f"%s_%08d.{format}", F.coalesce("stem", F.lit("")), n)


def write_archives(images: DataFrame, root: str, shard_size: int = 1000, format: str = "png", order: tuple[str, ...] = ("stem", "path")) -> DataFrame:
    """Writes rows (stem, path, image) as shards; gives (path, ref, shard, member, offset, size), ref null where image is.

    Members are named by stem and running number; a row that comes again, with the same names, is
    written once.  Shards are numbered by the images' order and behind those that are there.
    Only names are ranked; an image is shuffled once, to the task that writes its shard.  ``images``
    is computed twice (once to see which images there are): write it out first if that is dear.
    """
    spark = images.sparkSession
    root = stores.qualified(spark, root).rstrip("/")
    first = 1 + max((int(m[1]) for n in stores.names(spark, root) if (m := re.fullmatch(r"images_shard_(\d+)\.tar", n))), default=-1)
    columns = list(dict.fromkeys([*order, "stem", "path"]))
    there = images.where(F.col("image").isNotNull()).select(*columns, "image")
    number = lambda n: (F.floor(n / shard_size) + first).cast("int")
    light = written(ranked(there.select(*columns).distinct(), (), columns, "n")).withColumn("shard", number(F.col("n")))
    shards = -(-light.count() // shard_size)
    step = shard_size * max(1, -(-shards // GROUPS))
    bounds = [tuple((x is not None, x) for x in r) for r in light.where(F.col("n") % step == 0).orderBy("n").select(*columns).collect()]
    if not bounds:
        return images.select("path").distinct().select("path", *[F.lit(None).cast(k).alias(c) for c, k in (("ref", "string"), ("shard", "string"), ("member", "string"), ("offset", "long"), ("size", "long"))])

    @F.arrow_udf("int")
    def group(*own):
        return pa.array([bisect_right(bounds, tuple((x is not None, x) for x in row)) - 1 for row in zip(*(c.to_pylist() for c in own), strict=True)], pa.int32())

    own = Window.partitionBy("_g").orderBy(*columns)
    rows = there.withColumn("_g", group(*columns)).repartition(len(bounds), "_g").dropDuplicates(["_g", *columns])
    rows = rows.withColumn("n", F.row_number().over(own) - 1 + F.col("_g") * F.lit(step).cast("long")).withColumn("shard", number(F.col("n")))
    size = F.octet_length("image")
    rows = rows.withColumn("_t", _template(_member(F.col("n"), format))).withColumn("_h", _header("_t", size))
    after = F.lead(F.when(F.col("n") % shard_size != 0, F.col("_h"))).over(own)  # the header behind, within the shard
    tail = F.coalesce(F.substring(after, F.lit(1), F.length(after) - 1), _zeros(F.lit(1023)))
    lead = F.when(F.col("n") % shard_size == 0, F.col("_h")).otherwise(F.lit(bytearray()))
    rows = rows.select("n", F.concat(lead, F.col("image"), _zeros(F.pmod(-size, F.lit(512))), tail).cast("string").alias("value"), "shard")
    staging = f"{root}/_staging-{uuid.uuid4().hex}"
    rows.sortWithinPartitions("shard", "n").select("value", "shard").write.partitionBy("shard").option("lineSep", "\0").option("compression", "none").text(staging)
    for folder in stores.names(spark, staging):  # a name a shard
        if folder.startswith("shard="):
            (file,) = [x for x in stores.names(spark, f"{staging}/{folder}") if x.startswith("part-")]
            stores.rename(spark, f"{staging}/{folder}/{file}", f"{root}/{SHARD.format(int(folder[6:]))}")
    stores.delete(spark, staging)
    known = written(index(spark, root))
    known.write.mode("append").parquet(f"{root}/{INDEX}")
    name = light.select("path", F.format_string("images_shard_%04d.tar", "shard").alias("shard"), _member(F.col("n"), format).alias("member"))
    done = name.join(known, ["shard", "member"]).select("path", F.concat_ws("::", "shard", "member").alias("ref"), "shard", "member", "offset", "size")
    return images.select("path").distinct().join(done, "path", "left")


def _entries(file, shard: str):
    with tarfile.open(fileobj=file) as tar:
        for m in tar:
            if m.isfile():
                yield shard, m.name, m.offset_data, m.size


@F.udtf(returnType=MEMBERS)
class Members:
    """The files within a tar shard, by its headers alone."""

    def eval(self, path: str):
        with stores.input_file(path) as file:
            yield from _entries(file, path.rsplit("/", 1)[-1])


def _shards(spark: SparkSession, folders: list[str], recursive: bool = False) -> DataFrame:
    """(path, content) of the shards in folders; what is not asked for is not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").option("recursiveFileLookup", str(recursive).lower()).load(folders)
    return rows.select("path", "content")


@contextmanager
def _single_rows(spark: SparkSession):
    """Arrow batches of one row: whole shards go through them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, held)


def index(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """(shard, member, offset, size) of the shards in a folder that have no rows in its index yet."""
    root = stores.qualified(spark, root).rstrip("/")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    tars = _shards(spark, [root], recursive)
    if stores.exists(spark, f"{root}/{INDEX}"):
        known = known_index(spark, root).select(F.col("shard").alias("_known")).distinct()
        tars = tars.join(known, name == F.col("_known"), "left_anti")
    if stores.reachable(root):
        tars.select("path").createOrReplaceTempView("__weft_tars")
        spark.udtf.register("__weft_members", Members)
        return spark.sql("SELECT m.* FROM __weft_tars t, LATERAL __weft_members(t.path) m")

    def run(batches):
        for batch in batches:
            rows = [x for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in _entries(io.BytesIO(content), path.rsplit("/", 1)[-1])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [c.split()[0] for c in MEMBERS.split(", ")])

    with _single_rows(spark):
        return written(tars.select("path", "content").mapInArrow(run, MEMBERS))


def known_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{INDEX}")


def create_index(spark: SparkSession, root: str, recursive: bool = False) -> int:
    """Adds what is missing to the index; the number of members added."""
    new = written(index(spark, root, recursive))
    n = new.count()
    if n:
        new.write.mode("append").parquet(f"{root.rstrip('/')}/{INDEX}")
    return n


def roots(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(base_key, root): the archive roots of dataset folders; those without a side-car are left out."""
    rows = []
    for folder in folders:
        own = find_info(spark, folder)
        if own:
            info = read_info(spark, own)
            rows.append((info["base_key"], f"{own.rstrip('/')}/{info['archives_relpath']}"))
    return spark.createDataFrame(rows, "base_key string, root string")


def with_root(rows: DataFrame, known: DataFrame, base: str = "image_base") -> DataFrame:
    """Adds ``root`` by base key; an unknown key fails the job."""
    met = rows.join(F.broadcast(known), F.col(base) == F.col("base_key"), "left").drop("base_key")  # a row a dataset
    lost = F.raise_error(F.concat(F.lit("unknown image base: "), F.coalesce(base, F.lit("null"))))
    return met.withColumn("root", F.when(F.col("root").isNotNull(), F.col("root")).otherwise(lost))


class _Reader:
    """Open shards of a worker."""

    def __init__(self, most: int = 64):
        self.most, self.held = most, {}

    def file(self, path: str):
        if path not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held))).close()
            self.held[path] = stores.input_file(path)
        return self.held[path]

    def at(self, path: str, offset, size) -> bytes | None:
        try:
            return self.file(path).read_at(int(size), int(offset))
        except OSError:
            return None

    def named(self, path: str, member: str) -> bytes | None:
        try:
            with stores.input_file(path) as file, tarfile.open(fileobj=file) as tar:
                return tar.extractfile(member).read()
        except (OSError, KeyError, AttributeError, tarfile.TarError):
            return None


def load_images(rows: DataFrame, indexed: DataFrame | None = None, ref: str = "image_ref") -> DataFrame:
    """Adds ``content`` to rows with ``root`` and a reference: by seek where the index has the member, else by reading the shard.

    null for a null reference or a member that is not there.  Roots that tasks cannot open
    themselves need an index; see ``cut_images``.
    """
    shard, member = parts(F.col(ref))
    met = rows.withColumns({"_s": shard, "_m": member})
    if indexed is None:
        met = met.withColumns({"_o": F.lit(None).cast("long"), "_n": F.lit(None).cast("long")})
    else:
        own = indexed.select(F.col("shard").alias("_s"), F.col("member").alias("_m"), F.col("offset").alias("_o"), F.col("size").alias("_n")).dropDuplicates(["_s", "_m"])
        met = met.join(own, ["_s", "_m"], "left")

    @F.pandas_udf("binary")
    def run(root: pd.Series, s: pd.Series, m: pd.Series, o: pd.Series, n: pd.Series) -> pd.Series:
        reader, out = _Reader(), []
        for a, b, c, d, e in zip(root, s, m, o, n, strict=True):
            path = None if a is None or b is None else f"{a.rstrip('/')}/{b}"
            out.append(None if path is None else reader.named(path, c) if d != d or d is None else reader.at(path, d, e))
        return pd.Series(out, dtype=object)

    return met.withColumn("content", run("root", "_s", "_m", "_o", "_n")).select(*rows.columns, "content")


def cut_images(rows: DataFrame, indexed: DataFrame, ref: str = "image_ref") -> DataFrame:
    """``load_images`` for roots that only Spark's readers open: shards are read whole, each once, and cut in the JVM by the index."""
    spark = rows.sparkSession
    shard, member = parts(F.col(ref))
    own = indexed.select(F.col("shard").alias("_s"), F.col("member").alias("_m"), F.col("offset").alias("_o"), F.col("size").alias("_n")).dropDuplicates(["_s", "_m"])
    met = rows.withColumns({"_s": shard, "_m": member}).join(own, ["_s", "_m"], "left")
    met = met.withColumn("_p", F.when(F.col("_o").isNotNull(), F.concat_ws("/", F.rtrim("root", F.lit("/")), "_s")))
    folders = [r["root"] for r in rows.select("root").distinct().where("root is not null").collect()]  # a root a dataset
    if not folders:
        return rows.withColumn("content", F.lit(None).cast("binary"))
    known = dict(zip(folders, (stores.qualified(spark, x).rstrip("/") for x in folders), strict=True))
    names = spark.createDataFrame([(f, k) for f, k in known.items()], "_f string, _k string")
    met = met.join(F.broadcast(names), F.col("root") == F.col("_f"), "left").withColumn("_p", F.when(F.col("_p").isNotNull(), F.concat_ws("/", "_k", "_s")))
    files = _shards(spark, list(known.values())).withColumnsRenamed({"path": "_path", "content": "_content"})
    out = met.join(files, F.col("_p") == F.col("_path"), "left")
    return out.select(*rows.columns, F.substring("_content", F.col("_o") + 1, F.col("_n")).alias("content"))


def materialized_name(ref: Column) -> Column:
    """The file name under which a referenced image is laid down: the hash of the reference, with the member's suffix."""
    return F.concat(F.sha2(ref, 256), F.regexp_extract(ref, r"(\.[^./:]+)$", 1))


def materialize(rows: DataFrame, folder: str, ref: str = "image_ref") -> DataFrame:
    """Writes ``content`` to a shared folder, each reference once, and adds ``image_path``; null where there is no content."""
    at = stores.qualified(rows.sparkSession, folder).rstrip("/")

    @F.pandas_udf("string")
    def run(name: pd.Series, content: pd.Series) -> pd.Series:
        out = []
        for n, data in zip(name, content, strict=True):
            path = None if data is None or n is None else f"{at}/{n}"
            if path and not stores.there(path):
                stores.upload(path, data)
            out.append(path and stores.opened(path)[1])
        return pd.Series(out, dtype=object)

    return rows.withColumn("image_path", run(materialized_name(F.col(ref)), "content"))

"""Scans of tokenized and packed data.

A dataset is a versioned folder (``weftline.snapshots``), or a plain Parquet folder, partitioned by
``split`` or by ``batch_id``; side-cars lie beside it.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from weftline import snapshots, stores
from weftline.operators.tokens import parse_batches


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a dataset, split and batch_id as columns where it has them; of the latest version, if it has versions."""
    if snapshots.is_versioned(spark, folder):
        return snapshots.read(spark, folder)
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)


def batch_ids(spark: SparkSession, folder: str) -> list[int]:
    """The batches of a dataset in order, from its manifest or its folder names alone."""
    if not stores.exists(spark, folder):
        raise FileNotFoundError(f"no folder {folder}")
    if snapshots.is_versioned(spark, folder):
        return sorted(map(int, snapshots.values(spark, folder)))
    return sorted(int(n.partition("=")[2]) for n in stores.names(spark, folder) if n.startswith("batch_id="))


def training(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """The training rows, and the test rows if there is such a split; a dataset without splits is all for training."""
    rows = read(spark, folder)
    if "split" not in rows.columns:
        return rows, None
    test = rows.where(F.col("split") == "test").drop("split")
    return rows.where(F.col("split") == "train").drop("split"), None if test.isEmpty() else test


def union(parts: list[DataFrame]) -> DataFrame:
    """All rows of several datasets; columns that one lacks are null there."""
    if not parts:
        raise ValueError("no datasets to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def from_batches(spark: SparkSession, folders: list[str], spec=None) -> DataFrame:
    """The union of several datasets, of each only the batches of ``spec`` (pruned by folder); unknown batches are an error."""
    wanted = None if spec is None else parse_batches(spec)
    parts = []
    for folder in folders:
        rows = read(spark, folder)
        if wanted is not None:
            missing = sorted(set(wanted) - set(batch_ids(spark, folder)))
            if missing:
                raise ValueError(f"no batches {missing} in {folder}")
            rows = rows.where(F.col("batch_id").isin(wanted))
        parts.append(rows)
    return union(parts)


def merged(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """Old and new rows by split; a split that the new rows lack stays."""
    return new if old is None else union([old, new])


def side_car(spark: SparkSession, folder: str, name: str) -> dict | None:
    """A JSON file beside the data, or None."""
    text = stores.read_text(spark, f"{folder.rstrip('/')}/{name}")
    return None if text is None else json.loads(text)


#: Files beyond this size are read by several tasks, each of about so many bytes.
ARROW_SPLIT = 64 << 20


class ArrowPart(InputPartition):
    """Record batches first to last, exclusive, of a file; all of them without a last."""

    def __init__(self, path: str, first: int = 0, last: int | None = None):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


def arrow_paths(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the Arrow files in a folder, or of one file, in stores that tasks open."""
    store, at = stores.opened(path)
    own = store.get_file_info(at)
    if own.type == fs.FileType.File:
        return [(path, own.size)]
    top = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = [] if own.type == fs.FileType.NotFound else [x for x in store.get_file_info(fs.FileSelector(at)) if x.is_file and x.path.endswith(".arrow")]
    if not found:
        raise FileNotFoundError(f"no Arrow files in {path}")
    return [(top + x.path, x.size) for x in sorted(found, key=lambda x: x.path)]


def _opened(path: str, columns: list[str] | None = None):
    """A file's record batches by number, or a stream of them where the file has no footer."""
    file = stores.input_file(path)
    try:
        fields = None
        if columns is not None:
            schema = pa.ipc.open_file(file).schema
            fields = sorted(schema.get_field_index(c) for c in columns)
        return pa.ipc.open_file(file, options=pa.ipc.IpcReadOptions(included_fields=fields or []))
    except pa.ArrowInvalid:
        file.seek(0)
        return pa.ipc.open_stream(file)


def _condition(column: str, op: str, value=None) -> pc.Expression:
    """A filter as an expression of Arrow's that keeps the rows that Spark would: nulls go, NaN is greater than all numbers."""
    at = pc.field(column)
    if op in ("is null", "is not null"):
        return at.is_null() if op == "is null" else at.is_valid()
    if op in ("in", "not in"):
        return (at.isin(value) if op == "in" else ~at.isin(value)) & at.is_valid()
    if op == "startswith":
        return pc.starts_with(at, value)
    if op in (">", ">=") and isinstance(value, (int, float)) and not isinstance(value, bool):
        number = at.cast(pa.float64(), safe=False)
        return (at > value if op == ">" else at >= value) | pc.is_nan(number)
    known = {"=": at.__eq__, "!=": at.__ne__, "<": at.__lt__, "<=": at.__le__, ">": at.__gt__, ">=": at.__ge__}
    if op not in known:
        raise ValueError(f"unknown comparison {op!r}; known: {', '.join(known)}, in, not in, is null, is not null, startswith")
    return known[op](value)


class ArrowReader(DataSourceReader):
    """A task a file, or a part of its record batches; filters are applied to batches before they leave Python."""

    def __init__(self, path: str, schema: StructType, pruned: bool, filters: list[list]):
        self.path, self.schema, self.pruned, self.filters = path, schema, pruned, filters

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in arrow_paths(self.path):
            own = _opened(path) if size > ARROW_SPLIT else None
            n = getattr(own, "num_record_batches", 0)
            step = max(1, n * ARROW_SPLIT // size) if n else 1
            out += [ArrowPart(path, i, min(i + step, n)) for i in range(0, n, step)] or [ArrowPart(path)]
        return out

    def read(self, partition: ArrowPart) -> Iterator:
        more = [f[0] for f in self.filters if f[0] not in self.schema.names]
        own = _opened(partition.path, [*self.schema.names, *dict.fromkeys(more)] if self.pruned else None)
        if hasattr(own, "num_record_batches"):
            batches = (own.get_batch(i) for i in range(partition.first, own.num_record_batches if partition.last is None else partition.last))
        else:
            batches = iter(own)
        wanted = reduce(operator.and_, (_condition(*f) for f in self.filters)) if self.filters else None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            yield from (rows if wanted is None else rows.filter(wanted)).select(self.schema.names).to_batches()


class ArrowSource(DataSource):
    """``spark.read.format("weft_arrow").option("columns", "a,b").load(folder)``: Arrow IPC files or streams in stores that tasks open."""

    @classmethod
    def name(cls) -> str:
        return "weft_arrow"

    def _columns(self) -> list[str] | None:
        own = self.options.get("columns")
        return None if own is None else [c.strip() for c in own.split(",")]

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        whole = from_arrow_schema(_opened(arrow_paths(self.options["path"])[0][0]).schema)
        names = self._columns()
        if unknown := [c for c in names or [] if c not in whole.names]:
            raise ValueError(f"no columns {unknown}; known: {whole.names}")
        return whole if names is None else StructType([whole[c] for c in names])

    def reader(self, schema) -> DataSourceReader:
        return ArrowReader(self.options["path"], schema, self._columns() is not None, json.loads(self.options.get("filters", "[]")))


def arrow_files(spark: SparkSession, path: str, columns: list[str] | None = None, filters: list[tuple] = ()) -> DataFrame:
    """The rows of Arrow IPC files; of ``columns`` only, the others' bytes stay unread, and those that meet all ``filters``.

    filters: (column, comparison, value), as (``id``, ``>``, 5), (``text``, ``in``, [``a``, ``b``]) or (``text``, ``is null``).  They are
    given here, as Spark 4.1 keeps what a Python source has pushed for later queries of the same rows.
    """
    spark.dataSource.register(ArrowSource)
    for f in filters:
        _condition(*f)
    rows = spark.read.format("weft_arrow").option("filters", json.dumps([list(f) for f in filters]))
    return (rows if columns is None else rows.option("columns", ",".join(columns))).load(stores.qualified(spark, path))

"""Tables that cut the lineage: written to the folder that all executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder named by spark.checkpoint.dir, deleted when the session's JVM ends.

    Where that is unset, a local session makes itself a temporary folder; on a cluster, whose
    executors would each write to their own disk, it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/weftline-{uuid.uuid4().hex}"
    at, files = hadoop_file(spark, path)
    files.deleteOnExit(at)
    for scope_ in _scopes[-1:]:
        scope_.append(path)
    return path


def hadoop_file(spark: SparkSession, path: str):
    """The JVM's path object and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the scratch tables made within, so that a long session does not gather them."""
    _scopes.append(made := [])
    try:
        yield made
    finally:
        _scopes.pop()
        for path in made:
            at, files = hadoop_file(spark, path)
            files.delete(at, True)


def result(make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The rows of ``make()`` as one written table; what was written on the way is deleted."""
    with scope(spark) as made:
        out, path = _written(make())
        made.remove(path)
    for outer in _scopes[-1:]:
        outer.append(path)
    return out


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back."""
    return _written(df)[0]

"""Session helpers: Arrow batch sizes, id remainders, and the shared scratch tables under their names here."""

from __future__ import annotations

import os
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.scratch import result, scope, scratch, written

__all__ = ["arrow_batches", "remainder", "remainder_py", "result", "scope", "scratch", "table", "written"]


def arrow_batches(spark: SparkSession, rows: int = 500) -> None:
    """Small Arrow batches: texts are long, and a batch must fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    own = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if own not in held.split(os.pathsep):  # so that local Python workers find this package
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (own, held)))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(by)


def remainder_py(doc_id: int, by: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % by


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

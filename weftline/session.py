"""Session factory with the settings the engine is designed around."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: Rows of this library hold whole texts, token arrays and scenes: so many go into an Arrow batch, and are
#: read from Parquet at once, by a reader that keeps room for all their array elements.
BATCH, READ = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
MOST_ROWS = {BATCH: 1000, READ: 256}


def session(name: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key: str(rows) for key, rows in MOST_ROWS.items()},
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local session find this package; on a cluster it comes with the job (--py-files).

    Batches of a session made elsewhere get no more rows than those of ``session``.
    """
    for key, rows in MOST_ROWS.items():
        if not 0 < int(spark.conf.get(key)) <= rows:
            spark.conf.set(key, str(rows))
    own = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    held = env.get("PYTHONPATH", "")
    if own not in held.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (own, held)))
    return spark

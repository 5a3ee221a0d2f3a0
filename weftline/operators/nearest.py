"""Exact nearest neighbours within classes (the pairwise minimum of J13), tile against tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile, and of a class that are compared at a time.
TILE, AT_ONCE = 2048, 64


def nearest(rows: DataFrame, key: str, vector: str, by: str, tile: int = TILE) -> DataFrame:
    """(key, nearest, distance): for each row the closest other row of its class; ties to the smaller key.

    A class is dealt into tiles; every pair of tiles is compared by itself, with two tiles in
    memory, and gives one row for each of its queries, so pairs are never listed.  Null or empty
    vectors take no part; vectors of different lengths are of different classes; a row that is
    alone in its class has no result.  Rows that repeat a key do not match each other.
    """
    own = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(by).alias("c")).where(F.size("v") > 0).withColumn("n", F.size("v"))
    tiles = own.groupBy("c", "n").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    own = own.alias("o").join(tiles.alias("t"), F.col("o.c").eqNullSafe(F.col("t.c")) & (F.col("o.n") == F.col("t.n"))).select("o.*", "tiles")
    own = own.withColumn("t", F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    asks = own.select("c", "n", F.col("t").alias("q"), F.col("other").alias("a"), "k", "v", F.lit(True).alias("asks"))
    both = asks.unionByName(own.select("c", "n", F.col("other").alias("q"), F.col("t").alias("a"), "k", "v", F.lit(False).alias("asks")))

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        keys, ask = part["k"].to_numpy(), part["asks"].to_numpy()
        x = part["v"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        order = np.argsort(keys[~ask], kind="stable")
        held, other = x[~ask][order], keys[~ask][order]
        out = []
        for at in range(0, int(ask.sum()), AT_ONCE):
            mine = keys[ask][at : at + AT_ONCE]
            d = ((x[ask][at : at + AT_ONCE, None] - held[None]) ** 2).sum(-1)
            d[mine[:, None] == other[None]] = np.inf
            j = d.argmin(1)
            far = d[np.arange(len(j)), j]
            out.append((mine[far < np.inf], other[j][far < np.inf], far[far < np.inf]))
        k, best, far = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (keys[:0], keys[:0], np.zeros(0))
        return pa.table({"k": k, "best": best, "d": far})

    kind = rows.schema[key].dataType.simpleString()
    found = both.groupBy("c", "n", "q", "a").applyInArrow(run, f"k {kind}, best {kind}, d double")
    one = found.groupBy("k").agg(F.min(F.struct("d", "best")).alias("x"))
    return one.select(F.col("k").alias(key), F.col("x.best").alias("nearest"), F.sqrt("x.d").alias("distance"))

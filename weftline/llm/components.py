"""Connected components by alternating large and small stars, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, comp): for each node that has an edge, the smallest node of its component.

    Each round points nodes at the smallest neighbour and is written to the shared folder; the
    rounds needed grow with the logarithm of the longest path.  Minima are made map-side first
    and written out before they are joined back: both sides of the join are then bare shuffles,
    which AQE splits, so a hub costs no single task its whole neighbourhood.  Rows with a null
    end, loops and repeated edges do not count; without edges the result is empty.
    """
    now = written(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct())
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small)
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))

"""Length statistics, packed lengths, histograms, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranks import index_quantiles, percentiles

#: Lower bounds of the half-open length bins; the last one is open.
BOUNDS = (0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768)


def batch_stats(rows: DataFrame, length: str, by: str, shares: Sequence[int] = (25, 50, 75, 90, 95, 99)) -> DataFrame:
    """A row for each ``by``: count, extremes, mean, median, population deviation, sum and interpolated percentiles."""
    x = F.col(length)
    sums = rows.groupBy(by).agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.sum(x).alias("total"))
    exact = percentiles(rows, length, {"median": 0.5} | {f"p{p}": p / 100 for p in shares}, [by])
    met = sums.alias("s").join(exact.alias("e"), F.col(f"s.{by}").eqNullSafe(F.col(f"e.{by}")), "left")
    return met.select(f"s.{by}", "n", "least", "most", "mean", "median", "std", "total", *[f"p{p}" for p in shares])


def rollup(per_batch: DataFrame) -> DataFrame:
    """One row over ``batch_stats``: totals, extremes, token-weighted mean, and the sizes of the batches."""
    n = F.col("n")
    return per_batch.agg(F.count("*").alias("batches"), F.sum(n).alias("n"), F.sum("total").alias("total"), F.try_divide(F.sum("total"), F.sum(n)).alias("weighted_mean"), F.min("least").alias("least"), F.max("most").alias("most"), F.min(n).alias("least_batch"), F.max(n).alias("most_batch"), F.avg(n).alias("mean_batch"), F.stddev_pop(n).alias("std_batch"))


def bin_of(length: Column, bounds: Sequence[int] = BOUNDS, upper_closed: bool = False) -> Column:
    """The number of the bin: [low, high), or (low, high] with ``upper_closed``; the last is open, below the first is 0."""
    case = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        case = F.when((length <= bounds[i + 1]) if upper_closed else (length < bounds[i + 1]), F.lit(i)).otherwise(case)
    return F.when(length.isNotNull(), case)


def histogram(rows: DataFrame, length: str, bounds: Sequence[int] = BOUNDS, upper_closed: bool = False) -> DataFrame:
    """(bin, n) of the bins that hold rows."""
    return rows.groupBy(bin_of(F.col(length), bounds, upper_closed).alias("bin")).agg(F.count("*").alias("n"))


def sequences(packed: DataFrame) -> DataFrame:
    """(length): one row a sub-sequence, the whole row where there are no ``sequence_lengths``."""
    if "sequence_lengths" in packed.columns:
        return packed.select(F.explode("sequence_lengths").alias("length"))
    return packed.select(F.size("input_ids").alias("length"))


def packed_stats(packed: DataFrame, shares: Sequence[int] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """One row: packed rows, sequences, tokens, length statistics, sequences a row and their ratio.

    A row without sequences (null or empty) counts as a row of 0.
    """
    per_row = F.greatest(F.size("sequence_lengths"), F.lit(0)) if "sequence_lengths" in packed.columns else F.lit(1)
    rows = packed.select(per_row.alias("k")).agg(F.count("*").alias("packed_rows"), F.avg("k").alias("mean_per_row"), F.min("k").alias("least_per_row"), F.max("k").alias("most_per_row"))
    x = F.col("length")
    own = sequences(packed).agg(F.count(x).alias("sequences"), F.sum(x).alias("tokens"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))
    exact = percentiles(sequences(packed), "length", {"median": 0.5} | {f"p{p}": p / 100 for p in shares})
    return own.crossJoin(exact).crossJoin(rows).withColumn("ratio", F.try_divide("sequences", "packed_rows"))  # one row each


def length_report(rows: DataFrame, length: str, limit: int) -> DataFrame:
    """One row: the index-rule median, P95, P99, extremes, mean and the share that fits ``limit``."""
    x = F.col(length)
    total = rows.agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.try_divide(F.count_if(x <= limit), F.count(x)).alias("fits"))
    return total.crossJoin(index_quantiles(rows, length, {"median": 0.5, "p95": 0.95, "p99": 0.99}))  # one row each


def perplexity(losses: DataFrame, loss: str = "loss", by: Sequence[str] = ()) -> DataFrame:
    """(mean_loss, perplexity): exp of the mean; null without rows."""
    return losses.groupBy(*by).agg(F.count(loss).alias("n"), F.avg(loss).alias("mean_loss"), F.exp(F.avg(loss)).alias("perplexity"))


def running_loss(losses: DataFrame, step: str, loss: str, every: int) -> DataFrame:
    """Mean loss of each tumbling window of ``every`` steps."""
    window = F.floor(F.col(step) / every).cast("long")
    return losses.groupBy(window.alias("window")).agg(F.count(loss).alias("n"), F.avg(loss).alias("loss"))


def ratio_columns(tp: Column, fp: Column, fn: Column, prefix: str = "") -> dict[str, Column]:
    """Precision, recall and F1, 0 where a denominator is 0."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return {f"{prefix}precision": p, f"{prefix}recall": r, f"{prefix}f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}

"""Global numbering and order statistics that no single task has to sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.scratch import written

def ranked(rows: DataFrame, within: Sequence[str], order: Sequence[Column | str], name: str = "rank", size: str | None = None) -> DataFrame:
    """Adds the 0-based position of each row among those of equal ``within`` columns, in ``order``; as ``size`` their number.

    Rows are range-partitioned and sorted, so one group may spread over many tasks; a row's
    position is its place in its partition plus the counts of the partitions before, a table of
    one row for each group and partition.  Nulls sort first and are a group like any other;
    make the order total, or rows that tie are numbered in any order.  All columns are written
    once on the way: rank keys, and join, where rows are heavy.
    """
    keys = [F.col(c) for c in within] + [F.col(c) if isinstance(c, str) else c for c in order]
    held = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__weft_mid", F.monotonically_increasing_id()))
    held = held.withColumn("__weft_pid", F.shiftright("__weft_mid", 33))
    parts = held.groupBy(*within, "__weft_pid").agg(F.min("__weft_mid").alias("__weft_first"), F.count("*").alias("__weft_n"))
    group = Window.partitionBy(*within)
    before = F.sum("__weft_n").over(group.orderBy("__weft_pid").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*within, "__weft_pid", (F.coalesce(before, F.lit(0)) - F.col("__weft_first")).alias("__weft_shift"), F.sum("__weft_n").over(group).alias("__weft_n"))
    parts = written(parts)  # so that its size is known: it is broadcast only if it is small
    same = F.col("h.__weft_pid") == F.col("p.__weft_pid")
    for c in within:
        same = same & F.col(f"h.{c}").eqNullSafe(F.col(f"p.{c}"))
    met = held.alias("h").join(parts.alias("p"), same)
    more = [F.col("p.__weft_n").alias(size)] if size else []
    return met.select(*[F.col(f"h.{c}") for c in rows.columns], (F.col("h.__weft_mid") + F.col("p.__weft_shift")).alias(name), *more)


def cumulated(rows: DataFrame, within: Sequence[str], order: Sequence[str], weight: str, upto: str = "upto", total: str = "total") -> DataFrame:
    """Adds the sum of ``weight`` over the rows of a group up to each one in ``order``, and over the whole group.

    As ``ranked``, over many tasks for one group: sums within a range partition, behind those of the partitions before.
    """
    keys = [F.col(c) for c in (*within, *order)]
    held = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__weft_mid", F.monotonically_increasing_id()))
    held = held.withColumn("__weft_pid", F.shiftright("__weft_mid", 33))
    group = Window.partitionBy(*within)
    before = F.sum("__weft_w").over(group.orderBy("__weft_pid").rowsBetween(Window.unboundedPreceding, -1))
    parts = held.groupBy(*within, "__weft_pid").agg(F.sum(weight).alias("__weft_w"))
    parts = written(parts.select(*within, "__weft_pid", F.coalesce(before, F.lit(0)).alias("__weft_before"), F.sum("__weft_w").over(group).alias(total)))
    own = F.sum(weight).over(Window.partitionBy(*within, "__weft_pid").orderBy("__weft_mid").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("__weft_own", own)
    same = F.col("h.__weft_pid") == F.col("p.__weft_pid")
    for c in within:
        same = same & F.col(f"h.{c}").eqNullSafe(F.col(f"p.{c}"))
    met = held.alias("h").join(parts.alias("p"), same)
    return met.select(*[F.col(f"h.{c}") for c in rows.columns], (F.col("h.__weft_own") + F.col("p.__weft_before")).alias(upto), F.col(f"p.{total}"))


def batches(rows: DataFrame, size: int, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Adds ``batch_id``: every ``size`` rows in order, numbered from 0 (per group, if any)."""
    out = ranked(rows, within, order, "__weft_rank")
    return out.withColumn("batch_id", F.floor(F.col("__weft_rank") / size).cast("long")).drop("__weft_rank")


def positions(rows: DataFrame, order: Sequence[str], start: int, stop: int) -> DataFrame:
    """The rows at the positions from start up to stop, exclusive (offset and limit with a fixed order)."""
    return ranked(rows, (), order, "__weft_rank").where(F.col("__weft_rank").between(start, stop - 1)).drop("__weft_rank")


def split(rows: DataFrame, key: str, test_share: float, seed: int = 42, within: Sequence[str] = ()) -> DataFrame:
    """Adds ``split``: exactly floor(share) of each group is 'test', by a keyed hash order; the same on any layout."""
    out = ranked(rows, within, [drawn(F.col(key), seed)], "__weft_rank", "__weft_n")
    test = F.col("__weft_rank") < F.floor(F.col("__weft_n") * F.lit(test_share))
    return out.withColumn("split", F.when(test, "test").otherwise("train")).drop("__weft_rank", "__weft_n")


def _counted(rows: DataFrame, value: str, within: Sequence[str]) -> DataFrame:
    """The different values of each group with the numbers of rows up to each and in all: few rows for lengths, whatever their number."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count("*").alias("__weft_n"))
    return cumulated(counts, within, [value], "__weft_n", "__weft_upto", "__weft_total")


def _value_at(value: str, position: Column) -> Column:
    return F.min(F.when(F.col("__weft_upto") > position, F.col(value)))


def index_quantiles(rows: DataFrame, value: str, shares: dict[str, float], within: Sequence[str] = ()) -> DataFrame:
    """For each name the value at position floor(n * share) of the sorted values - the index rule, no interpolation."""
    at = [_value_at(value, F.floor(F.col("__weft_total") * p)).alias(name) for name, p in shares.items()]
    return _counted(rows, value, within).groupBy(*within).agg(*at)


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], within: Sequence[str] = ()) -> DataFrame:
    """For each name the value at position (n - 1) * share, interpolated between its neighbours; exact at any number of values."""
    counted = _counted(rows, value, within)
    at = []
    for i, p in enumerate(shares.values()):
        place = (F.col("__weft_total") - 1) * F.lit(float(p))
        at += [_value_at(value, F.floor(place)).alias(f"__weft_a{i}"), _value_at(value, F.ceil(place)).alias(f"__weft_b{i}"), F.max(place - F.floor(place)).alias(f"__weft_s{i}")]
    by = counted.groupBy(*within).agg(*at)
    between = lambda i: F.when(F.col(f"__weft_a{i}") == F.col(f"__weft_b{i}"), F.col(f"__weft_a{i}").cast("double")).otherwise((1 - F.col(f"__weft_s{i}")) * F.col(f"__weft_a{i}") + F.col(f"__weft_s{i}") * F.col(f"__weft_b{i}"))
    return by.select(*within, *[between(i).alias(name) for i, name in enumerate(shares)])


def drawn(key: Column, seed: int) -> Column:
    """The hash by which rows are drawn: 32 hexadecimal digits, the same on any layout and in any engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")).cast("binary"))


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds ``place``: the order drawn by a keyed hash (O8); rows of one key keep an order of their own."""
    return ranked(rows, (), [drawn(F.col(key), seed)], "place")


def sample(rows: DataFrame, key: str, n: int, seed: int = 0, within: Sequence[str] = ()) -> DataFrame:
    """n rows of each group drawn without replacement: those of the least keyed hashes.

    Hashes are even, so the n least of a group of k lie below n / k of their range, and a little: only rows below
    that are ranked.  Where fewer than n are - which chance all but rules out - all rows of the group are.
    """
    few = F.conv(F.substring("__weft_h", 1, 12), 16, 10).cast("long") / F.lit(2.0**48)
    own = rows.withColumn("__weft_h", drawn(F.col(key), seed)).withColumn("__weft_u", few)
    sizes = written(own.groupBy(*within).agg(F.count("*").alias("__weft_k")))
    bound = (n + 10 * (n + 10) ** 0.5) / F.col("__weft_k")
    met = _beside(own, sizes, within)
    low = met.where(F.col("__weft_u") <= bound)
    found = low.groupBy(*within).agg(F.count("*").alias("__weft_f"))
    short = written(_beside(sizes, found, within, "left").where(F.coalesce("__weft_f", F.lit(0)) < F.least(F.lit(n), F.col("__weft_k"))).select(*within, F.lit(True).alias("__weft_s")))
    if not short.isEmpty():
        low = low.unionByName(_beside(met.where(F.col("__weft_u") > bound), short, within).drop("__weft_s"))
    return ranked(low, within, ["__weft_h"], "__weft_rank").where(F.col("__weft_rank") < n).select(*rows.columns)


def _beside(rows: DataFrame, table: DataFrame, within: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of a table that has a row a group; null groups are groups like any other."""
    if not within:
        return rows.crossJoin(table) if how == "inner" else rows.join(table, F.lit(True), how)  # one row
    same = F.lit(True)
    for c in within:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    return rows.alias("r").join(table.alias("t"), same, how).select("r.*", *[F.col(f"t.{c}") for c in table.columns if c not in within])

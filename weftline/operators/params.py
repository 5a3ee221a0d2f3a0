"""Typed comparison of object parameters.

A pair of parameter objects becomes a few sums for each kind of value; the sums of many pairs
add up, so Spark aggregates them by class and in total.

Kinds and rules: ``keys`` counts the truth's keys and those found; null and strings are equal or
not (``str``); ``bool``; ``float`` for truths from -1 to 1, ``thickness`` for any float under a key
that names it, both with absolute and relative error, where the prediction is a number; ``int``
for truths under 32, where anything but a number is off by the whole truth; lists are compared
place by place and count as ``list``; objects by key.  ``object`` counts pairs, and those in
which every key of the truth exists, whatever its value.  Malformed JSON counts as {}.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("keys", "float", "int", "bool", "str", "list", "thickness", "object")
SUMS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n", "ok", "extra")], *[T.StructField(c, T.DoubleType()) for c in ("abs_error", "rel_error", "least", "most")]]))


def is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def is_float(x) -> bool:
    return isinstance(x, float)


def is_int(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def findings(pred, truth, key: str = "") -> Iterator[tuple]:
    """(kind, ok, absolute error, relative error, truth's number) for each value; (keys, found, extra, all) for an object."""
    if isinstance(truth, dict):
        own = pred if isinstance(pred, dict) else {}
        yield "keys", len(truth.keys() & own.keys()), len(own.keys() - truth.keys()), len(truth)
        for k, v in truth.items():
            yield from findings(own.get(k), v, k)
    elif isinstance(truth, list):
        yield "list", 0, 0.0, 0.0, None
        own = pred if isinstance(pred, list) else []
        for i, v in enumerate(truth):
            yield from findings(own[i] if i < len(own) else None, v, key)
    elif isinstance(truth, bool):
        yield "bool", int(isinstance(pred, bool) and pred == truth), 0.0, 0.0, None
    elif truth is None or isinstance(truth, str):
        yield "str", int(type(pred) is type(truth) and pred == truth), 0.0, 0.0, None
    elif is_float(truth):
        thick = "thickness" in key.lower()
        if is_number(pred) and (thick or -1 <= truth <= 1):
            off = abs(float(pred) - truth)
            yield "thickness" if thick else "float", 0, off, off / abs(truth) if abs(truth) > 1e-9 else off, truth
    elif truth < 32:
        yield "int", 0, float(abs(round(pred) - truth if is_number(pred) else truth)), 0.0, float(truth)


def holds_keys(pred, truth) -> bool:
    """Does every key of the truth exist, lists being of equal length?"""
    if isinstance(truth, dict):
        return isinstance(pred, dict) and truth.keys() <= pred.keys() and all(holds_keys(pred[k], v) for k, v in truth.items())
    if isinstance(truth, list):
        return isinstance(pred, list) and len(pred) == len(truth) and all(map(holds_keys, pred, truth))
    return True


def equal_values(a, b, tolerance: float = 1e-6) -> bool:
    """Deep equality with a tolerance for numbers; truth values are no numbers."""
    if isinstance(b, dict):
        return isinstance(a, dict) and a.keys() == b.keys() and all(equal_values(a[k], b[k], tolerance) for k in b)
    if isinstance(b, list):
        return isinstance(a, list) and len(a) == len(b) and all(equal_values(x, y, tolerance) for x, y in zip(a, b, strict=True))
    if is_number(a) and is_number(b) and (is_float(a) or is_float(b)):
        return abs(a - b) <= tolerance
    return type(a) is type(b) and a == b


def equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Are two JSON texts deeply equal, numbers within the tolerance (A19)? Malformed texts are equal to none."""

    @F.pandas_udf(T.BooleanType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for one, other in zip(x, y, strict=True):
            try:
                out.append(equal_values(json.loads(one), json.loads(other), tolerance))
            except (ValueError, TypeError):
                out.append(False)
        return pd.Series(out, dtype=bool)

    return run(a, b)


def sums(pred: dict, truth: dict) -> list[tuple]:
    """The sums of one pair, a row a kind that occurs."""
    out: dict = {"object": [1, int(holds_keys(pred, truth)), 0, 0.0, 0.0, None, None]}
    for kind, *x in findings(pred, truth):
        row = out.setdefault(kind, [0, 0, 0, 0.0, 0.0, None, None])
        if kind == "keys":
            found, extra, n = x
            row[0], row[1], row[2] = row[0] + n, row[1] + found, row[2] + extra
            continue
        ok, off, rel, number = x
        row[0], row[1], row[3], row[4] = row[0] + 1, row[1] + ok, row[3] + off, row[4] + rel
        if number is not None:
            row[5] = number if row[5] is None else min(row[5], number)
            row[6] = number if row[6] is None else max(row[6], number)
    return [(kind, *row) for kind, row in out.items()]


def _loaded(text) -> dict:
    try:
        x = json.loads(text) if text is not None else {}
    except ValueError:
        x = {}
    return x if isinstance(x, dict) else {}


@F.pandas_udf(SUMS)
def compared(pred: pd.Series, truth: pd.Series) -> pd.Series:
    """The sums of pairs of JSON objects."""
    return pd.Series([sums(_loaded(a), _loaded(b)) for a, b in zip(pred, truth, strict=True)])


def compare(pairs: DataFrame, pred: str = "pred", truth: str = "gt", kind: str = "class") -> DataFrame:
    """(class, kind, n, ok, extra, abs_error, rel_error, least, most): a row for each class and kind of value, and in total (class null)."""
    rows = pairs.select(F.col(kind).alias("class"), F.explode(compared(pred, truth)).alias("x")).select("class", "x.*")
    add = [F.sum(c).alias(c) for c in ("n", "ok", "extra", "abs_error", "rel_error")]
    by = rows.groupingSets([[F.col("class"), F.col("kind")], [F.col("kind")]], "class", "kind")  # in one pass: what is compared may be long work
    by = by.agg(*add, F.min("least").alias("least"), F.max("most").alias("most"), F.grouping("class").alias("_total"))
    return by.where((F.col("_total") == 1) | F.col("class").isNotNull()).drop("_total")


def summary(sums_: DataFrame) -> DataFrame:
    """Adds accuracy (ok of n), mean_abs_error and mean_rel_error, 0 where nothing was compared."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return sums_.withColumns({"accuracy": zero(F.try_divide("ok", "n")), "mean_abs_error": zero(F.try_divide("abs_error", "n")), "mean_rel_error": zero(F.try_divide("rel_error", "n"))})


def report(summed: DataFrame) -> str:
    """A printable table of a summary in total; the driver gets a row a kind."""
    rows = {r["kind"]: r for r in summary(summed).where(F.col("class").isNull()).collect()}
    lines = [f"{'kind':<10}{'n':>10}{'accuracy':>10}{'abs error':>12}{'rel error':>12}"]
    for kind in KINDS:
        if r := rows.get(kind):
            lines.append(f"{kind:<10}{r['n']:>10}{r['accuracy']:>10.4f}{r['mean_abs_error']:>12.6f}{r['mean_rel_error']:>12.6f}")
    return "\n".join(lines)

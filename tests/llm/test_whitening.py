from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import whitening as W


def exact(pair):
    return Fraction(float(pair[0])) + Fraction(float(pair[1]))


def test_sums_and_products_keep_what_doubles_lose():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(301, 3)) * 10.0 ** rng.integers(-8, 9, (301, 3))
    low = rows * 2.0**-54 * rng.random((301, 3))
    sums, pairs = W.total(rows, low), W.outer(rows, low)
    full = [[Fraction(float(h)) + Fraction(float(l)) for h, l in zip(a, b)] for a, b in zip(rows, low)]
    for j in range(3):
        want = sum(r[j] for r in full)
        assert abs(exact((sums[0][j], sums[1][j])) - want) <= abs(want) / 2**95 + Fraction(1, 2**60)
    for t, (i, j) in enumerate(zip(*np.triu_indices(3))):
        want, size = sum(r[i] * r[j] for r in full), sum(abs(r[i] * r[j]) for r in full)
        assert abs(exact((pairs[0][t], pairs[1][t])) - want) <= size / 2**90


def truth(x):
    """Mean and covariance of whole numbers by exact fractions."""
    n, d = len(x), len(x[0])
    s = [sum(int(r[j]) for r in x) for j in range(d)]
    v = [[float(Fraction(sum((n * int(r[i]) - s[i]) * (n * int(r[j]) - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)]
    return s, np.array(v)


def test_report_against_fractions(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(90, 5)) @ np.diag([3, 2, 1, 0.5, 0.1])
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(base)]
    rows += [(7, rows[7][1], None), (None, rows[3][1], 2), (200, None, 1), (201, [], 1), (202, [1.0, None, 0.0, 0.0, 0.0], 1), (203, [float("nan")] * 5, 1), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (205, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long").repartition(5)
    got = W.report(df, 3).collect()
    used = [(i, [int(np.floor(1024 * c)) + 100000 for c in v]) for i, v, _ in rows[:92]]
    s, v = truth([x for _, x in used])
    values, vectors = np.linalg.eigh(v)
    n = len(used)
    assert len(got) == 3 * n and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for i, x in used:
        for c in (1, 2, 3):
            r = by[i, c][0]
            assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s)) == int(r["deviation_exact"])
            want = sum((a - b / n) * w for a, b, w in zip(x, s, vectors[:, -c])) / np.sqrt(values[-c])
            assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
            assert r["explained"] == pytest.approx(values[-c] / np.trace(v), rel=1e-12) and r["identity_error"] < 1e-10
    assert len(by[7, 1]) == 2 and by[None, 1][0]["whitened"] == by[3, 1][0]["whitened"]
    sign = {c: np.sign(by[0, c][0]["whitened"]) * np.sign(sum((a - b / n) * w for a, b, w in zip(used[0][1], s, vectors[:, -c]))) for c in (1, 2, 3)}
    for i, x in used:  # one sign for all rows
        assert all(abs(by[i, c][0]["whitened"] - sign[c] * sum((a - b / n) * w for a, b, w in zip(x, s, vectors[:, -c])) / np.sqrt(values[-c])) < 1e-9 for c in (1, 2, 3))


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = [tuple(r)[:7] for r in W.report(df).orderBy("vec_id", "component").collect()]
    assert got == [(i, c, 2, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]  # no variance
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    rows = W.report(line).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in rows) and len(rows) == 18
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    rows = W.report(huge).where("component = 1").collect()
    assert all(r["deviation"] is None and int(r["deviation_exact"]) > 2**63 for r in rows if r["vec_id"] != 3) and len(rows) == 3
    for empty in (df.where("false"), df.withColumn("embedding", F.lit(None).cast("array<float>"))):
        assert W.report(empty).count() == 0


def test_sums_of_many_tasks_meet_in_rounds(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(300, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>").repartition(30)
    whole = W.fit(df)
    monkeypatch.setattr(W, "WIDE", 7)
    monkeypatch.setattr(W, "FEW", 2)
    again = W.fit(df)
    assert whole.n == again.n == 300 and np.array_equal(whole.values, again.values) and whole.mean[0].tolist() == again.mean[0].tolist()


def test_a_mean_far_from_the_spread(spark):
    rng = np.random.default_rng(9)
    x = 1e9 + rng.integers(-3, 4, (4000, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    model = W.fit(df.repartition(7))
    want = np.sort(np.linalg.eigvalsh(truth(x.astype(int).tolist())[1]))[::-1]
    assert np.allclose(model.values, want, rtol=1e-13) and W.identity_error(model, df, 4) < 1e-12

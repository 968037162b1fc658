"""Whitening against fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows):
    """n, covariance as fractions, and by position x and deviation."""
    xs = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows]
    n, d = len(xs), len(xs[0])
    s = [sum(x[j] for x in xs) for j in range(d)]
    y = [[n * x[j] - s[j] for j in range(d)] for x in xs]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]
    return n, cov, y, [sum(c * c for c in r) for r in y]


def test_equals_exact_arithmetic(spark):
    r = np.random.default_rng(3)
    rows = [(r.normal(size=6) * [5, 3, 1, 1, 0.5, 0.1]).astype(np.float32).tolist() for _ in range(300)]
    odd = [(900, None), (901, [1.0] * 5 + [None]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0]), (905, [])]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)] + odd, SCHEMA).withColumn("n", F.lit("clash")).withColumn("component", F.lit(-1))
    got = whitening.whiten(df, 4).toPandas()
    n, cov, y, deviation = plain(rows)
    assert len(got) == 300 * 4 and set(got["n"]) == {300} and sorted(got["component"].unique()) == [1, 2, 3, 4]
    v = np.array([[float(c) for c in row] for row in cov])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    z = (np.array(y, float) / n) @ u[:, :4] / np.sqrt(e[:4])
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(table), np.abs(z), rtol=1e-9, atol=1e-9)
    assert np.abs(table.T @ table / n - np.eye(4)).max() < 1e-9 > got["identity_error"].max()
    first = got[got["component"] == 1].sort_values("vec_id")
    assert first["deviation"].tolist() == deviation
    assert first["explained"].iloc[0] == pytest.approx(e[0] / np.trace(v), rel=1e-12)


def test_scatter_is_exact_for_large_entries(spark):
    rows = [[1e14 + 1e9 * k * k, -3.0 * k, 5.0] for k in range(7)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    good, d = whitening.fit_list(df, "embedding")
    n, sums, width = whitening._sums(good, "embedding", d)
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    y = [[n * x[j] - sum(z[j] for z in xs) for j in range(3)] for x in xs]
    assert sums == [sum(x[j] for x in xs) for j in range(3)]
    assert whitening.scatter(good, "embedding", d, n, sums, n * width).tolist() == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
    got = whitening.whiten(df).toPandas()
    assert got["deviation"].isna().all()  # no long holds them
    assert (got[got["component"] == 3]["whitened"] == 0).all() and got["identity_error"].max() < 1e-4


def test_nothing_repeats_and_null_ids(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(9007199254740993, [0.5, 2.0])] * 3 + [(None, [0.5, 2.0])], SCHEMA)).toPandas()
    assert len(one) == 8 and (one["whitened"] == 0).all() and (one["explained"] == 0).all() and (one["deviation"] == 0).all()
    ids = whitening.whiten(spark.createDataFrame([(9007199254740993, [0.5, 2.0]), (None, [1.5, 2.0])], SCHEMA)).select("vec_id").collect()
    assert {r[0] for r in ids} == {9007199254740993, None}

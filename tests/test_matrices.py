"""Matrix expressions against numpy, many at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import matrices as X
from tidemark.functions.special import digamma, digamma_column
from tidemark.operators import moments as M
from tidemark.operators import recovery


def table(spark, matrices):
    return spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(matrices)], "fit int, a array<array<double>>").withColumn("names", F.transform("a", lambda r, i: F.concat(F.lit("n"), i.cast("string"))))


def test_solve_and_inverse(spark):
    rng = np.random.default_rng(0)
    ms = [rng.standard_normal((n, n)) for n in (1, 2, 3, 5, 8) for _ in range(3)] + [np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([[1e-20, 1.0], [1.0, 1.0]])]
    for r in table(spark, ms).select("fit", X.inverse(F.col("a")).alias("i"), X.solve_vector(F.col("a"), F.transform("a", lambda row: row[0])).alias("x"), X.product(F.col("a"), X.transposed(F.col("a"))).alias("p")).collect():
        m = ms[r.fit]
        assert np.allclose(np.array(r.i) @ m, np.eye(len(m)), atol=1e-8) and np.allclose(m @ r.x, m[:, 0], atol=1e-8) and np.allclose(r.p, m @ m.T)
    bad = [np.ones((2, 2)), np.zeros((3, 3)), np.array([[np.nan, 1.0], [1.0, 2.0]])]
    assert [r.i for r in table(spark, bad).select(X.inverse(F.col("a")).alias("i")).collect()] == [None] * 3


def test_leading_pairs(spark):
    rng = np.random.default_rng(1)
    ms = [(lambda b: b @ b.T)(rng.standard_normal((n, n + 2))) for n in (1, 2, 4, 7)] + [np.zeros((2, 2))]
    pair = table(spark, ms).withColumn("p", X.leading(F.col("a"))).withColumn("q", X.leading(X.deflated(F.col("a"), F.col("p"))))
    for r in pair.collect():
        values = np.linalg.eigvalsh(ms[r.fit])[::-1]
        assert r.p.value == pytest.approx(values[0], rel=1e-9, abs=1e-12) and np.linalg.norm(r.p.vector) == pytest.approx(1)
        assert len(values) == 1 or r.q.value == pytest.approx(values[1], rel=1e-6, abs=1e-9)


def test_roots_of_three(spark):
    rng = np.random.default_rng(2)
    ms = [rng.standard_normal((3, 3)) for _ in range(60)] + [np.diag([2.0, 2.0, 1.0]), np.eye(3), np.zeros((3, 3)), np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 0.5]]), np.eye(2)]
    got: dict = {}
    for r in M.roots_of_three(table(spark, ms)).collect():
        got.setdefault(r.fit, {})[r.nth] = complex(r.re, r.im)
        assert r.modulus == pytest.approx(abs(complex(r.re, r.im)))
    assert len(got) == len(ms) - 1
    for i, own in got.items():
        assert sorted(own) == [1, 2, 3] and abs(own[1]) >= abs(own[2]) - 1e-12 >= abs(own[3]) - 2e-12
        left = list(np.linalg.eigvals(ms[i]))
        for z in own.values():
            k = int(np.argmin([abs(z - w) for w in left]))
            assert abs(z - left.pop(k)) < 1e-6


def test_degrees_stay_within_their_bounds(spark):
    weights = spark.createDataFrame([("even", 1.0)] * 5 + [("wild", w) for w in (1e-6, 1e-6, 1e-6, 4.0, 9.0)] + [("some", w) for w in (0.4, 0.8, 1.0, 1.1, 1.5)], "fit string, w double")
    got = {r.fit: (r.gap, r.nu) for r in M.degrees_of_freedom(weights).collect()}
    assert got["even"][1] == 1000.0 and got["wild"][1] == 2.001
    gap, nu = got["some"]
    assert 2.001 < nu < 1000 and np.log(nu / 2) - digamma(nu / 2)[0] + gap == pytest.approx(0, abs=1e-9)


def test_digamma_column(spark):
    xs = [0.05, 0.5, 1.0, 2.5, 9.0, 500.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", digamma_column(F.col("x")).alias("d")).collect()
    assert all(r.d == pytest.approx(digamma(r.x)[0], rel=1e-9) for r in rows)


def test_rotations_and_changes_of_basis(spark):
    rng = np.random.default_rng(3)
    ms = [rng.standard_normal((n, n)) for n in (1, 2, 3, 6)] + [np.diag([1e-4, 1.0, 1e4])]
    for r in table(spark, ms).select("fit", X.polar(F.col("a")).alias("p")).collect():
        u, _, v = np.linalg.svd(ms[r.fit])
        p = np.array(r.p)
        assert np.abs(p.T @ p - np.eye(len(p))).max() < 1e-9 and np.allclose(p, u @ v, atol=1e-8)
    assert table(spark, [np.ones((2, 2))]).select(X.polar(F.col("a")).alias("p")).first().p is None
    h, q = ms[2], ms[2] @ ms[2].T
    row = table(spark, [h]).select(X.changed_basis(F.lit(ms[2].tolist()), F.col("a")).alias("b"), X.changed_covariance(F.lit(q.tolist()), F.col("a")).alias("c")).first()
    assert np.allclose(row.b, np.linalg.inv(h) @ ms[2] @ h) and np.allclose(row.c, np.eye(3), atol=1e-8)


def test_free_rotation_undoes_a_rotation(spark):
    rng = np.random.default_rng(4)
    rows, turns = [], {}
    for fit in ("a", "b"):
        star = rng.standard_normal((12, 3))
        turns[fit], _ = np.linalg.qr(rng.standard_normal((3, 3)))
        hat = star @ turns[fit].T + (0 if fit == "a" else 0.1) * rng.standard_normal((12, 3))
        rows += [(fit, f"s{i}", f"f{j}", float(hat[i, j]), float(star[i, j])) for i in range(12) for j in range(3)]
    made = {r.fit: r for r in recovery.free_rotation(spark.createDataFrame(rows, "fit string, series string, factor string, hat double, star double")).collect()}
    assert np.allclose(made["a"].rotation, turns["a"], atol=1e-9) and made["a"].error < 1e-7 < made["b"].error < 0.2

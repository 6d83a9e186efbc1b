"""Intervals of what one model adds to another against NumPy, their empty cases, and the boundary of a split."""

import numpy as np
import pytest

from tickforge.operators import regression as R
from tickforge.operators import scores as S
from tickforge.operators import windows as W

SUMS = "date string, n long, y_sum double, y_squares double, base_sse double, plus_sse double"


def test_model_intervals(spark):
    rng = np.random.default_rng(4)
    rows = [(f"d{i:02d}", 30, float(rng.normal(0, 9)), 900.0 + 9 * i, 700.0 + 8 * i, float(690 + 8 * i + rng.normal(0, 20))) for i in range(12)]
    got = S.model_intervals(spark.createDataFrame(rows, SUMS).repartition(3), 500, 42).first()
    sums = np.array([r[1:] for r in rows], dtype=float)

    def gains(t):
        return (t[3] - t[4]) / (t[2] - t[1] ** 2 / t[0]), 1 - t[4] / t[3]

    plan = [[pow(rep * 7919 + pos * 104_729 + 42 * 31, 5, 1_000_003) % 12 for pos in range(12)] for rep in range(500)]
    per = np.array([gains(sums[at].sum(axis=0)) for at in plan])
    for k, name in enumerate(("delta_r2", "mse_reduction")):
        assert got[name] == pytest.approx(gains(sums.sum(axis=0))[k], rel=1e-9)
        assert [got[f"{name}_{p}"] for p in ("lower", "median", "upper")] == pytest.approx(np.quantile(per[:, k], [0.025, 0.5, 0.975]).tolist(), rel=1e-9)
    assert (got["sessions"], got["replicates"], got["share_not_positive"]) == (12, 500, pytest.approx(np.mean(per[:, 0] <= 0)))


def test_model_intervals_without_values(spark):
    assert S.model_intervals(spark.createDataFrame([], SUMS), 50, 1).collect() == []
    got = S.model_intervals(spark.createDataFrame([("d", 5, 10.0, 20.0, 0.0, 0.0)], SUMS), 50, 1).first()
    assert got["delta_r2"] is None and got["mse_reduction_median"] is None and got["share_not_positive"] is None and got["replicates"] == 50


def test_constant_and_collinear_features():
    x = np.column_stack([np.ones(50), np.arange(50.0), 2 * np.arange(50.0), np.full(50, 7.0)])
    y = 3 + 0.5 * np.arange(50)
    assert x @ R.solve(x.T @ x, x.T @ y) == pytest.approx(y)
    assert R.solve(np.zeros((3, 3)), np.zeros(3)).tolist() == [0, 0, 0]


def test_boundary_is_a_session_with_others_before_it(spark):
    dates = spark.createDataFrame([("d1",), ("d2",), ("d2",)], "date string")
    W.require_boundary(dates, "d2")
    for start in ("d1", "d3"):
        with pytest.raises(ValueError):
            W.require_boundary(dates, start)
    with pytest.raises(ValueError):
        W.require_boundary(dates.limit(0), "d1")


def test_plan_resamples_like_independent_draws():
    for n in (6, 12, 17, 30, 251):
        x = np.random.default_rng(n).normal(size=n)
        rep = np.arange(10_000)
        means = x[S.drawn(rep, n, 17)].mean(axis=1)
        assert means.std() == pytest.approx(x.std() / np.sqrt(n), rel=0.05) and means.mean() == pytest.approx(x.mean(), abs=0.05)
        sums = S.flipped(rep, n, 17) @ x
        assert sums.std() == pytest.approx(np.sqrt((x * x).sum()), rel=0.05)

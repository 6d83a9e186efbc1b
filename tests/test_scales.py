"""The bounded soft-L1 fit, the scaling laws and the scores of models against NumPy."""

import numpy as np
import pytest

from tickforge import cli
from tickforge.operators import orders as O
from tickforge.operators import regression as R
from tickforge.operators import windows as W


def shape(x, q, r, a, b):
    z = x / q
    return r * z / (1 + np.abs(z) ** a) ** (b / a)


def test_scales_of_curves_are_recovered(spark):
    rng, rows, truth = np.random.default_rng(2), [], {}
    for h in (10, 40, 160, 640):
        q, r = 50.0 * h**0.5, 2e-4 * h**0.6
        truth[h] = q, r
        for i, z in enumerate(np.linspace(-3, 3, 21)):
            rows.append((h, i, float(z * q), float(shape(z * q, q, r, 1.5, 0.8)), int(rng.integers(20, 400))))
    table = R.volume_curve_scales(spark.createDataFrame(rows, "horizon long, bin int, x_mean double, y_mean double, n long"))
    got = {r["horizon"]: r for r in table.collect()}
    for h, (q, r) in truth.items():
        # width and height of a power law trade off, so the curve and the laws are compared
        x = np.linspace(-3 * q, 3 * q, 50)
        own = got[h]
        fit = shape(x, own["x_scale"], own["y_scale"], own["alpha"], own["beta"])
        assert np.abs(fit - shape(x, q, r, 1.5, 0.8)).max() < 0.02 * np.abs(shape(x, q, r, 1.5, 0.8)).max()
        assert own["success"] and 0 <= own["cost"] < 1e-7
    laws = {r["law"]: r for r in R.scaling_laws(table).collect()}
    assert laws["width"]["slope"] == pytest.approx(0.5, abs=0.05) and laws["height"]["slope"] == pytest.approx(0.6, abs=0.05)


def test_points_count_by_their_observations():
    """The weighted loss is the one that is reported, and no neighbour of the answer has a lower one."""
    x, y, w = np.linspace(-2, 2, 15), None, np.sqrt(np.linspace(1, 30, 15))
    y = shape(x, 1.0, 1.0, 1.5, 0.8) + 0.3 * np.cos(9 * x)
    w = w / w.max()
    residuals = lambda p: w * (shape(x, *np.exp(p)) - y)
    low, high = np.log([1e-3, 1e-3, 0.1, 0.1]), np.log([1e3, 1e2, 8.0, 5.0])
    p, cost, success = R._soft_l1(residuals, np.log([0.5, 0.5, 1.2, 1.3]), low, high, 2000)
    loss = lambda p: float(np.sum(np.sqrt(1 + residuals(p) ** 2) - 1))
    assert success and cost == pytest.approx(loss(p))
    for v in np.vstack([np.eye(4), -np.eye(4)]):
        assert loss(np.clip(p + 1e-3 * v, low, high)) >= cost - 1e-9
    assert (p >= low).all() and (p <= high).all()


def test_scores_of_every_model(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = np.where(rng.random(400) < 0.1, 0.0, x @ [0.5, -1.0] + rng.normal(size=400))
    rows = [(float(a), float(b), float(c), i >= 300) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    split = spark.createDataFrame(rows, "a double, b double, y double, is_test boolean").repartition(3)
    got = {r["model"]: r for r in R.model_table(split, "y", {"one": (["a"], 0.0), "two": (["a", "b"], 0.0)}).collect()}
    for name, k in (("one", 1), ("two", 2)):
        design = np.column_stack([np.ones(400), x[:, :k]])
        p = design[300:] @ np.linalg.lstsq(design[:300], y[:300], rcond=None)[0]
        e, moved = y[300:] - p, y[300:] != 0
        want = [np.mean(e * e), np.sqrt(np.mean(e * e)), np.mean(np.abs(e)), 1 - (e @ e) / np.sum((y[300:] - y[300:].mean()) ** 2), np.mean(np.sign(p[moved]) == np.sign(y[300:][moved]))]
        assert [got[name][c] for c in ("mse", "rmse", "mae", "r2", "sign_accuracy")] == pytest.approx(want)


def test_regular_hours_and_scaling_trades(spark):
    rows = [("d", 34_199_999_999, 1, 0, 5, 100.0), ("d", 34_200_000_000, -1, 4, 6, 100.005), ("d", 57_600_000_000, 1, 9, 7, 100.01), ("d", 57_600_000_001, 1, 11, 8, 100.0)]
    kept = O.regular_hours(spark.createDataFrame(rows, "date string, ts_us long, trade_sign int, first_event_row long, size long, mid_price_before double"))
    got = sorted(tuple(r) for r in cli.scaling_trades(kept).select("row0", "size", "sign", "mid_raw").collect())
    assert got == [(0, 6, -1, 2_000_100), (1, 7, 1, 2_000_200)]
    assert W.SCALING_HORIZONS[0] == 10

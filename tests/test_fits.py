"""Grouped fits, keyed intervals and economics against plain NumPy."""

import numpy as np
import pytest

from tickforge.operators import economics as N
from tickforge.operators import evaluate as E
from tickforge.operators import fits as M
from tickforge.operators import scores as S

CELLS = "spread_bucket string, date string, queue_bin int, ofi_bin int, queue_center double, ofi_center double, up_moves long, down_moves long"


def made_cells(seed: int, buckets: dict[str, tuple[float, float, float]], days: int) -> list[tuple]:
    rng, rows = np.random.default_rng(seed), []
    for bucket, (a, b, c) in buckets.items():
        for d in range(days):
            for i, q in enumerate((-0.8, -0.3, 0.2, 0.7)):
                for j, f in enumerate((-0.6, 0.0, 0.6)):
                    n = int(rng.integers(5, 40))
                    up = int(rng.binomial(n, 1 / (1 + np.exp(-(a + b * q + c * f)))))
                    rows.append((bucket, f"2024-01-{d + 1:02d}", i, j, q, f, up, n - up))
    return rows


def plain_fit(rows, features):
    x = np.array([[1.0, *(r[f] for f in features)] for r in rows])
    up, down = np.array([r[6] for r in rows], float), np.array([r[7] for r in rows], float)
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * ((up + down) * p * (1 - p))[:, None]), x.T @ (up - (up + down) * p))
    return beta


BUCKETS = {"all_spreads": (0.1, 1.2, 0.8), "one_tick": (-0.2, 0.5, 1.5)}


def test_all_groups_and_models_at_once(spark):
    rows = made_cells(1, BUCKETS, 8)
    got = {(r["spread_bucket"], r["model"]): r for r in M.fit_groups(spark.createDataFrame(rows, CELLS).repartition(5), ["spread_bucket"]).collect()}
    assert len(got) == 8 and all(r["converged"] for r in got.values())
    for bucket in BUCKETS:
        own = [r for r in rows if r[0] == bucket]
        for model, features in {"intercept": [], "queue": [4], "ofi": [5], "both": [4, 5]}.items():
            r = got[bucket, model]
            assert [v for v in (r["intercept"], r["queue"], r["ofi"]) if v is not None] == pytest.approx(plain_fit(own, features).tolist(), abs=1e-9)
            assert r["moves"] == sum(x[6] + x[7] for x in own) and r["up_moves"] == sum(x[6] for x in own)


def test_keyed_intervals_count_missing_sessions_as_zero(spark):
    rng = np.random.default_rng(2)
    dates = [f"d{i:02d}" for i in range(9)]
    rows = [(k, d, float(rng.normal(k, 1)), float(rng.integers(1, 9))) for k in (1, 2) for d in dates if not (k == 2 and d in ("d03", "d07"))]
    rows += [(3, "d01", 1.0, 0.0)]
    calendar = spark.createDataFrame([(d,) for d in dates], "date string")
    frame = spark.createDataFrame(rows, "key int, date string, a double, b double").repartition(4)
    for improvement in (False, True):
        got = {(r["key"], r["block"]): r for r in M.keyed_intervals(frame, calendar, ["key"], "a", "b", 700, 5, improvement, (1, 3)).collect()}
        for k in (1, 2):
            sums = np.zeros((9, 2))
            for key, d, a, b in rows:
                if key == k:
                    sums[dates.index(d)] = a, b
            for block in (1, 3):
                t = sums[S.drawn(np.arange(700), 9, 5, block if block > 1 else None)].sum(axis=1)
                t = t[t[:, 1] > 0]
                v = t[:, 0] / t[:, 1]
                v = 1 - v if improvement else v
                r = got[k, block]
                assert [r["lower"], r["median"], r["upper"]] == pytest.approx(np.quantile(v, [0.025, 0.5, 0.975]).tolist())
                assert r["replicates"] == len(t) and r["clusters"] == 9 and r["share_not_positive"] == pytest.approx(np.mean(v <= 0))
                whole = sums.sum(axis=0)
                assert r["estimate"] == pytest.approx(1 - whole[0] / whole[1] if improvement else whole[0] / whole[1])
        assert got[3, 1]["replicates"] == 0 and got[3, 1]["estimate"] is None and got[3, 1]["lower"] is None


def test_economics_of_markouts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for bucket, date, i, j, q, f, up, down in made_cells(4, BUCKETS, 10):
        for latency in (0, 100):
            n = up + down
            done = n if latency == 0 else int(rng.integers(0, n + 1))
            rows.append((bucket, date, i, j, q, f, up, down, latency, n, done, n - done, float(rng.normal(up - down, 1)), 0.4 * done))
    grid = spark.createDataFrame(rows, CELLS + ", latency_us long, signals long, executable long, stale long, midpoint_move_sum_bps double, half_spread_sum_bps double")
    out = N.signal_economics(grid, "2024-01-07", N.MARKOUTS, [1.0, 0.2], 400, 9).collect()
    assert len(out) == 2 * 3 * 2 * 2
    for r in out:
        assert r["clusters"] == 4 and r["lower"] <= r["median"] <= r["upper"]
        own = [x for x in rows if x[0] == r["spread_bucket"]]
        features = {"queue": [4], "ofi": [5], "both": [4, 5]}[r["model"]]
        beta = plain_fit([x for x in own if x[1] < "2024-01-07" and x[8] == 0], features)
        p = lambda x: 1 / (1 + np.exp(-(beta[0] + sum(b * x[f] for b, f in zip(beta[1:], features, strict=True)))))  # noqa: B023, E731
        test = [x for x in own if x[1] >= "2024-01-07" and x[8] == r["latency_us"] and abs(p(x) - 0.5) >= r["cutoff"] - 1e-11]
        assert r["signals"] == sum(x[9] for x in test) and r["executions"] == sum(x[10] for x in test)
        gross = sum((1 if p(x) >= 0.5 else -1) * x[12] for x in test)
        assert r["net_bps"] == pytest.approx((gross - sum(x[13] for x in test)) / r["executions"])
        assert r["train_fraction"] == 1 or 0.15 < r["train_fraction"] < 0.5


def test_horizon_selection_takes_fixed_horizons_only(spark):
    rows = []
    for kind, value, strength in (("price_spell", 0, 3.0), ("quote_updates", 5, 2.0), ("clock_us", 100, 0.1)):
        rows += [(*r, kind, value) for r in made_cells(7, {"all_spreads": (0.0, 0.0, strength)}, 12)]
    grid = spark.createDataFrame(rows, CELLS + ", horizon_kind string, horizon_value long")
    out = {(r["model"], r["horizon_kind"]): r for r in E.select_horizon(grid, "2024-01-05", "2024-01-09", 300, 3).collect()}
    assert len(out) == 6
    for model in ("ofi", "both"):
        chosen, spell, other = (out[model, k] for k in ("quote_updates", "price_spell", "clock_us"))
        assert chosen["chosen"] and not spell["chosen"] and not other["chosen"]
        assert spell["selection_brier"] < chosen["selection_brier"] < other["selection_brier"]
        assert chosen["test_brier"] is not None and spell["test_brier"] is not None and other["test_brier"] is None
        assert chosen["baseline_lower"] > 0 and chosen["price_spell_estimate"] < 0 and spell["baseline_estimate"] is None

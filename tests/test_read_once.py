"""Windows of trades against plain versions, and plans that read their tables once or less of them."""

import numpy as np
import pytest

from tickforge.operators import windows as W
from tickforge.plans import books
from tickforge.plans import trades as T

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def days():
    rng = np.random.default_rng(4)
    return {d: [(i, int(s), int(v), 1_000_000 + 100 * int(m)) for i, (s, v, m) in enumerate(zip(rng.choice([-1, 1], n), rng.integers(1, 51, n), np.cumsum(rng.integers(-1, 2, n)), strict=True))] for d, n in (("a", 203), ("b", 40), ("c", 7))}


@pytest.fixture(scope="module")
def frame(spark, days):
    return spark.createDataFrame([(d, *r) for d, rows in days.items() for r in rows], "date string, row0 long, sign int, size long, mid_raw long").repartition(3)


@pytest.mark.parametrize("stride", [None, 5, 3])
def test_prediction_windows(frame, days, stride):
    got = {(r["date"], r["horizon"], r["row0"]): (r["volume_imbalance"], r["order_flow_imbalance"], r["impact"]) for r in W.prediction_windows(frame, [5, 10, 20], stride).collect()}
    want = {
        (d, t, k): (sum(s * v for _, s, v, _ in rows[k : k + t]), sum(s for _, s, _, _ in rows[k : k + t]), (rows[k + t][3] - rows[k][3]) / 10_000)
        for d, rows in days.items() for t in (5, 10, 20) for k in range(0, len(rows) - t, stride or t)
    }
    assert got == want


def test_scaling_windows(frame, days):
    got = {(r["date"], r["horizon"], r["w"]): r for r in W.scaling_windows(frame, [3, 10, 13]).collect()}
    mean = np.mean([sum(r[2] for r in rows) for rows in days.values()])
    count = 0
    for d, rows in days.items():
        scale, mid = mean / sum(r[2] for r in rows), np.array([r[3] for r in rows])
        for h in (3, 10, 13):
            for k in range(0, len(rows) - h, h):
                r, own, step, count = got[d, h, k // h], rows[k : k + h], np.diff(mid[k : k + h + 1]), count + 1
                assert (r["n"], r["e"], r["opened"], r["closed"]) == (h, sum(x[1] for x in own), mid[k], mid[k + h])
                assert r["q"] == sum(x[1] * x[2] for x in own) * scale  # equal imbalances of a session are equal
                assert [r["mean_sign"], r["price_change_probability"], r["return_sign_imbalance"], r["impact_log"]] == pytest.approx([r["e"] / h, np.mean(step != 0), np.mean(np.sign(step)), np.log(mid[k + h] / mid[k])])
    assert len(got) == count


def test_curves_of_collapsed_values(spark):
    rng = np.random.default_rng(6)
    x, y = rng.integers(-9, 10, 500), rng.normal(size=500)
    rows = [("g", int(a), float(b)) for a, b in zip(x, y, strict=True)] + [("one", 4, 2.0)]
    df = spark.createDataFrame(rows, "g string, x long, y double").repartition(3)
    got = {(r["g"], r["bin"]): r for r in W.quantile_curve(df, ["g"], "x", "y", 5).collect()}
    edges = np.unique(np.quantile(x, [i / 5 for i in range(6)]))
    at = np.maximum(1, (edges[None] < x[:, None]).sum(axis=1)) - 1
    for b in np.unique(at):
        own = at == b
        assert [got["g", b][c] for c in ("x_mean", "y_mean", "standard_error", "n")] == pytest.approx([x[own].mean(), y[own].mean(), y[own].std(ddof=1) / np.sqrt(own.sum()), own.sum()])
    assert got["one", 0]["standard_error"] is None and len(got) == len(set(at)) + 1
    scales = W.cell_scales(W.curve_cells(df, ["g"], "x", "y"), ["g"], "sx", "sy").where("g = 'g'").first()
    assert [scales["sx"], scales["sy"]] == pytest.approx([x.std(ddof=1), y.std(ddof=1)])


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_features_of_fits_are_written_once(spark):
    for query in (lambda s, d: W.sigma_filter(T.split(s, d), ["volume_imbalance"]), T.contributions, T.walk_forward, T.collapse):
        assert "l_orderkey" not in plan(query(spark, TABLES))


def test_test_sessions_are_filtered_below_the_windows(spark):
    lines = plan(T.scored(spark, TABLES).where("is_test")).splitlines()
    last = max(i for i, line in enumerate(lines) if "Window [" in line)
    assert any("Filter" in line and ">=" in line for line in lines[last:]) and not any("Join" in line for line in lines)
    want = {r["date"]: r["is_test"] for r in W.with_split(T.L.with_lags(T.trades(spark, TABLES), 1)).select("date", "is_test").distinct().collect()}
    assert {r["date"]: r["is_test"] for r in T.scored(spark, TABLES).select("date", "is_test").distinct().collect()} == want


def test_boundary_of_one_session(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "date string, v int")
    assert [tuple(r) for r in W.with_split(df, sessions=df.where("v = 1")).collect()] == [("a", 1, False)]


def test_contracts_read_a_grid_that_is_written_once(spark):
    for query in (books.horizon_contract, books.broken_horizon_contract):
        assert "event_id" not in plan(query(spark, TABLES))


def test_fits_take_no_log_of_a_mid(spark, monkeypatch):
    """A mid of 0 has no log return, which the fits don't use."""
    rows = [("a", i, 1, 5, 0 if i == 0 else 1_000_000 + i) for i in range(60)] + [("b", i, -1, 5, 1_000_000) for i in range(60)]
    monkeypatch.setattr(T, "trades", lambda s, d: spark.createDataFrame(rows, "date string, row0 long, sign int, size long, mid_raw long"))
    assert T.split(spark, TABLES).count() == 10 and T.horizon_robustness(spark, TABLES).count() == 4

"""Causal windows against brute force, statistics against NumPy, policies, streams and the query catalogue."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tickforge.operators import contracts as C
from tickforge.operators import evaluate as E
from tickforge.operators import fits as M
from tickforge.operators import regression as R
from tickforge.operators import scores as S
from tickforge.operators import spells as P
from tickforge.operators import windows as W
from tickforge.plans import catalogue
from tickforge.sources import policy
from tickforge.streaming import counts


def test_clock_flow_is_causal_by_row(spark):
    rng = np.random.default_rng(3)
    ts = np.sort(rng.integers(0, 60, 120)).tolist()  # many ties
    ofi = rng.integers(-9, 10, 120).tolist()
    df = spark.createDataFrame([("d", i, t, o) for i, (t, o) in enumerate(zip(ts, ofi, strict=True))], "date string, event_row long, ts_us long, ofi long")
    got = {r["event_row"]: r["flow"] for r in P.clock_flow(df, 7).collect()}
    assert got == {i: sum(o for j, o in enumerate(ofi[: i + 1]) if ts[j] > ts[i] - 7) for i in range(120)}


def test_entry_is_strictly_before_the_deadline(spark):
    ts = [0, 0, 3, 5, 5, 9, 12]
    df = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(ts)], "date string, spell int, event_row long, ts_us long")
    got = {r["event_row"]: r["at"] for r in df.withColumn("at", P.entry(5, F.col("event_row"))).collect()}
    assert got == {i: max(j for j, u in enumerate(ts) if u < t + 5) for i, t in enumerate(ts)}


def test_windows_never_cross_sessions(spark):
    rows = [(d, i, 10 * (i + 1), 1 if i % 2 else -1, 1_000_000 + 100 * i) for d in ("a", "b") for i in range(6)]
    trades = spark.createDataFrame(rows, "date string, row0 long, size long, sign int, mid_raw long")
    got = sorted(tuple(r)[:4] for r in W.prediction_windows(trades, [2]).select("date", "row0", "volume_imbalance", "impact").collect())
    assert got == [(d, k, 10, pytest.approx(0.02)) for d in ("a", "b") for k in (0, 2)]


def test_right_closed_bins(spark):
    x = [1.0, 1.0, 2.0, 3.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([("k", v, v) for v in x], "g string, x double, y double")
    edges = np.unique(np.quantile(x, [0, 0.25, 0.5, 0.75, 1]))
    want = {}
    for v in x:
        b = max(1, int(np.sum(edges < v))) - 1
        want.setdefault(b, []).append(v)
    got = {r["bin"]: (r["x_mean"], r["n"]) for r in W.quantile_curve(df, ["g"], "x", "y", 4).collect()}
    assert got == {b: (pytest.approx(np.mean(v)), len(v)) for b, v in want.items()}


def test_detrended_fluctuation(spark):
    rng = np.random.default_rng(5)
    signs = rng.choice([-1, 1], 70)
    df = spark.createDataFrame([("d", i, int(s)) for i, s in enumerate(signs)], "date string, row0 long, sign int")
    profile = np.cumsum(signs - signs.mean())
    for r in W.dfa_fluctuations(df, [8, 16]).collect():
        s, n = r["scale"], len(signs) // r["scale"]
        parts = [profile[k * s : (k + 1) * s] for k in range(n)] + [profile[len(signs) - n * s :][k * s : (k + 1) * s] for k in range(n)]
        rss = [np.mean((p - np.polyval(np.polyfit(np.arange(s), p, 1), np.arange(s))) ** 2) for p in parts]
        assert r["fluctuation"] == pytest.approx(math.sqrt(np.mean(rss)), rel=1e-9) and r["segments"] == 2 * n


def test_models_from_sums(spark):
    rng = np.random.default_rng(6)
    v, n = rng.normal(size=400) * 50, rng.integers(-6, 7, 400)
    y = 0.3 * v - 2 * n + rng.normal(size=400)
    rows = [(f"d{i // 20:02d}", i % 20, float(a), int(b), float(c) / 100, 0.0) for i, (a, b, c) in enumerate(zip(v, n, y, strict=True))]
    data = W.impact_features(spark.createDataFrame(rows, "date string, row0 long, volume_imbalance double, order_flow_imbalance int, impact double, impact_bps double"))
    split = W.with_split(data)
    assert split.where("is_test").select("date").distinct().count() == 4
    got = {r["model"]: r for r in R.model_table(split, "impact_cents").collect()}
    volume = [np.ones(400), v, np.abs(v), np.sign(v) * np.sqrt(np.abs(v)), np.sign(v) * np.log1p(np.abs(v))]
    flow = [n, np.abs(n), np.sign(n) * np.sqrt(np.abs(n))]
    rest = {}
    for name, columns in {"volume": volume[:2], "volume_transforms": volume, "volume_and_flow": [*volume, n], "flow_transforms": [*volume, *flow]}.items():
        x = np.column_stack(columns)
        beta = np.linalg.lstsq(x[:320], y[:320], rcond=None)[0]
        rest[name] = y[320:] - x[320:] @ beta
        assert got[name]["mse"] == pytest.approx(np.mean(rest[name] ** 2), rel=1e-6)
    x = np.column_stack([*volume[1:], *flow])
    z = (x - x[:320].mean(axis=0)) / x[:320].std(axis=0)
    beta = np.linalg.solve(z[:320].T @ z[:320] + np.eye(7), z[:320].T @ (y[:320] - y[:320].mean()))
    assert got["ridge"]["mse"] == pytest.approx(np.mean((y[320:] - y[:320].mean() - z[320:] @ beta) ** 2), rel=1e-6)
    days = R.nested_contributions(split, "impact_cents").orderBy("date").collect()
    assert [r["n"] for r in days] == [20] * 4
    for d, r in enumerate(days):
        at = slice(20 * d, 20 * d + 20)
        want = [y[320:][at].sum(), (y[320:][at] ** 2).sum(), (rest["volume_transforms"][at] ** 2).sum(), (rest["volume_and_flow"][at] ** 2).sum()]
        assert [r[c] for c in S.MODEL_SUMS[1:]] == pytest.approx(want, rel=1e-6)
    folds = R.walk_forward(split, "volume_imbalance", "impact_cents", 5, 0.4).collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4] and sum(r["n"] for r in folds) == 240


def test_logit_fit_and_auc(spark):
    q = np.linspace(-0.9, 0.9, 7)
    p = 1 / (1 + np.exp(-(0.2 + 1.7 * q)))
    rows = [("d", "all", i, 0, float(a), 0.0, round(1e6 * b), round(1e6 * (1 - b))) for i, (a, b) in enumerate(zip(q, p, strict=True))]
    cells = spark.createDataFrame(rows, "date string, spread_bucket string, queue_bin int, ofi_bin int, queue_center double, ofi_center double, up_moves long, down_moves long")
    fits = M.fit_groups(cells, ["spread_bucket"], {"queue": M.MODELS["queue"]})
    r = fits.first()
    assert [r["intercept"], r["queue"]] == pytest.approx([0.2, 1.7], abs=1e-4) and r["ofi"] is None and r["converged"]
    scored = M.with_fits(cells, fits, ["spread_bucket"])
    up, down = np.array([r[6] for r in rows], float), np.array([r[7] for r in rows], float)
    pairs = sum(up[i] * (down[:i].sum() + 0.5 * down[i]) for i in range(7))
    assert S.auc(scored, ["spread_bucket"]).first()["auc"] == pytest.approx(pairs / (up.sum() * down.sum()))
    cut = {r["fraction"]: r["cutoff"] for r in S.confidence_cutoffs(scored, ["spread_bucket"], [1.0, 0.5]).collect()}
    assert cut[1.0] == 0 and 0 < cut[0.5] < 0.5


def test_resampling_plans(spark):
    daily = spark.createDataFrame([(f"d{i:02d}", 0.8 * (i + 1), float(i + 1)) for i in range(10)], "date string, challenger double, reference double")
    for block in (None, 3):
        at = S.drawn(np.arange(50), 10, 7, block)
        assert at.shape == (50, 10) and at.min() >= 0 and at.max() < 10
        if block:  # blocks are stretches of the circle
            assert ((at[:, 1] - at[:, 0]) % 10 == 1).all() and ((at[:, 5] - at[:, 4]) % 10 == 1).all()
        r = S.improvement_interval(daily, 50, 7, block).first()
        assert [r[c] for c in ("estimate", "lower", "median", "upper")] == pytest.approx([0.2] * 4)  # proportional losses


def test_family_of_policies(spark):
    rng = np.random.default_rng(4)
    days = [f"d{i:02d}" for i in range(12)]
    rows = [("good", d, 5, float(x)) for d, x in zip(days, rng.normal(10, 2, 12), strict=True)] + [("thin", "d03", 2, 1.0)]
    rows += [("even", d, 1, 2.0) for d in days] + [("none", d, 0, 0.0) for d in days[:3]]
    frame = spark.createDataFrame(rows, "name string, date string, fills long, pnl double")
    calendar = spark.createDataFrame([(d,) for d in days], "date string")
    got = {r["name"]: r for r in S.family_audit(frame, calendar, ["name"], 2000, 42).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"good": "estimable", "thin": "one_filled_date", "even": "zero_cluster_variance", "none": "zero_fills"}
    pnl = np.array([r[3] for r in rows[:12]])
    point = pnl.sum() / 60
    u = pnl - 5 * point
    se = u.std(ddof=1) / (np.sqrt(12) * 5)
    t = np.abs(S.flipped(np.arange(2000), 12, 42) @ u) / (np.sqrt(12) * u.std(ddof=1))
    want = [point, se, point - np.quantile(t, 0.95) * se, (1 + (t >= abs(point / se)).sum()) / 2001]
    assert [got["good"][c] for c in ("mean_bps", "se_bps", "lower_bps", "p_adjusted")] == pytest.approx(want)
    assert got["thin"]["mean_bps"] == 0.5 and got["thin"]["lower_bps"] is None and got["none"]["mean_bps"] is None


def test_separable_cells_and_single_outcomes_have_no_fit(spark):
    rows = [("a", -0.5, 0.0, 0, 10), ("a", 0.5, 0.0, 10, 0), ("b", 0.1, 0.0, 3, 0)]
    cells = spark.createDataFrame(rows, "spread_bucket string, queue_center double, ofi_center double, up_moves long, down_moves long")
    fits = M.fit_groups(cells, ["spread_bucket"], {"queue": M.MODELS["queue"]})
    assert [(r["spread_bucket"], r["converged"]) for r in fits.collect()] == [("a", False)]
    assert M.with_fits(cells.withColumn("date", F.lit("d")), fits, ["spread_bucket"]).count() == 0


def test_rolling_origins_are_months(spark):
    rng = np.random.default_rng(6)
    rows = [("all_spreads", f"2024-{m:02d}-{d:02d}", q / 10, f / 10, int(rng.integers(1, 9)), int(rng.integers(1, 9))) for m in range(1, 9) for d in (3, 17) for q in (-5, 5) for f in (-5, 5)]
    cells = spark.createDataFrame(rows, "spread_bucket string, date string, queue_center double, ofi_center double, up_moves long, down_moves long")
    train, test = E.expanding(cells, ["spread_bucket"], 6, "month")
    for origin in ("2024-07-01", "2024-08-01"):
        got = {(r["queue_center"], r["ofi_center"]): (r["up_moves"], r["down_moves"]) for r in train.where(F.col("origin") == origin).collect()}
        want = {(q / 10, f / 10): tuple(sum(r[i] for r in rows if r[1] < origin and r[2:4] == (q / 10, f / 10)) for i in (4, 5)) for q in (-5, 5) for f in (-5, 5)}
        assert got == want
    assert sorted({r["date"] for r in test.collect()}) == ["2024-07-03", "2024-07-17", "2024-08-03", "2024-08-17"]
    scored = E.rolling_scored(cells)
    folds = E.rolling_folds(scored).where("model = 'both'")
    assert [r["origin"] for r in folds.orderBy("origin").collect()] == ["2024-07-01", "2024-08-01"]
    s = E.stability_summary(folds).first()
    assert s["folds"] == 2 and 0 <= s["positive_folds"] <= 2 and s["least_improvement"] <= s["median_improvement"]
    got = {(r["challenger"], r["reference"], r["block"]): r for r in E.rolling_comparisons(scored, 500, 7, (1, 2)).collect()}
    assert len(got) == 8 and all(r["months"] == 2 and r["clusters"] == 4 for r in got.values())


POLICY = """
# scope
symbol=XYZ
year=2024
source_availability=licensed
maximum_session_end_gap_seconds=60
expected_delivered_sessions=4
expected_included_sessions=3
expected_development_sessions=1
expected_selection_sessions=1
expected_test_sessions=1
source_exclusion=2024-01-05
early_close=2024-01-03,46800
development_end=2024-01-02
selection_start=2024-01-03
selection_end=2024-01-03
test_start=2024-01-04
"""


def test_policy(spark):
    p = policy.parse(POLICY)
    assert p["symbol"] == "XYZ" and p.exclusions == ("2024-01-05",) and p.close_ns() == {"2024-01-03": 46_800_000_000_000}
    for bad in (POLICY + "year=2024", POLICY + "what=1", POLICY.replace("year=2024", ""), POLICY.replace("test_start=2024-01-04", "test_start=2024-01-01"), POLICY + "source_exclusion=2024-01-06"):
        with pytest.raises(C.ContractError):
            policy.parse(bad)
    with pytest.raises(C.ContractError):
        policy.require_scope(p, "ABC", 2024)
    dates = lambda *d: spark.createDataFrame([(f"2024-01-0{i}",) for i in d], "date string")
    C.require(policy.universe_violations(dates(2, 3, 4), p).where("rule <> 'boundaries_missing'"))
    with pytest.raises(C.ContractError, match="excluded_present"):
        C.require(policy.universe_violations(dates(2, 3, 5), p))


def test_streams(spark, tmp_path):
    mids = [5, 5, 7, 7, 6, 6, 6, 9]
    rows = spark.createDataFrame([("d", i, 10 * i, m) for i, m in enumerate(mids)], "date string, event_row long, ts_us long, m2 long")
    rows.where("event_row < 3").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    rows.where("event_row >= 3").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    query = counts.closed_spells(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(120)
    got = sorted((r["m2"], r["next_m2"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(5, 7), (6, 9), (7, 6)]


def test_catalogue_names():
    named, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalogue.QUERIES) <= set(named) and set(sql) <= set(named) and len(catalogue.QUERIES) >= 80

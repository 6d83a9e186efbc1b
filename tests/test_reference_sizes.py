"""Queries have the reference's horizons, scales and replicates; the permutation test against windows and NumPy."""

import numpy as np
import pytest

from tickforge.operators import persistence as H
from tickforge.operators import regression as R
from tickforge.operators import scores as S
from tickforge.operators import windows as W
from tickforge.plans import signals, trades


def test_sizes():
    assert len(trades.SCALING) == 28 and (trades.SCALING[0], trades.SCALING[-1]) == (10, 5000)
    assert trades.DFA == [16, 32, 64, 128, 256, 512, 1024] and trades.PERMUTATIONS == 199
    assert signals.REPLICATES == 10_000 and 100 in trades.HORIZONS


def test_permutation_test(spark):
    rng = np.random.default_rng(8)
    walk = np.cumprod(np.where(rng.random(1500) < 0.9, 1, -1))
    days = {"persistent": walk, "fair": rng.choice([-1, 1], 700), "short": [1] * 9}
    df = spark.createDataFrame([(d, i, int(s)) for d, signs in days.items() for i, s in enumerate(signs)], "date string, row0 long, sign int").repartition(5)
    got = {r["date"]: r for r in H.session_exponents(df, W.DFA_SCALES, 1, 199).where("exponent IS NOT NULL").collect()}
    want = {r["date"]: r["exponent"] for r in R.exponents(W.dfa_fluctuations(df, W.DFA_SCALES)).collect()}
    assert set(got) == {"persistent", "fair"}
    for d in got:
        assert got[d]["exponent"] == pytest.approx(want[d], abs=1e-9) and len(got[d]["nulls"]) == 199
    assert got["persistent"]["p_value"] == 1 / 200 and got["fair"]["p_value"] > 0.01  # 19 replicates stop at 0.05


def test_many_replicates_of_max_t(spark):
    rows = [(p, f"d{i:02d}", float(x)) for p, m in (("a", 0.0), ("b", 3.0)) for i, x in enumerate(np.random.default_rng(2).normal(m, 1, 12))]
    got = {r["policy"]: r for r in S.max_t(spark.createDataFrame(rows, "policy string, date string, x double"), 10_000, 17).collect()}
    assert got["b"]["p_adjusted"] < got["a"]["p_adjusted"] <= 1

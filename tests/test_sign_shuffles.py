"""Shuffled signs of long sessions and their fluctuations against plain versions."""

import time

import numpy as np
import pytest

from tickforge.operators import liquidity as L
from tickforge.operators import persistence as H
from tickforge.operators import scores as S


@pytest.mark.parametrize("n", [700, 40_000, S.PRIME - 1, S.PRIME, S.PRIME + 1, 2_500_000])
def test_order_of_long_sessions_is_that_of_a_sort(n):
    x = np.arange(n)
    for rep, seed in ((0, 42), (198, 42), (3, 7)):
        assert (H.shuffled(x, rep, seed) == x[np.argsort(S._mixed(np.array([rep]), x, seed)[0], kind="stable")]).all()


@pytest.mark.parametrize("scales", [[4, 10, 16, 128, 1000], [16, 48, 128, 1008]])  # single signs, whole units
def test_fluctuations_are_those_of_fitted_lines(scales):
    rng = np.random.default_rng(3)
    signs = np.stack([rng.choice([-1, 1], 5003), np.where(np.arange(5003) // 37 % 2, 1, -1)]).astype(np.int8)
    for row, got in zip(signs, L.log_fluctuations(signs, scales)[1], strict=True):
        y = np.cumsum(row - row.mean())
        for s, f in zip(scales, got, strict=True):
            k, i = len(y) // s, np.arange(s)
            parts = np.concatenate([y[: k * s].reshape(k, s), y[len(y) - k * s :].reshape(k, s)])
            rest = [np.mean((p - np.polyval(np.polyfit(i, p, 1), i)) ** 2) for p in parts]
            assert np.exp(f) == pytest.approx(np.sqrt(np.mean(rest)), rel=1e-9)
    assert np.isnan(L.sign_exponents(np.ones((1, 300), np.int8), [16, 32, 64])[0])


def test_a_drifting_session_has_the_exponent_of_its_steps():
    """A walk far from where it started loses no digits."""
    x = np.where(np.random.default_rng(1).random(100 * 29_952) < 0.9, 1, -1).astype(np.int8)
    whole = L.log_fluctuations(x[None], [16, 64])[1][0]
    parts = np.mean([np.exp(2 * L.log_fluctuations(p[None], [16, 64])[1][0]) for p in x.reshape(100, -1)], axis=0)
    assert np.exp(2 * whole) == pytest.approx(parts, rel=1e-9)


def test_shuffles_of_a_session_are_shared_out(spark):
    """Runs longer than one, more shuffles than a share, and sessions that are too short."""
    rng = np.random.default_rng(8)
    days = {"long": rng.choice([-1, 1], 9000), "short": rng.choice([-1, 1], 60), "level": np.ones(600, int)}
    rows = [(d, i, int(v)) for d, x in days.items() for i, v in enumerate(x)]
    rng.shuffle(rows)
    got = {r["date"]: r for r in H.session_exponents(spark.createDataFrame([(d, int(i), int(v)) for d, i, v in rows], "date string, row0 long, sign int"), [16, 32, 64], 100, 120, 5).collect()}
    x = days["long"]
    real = L.sign_exponents(x[None], [16, 32, 64])[0]
    nulls = [L.sign_exponents(H.shuffled(x, rep, 5)[None], [16, 32, 64])[0] for rep in range(120)]
    assert got["long"]["nulls"] == pytest.approx(nulls) and got["long"]["exponent"] == pytest.approx(real)
    assert got["long"]["p_value"] == (1 + sum(v >= real for v in nulls)) / 121 and got["long"]["trades"] == 9000
    assert [got[d]["included"] for d in ("short", "level")] == [False, True]
    assert all(got[d][c] is None for d in ("short", "level") for c in ("exponent", "p_value", "nulls"))


def test_time_of_a_shuffle_of_a_long_session():
    x = np.random.default_rng(2).choice(np.array([-1, 1], np.int8), 1_500_000)
    H.shuffled(x, 0, 42)
    def took(f):
        t = time.perf_counter()
        for rep in range(3):
            f(rep)
        return time.perf_counter() - t
    plain = took(lambda rep: x[np.argsort(S._mixed(np.array([rep]), np.arange(len(x)), 42)[0], kind="stable")])
    assert took(lambda rep: H.shuffled(x, rep, 42)) < plain / 2

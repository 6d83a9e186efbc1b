"""Economics of selected signals: fits on earlier sessions at no latency, cutoffs by share of signals, outcomes later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.operators import fits as M
from tickforge.operators import scores as S

MODELS = {m: M.MODELS[m] for m in ("queue", "ofi", "both")}


@dataclass(frozen=True)
class Outcomes:
    """What a kind of grid says about a signal that is acted on: the axes beside the cell, the count of
    signals that arrive in time, and the sums per execution, the result last."""

    axes: tuple[str, ...]
    arrived: str
    sums: tuple[str, ...]

    def columns(self) -> dict[str, Column]:
        side = lambda what: F.when(F.col("action") > 0, F.col(f"long_{what}")).otherwise(F.col(f"short_{what}"))
        if "shares" in self.axes:
            return {"executions": side("fills")} | {s: side(f"{s}_sum_bps") for s in self.sums}
        gross, half = F.col("action") * F.col("midpoint_move_sum_bps"), F.col("half_spread_sum_bps")
        return {"executions": F.col("executable"), "gross": gross, "half_spread": half, "net": gross - half}


MARKOUTS = Outcomes(("latency_us",), "executable", ("gross", "half_spread", "net"))
ROUND_TRIPS = Outcomes(("latency_us", "shares"), "arrived", ("move", "entry_cost", "exit_cost", "pnl"))
KEYS = ["spread_bucket"]


def origin(grid: DataFrame) -> DataFrame:
    """The cells that a fit sees: signals at no latency, of one share."""
    first = grid.where("latency_us = 0")
    return first.where("shares = 1") if "shares" in grid.columns else first


def signal_economics(grid: DataFrame, test_from: str, outcomes: Outcomes, fractions: list[float], replicates: int, seed: int) -> DataFrame:
    """A row per bucket, model, fraction and policy axis: the cutoff, the share of training signals it selects, signals,
    arrivals and executions on the test sessions, each sum per execution, and the interval of the result over resampled
    sessions. Policies without executions stay, with nulls. Buckets that lack an outcome on either side of the split are
    left out. The grid is small and read several times, so it should be a written table."""
    first, date = origin(grid), F.col("date")
    able = M.both_outcomes(first, KEYS, test_from)
    train = first.where(date < test_from).join(able, KEYS, "left_semi")
    fitted, by = M.fit_groups(train, KEYS, MODELS), [*KEYS, "model"]
    scored = M.with_fits(train, fitted, KEYS)
    cut = S.confidence_cutoffs(scored, by, fractions).withColumns({"cutoff": F.round("cutoff", M.PLACES), "fraction": F.round("fraction", 9)})
    weight = F.sum(F.col("up_moves") + F.col("down_moves"))
    achieved = S.selected(scored, cut, by).groupBy(*by, "fraction").agg(weight.alias("w")).join(scored.groupBy(*by).agg(weight.alias("all")), by)
    achieved = achieved.select(*by, "fraction", (F.col("w") / F.col("all")).alias("train_fraction"))
    later = grid.where(date >= test_from)
    chosen = S.selected(M.with_fits(later, fitted, KEYS), cut, by)
    policy, columns = [*by, "fraction", *outcomes.axes], outcomes.columns()
    daily = chosen.groupBy(*policy, "date").agg(
        F.sum("signals").alias("signals"), F.sum(outcomes.arrived).alias("arrived"), *[F.sum(c).alias(name) for name, c in columns.items()]
    )
    count = F.sum("executions")
    whole = daily.groupBy(*policy).agg(F.sum("signals").alias("signals"), F.sum("arrived").alias("arrived"), count.alias("executions"), *[F.when(count > 0, F.sum(s) / count).alias(f"{s}_bps") for s in outcomes.sums])
    intervals = M.keyed_intervals(daily, later, policy, outcomes.sums[-1], "executions", replicates, seed)
    every = cut.join(later.select(*KEYS, *outcomes.axes).distinct(), KEYS)
    zero = {"signals": 0, "arrived": 0, "executions": 0}
    out = every.join(achieved, [*by, "fraction"], "left").join(whole, policy, "left").fillna(zero).join(intervals.drop("block", "estimate"), policy, "left")
    return out.select(*policy, "cutoff", "train_fraction", "signals", "arrived", "executions", *[f"{s}_bps" for s in outcomes.sums], F.when(F.col("executions") > 0, F.col("clusters")).alias("clusters"), "lower", "median", "upper", "share_not_positive")


def direction_scores(grid: DataFrame, test_from: str, replicates: int, seed: int) -> DataFrame:
    """Scores of each model's direction on the test sessions at no latency, and its improvement on the training share of
    up moves with an interval."""
    first, date = origin(grid), F.col("date")
    able = M.both_outcomes(first, KEYS, test_from)
    train, test = (first.where(c).join(able, KEYS, "left_semi") for c in (date < test_from, date >= test_from))
    scored = M.with_fits(test, M.fit_groups(train, KEYS, {"intercept": ()} | MODELS), KEYS)
    pairs = tuple((m, "intercept") for m in MODELS)
    gains = M.comparisons(M.daily_losses(scored, KEYS), test, KEYS, replicates, seed, pairs).withColumnRenamed("challenger", "model")
    return M.model_scores(scored, KEYS).join(gains.drop("reference", "block"), [*KEYS, "model"])

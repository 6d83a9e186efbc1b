"""Chronological evaluations over grids: fits on earlier sessions, scores and economics on later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.operators import contracts as C
from tickforge.operators import fits as M
from tickforge.operators import scores as S

MODELS = {name: list(features) for name, features in M.MODELS.items()}
POLICY = ["spread_bucket", "latency_us", "shares", "fraction"]
KEYS = ["spread_bucket"]


def logit_table(cells: DataFrame, model: str = "both") -> DataFrame:
    """spread_bucket, feature, coefficient of one model's fit per bucket."""
    fits = M.fit_groups(cells, KEYS, {model: M.MODELS[model]})
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).alias("coefficient")) for f, c in (("intercept", "intercept"), ("queue_center", "queue"), ("ofi_center", "ofi"))])
    return fits.withColumn("e", F.explode(each)).select(*KEYS, "e.*").where("coefficient IS NOT NULL")


def evaluate_models(cells: DataFrame, test_from: str, models: dict[str, tuple[str, ...]], keys: list[str] = KEYS) -> DataFrame:
    """Scores on the test sessions per group and model, each fitted on its group's sessions before; all groups at once."""
    date = F.col("date")
    able = M.both_outcomes(cells, keys, test_from)
    train, test = (cells.where(c).join(able, keys, "left_semi") for c in (date < test_from, date >= test_from))
    return M.model_scores(M.with_fits(test, M.fit_groups(train, keys, models), keys), keys)


def compare_models(cells: DataFrame, test_from: str, replicates: int, seed: int, pairs: tuple[tuple[str, str], ...] = M.PAIRS, keys: list[str] = KEYS) -> DataFrame:
    """Relative Brier improvement of model pairs per group, with intervals from resampled test sessions."""
    date = F.col("date")
    able = M.both_outcomes(cells, keys, test_from)
    train, test = (cells.where(c).join(able, keys, "left_semi") for c in (date < test_from, date >= test_from))
    scored = M.with_fits(test, M.fit_groups(train, keys, {m: M.MODELS[m] for pair in pairs for m in pair}), keys)
    return M.comparisons(M.daily_losses(scored, keys), test, keys, replicates, seed, pairs).drop("block")


def evaluate_grids(grids: DataFrame, test_from: str, replicates: int, seed: int) -> DataFrame:
    """Whether the comparison changes with the resolution: scores and the improvement on the intercept per grid, bucket and
    model, joined one to one. grids: cells with ``grid_bins_per_axis``."""
    keys = ["grid_bins_per_axis", *KEYS]
    own = evaluate_models(grids, test_from, M.MODELS, keys)
    gains = compare_models(grids, test_from, replicates, seed, tuple(p for p in M.PAIRS if p[1] == "intercept"), keys)
    gains = gains.withColumnRenamed("challenger", "model").drop("reference", "clusters", "replicates")
    return own.join(gains, [*keys, "model"])


def queue_calibration(cells: DataFrame, test_from: str) -> DataFrame:
    """Per bucket and bin of the test sessions: the queue model's probability beside the share of up moves."""
    date = F.col("date")
    able = M.both_outcomes(cells, KEYS, test_from)
    fits = M.fit_groups(cells.where(date < test_from).join(able, KEYS, "left_semi"), KEYS, {"queue": M.MODELS["queue"]})
    scored = M.with_fits(cells.where(date >= test_from), fits, KEYS)
    n = F.sum(F.col("up_moves") + F.col("down_moves"))
    return scored.groupBy(*KEYS, "queue_center").agg(n.alias("n"), F.sum("up_moves").alias("up_moves"), F.max("p").alias("predicted"), (F.sum("up_moves") / n).alias("observed"))


HORIZON = ["horizon_kind", "horizon_value"]
HORIZON_MODELS = {m: M.MODELS[m] for m in ("ofi", "both")}


def select_horizon(grid: DataFrame, selection_from: str, test_from: str, replicates: int, seed: int) -> DataFrame:
    """Per bucket and model a row per horizon: its Brier score on the selection sessions after a fit on those before. The
    fixed horizon with the least score (ties: quote updates before clock, then the shorter) is chosen; it and the price
    spell, the adaptive reference, are fitted on all sessions before the test and scored there, with the chosen one's
    improvement on the share of up moves and on the price spell. Other horizons have no test values. The grid is read
    several times, so it should be a written table."""
    date, keys, by = F.col("date"), [*KEYS, *HORIZON], [*KEYS, *HORIZON, "model"]
    models = {"intercept": ()} | HORIZON_MODELS
    early, middle, late = grid.where(date < selection_from), grid.where((date >= selection_from) & (date < test_from)), grid.where(date >= test_from)
    chosen_by = S.binary_scores(M.with_fits(middle, M.fit_groups(early, keys, HORIZON_MODELS), keys), by).select(*by, F.round("brier", M.PLACES).alias("selection_brier"))
    kind = F.when(F.col("horizon_kind") == "price_spell", 0).when(F.col("horizon_kind") == "quote_updates", 1).otherwise(2)
    fixed = chosen_by.where("horizon_kind <> 'price_spell'")
    best = fixed.groupBy(*KEYS, "model").agg(F.min_by(F.struct(*HORIZON), F.struct("selection_brier", kind, "horizon_value")).alias("h")).select(*KEYS, "model", "h.*", F.lit(True).alias("chosen"))
    scored = M.with_fits(late, M.fit_groups(grid.where(date < test_from), keys, models), keys)
    # the chosen horizon with its baseline, and the price spell, as models of one group for the comparisons
    groups = [*KEYS, "selected_model"]
    losses = M.daily_losses(scored, keys)
    own = best.withColumnRenamed("model", "selected_model").drop("chosen")
    taken = lambda rows, label: rows.select(*groups, "date", "loss", F.lit(label).alias("model"))
    mine = losses.join(own, keys)
    spell = losses.where("horizon_kind = 'price_spell'").drop(*HORIZON).join(own.drop(*HORIZON), KEYS)
    same = F.col("model") == F.col("selected_model")
    three = taken(mine.where(same), "chosen").unionByName(taken(mine.where("model = 'intercept'"), "baseline")).unionByName(taken(spell.where(same), "price_spell"))
    gains = M.comparisons(three, late, groups, replicates, seed, (("chosen", "baseline"), ("chosen", "price_spell")))
    part = lambda name, c: F.max(F.when(F.col("reference") == name, F.col(c))).alias(f"{name}_{c}")
    gains = gains.groupBy(*groups).agg(*[part(n, c) for n in ("baseline", "price_spell") for c in ("estimate", "lower", "upper")]).withColumnRenamed("selected_model", "model")
    tested = S.binary_scores(scored.where("model <> 'intercept'"), by).select(*by, F.col("brier").alias("test_brier"))
    out = chosen_by.join(best, by, "left").join(tested, by, "left").join(gains, [*KEYS, "model"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    kept = F.col("chosen") | (F.col("horizon_kind") == "price_spell")
    shown = [c for c in gains.columns if c not in (*KEYS, "model")]
    return out.select(*by, "selection_brier", "chosen", F.when(kept, F.col("test_brier")).alias("test_brier"), *[F.when(F.col("chosen"), F.col(c)).alias(c) for c in shown])


def expanding(cells: DataFrame, keys: list[str], first: int, unit: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): for each unit of time after the first ``first`` ones, an ``origin``, the cells of all units before,
    summed, and its own cells by session. One scan: a cell's sums run along the units, so more origins read nothing twice.
    A cell has a row for each unit at most."""
    cells = cells.withColumn("origin", F.date_format(F.date_trunc(unit, F.to_date("date")), "yyyy-MM-dd"))
    cell = [*keys, *M.FEATURES]
    per = cells.groupBy(*cell, "origin").agg(F.sum("up_moves").alias("up_moves"), F.sum("down_moves").alias("down_moves"))
    origins = cells.select("origin").distinct().withColumn("unit", F.row_number().over(Window.orderBy("origin")))  # a row per unit
    later = Window.partitionBy(*cell).orderBy("origin").rowsBetween(Window.unboundedPreceding, -1)
    every = per.select(*cell).distinct().crossJoin(F.broadcast(origins.where(F.col("unit") > first))).join(per, [*cell, "origin"], "left")
    before = per.join(origins.where(F.col("unit") <= first), "origin").groupBy(*cell).agg(F.sum("up_moves").alias("up_first"), F.sum("down_moves").alias("down_first"))
    summed = every.join(before, cell, "left")
    for c, name in (("up_moves", "up_first"), ("down_moves", "down_first")):
        summed = summed.withColumn(c, F.coalesce(F.sum(c).over(later), F.lit(0)) + F.coalesce(name, F.lit(0)))
    train = summed.where("up_moves + down_moves > 0").select(*cell, "origin", "up_moves", "down_moves")
    return train, cells.join(F.broadcast(origins.where(F.col("unit") > first)), "origin").drop("unit")


STABILITY_PAIRS = (("queue", "intercept"), ("ofi", "intercept"), ("both", "intercept"), ("both", "ofi"))


def rolling_scored(cells: DataFrame, first: int = 6, unit: str = "month") -> DataFrame:
    """The cells after the first months with each model's probability from a fit on all sessions before the month."""
    keys = [*KEYS, "origin"]
    train, test = expanding(cells, KEYS, first, unit)
    return M.with_fits(test, M.fit_groups(train, keys), keys)


def rolling_folds(scored: DataFrame) -> DataFrame:
    """Scores per bucket, origin and model, and the reduction of squared loss against the intercept."""
    by = [*KEYS, "origin", "model"]
    scores = M.model_scores(scored, [*KEYS, "origin"])
    base = scores.where("model = 'intercept'").select(*KEYS, "origin", F.col("brier").alias("base"))
    return scores.join(base, [*KEYS, "origin"]).select(*by, "n", "brier", "log_loss", "accuracy", "auc", (1 - F.col("brier") / F.col("base")).alias("improvement"))


def rolling_comparisons(scored: DataFrame, replicates: int, seed: int, blocks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per bucket, pair and block length: the improvement over all evaluated sessions with an interval from circular blocks
    of sessions, and how many of the months improve."""
    losses = M.daily_losses(scored, KEYS)
    intervals = M.comparisons(losses, scored, KEYS, replicates, seed, STABILITY_PAIRS, blocks)
    monthly = scored.groupBy(*KEYS, "model", F.col("origin").alias("date")).agg(S.squared_loss("p").alias("loss"))
    names = [*KEYS, "challenger", "reference"]
    months = M.paired(monthly, KEYS, STABILITY_PAIRS).groupBy(*names).agg(F.count_if(F.col("challenger_loss") < F.col("reference_loss")).alias("positive_months"), F.count("*").alias("months"))
    return intervals.join(months, names)


def stability_summary(folds: DataFrame) -> DataFrame:
    """Per bucket and model over the folds: their number, how many improve, the improvement pooled by sums of loss, and the
    worst and median one."""
    base = F.col("brier") / (1 - F.col("improvement"))
    pooled = 1 - F.sum(F.col("brier") * F.col("n")) / F.sum(base * F.col("n"))
    return folds.groupBy(*KEYS, "model").agg(
        F.count("*").alias("folds"), F.count_if(F.col("improvement") > 0).alias("positive_folds"), pooled.alias("pooled_improvement"),
        F.min("improvement").alias("least_improvement"), F.percentile("improvement", 0.5).alias("median_improvement"),
    )


def stability_violations(grid: DataFrame, buckets: tuple[str, ...] = ("all_spreads", "one_tick")) -> DataFrame:
    """Of a landmark grid: counts that are negative or don't add up, cells twice at no latency, buckets that lack it."""
    c = F.col
    own = C.count_violations(grid, {"moves_match": c("signals") != c("up_moves") + c("down_moves"), "negative_counts": F.least("signals", "up_moves", "down_moves") < 0})
    zero = grid.where("latency_us = 0")
    twice = C.duplicate_keys(zero, ["date", "spread_bucket", "queue_bin", "ofi_bin"]).agg(F.count("*").alias("violations")).select(F.lit("duplicate_cells").alias("rule"), "violations")
    missing = zero.agg(F.sum(F.lit(0)).alias("none"), *[(F.count_if(c("spread_bucket") == b) == 0).cast("long").alias(b) for b in buckets])
    missing = missing.select(F.lit("missing_buckets").alias("rule"), sum((F.col(b) for b in buckets), F.lit(0)).cast("long").alias("violations"))
    return own.unionByName(twice).unionByName(missing)


def markout_economics(chosen: DataFrame) -> DataFrame:
    """Per bucket, latency and fraction: move in favour, half the spread paid and what remains, per executed signal."""
    gross, cost = F.sum(F.col("action") * F.col("midpoint_move_sum_bps")), F.sum("half_spread_sum_bps")
    n = F.sum("executable")
    per = lambda c: F.when(n > 0, c / n)
    return chosen.groupBy("spread_bucket", "latency_us", "fraction").agg(
        F.sum("signals").alias("signals"), n.alias("executable"), F.sum("stale").alias("stale"), per(gross).alias("gross_bps"), per(cost).alias("half_spread_bps"), per(gross - cost).alias("net_bps")
    )


def policy_days(chosen: DataFrame) -> DataFrame:
    """Signals, fills and profit per policy and session, on the side that the action takes."""
    side = lambda what: F.sum(F.when(F.col("action") > 0, F.col(f"long_{what}")).otherwise(F.col(f"short_{what}")))
    return chosen.groupBy(*POLICY, "date").agg(F.sum("signals").alias("signals"), side("fills").alias("fills"), side("pnl_sum_bps").alias("pnl"))


def policy_table(days: DataFrame) -> DataFrame:
    fills = F.sum("fills")
    return days.groupBy(*POLICY).agg(F.sum("signals").alias("signals"), fills.alias("fills"), F.when(fills > 0, F.sum("pnl") / fills).alias("pnl_bps"), F.count_if(F.col("fills") > 0).alias("filled_dates"))


def best_policy(table: DataFrame) -> DataFrame:
    return table.where("fills > 0").orderBy(F.desc("pnl_bps"), *POLICY).limit(1)


def missing_policies(table: DataFrame) -> DataFrame:
    """Combinations of the policy axes that the table lacks; the axes have a few values each."""
    full = None
    for c in POLICY:
        axis = table.select(c).distinct()
        full = axis if full is None else full.crossJoin(axis)
    return full.join(table.select(*POLICY), POLICY, "left_anti")


def policy_violations(table: DataFrame) -> DataFrame:
    c = F.col
    return C.count_violations(
        table,
        {
            "more_fills_than_signals": c("fills") > c("signals"),
            "null_iff_no_fills": (c("fills") == 0) != c("pnl_bps").isNull(),
            "dates_without_fills": (c("filled_dates") == 0) != (c("fills") == 0),
        },
    )


METRIC_KEYS = ["spread_bucket", "model", "target_train_fraction", "latency_us", "shares"]
#: What a stored mean may differ by from the reconstructed one, relative and absolute.
PROFIT_TOLERANCE = 1e-10


def metrics_violations(metrics: DataFrame) -> DataFrame:
    """Of stored policy metrics: policies twice or missing from the complete grid, dates and clusters that differ, counts
    out of order, and means that are there without fills or lack with them."""
    c, shared = F.col, ("test_first_date", "test_last_date", "clusters")
    mean, fills = c("quoted_round_trip_mean_bps"), c("filled_round_trips")
    own = C.count_violations(
        metrics,
        {
            "arrived_beyond_selected": c("arrived_test_signals") > c("selected_test_signals"),
            "filled_beyond_arrived": fills > c("arrived_test_signals"),
            "null_iff_no_fills": (fills == 0) != mean.isNull(),
            "too_few_clusters": c("clusters") < 2,
        },
    )
    twice = C.duplicate_keys(metrics, METRIC_KEYS).agg(F.count("*").alias("violations")).select(F.lit("duplicate_policies").alias("rule"), "violations")
    axes = metrics.agg(*[F.count_distinct(k).alias(k) for k in METRIC_KEYS], F.count_distinct(*METRIC_KEYS).alias("there"), *[F.count_distinct(k).alias(f"n_{k}") for k in shared])
    full = F.lit(1).cast("long")
    for k in METRIC_KEYS:
        full = full * F.col(k)
    differ = sum((F.when(F.col(f"n_{k}") > 1, 1).otherwise(0) for k in shared), F.lit(0)).cast("long")
    rest = axes.select(F.explode(F.array(F.struct(F.lit("missing_policies").alias("rule"), (full - F.col("there")).alias("violations")), F.struct(F.lit("dates_differ").alias("rule"), differ.alias("violations")))).alias("r")).select("r.*")
    return own.unionByName(twice).unionByName(rest)


def stored_policy_days(test: DataFrame, metrics: DataFrame) -> DataFrame:
    """METRIC_KEYS, date, signals, arrived, fills, pnl: every stored policy's outcome by session, from its coefficients and
    cutoff over the cells of its bucket, latency and size. test: cells of the test sessions."""
    own = metrics.select(*METRIC_KEYS, "confidence_cutoff", F.col("intercept").alias("b0"), F.coalesce("queue_coefficient", F.lit(0.0)).alias("b1"), F.coalesce("ofi_coefficient", F.lit(0.0)).alias("b2"))
    rows = test.join(own, ["spread_bucket", "latency_us", "shares"])
    rows = rows.withColumn("p", 1.0 / (1.0 + F.exp(-(F.col("b0") + F.col("b1") * F.col("queue_center") + F.col("b2") * F.col("ofi_center")))))
    conf = F.abs(F.col("p") - 0.5)
    rows = rows.where((conf >= F.col("confidence_cutoff")) | (F.abs(conf - F.col("confidence_cutoff")) <= S.EPS))
    side = lambda what: F.when(F.col("p") >= 0.5, F.col(f"long_{what}")).otherwise(F.col(f"short_{what}"))
    return rows.groupBy(*METRIC_KEYS, "date").agg(F.sum("signals").alias("signals"), F.sum("arrived").alias("arrived"), F.sum(side("fills")).alias("fills"), F.sum(side("pnl_sum_bps")).alias("pnl"))


def reconstruction(days: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row per policy of either side: whether its counts and its mean are those stored. A policy that selects nothing has
    no days, and counts as zero."""
    whole = days.groupBy(*METRIC_KEYS).agg(*[F.sum(c).alias(c) for c in ("signals", "arrived", "fills", "pnl")])
    both = whole.join(metrics.select(*METRIC_KEYS, "selected_test_signals", "arrived_test_signals", "filled_round_trips", "quoted_round_trip_mean_bps", F.lit(True).alias("stored")), METRIC_KEYS, "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    counts = (n("signals") == n("selected_test_signals")) & (n("arrived") == n("arrived_test_signals")) & (n("fills") == n("filled_round_trips"))
    mean = F.col("pnl") / F.when(F.col("fills") > 0, F.col("fills"))
    stored = F.col("quoted_round_trip_mean_bps")
    near = F.coalesce(F.abs(mean - stored) <= PROFIT_TOLERANCE + PROFIT_TOLERANCE * F.abs(stored), mean.isNull() & stored.isNull())
    return both.select(*METRIC_KEYS, counts.alias("counts_match"), near.alias("profit_matches"), F.coalesce("stored", F.lit(False)).alias("stored"))


def reconstruction_violations(days: DataFrame, metrics: DataFrame) -> DataFrame:
    return C.count_violations(reconstruction(days, metrics), {"counts_differ": ~F.col("counts_match"), "profit_differs": ~F.col("profit_matches"), "not_stored": ~F.col("stored")})


def calendar_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sessions of the left calendar only, and of both."""
    only = left.exceptAll(right).select(F.lit("left_only").alias("side"), "date")
    return only.unionByName(left.intersect(right).select(F.lit("both").alias("side"), "date"))

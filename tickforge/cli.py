"""Command line: ``python -m tickforge.cli VERB ...``. Every verb reads with Spark and writes tables to a folder.

Verbs that start from raw session pairs take --raw-dir; the analyses take events written by ``prepare-events``; the
evaluations also take the grid they need from a file (--bins PATH, or --bins N=PATH for each of several resolutions), as
``replay --format csv`` writes it. Given a policy, every verb first checks its scope and calendar against the data.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.operators import audit as A
from tickforge.operators import contracts as C
from tickforge.operators import economics as N
from tickforge.operators import evaluate as E
from tickforge.operators import fits as M
from tickforge.operators import grids as G
from tickforge.operators import liquidity as L
from tickforge.operators import orders as O
from tickforge.operators import persistence as H
from tickforge.operators import regression as R
from tickforge.operators import scores as S
from tickforge.operators import spells as P
from tickforge.operators import windows as W
from tickforge.plans.books import transitions
from tickforge.session import session
from tickforge.sources import grids as X
from tickforge.sources import policy as Y
from tickforge.sources import raw
from tickforge.sources.policy import Policy, parse
from tickforge.sources.settle import settled

BINS, QUEUE_BINS = 31, 101
UPDATES, CLOCKS = [1, 5, 20, 100], [10, 100, 1000, 10_000]
LATENCIES, AGE, SIZES = [0, 10, 100, 1000, 10_000], 100, [1, 100, 500]
FRACTIONS = [1.0, 0.2, 0.1, 0.05]
REPLICATES, SEED = 10_000, 42
GRIDS = (21, 31, 41)


def trades_of(orders: DataFrame) -> DataFrame:
    """Market orders as trades: date, row0, size, sign, mid_raw."""
    return orders.select(
        "date", (F.row_number().over(W.Window.partitionBy("date").orderBy("first_event_row")) - 1).cast("long").alias("row0"), "size",
        F.col("trade_sign").alias("sign"), (F.col("midpoint_twice_before_raw") / 2).cast("long").alias("mid_raw"),
    )


def scaling_trades(transactions: DataFrame) -> DataFrame:
    """Transactions of visible and hidden executions, signed against the midpoint before, as trades: date, row0, size, sign,
    mid_raw (twice the mid, as its log steps are those of the mid)."""
    place = F.row_number().over(W.Window.partitionBy("date").orderBy("first_event_row")) - 1
    return transactions.select("date", place.cast("long").alias("row0"), "size", F.col("trade_sign").alias("sign"), F.round(20_000 * F.col("mid_price_before")).cast("long").alias("mid_raw"))


class Run:
    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args
        self.policy: Policy | None = parse("\n".join(r[0] for r in spark.read.text(args.analysis_policy).collect())) if args.analysis_policy else None
        if self.policy and (args.symbol or args.year):
            Y.require_scope(self.policy, args.symbol or self.policy["symbol"], args.year or self.policy["year"])

    def events(self) -> DataFrame:
        """Events up to the close of each session. Given a policy, their symbol and calendar must be its."""
        p = self.policy
        if self.args.raw_dir:
            found = raw.read_sessions(self.spark, self.args.raw_dir, self.args.symbol or (p["symbol"] if p else None), self.args.year or (p["year"] if p else None), p.exclusions if p else (), p.close_ns() if p else None)
        else:
            found = self.spark.read.parquet(self.args.events).withColumn("date", F.col("date").cast("string"))
        if p:
            if "symbol" in found.columns:
                for r in found.select("symbol").distinct().limit(2).collect():
                    Y.require_scope(p, r["symbol"], p["year"])
            C.require(Y.universe_violations(found.select("date"), p))
        return found

    def flow(self) -> DataFrame:
        return P.with_flow(self.events())

    def lab(self) -> DataFrame:
        return P.labelled(self.flow())

    def test_from(self) -> str:
        if not (self.args.test_start or self.policy):
            raise C.ContractError("--test-start or --analysis-policy is needed")
        return self.args.test_start or self.policy["test_start"]

    def selection_from(self) -> str:
        if not (self.args.selection_start or self.policy):
            raise C.ContractError("--selection-start or --analysis-policy is needed")
        return self.args.selection_start or self.policy["selection_start"]

    def checked(self, grid: DataFrame) -> DataFrame:
        """The grid, written once, if its sessions are the policy's and its test sessions exist and aren't the first."""
        grid = settled(grid)
        if self.policy:
            C.require(Y.universe_violations(grid.select("date"), self.policy))
        if self.args.test_start or self.policy:
            W.require_boundary(grid, self.test_from())
        return grid

    def grid(self, kind: str, made: Callable[[], DataFrame], *contracts: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The grid of --bins, or else made from the events; its contracts are checked either way."""
        grid = self.checked(X.read_grid(self.spark, self.args.bins[0], kind) if self.args.bins else made())
        for contract in contracts:
            C.require(contract(grid))
        return grid

    def flow_cells(self) -> DataFrame:
        grid = self.grid("order_flow", lambda: G.order_flow_bins(self.lab(), BINS), lambda g: C.cell_violations(g, ["date", "sample", "spread_bucket", "queue_bin", "ofi_bin"]))
        return grid.where(F.col("sample") == "best_quote_updates")

    def queue_cells(self) -> DataFrame:
        grid = self.grid("queue", lambda: G.queue_bins(self.lab(), QUEUE_BINS), lambda g: C.cell_violations(g, ["date", "sample", "spread_bucket", "bin"]))
        return grid.where(F.col("sample") == "best_quote_updates").withColumnRenamed("bin_center", "queue_center").withColumn("ofi_center", F.lit(0.0))

    def several(self) -> DataFrame:
        if self.args.bins:
            if len(self.args.bins) < 2:
                raise C.ContractError("at least two grids N=PATH are needed")
            grids = X.read_grids(self.spark, self.args.bins, "order_flow")
        else:
            lab = self.lab()
            grids = reduce(DataFrame.unionByName, [G.order_flow_bins(lab, n).withColumn("grid_bins_per_axis", F.lit(n)) for n in GRIDS])
        grids = self.checked(grids)
        C.require(C.cell_violations(grids, ["grid_bins_per_axis", "date", "sample", "spread_bucket", "queue_bin", "ofi_bin"]))
        return grids.where(F.col("sample") == "best_quote_updates")

    def horizons(self) -> DataFrame:
        return self.grid("horizon", lambda: G.horizon_bins(self.lab(), BINS, UPDATES, CLOCKS), C.horizon_violations)

    def markouts(self) -> DataFrame:
        return self.grid("markout", lambda: G.markout_bins(self.lab(), BINS, LATENCIES), C.markout_violations)

    def landmarks(self) -> DataFrame:
        return self.grid("landmark", lambda: G.landmark_bins(G.landmarks(self.lab(), AGE, LATENCIES), BINS), C.markout_violations)

    def trips(self) -> DataFrame:
        return self.grid("round_trip", lambda: G.round_trip_bins(G.round_trips(G.landmarks(P.labelled(self.flow(), exits=True), AGE, LATENCIES), SIZES), BINS), C.round_trip_violations)


def coverage(r: Run) -> dict[str, DataFrame]:
    """Every delivered session, excluded ones too. Given a policy, a calendar that isn't its stops the verb, unless
    --lenient is given."""
    p = r.policy
    gap = p["maximum_session_end_gap_seconds"] if p else 60
    if r.args.raw_dir:
        events = raw.read_sessions(r.spark, r.args.raw_dir, r.args.symbol or (p["symbol"] if p else None), r.args.year or (p["year"] if p else None), (), p.close_ns() if p else None, after_close=True)
    else:
        events = r.spark.read.parquet(r.args.events).withColumns({"date": F.col("date").cast("string"), "close_us": F.lit(57_600 * 1_000_000)})
    sessions = settled(C.session_coverage(events, F.col("close_us"), gap * 1_000_000, list(p.exclusions) if p else []))
    if p and not r.args.lenient:
        C.require(Y.coverage_violations(sessions, p))
    return {"session_coverage": sessions, "coverage_gate": C.coverage_gate(sessions)}


def replay(r: Run) -> dict[str, DataFrame]:
    """The audit, which must reconcile unless --lenient is given, and the six grids as their files."""
    flow = settled(r.flow())
    lab = settled(P.labelled(flow, exits=True))
    sessions = settled(A.replay_audit(flow))
    totals = A.audit_totals(sessions)
    if not r.args.lenient:
        C.require(A.audit_violations(totals))
    marks = settled(G.landmarks(lab, AGE, LATENCIES))
    grids = {
        "queue": G.queue_bins(lab, QUEUE_BINS),
        "order_flow": G.order_flow_bins(lab, BINS),
        "horizon": G.horizon_bins(lab, BINS, UPDATES, CLOCKS),
        "markout": G.markout_bins(lab, BINS, LATENCIES),
        "landmark": G.landmark_bins(marks, BINS),
        "round_trip": G.round_trip_bins(G.round_trips(marks, SIZES), BINS),
    }
    transit = transitions(flow).groupBy("verdict", "event_type").agg(F.count("*").alias("events"))
    return {"replay_sessions": sessions, "replay_audit": totals, "transitions": transit} | {f"{k}_bins": X.as_file(g, k, AGE) for k, g in grids.items()}


def analyze(r: Run) -> dict[str, DataFrame]:
    trades = trades_of(O.visible_orders(r.flow())).persist()
    windows = W.prediction_windows(trades, [5, 10, 20, 50, 100])
    if r.args.test_start:
        W.require_boundary(trades, r.args.test_start)
    split = W.with_split(W.impact_features(windows.where("horizon = 10")), test_start=r.args.test_start)
    contributions = R.nested_contributions(split, "impact_cents")
    fits = R.simple_fit(split, "volume_imbalance", "impact_cents")
    test = R.with_prediction(split.where("is_test"), fits, "volume_imbalance")
    scaling = settled(W.scaling_windows(scaling_trades(O.regular_hours(O.scaling_transactions(r.flow()))), W.SCALING_HORIZONS))
    lambdas = R.kyle_lambdas(windows)
    return {
        "impact_curve": W.quantile_curve(windows, ["horizon"], "volume_imbalance", "impact", 51),
        "models": R.model_table(split, "impact_cents"),
        "model_contributions": contributions,
        "model_intervals": S.model_intervals(contributions, 10_000, 42),
        "calibration": W.quantile_curve(test, ["is_test"], "fitted", "impact_cents", 20),
        "residuals_by_count": R.residuals_by_count(test, "order_flow_imbalance", "impact_cents", "fitted"),
        "monthly_scores": test.groupBy(F.substring("date", 1, 7).alias("month")).agg(*R.scores("impact_cents", "fitted")),
        "walk_forward": R.walk_forward(split, "volume_imbalance", "impact_cents", 5, 0.4),
        "scaling_curve": W.quantile_curve(scaling, ["horizon"], "q", "impact_log", 31),
        "volume_curve_scales": R.volume_curve_scales(W.quantile_curve(scaling, ["horizon"], "q", "impact_log", 31)),
        "kyle_lambdas": lambdas,
        "kyle_decay": R.kyle_decay(lambdas),
    }


def economics(r: Run, grid: DataFrame, outcomes: N.Outcomes) -> dict[str, DataFrame]:
    metrics = settled(N.signal_economics(grid, r.test_from(), outcomes, FRACTIONS, REPLICATES, SEED))
    return {"metrics": metrics, "direction": N.direction_scores(grid, r.test_from(), REPLICATES, SEED)}


def policy_audit(r: Run) -> dict[str, DataFrame]:
    """The whole family on the test sessions: policies as given by --metrics, each reconstructed and compared with them, or
    else a fit and cutoffs on the sessions before the test."""
    grid = r.trips()
    test = grid.where(F.col("date") >= r.test_from())
    if r.args.metrics:
        metrics = settled(X.read_grid(r.spark, r.args.metrics, "policy_metrics"))
        C.require(E.metrics_violations(metrics))
        days = settled(E.stored_policy_days(test, metrics))
        C.require(E.reconstruction_violations(days, metrics))
        days = days.groupBy(*E.METRIC_KEYS, "date").agg(F.sum("fills").alias("fills"), F.sum("pnl").alias("pnl"))
        return {"policy_audit": S.family_audit(days, test.select("date"), E.METRIC_KEYS, REPLICATES, SEED)}
    first = N.origin(grid).where(F.col("date") < r.test_from())
    fitted = M.fit_groups(first, E.KEYS, {"both": M.MODELS["both"]})
    cut = S.confidence_cutoffs(M.with_fits(first, fitted, E.KEYS).drop("model"), E.KEYS, FRACTIONS)
    days = E.policy_days(S.selected(M.with_fits(test, fitted, E.KEYS).drop("model"), cut, E.KEYS))
    table = E.policy_table(days)
    C.require(E.policy_violations(table))
    return {"policy_audit": S.family_audit(days, test.select("date"), E.POLICY, REPLICATES, SEED), "missing_policies": E.missing_policies(table)}


def stability(r: Run) -> dict[str, DataFrame]:
    grid = r.landmarks()
    C.require(E.stability_violations(grid))
    scored = settled(E.rolling_scored(grid.where("latency_us = 0 AND spread_bucket IN ('all_spreads', 'one_tick')")))
    folds = E.rolling_folds(scored)
    return {"folds": folds, "overall": M.model_scores(scored, E.KEYS), "comparisons": E.rolling_comparisons(scored, REPLICATES, SEED), "summary": E.stability_summary(folds)}


def queue(r: Run) -> dict[str, DataFrame]:
    cells, models = r.queue_cells(), {m: M.MODELS[m] for m in ("intercept", "queue")}
    return {
        "metrics": E.evaluate_models(cells, r.test_from(), models), "comparisons": E.compare_models(cells, r.test_from(), REPLICATES, SEED, (("queue", "intercept"),)),
        "calibration": E.queue_calibration(cells, r.test_from()),
    }


def order_flow(r: Run) -> dict[str, DataFrame]:
    cells = r.flow_cells()
    return {"metrics": E.evaluate_models(cells, r.test_from(), M.MODELS), "comparisons": E.compare_models(cells, r.test_from(), REPLICATES, SEED), "coefficients": M.fit_groups(cells.where(F.col("date") < r.test_from()), E.KEYS)}


def liquidity(r: Run) -> dict[str, DataFrame]:
    orders = O.visible_orders(r.flow()).persist()
    C.require(L.order_violations(orders))
    tables = L.asymmetric_liquidity(orders, r.test_from())
    gate = tables["prediction"].where(F.col("block_length") == 5).select(F.lit("signs_not_predicted").alias("rule"), (F.col("estimate") <= 0).cast("long").alias("violations"))
    C.require(gate)
    return tables


VERBS: dict[str, Callable[[Run], dict[str, DataFrame]]] = {
    "prepare-events": lambda r: {"events": r.events()},
    "prepare-visible": lambda r: {"visible_orders": O.visible_orders(r.flow())},
    "prepare-scaling": lambda r: {"scaling_transactions": O.scaling_transactions(r.flow())},
    "audit-session-coverage": coverage,
    "replay": replay,
    "analyze": analyze,
    "analyze-sign-persistence": lambda r: H.persistence(settled(scaling_trades(O.scaling_transactions(r.flow()))), W.DFA_SCALES, r.args.minimum_transactions),
    "analyze-asymmetric-liquidity": liquidity,
    "analyze-queue": queue,
    "analyze-order-flow": order_flow,
    "analyze-order-flow-grid": lambda r: {"metrics": E.evaluate_grids(r.several(), r.test_from(), REPLICATES, SEED)},
    "analyze-ofi-horizons": lambda r: {"selection": E.select_horizon(r.horizons(), r.selection_from(), r.test_from(), REPLICATES, SEED)},
    "analyze-markouts": lambda r: economics(r, r.markouts(), N.MARKOUTS),
    "analyze-landmarks": lambda r: economics(r, r.landmarks(), N.MARKOUTS),
    "analyze-round-trips": lambda r: economics(r, r.trips(), N.ROUND_TRIPS),
    "analyze-signal-stability": stability,
    "audit-round-trip-policies": policy_audit,
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tickforge", description=__doc__)
    out.add_argument("verb", choices=sorted(VERBS))
    out.add_argument("--raw-dir", help="folder of raw session pairs")
    out.add_argument("--events", help="Parquet of prepared events")
    out.add_argument("--bins", action="append", metavar="PATH or N=PATH", help="CSV or Parquet of a grid; N=PATH for several resolutions")
    out.add_argument("--metrics", help="CSV or Parquet of policy metrics to reconcile")
    out.add_argument("--minimum-transactions", type=int, default=H.MINIMUM, help="analyze-sign-persistence: least trades of a session that counts")
    out.add_argument("--lenient", action="store_true", help="replay and audit-session-coverage: report a failed audit instead of stopping")
    out.add_argument("--output", required=True, help="folder for the tables")
    out.add_argument("--symbol")
    out.add_argument("--year", type=int)
    out.add_argument("--analysis-policy")
    out.add_argument("--selection-start")
    out.add_argument("--test-start")
    out.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, int]:
    args = parser().parse_args(argv)
    if not (args.raw_dir or args.events or args.bins):
        raise SystemExit("one of --raw-dir, --events and --bins is needed")
    spark = spark or session()
    counts = {}
    for name, df in VERBS[args.verb](Run(spark, args)).items():
        path = f"{args.output}/{name}"
        if args.format == "csv":
            raw.write_table(df, path)
        elif args.format == "json":
            raw.write_json(df, path)
        elif name == "events":
            raw.write_events(df, path)
        else:
            df.write.mode("overwrite").parquet(path)
        counts[name] = spark.read.format(args.format).load(path).count()
    print(json.dumps(counts))
    return counts


if __name__ == "__main__":
    main()

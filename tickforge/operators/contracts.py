"""Data contracts: coverage of sessions and accounting identities of grids, as counts of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Raised by ``require`` when a contract is broken."""


def session_coverage(events: DataFrame, close_us: int | Column, most_gap_us: int, excluded: list[str]) -> DataFrame:
    """One row per session, in one aggregate: its extent, its last row at or before the close, how many rows come after
    it, the gap from that last row to the close (null without one), and whether the session is included, excluded or
    unexplained. The close is the same for all, or a column that is the same within a session."""
    close = close_us if isinstance(close_us, Column) else F.lit(close_us)
    within = F.col("ts_us") <= close
    per = events.groupBy("date").agg(
        F.count("*").alias("events"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.max(close).alias("close"),
        F.max(F.when(within, F.struct("event_row", "ts_us"))).alias("at"), F.count_if(~within).alias("after_close"),
    )
    per = per.withColumns({"last_row": F.col("at.event_row"), "gap_us": F.col("close") - F.col("at.ts_us")}).drop("at", "close")
    per = per.withColumn("complete", F.coalesce(F.col("gap_us") <= most_gap_us, F.lit(False)))
    status = F.when(F.col("complete"), "included").when(F.col("date").isin(excluded), "declared_source_exclusion").otherwise("unexplained_incomplete")
    return per.withColumn("status", status)


def coverage_gate(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("status").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: one aggregate over the table, a row per rule (a condition that marks a bad row)."""
    one = df.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("r")).select("r.*")


def require(violations: DataFrame) -> None:
    bad = [f"{r['rule']}: {r['violations']}" for r in violations.where("violations > 0").collect()]
    if bad:
        raise ContractError("; ".join(bad))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def one_to_one_violations(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """rule, violations: keys that stand more than once on a side, and keys that only one side has. One join of the sides'
    counts by key."""
    sides = [df.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias(name)) for df, name in ((left, "left"), (right, "right"))]
    both = sides[0].join(sides[1], [f"_{i}" for i in range(len(keys))], "full")
    return count_violations(
        both,
        {"left_duplicates": F.col("left") > 1, "right_duplicates": F.col("right") > 1, "left_only": F.col("right").isNull(), "right_only": F.col("left").isNull()},
    )


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The join of two tables whose keys must be unique on both sides; keys of one side only are left out."""
    require(one_to_one_violations(left, right, keys).where("rule IN ('left_duplicates', 'right_duplicates')"))
    return left.join(right, keys)


def cell_violations(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Observations that aren't the moves' sum, and cells that stand twice."""
    own = count_violations(grid, {"moves_match": F.col("observations") != F.col("up_moves") + F.col("down_moves")})
    twice = duplicate_keys(grid, keys).agg(F.count("*").alias("violations")).select(F.lit("duplicate_cells").alias("rule"), "violations")
    return own.unionByName(twice)


def markout_violations(grid: DataFrame) -> DataFrame:
    c = F.col
    return count_violations(
        grid,
        {
            "moves_match": c("signals") != c("up_moves") + c("down_moves"),
            "arrivals_match": c("signals") != c("executable") + c("stale"),
            "zero_latency_stale": (c("latency_us") == 0) & (c("stale") > 0),
            "cost_sign": c("half_spread_sum_bps") < 0,
        },
    )


def round_trip_violations(grid: DataFrame) -> DataFrame:
    c = F.col
    rules = {"arrivals_match": c("signals") != c("arrived") + c("stale")}
    for s in ("long", "short"):
        identity = c(f"{s}_move_sum_bps") - c(f"{s}_entry_cost_sum_bps") - c(f"{s}_exit_cost_sum_bps")
        rules[f"{s}_fills_match"] = c("arrived") != c(f"{s}_fills") + c(f"{s}_censored")
        rules[f"{s}_one_share_censored"] = (c("shares") == 1) & (c(f"{s}_censored") > 0)
        rules[f"{s}_pnl_identity"] = F.abs(c(f"{s}_pnl_sum_bps") - identity) > 1e-7 + 1e-9 * F.abs(identity)
    return count_violations(grid, rules)


def horizon_violations(grid: DataFrame) -> DataFrame:
    """Counts add up, no cell twice, and every horizon of a date and bucket has the same labels."""
    own = count_violations(grid, {"moves_match": F.col("observations") != F.col("up_moves") + F.col("down_moves")})
    keys = ["date", "spread_bucket", "horizon_kind", "horizon_value"]
    twice = duplicate_keys(grid, [*keys, "queue_bin", "ofi_bin"]).agg(F.count("*").alias("violations")).select(F.lit("duplicate_cells").alias("rule"), "violations")
    labels = grid.groupBy(*keys).agg(F.sum("up_moves").alias("up"), F.sum("down_moves").alias("down")).groupBy("date", "spread_bucket")
    differ = labels.agg((F.min(F.struct("up", "down")) != F.max(F.struct("up", "down"))).alias("bad")).agg(F.count_if("bad").alias("violations"))
    return own.unionByName(twice).unionByName(differ.select(F.lit("labels_differ").alias("rule"), "violations"))

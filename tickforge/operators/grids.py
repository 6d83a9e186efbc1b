"""Binomial grids: counts of next moves by binned state. Each grid is one plan over labelled events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions import book as B
from tickforge.operators import spells as S

ALL = "all_spreads"


def by_bucket(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Each row for all spreads and for its own bucket (or those of the given names)."""
    own = F.col("bucket") if names is None else F.when(F.col("bucket").isin(names), F.col("bucket"))
    return df.withColumn("spread_bucket", F.explode(F.array_compact(F.array(F.lit(ALL), own))))


def by_sample(df: DataFrame) -> DataFrame:
    """Each row for all events and, at a best-quote update, for that sample."""
    update = F.when(F.col("is_update"), F.lit("best_quote_updates"))
    return df.withColumn("sample", F.explode(F.array_compact(F.array(F.lit("all_events"), update))))


def moves() -> list[Column]:
    up = F.col("move") == 1
    return [F.count("*").alias("observations"), F.count_if(up).alias("up_moves"), F.count_if(~up).alias("down_moves")]


def queue_bins(lab: DataFrame, bins: int) -> DataFrame:
    b = F.col("bin")
    out = by_bucket(by_sample(lab)).withColumn("bin", B.unit_bin(F.col("queue"), bins)).groupBy("date", "sample", "spread_bucket", "bin").agg(*moves())
    return out.withColumns({"bin_left": -1.0 + 2.0 * b / bins, "bin_right": -1.0 + 2.0 * (b + 1) / bins, "bin_center": B.bin_center(b, bins)})


def _axes(df: DataFrame, flow: Column, bins: int, queue: str = "queue", depth: str = "depth") -> DataFrame:
    return df.withColumns({"queue_bin": B.unit_bin(F.col(queue), bins), "ofi_bin": B.unit_bin(B.pressure(flow, F.col(depth)), bins)})


def with_centers(df: DataFrame, bins: int) -> DataFrame:
    return df.withColumns({"queue_center": B.bin_center(F.col("queue_bin"), bins), "ofi_center": B.bin_center(F.col("ofi_bin"), bins)})


def order_flow_bins(lab: DataFrame, bins: int) -> DataFrame:
    cells = _axes(by_bucket(by_sample(lab)), F.col("cofi"), bins).groupBy("date", "sample", "spread_bucket", "queue_bin", "ofi_bin").agg(*moves())
    return with_centers(cells, bins)


def horizon_bins(lab: DataFrame, bins: int, updates: list[int], clocks_us: list[int]) -> DataFrame:
    """Moves at quote updates by order flow over the spell, the last updates, and clock windows. Labels drop only the last
    spell of a session and all windows look back, so they run over the labelled events themselves."""
    rows = lab.select("date", "event_row", "is_update", "ofi", "ts_us", "cofi", "queue", "depth", "bucket", "move")
    rows = S.clock_flows(rows, {f"clock_{us}": us for us in clocks_us})
    rows = rows.where("is_update")
    for n in updates:
        rows = rows.withColumn(f"updates_{n}", F.sum("ofi").over(S.in_session().rowsBetween(1 - n, Window.currentRow)))
    each = F.array(
        F.struct(F.lit("price_spell").alias("horizon_kind"), F.lit(0).cast("long").alias("horizon_value"), F.col("cofi").alias("flow")),
        *[F.struct(F.lit("quote_updates").alias("horizon_kind"), F.lit(n).cast("long").alias("horizon_value"), F.col(f"updates_{n}").alias("flow")) for n in updates],
        *[F.struct(F.lit("clock_us").alias("horizon_kind"), F.lit(us).cast("long").alias("horizon_value"), F.col(f"clock_{us}").alias("flow")) for us in clocks_us],
    )
    rows = by_bucket(rows.withColumn("h", F.explode(each)))
    cells = _axes(rows, F.col("h.flow"), bins).groupBy("date", "spread_bucket", F.col("h.horizon_kind").alias("horizon_kind"), F.col("h.horizon_value").alias("horizon_value"), "queue_bin", "ofi_bin")
    return with_centers(cells.agg(*moves()), bins)


def with_entries(lab: DataFrame, latencies_us: list[int]) -> DataFrame:
    """A row per event and latency: arrived (the spell still runs) and the book on arrival (``at``)."""
    state = F.struct("m2", "spread_raw")
    each = F.array(
        *[
            F.struct(
                F.lit(us).cast("long").alias("latency_us"),
                (F.lit(us == 0) | (F.col("ts_us") + us < F.col("next_us"))).alias("arrived"),
                S.entry(us, state).alias("at"),
            )
            for us in latencies_us
        ]
    )
    return lab.withColumn("entries", each).withColumn("e", F.explode("entries")).drop("entries")


def economics(arrived: Column, at: str) -> list[Column]:
    move = (F.col("next_m2") - F.col(f"{at}.m2")) * 1e4 / F.col(f"{at}.m2")
    cost = F.col(f"{at}.spread_raw") * 1e4 / F.col(f"{at}.m2")
    up = F.col("move") == 1
    total = lambda c: F.coalesce(F.sum(F.when(arrived, c)), F.lit(0.0))
    return [
        F.count("*").alias("signals"),
        F.count_if(arrived).alias("executable"),
        F.count_if(~arrived).alias("stale"),
        F.count_if(up).alias("up_moves"),
        F.count_if(~up).alias("down_moves"),
        total(move).alias("midpoint_move_sum_bps"),
        total(cost).alias("half_spread_sum_bps"),
    ]


def markout_bins(lab: DataFrame, bins: int, latencies_us: list[int]) -> DataFrame:
    rows = by_bucket(with_entries(lab, latencies_us).where("is_update"))
    cells = _axes(rows, F.col("cofi"), bins).groupBy("date", "spread_bucket", F.col("e.latency_us").alias("latency_us"), "queue_bin", "ofi_bin")
    return with_centers(cells.agg(*economics(F.col("e.arrived"), "e.at")), bins)


def landmarks(lab: DataFrame, age_us: int, latencies_us: list[int]) -> DataFrame:
    """One row per spell that outlives its landmark: the state at the landmark, the book on arrival per latency, and where
    the labels have it the book at the exit."""
    state = F.struct(*B.BOOK, "m2", "spread_raw", "bucket", "queue", "depth")
    last = lambda us: F.max_by(state, F.when(F.col("ts_us") < F.col("start_us") + us, F.col("event_row")))
    flow = F.sum(F.when(~F.col("first_in_spell") & (F.col("ts_us") < F.col("start_us") + age_us), F.col("ofi")).otherwise(0))
    per = lab.groupBy("date", "spell").agg(
        F.first("start_us").alias("start_us"),
        F.first("next_us").alias("next_us"),
        F.first("next_m2").alias("next_m2"),
        F.first("move").alias("move"),
        last(age_us).alias("signal"),
        flow.alias("flow"),
        *[last(age_us + us).alias(f"at_{us}") for us in latencies_us],
        *([F.first("exit").alias("exit")] if "exit" in lab.columns else []),
    )
    alive = per.where(F.col("start_us") + age_us < F.col("next_us"))
    each = F.array(
        *[
            F.struct(F.lit(us).cast("long").alias("latency_us"), (F.col("start_us") + age_us + us < F.col("next_us")).alias("arrived"), F.col(f"at_{us}").alias("at"))
            for us in latencies_us
        ]
    )
    out = alive.withColumn("e", F.explode(each)).drop(*[f"at_{us}" for us in latencies_us])
    return out.withColumns({"bucket": F.col("signal.bucket"), "queue": F.col("signal.queue"), "depth": F.col("signal.depth")})


def landmark_bins(marks: DataFrame, bins: int) -> DataFrame:
    cells = _axes(by_bucket(marks), F.col("flow"), bins).groupBy("date", "spread_bucket", F.col("e.latency_us").alias("latency_us"), "queue_bin", "ofi_bin")
    return with_centers(cells.agg(*economics(F.col("e.arrived"), "e.at")), bins)


def round_trips(marks: DataFrame, sizes: list[int]) -> DataFrame:
    """A row per landmark (of labels with exits), latency and size with the outcome of a long and a short round trip in basis points of the
    entry mid: filled, move, entry cost, exit cost and profit; null where a leg isn't filled."""
    out = marks.withColumn("shares", F.explode(F.array(*[F.lit(n) for n in sizes])))
    mid_in, mid_out, n = F.col("e.at.m2") / 2.0, F.col("exit.m2") / 2.0, F.col("shares")
    bps = lambda c: c * 1e4 / mid_in
    for side, sign, enter, leave in (("long", 1, "ask", "bid"), ("short", -1, "bid", "ask")):
        bought, sold = B.displayed_vwap(enter, n, "e.at"), B.displayed_vwap(leave, n, "exit")
        filled = F.col("e.arrived") & bought.isNotNull() & sold.isNotNull()
        move = bps(sign * (mid_out - mid_in))
        cost_in, cost_out = bps(sign * (bought - mid_in)), bps(sign * (mid_out - sold))
        out = out.withColumn(
            side,
            F.struct(
                filled.alias("filled"),
                F.when(filled, move).alias("move"),
                F.when(filled, cost_in).alias("entry_cost"),
                F.when(filled, cost_out).alias("exit_cost"),
                F.when(filled, bps(sign * (sold - bought))).alias("pnl"),
            ),
        )
    return out


def round_trip_bins(trips: DataFrame, bins: int) -> DataFrame:
    rows = _axes(by_bucket(trips, ["one_tick"]), F.col("flow"), bins)
    up, arrived = F.col("move") == 1, F.col("e.arrived")
    sums = []
    for side in ("long", "short"):
        filled = F.col(f"{side}.filled")
        sums += [F.count_if(filled).alias(f"{side}_fills"), F.count_if(arrived & ~filled).alias(f"{side}_censored")]
        sums += [F.coalesce(F.sum(f"{side}.{c}"), F.lit(0.0)).alias(f"{side}_{c}_sum_bps") for c in ("move", "entry_cost", "exit_cost", "pnl")]
    cells = rows.groupBy("date", "spread_bucket", F.col("e.latency_us").alias("latency_us"), "shares", "queue_bin", "ofi_bin").agg(
        F.count("*").alias("signals"), F.count_if(arrived).alias("arrived"), F.count_if(~arrived).alias("stale"),
        F.count_if(up).alias("up_moves"), F.count_if(~up).alias("down_moves"), *sums,
    )
    return with_centers(cells, bins)

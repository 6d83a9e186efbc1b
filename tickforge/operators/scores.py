"""Weighted binary scores, quantiles and resampling over binomial grid cells.

A cell is a weighted pair of outcomes, so no score expands it: sums of up and down moves are the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_ORDER = ["date", "queue_bin", "ofi_bin"]
EPS = 2.220446049250313e-16
#: The modulus of the integer plan and its factors of position, replicate and seed.
PRIME, STEP, REPLICATE, SEEDED = 1_000_003, 104_729, 7919, 31


def logit_probability(queue: float, flow: float, intercept: float = 0.0) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(intercept) + queue * F.col("queue_center") + flow * F.col("ofi_center"))))


def binary_rows(cells: DataFrame) -> DataFrame:
    """Each cell as its outcomes: target, weight; those without weight are left out."""
    both = F.array(F.struct(F.lit(1).alias("target"), F.col("up_moves").alias("weight")), F.struct(F.lit(0).alias("target"), F.col("down_moves").alias("weight")))
    return cells.withColumn("o", F.explode(both)).select("*", "o.target", "o.weight").drop("o").where("weight > 0")


def binary_scores(cells: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Brier score, log-loss and accuracy at one half, weighted."""
    up, down, prob = F.col("up_moves"), F.col("down_moves"), F.col(p)
    held = F.least(F.greatest(prob, F.lit(EPS)), F.lit(1 - EPS))
    n = F.sum(up + down)
    return cells.groupBy(*keys).agg(
        n.alias("n"),
        (F.sum(up * (1 - prob) * (1 - prob) + down * prob * prob) / n).alias("brier"),
        (-F.sum(up * F.log(held) + down * F.log(1 - held)) / n).alias("log_loss"),
        (F.sum(F.when(prob >= 0.5, up).otherwise(down)) / n).alias("accuracy"),
    )


def auc(cells: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Weighted area under the curve; equal probabilities count half. Probabilities are collapsed before ranking."""
    per = cells.groupBy(*keys, p).agg(F.sum("up_moves").alias("u"), F.sum("down_moves").alias("d"))
    below = F.coalesce(F.sum("d").over(Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per.withColumn("pairs", F.col("u") * (below + 0.5 * F.col("d")))
    return ranked.groupBy(*keys).agg(F.sum("u").alias("up"), F.sum("d").alias("down"), F.try_divide(F.sum("pairs"), (F.sum("u") * F.sum("d")).cast("double")).alias("auc"))


def weighted_quantiles(rows: DataFrame, keys: list[str], x: str, w: str, points: list[float], order: list[str]) -> DataFrame:
    """keys, point, value: interpolated between the middles of cumulative weights, in a total order of the rows."""
    by = Window.partitionBy(*keys).orderBy(x, *order)
    upto = F.sum(w).over(by.rowsBetween(Window.unboundedPreceding, 0))
    at = rows.where(F.col(w) > 0).withColumn("pos", (upto - 0.5 * F.col(w)) / F.sum(w).over(Window.partitionBy(*keys)))
    at = at.withColumns({"next_pos": F.lead("pos").over(by), "next_x": F.lead(x).over(by), "first": F.row_number().over(by) == 1})
    at = at.withColumn("point", F.explode(F.array(*[F.lit(float(q)) for q in points])))
    q = F.col("point")
    value = (
        F.when(F.col("first") & (q <= F.col("pos")), F.col(x))
        .when((q > F.col("pos")) & F.col("next_pos").isNull(), F.col(x))
        .when((q > F.col("pos")) & (q <= F.col("next_pos")), F.col(x) + (q - F.col("pos")) / (F.col("next_pos") - F.col("pos")) * (F.col("next_x") - F.col(x)))
    )
    return at.withColumn("value", value).where("value IS NOT NULL").groupBy(*keys, "point").agg(F.max("value").alias("value"))


def confidence_cutoffs(cells: DataFrame, keys: list[str], fractions: list[float]) -> DataFrame:
    """keys, fraction, cutoff: the confidence that the given share of weight reaches; 0 for the whole."""
    conf = cells.withColumns({"conf": F.abs(F.col("p") - 0.5), "w": F.col("up_moves") + F.col("down_moves")})
    part = weighted_quantiles(conf, keys, "conf", "w", [1 - f for f in fractions if f < 1], CELL_ORDER)
    out = part.select(*keys, F.round(1 - F.col("point"), 9).alias("fraction"), F.col("value").alias("cutoff"))
    whole = conf.select(*keys).distinct().select(*keys, F.lit(1.0).alias("fraction"), F.lit(0.0).alias("cutoff"))
    return out.unionByName(whole) if 1 in fractions or 1.0 in fractions else out


def selected(cells: DataFrame, cutoffs: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose confidence reaches the cutoff, per fraction, with ``action`` 1 (buy) or -1."""
    conf = F.abs(F.col("p") - 0.5)
    joined = cells.join(cutoffs, keys).where((conf >= F.col("cutoff")) | (F.abs(conf - F.col("cutoff")) <= EPS))
    return joined.withColumn("action", F.when(F.col("p") >= 0.5, 1).otherwise(-1))


def squared_loss(p: str) -> Column:
    return F.sum(F.col("up_moves") * (1 - F.col(p)) * (1 - F.col(p)) + F.col("down_moves") * F.col(p) * F.col(p))


# resampling by an integer plan, which any engine can repeat
def _mixed(rep: np.ndarray, pos: np.ndarray, seed: int) -> np.ndarray:
    """A whole number below PRIME for each replicate and position. The fifth power, which permutes the residues, breaks
    up the steps of the linear term: without it neighbouring positions would draw different sessions almost always."""
    a = (rep[:, None] * REPLICATE + pos * STEP + seed * SEEDED) % PRIME
    b = a * a % PRIME
    return b * b % PRIME * a % PRIME


def mixed_sql(rep: str, pos: str, seed: int) -> str:
    a = f"(({rep} * {REPLICATE} + {pos} * {STEP} + {seed * SEEDED}) % {PRIME})"
    b = f"({a} * {a} % {PRIME})"
    return f"({b} * {b} % {PRIME} * {a} % {PRIME})"


def drawn(rep: np.ndarray, n: int, seed: int, block: int | None = None) -> np.ndarray:
    """For each replicate the sessions (ranked from 0 in date order) at its n positions: drawn one by one, or in circular
    blocks cut at n."""
    pos = np.arange(n)
    start = _mixed(rep, pos if block is None else pos // block, seed) % n
    return start if block is None else (start + pos % block) % n


def flipped(rep: np.ndarray, n: int, seed: int) -> np.ndarray:
    """For each replicate a sign per session."""
    return 1 - 2 * (_mixed(rep, np.arange(n), seed) % 2)


def _replicated(spark, replicates: int, names: list[str], f: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """A row per replicate with the values of f, a column each; replicates are shared out over tasks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                rep = np.asarray(batch.column("id"))[i : i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64()) for v in f(rep)], names)

    return spark.range(replicates).mapInArrow(each, ", ".join(f"{name} double" for name in names))


INTERVAL = "estimate double, lower double, median double, upper double, share_not_positive double, replicates long"


def improvement_interval(daily: DataFrame, replicates: int, seed: int, block: int | None = None) -> DataFrame:
    """Relative reduction of loss by the challenger: the estimate, its 95 % interval and the share of replicates at or
    below 0. Input: date, challenger, reference, a row per session; these sums, three values a session, are read once
    and go to the replicates. No sessions, no row."""
    rows = daily.select("date", "challenger", "reference").orderBy("date").collect()
    if not rows:
        return daily.sparkSession.createDataFrame([], INTERVAL)
    challenger, reference = (np.array([r[c] for r in rows], dtype=float) for c in ("challenger", "reference"))

    def gains(rep: np.ndarray) -> list[np.ndarray]:
        at = drawn(rep, len(rows), seed, block)
        return [1 - challenger[at].sum(axis=1) / reference[at].sum(axis=1)]

    q = F.percentile("gain", [0.025, 0.5, 0.975])
    per = _replicated(daily.sparkSession, replicates, ["gain"], gains)
    out = per.agg(q.alias("q"), F.avg((F.col("gain") <= 0).cast("double")).alias("share_not_positive"), F.count("*").alias("replicates"))
    real = float(1 - challenger.sum() / reference.sum())
    return out.select(F.lit(real).alias("estimate"), F.col("q")[0].alias("lower"), F.col("q")[1].alias("median"), F.col("q")[2].alias("upper"), "share_not_positive", "replicates")


MODEL_SUMS = ["n", "y_sum", "y_squares", "base_sse", "plus_sse"]
MODEL_INTERVALS = ["delta_r2", "mse_reduction"]


def model_intervals(daily: DataFrame, replicates: int, seed: int) -> DataFrame:
    """What the larger of two models adds on the test sessions: R2 and the relative reduction of the mean squared error,
    with medians and 95 % intervals over resampled sessions, and the share of replicates whose R2 doesn't grow. Input: the
    sums of ``regression.nested_contributions``, five values a session, read once. A replicate whose y doesn't vary or
    that the smaller model fits without error has no value there. No sessions, no row."""
    rows = daily.select("date", *MODEL_SUMS).orderBy("date").collect()
    names = [f"{m}{part}" for m in MODEL_INTERVALS for part in ("", "_lower", "_median", "_upper")]
    schema = ", ".join(["sessions long", "replicates long", *[f"{name} double" for name in names], "share_not_positive double"])
    if not rows:
        return daily.sparkSession.createDataFrame([], schema)
    sums = np.array([[r[c] for c in MODEL_SUMS] for r in rows], dtype=float)

    def gains(totals: np.ndarray) -> list[np.ndarray]:
        n, y, yy, base, plus = totals.T
        spread = yy - y * y / n
        with np.errstate(divide="ignore", invalid="ignore"):
            return [np.where(spread > 0, (base - plus) / spread, np.nan), np.where(base > 0, 1 - plus / base, np.nan)]

    drawn_gains = lambda rep: gains(sums[drawn(rep, len(sums), seed)].sum(axis=1))
    per = _replicated(daily.sparkSession, replicates, MODEL_INTERVALS, drawn_gains).replace(float("nan"), None)
    real = dict(zip(MODEL_INTERVALS, (None if np.isnan(g[0]) else float(g[0]) for g in gains(sums.sum(axis=0, keepdims=True))), strict=True))
    out = per.agg(
        *[F.percentile(m, [0.025, 0.5, 0.975]).alias(m) for m in MODEL_INTERVALS],
        F.avg((F.col("delta_r2") <= 0).cast("double")).alias("share_not_positive"), F.count("*").alias("replicates"),
    )
    columns = [F.lit(len(rows)).cast("long").alias("sessions"), "replicates"]
    for m in MODEL_INTERVALS:
        columns += [F.lit(real[m]).cast("double").alias(m), *[F.col(m)[i].alias(f"{m}_{part}") for i, part in enumerate(("lower", "median", "upper"))]]
    return out.select(*columns, "share_not_positive")


def _largest(z: DataFrame, replicates: int, seed: int) -> DataFrame:
    """all: in order, the largest absolute sum over policies of each replicate's signed z. Input: policy, date, z, for
    each policy all dates. The matrix of policies by sessions, whose axes a grid of policies fixes, goes to the tasks."""
    frame = z.toPandas()
    wide = frame.pivot(index="date", columns="policy", values="z").sort_index().to_numpy() if len(frame) else np.zeros((0, 0))
    n = len(wide)
    per = _replicated(z.sparkSession, replicates if n else 0, ["largest"], lambda rep: [np.abs(flipped(rep, n, seed) @ wide).max(axis=1)])
    return per.agg(F.sort_array(F.collect_list("largest")).alias("all"))  # as many numbers as replicates


def max_t(daily: DataFrame, replicates: int, seed: int) -> DataFrame:
    """policy, mean, t, p_adjusted by a studentised Rademacher multiplier bootstrap of the largest absolute t. Input:
    policy, date, x, with a row per policy and session; it is read once."""
    daily = daily.sparkSession.createDataFrame(daily.select("policy", "date", "x").toPandas(), "policy string, date string, x double")
    stats = daily.groupBy("policy").agg(F.avg("x").alias("mean"), (F.stddev_samp("x") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))
    stats = stats.where("se > 0")
    z = daily.join(stats, "policy").select("policy", "date", ((F.col("x") - F.col("mean")) / (F.col("se") * F.col("n"))).alias("z"))
    t = stats.withColumn("t", F.col("mean") / F.col("se"))
    beyond = F.size(F.filter("all", lambda v: v >= F.abs("t")))
    return t.crossJoin(F.broadcast(_largest(z, replicates, seed))).select("policy", "mean", "t", ((1 + beyond) / F.lit(1.0 + replicates)).alias("p_adjusted"))


def family_audit(days: DataFrame, calendar: DataFrame, keys: list[str], replicates: int, seed: int, coverage: float = 0.95) -> DataFrame:
    """The whole family of policies with simultaneous intervals: profit per fill (a ratio of sums over sessions), its
    error from the sessions' influence, two-sided studentised Rademacher multipliers and the p-value adjusted for the
    largest t. Input: days (keys, date, fills, pnl) and the calendar's dates; a policy has no fills on dates it lacks.

    Policies without fills, with fills on fewer than two dates, or whose influence doesn't vary have no interval, and
    ``status`` says so.
    """
    days = days.select(*keys, "date", "fills", "pnl")
    days = days.sparkSession.createDataFrame(days.toPandas(), days.schema)  # read once: policies by sessions, fixed by the axes of the grid
    policy = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    full = days.select(*keys).distinct().crossJoin(calendar.select("date").distinct())
    full = full.join(days, [*keys, "date"], "left").fillna({"fills": 0, "pnl": 0.0}).withColumn("policy", policy)
    whole = Window.partitionBy(*keys)
    point = F.sum("pnl").over(whole) / F.when(F.sum("fills").over(whole) > 0, F.sum("fills").over(whole))
    full = full.withColumn("point", point).withColumn("influence", F.coalesce(F.col("pnl") - F.col("fills") * F.col("point"), F.lit(0.0)))
    stats = full.groupBy(*keys, "policy").agg(
        F.sum("fills").alias("fills"), F.count_if(F.col("fills") > 0).alias("filled_dates"), F.max("point").alias("mean_bps"),
        F.stddev_samp("influence").alias("scale"), F.avg("fills").alias("mean_fills"), F.count("*").alias("n"),
    )
    able = (F.col("fills") > 0) & (F.col("filled_dates") >= 2) & (F.col("scale") > 0)
    stats = stats.withColumn("se_bps", F.when(able, F.col("scale") / (F.sqrt("n") * F.col("mean_fills"))))
    z = full.join(stats.where(able).select("policy", "scale", "n"), "policy").select("policy", "date", (F.col("influence") / (F.sqrt("n") * F.col("scale"))).alias("z"))
    largest = _largest(z, replicates, seed).withColumn("critical", _percentile("all", coverage))
    beyond = F.size(F.filter("all", lambda v: v >= F.abs(F.col("mean_bps") / F.col("se_bps"))))
    status = (
        F.when(F.col("fills") == 0, "zero_fills").when(F.col("filled_dates") < 2, "one_filled_date")
        .when(~(F.col("scale") > 0), "zero_cluster_variance").otherwise("estimable")
    )
    out = stats.crossJoin(F.broadcast(largest))
    half = F.col("critical") * F.col("se_bps")
    return out.select(
        *keys, "fills", "filled_dates", "mean_bps", "se_bps", (F.col("mean_bps") - half).alias("lower_bps"), (F.col("mean_bps") + half).alias("upper_bps"),
        F.when(F.col("se_bps").isNotNull(), (1 + beyond) / F.lit(1.0 + replicates)).alias("p_adjusted"), status.alias("status"),
    )


def _percentile(values: str, q: float) -> Column:
    """The interpolated quantile of an array in order; null where it is empty."""
    at = (F.size(values) - 1) * F.lit(q)
    lo = F.floor(at).cast("int")
    a, b = F.get(values, lo), F.coalesce(F.get(values, lo + 1), F.get(values, lo))
    return a + (b - a) * (at - lo)

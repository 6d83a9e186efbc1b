"""Logistic fits and resampled intervals of many groups in one plan.

A fit sees its group's cells collapsed to distinct feature values, at most bins squared rows, so a group fits one task and
all groups are fitted side by side. Intervals get one row per group with its sums by session; replicates are drawn in
tasks by the integer plan of ``scores``, which any engine can repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.operators import scores as S

FEATURES = ("queue_center", "ofi_center")
MODELS: dict[str, tuple[str, ...]] = {"intercept": (), "queue": ("queue_center",), "ofi": ("ofi_center",), "both": FEATURES}
#: Challenger and reference of each comparison.
PAIRS = (("queue", "intercept"), ("ofi", "intercept"), ("both", "intercept"), ("both", "queue"), ("both", "ofi"))
STEPS, TOLERANCE = 50, 1e-9
#: Probabilities are rounded before they are ranked or compared, so that any engine sees the same ties.
PLACES = 12


def newton(x: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """Unpenalised weighted logistic coefficients, the steps taken, and whether they converged."""
    beta = np.zeros(x.shape[1])
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        gradient, hessian = x.T @ (up - (up + down) * p), x.T @ (x * ((up + down) * p * (1 - p))[:, None])
        change = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        beta = beta + np.clip(change, -5, 5)
        if np.abs(change).max() < TOLERANCE:
            return beta, step, True
    return beta, STEPS, False


def fit_groups(cells: DataFrame, keys: list[str], models: dict[str, tuple[str, ...]] = MODELS) -> DataFrame:
    """keys, model, intercept, queue, ofi (null where the model lacks it), moves, up_moves, steps, converged: a row per
    group and model. Groups without both outcomes have no row."""
    flat = cells.groupBy(*keys, *FEATURES).agg(F.sum("up_moves").cast("double").alias("u"), F.sum("down_moves").cast("double").alias("d"))
    rows = flat.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    kinds = [T.StructField(k, cells.schema[k].dataType) for k in keys]
    numbers = [T.StructField(c, T.DoubleType()) for c in ("intercept", "queue", "ofi")]
    counts = [T.StructField(c, T.LongType()) for c in ("moves", "up_moves", "steps")]
    schema = T.StructType([*kinds, T.StructField("model", T.StringType()), *numbers, *counts, T.StructField("converged", T.BooleanType())])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        up, down = group["u"].to_numpy(), group["d"].to_numpy()
        model = group["model"].iloc[0]
        if not (up.sum() > 0 and down.sum() > 0):
            return pd.DataFrame(columns=schema.names)
        beta, steps, converged = newton(np.column_stack([np.ones(len(group)), *[group[f].to_numpy(float) for f in models[model]]]), up, down)
        slopes = dict(zip(models[model], beta[1:], strict=True))
        row = [*group[keys].iloc[0], model, beta[0], *(slopes.get(f) for f in FEATURES), int(up.sum() + down.sum()), int(up.sum()), steps, converged]
        return pd.DataFrame([row], columns=schema.names)

    return rows.groupBy(*keys, "model").applyInPandas(fit, schema)


def with_fits(cells: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """A row per cell and model of its group, with the model's probability ``p``. Fits that didn't converge are left out."""
    own = fits.where("converged").select(*keys, "model", "intercept", "queue", "ofi")
    z = F.col("intercept") + F.coalesce(F.col("queue") * F.col("queue_center"), F.lit(0.0)) + F.coalesce(F.col("ofi") * F.col("ofi_center"), F.lit(0.0))
    return cells.join(own, keys).withColumn("p", F.round(1.0 / (1.0 + F.exp(-z)), PLACES)).drop("intercept", "queue", "ofi")


def model_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """n, brier, log_loss, accuracy, auc per group and model."""
    by = [*keys, "model"]
    return S.binary_scores(scored, by).join(S.auc(scored, by).drop("up", "down"), by)


def ranked_calendar(dates: DataFrame) -> DataFrame:
    """date, r, n: the sessions in order and their number. One task, as sessions are some hundreds a year."""
    return dates.select("date").distinct().withColumns({"r": (F.row_number().over(Window.orderBy("date")) - 1).cast("long"), "n": F.count("*").over(Window.partitionBy())})


INTERVAL = ("estimate", "lower", "median", "upper", "share_not_positive")


def keyed_intervals(
    daily: DataFrame, calendar: DataFrame, keys: list[str], numerator: str, denominator: str, replicates: int, seed: int,
    improvement: bool = False, blocks: tuple[int, ...] = (1,),
) -> DataFrame:
    """keys, block, clusters, replicates, estimate, lower, median, upper, share_not_positive: a ratio of sums over sessions
    (or, as an improvement, 1 less it) and its 95 % interval over resampled sessions, in circular blocks where a block is
    more than one session. Sessions of the calendar that a group lacks count as zero. Replicates whose denominator isn't
    above zero have no value; a group without any has nulls."""
    ranked = ranked_calendar(calendar)
    rows = daily.join(ranked, "date").groupBy(*keys).agg(F.max("n").alias("n"), F.collect_list(F.struct("r", F.col(numerator).cast("double").alias("a"), F.col(denominator).cast("double").alias("b"))).alias("days"))
    kinds = [T.StructField(k, daily.schema[k].dataType) for k in keys]
    counts = [T.StructField(c, T.LongType()) for c in ("block", "clusters", "replicates")]
    schema = T.StructType([*kinds, *counts, *[T.StructField(c, T.DoubleType()) for c in INTERVAL]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sums = np.zeros((row["n"], 2))
                for day in row["days"]:
                    sums[day["r"]] += day["a"], day["b"]
                for block in blocks:
                    out.append({k: row[k] for k in keys} | {"block": block, "clusters": row["n"]} | _interval(sums, replicates, seed, block, improvement))
            columns = [pa.array([r[f.name] for r in out], batch.schema.field(f.name).type if f.name in keys else pa.int64() if i < len(keys) + 3 else pa.float64()) for i, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(each, schema)


def _interval(sums: np.ndarray, replicates: int, seed: int, block: int, improvement: bool) -> dict:
    of = lambda totals: (1 - totals[:, 0] / totals[:, 1]) if improvement else totals[:, 0] / totals[:, 1]
    found, step = [], max(1, (1 << 22) // max(1, len(sums)))
    for lo in range(0, replicates, step):
        totals = sums[S.drawn(np.arange(lo, min(replicates, lo + step)), len(sums), seed, block if block > 1 else None)].sum(axis=1)
        found.append(of(totals[totals[:, 1] > 0]))
    values, whole = np.round(np.concatenate(found), PLACES), sums.sum(axis=0, keepdims=True)
    if not len(values):
        return {"replicates": 0} | dict.fromkeys(INTERVAL)
    low, mid, high = np.quantile(values, [0.025, 0.5, 0.975]).tolist()
    real = float(of(whole)[0]) if whole[0, 1] > 0 else None
    return {"replicates": len(values), "estimate": real, "lower": low, "median": mid, "upper": high, "share_not_positive": float(np.mean(values <= 0))}


def daily_losses(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, model, date, loss: squared loss by session."""
    return scored.groupBy(*keys, "model", "date").agg(S.squared_loss("p").alias("loss"))


def paired(losses: DataFrame, keys: list[str], pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """keys, challenger, reference, date, challenger_loss, reference_loss: each pair of models side by side, from one
    aggregate; pairs of which a group lacks a model are left out."""
    names = sorted({m for pair in pairs for m in pair})
    wide = losses.groupBy(*keys, "date").agg(*[F.max(F.when(F.col("model") == m, F.col("loss"))).alias(f"loss_{m}") for m in names])
    each = F.array(*[F.struct(F.lit(a).alias("challenger"), F.lit(b).alias("reference"), F.col(f"loss_{a}").alias("challenger_loss"), F.col(f"loss_{b}").alias("reference_loss")) for a, b in pairs])
    return wide.withColumn("pair", F.explode(each)).select(*keys, "date", "pair.*").where("challenger_loss IS NOT NULL AND reference_loss IS NOT NULL")


def comparisons(losses: DataFrame, calendar: DataFrame, keys: list[str], replicates: int, seed: int, pairs: tuple[tuple[str, str], ...] = PAIRS, blocks: tuple[int, ...] = (1,)) -> DataFrame:
    """Relative reduction of squared loss by each pair's challenger, with intervals."""
    return keyed_intervals(paired(losses, keys, pairs), calendar, [*keys, "challenger", "reference"], "challenger_loss", "reference_loss", replicates, seed, True, blocks)


def both_outcomes(cells: DataFrame, keys: list[str], test_from: Column | str) -> DataFrame:
    """The groups whose sessions before and from a date both have moves up and down."""
    early = F.col("date") < test_from
    part = lambda c, own: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)) > 0
    return cells.groupBy(*keys).agg((part("up_moves", early) & part("down_moves", early) & part("up_moves", ~early) & part("down_moves", ~early)).alias("able")).where("able").select(*keys)

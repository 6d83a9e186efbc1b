"""Regressions, scores and scaling fits from sufficient statistics: Spark reduces the data, NumPy solves what is left."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def simple_fit(split: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """keys, slope, intercept, r2, n of y on x over the training rows."""
    return split.where("NOT is_test").groupBy(*(keys or [])).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n")
    )


def with_prediction(data: DataFrame, fits: DataFrame, x: str, keys: list[str] | None = None) -> DataFrame:
    """Adds ``fitted``. Without keys the fit is one row, read as two numbers."""
    if not keys:
        one = fits.first()
        slope, intercept = (F.lit(one[c] if one else None).cast("double") for c in ("slope", "intercept"))
        return data.withColumn("fitted", intercept + slope * F.col(x))
    joined = data.join(fits.select(*keys, F.col("slope").alias("_s"), F.col("intercept").alias("_i")), keys)
    return joined.withColumn("fitted", F.col("_i") + F.col("_s") * F.col(x)).drop("_s", "_i")


def scores(y: str, p: str) -> list[Column]:
    """n, MSE, RMSE, MAE, R2 and the share of equal signs where neither is 0."""
    e = F.col(y) - F.col(p)
    total = F.var_pop(y) * F.count("*")
    signs = F.when((F.col(y) != 0) & (F.col(p) != 0), (F.signum(y) == F.signum(p)).cast("double"))
    return [
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / F.when(total != 0, total)).alias("r2"), F.avg(signs).alias("sign_accuracy"),
    ]


def residuals_by_count(test: DataFrame, count: str, y: str, p: str) -> DataFrame:
    """Mean residual per count: first per session, then over sessions with its standard error."""
    per = test.groupBy(count, "date").agg(F.avg(F.col(y) - F.col(p)).alias("m"), F.count("*").alias("c"))
    return per.groupBy(count).agg(
        F.avg("m").alias("residual"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("standard_error"), F.count("*").alias("dates"), F.sum("c").alias("windows")
    )


def gram(df: DataFrame, features: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X and X'y with an intercept first, y'y and n, from one aggregate."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(y).cast("double")]
    k = len(cols)
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    full = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return full[:-1, :-1], full[:-1, -1], full[-1, -1], int(full[0, 0])


def solve(xx: np.ndarray, xy: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Least squares on standardised features (ddof 0), the smallest coefficients where they are collinear; with ridge,
    the squares of those coefficients are penalised. Without rows all are 0."""
    n = xx[0, 0]
    if not n:
        return np.zeros(len(xy))
    mean = xx[0, 1:] / n
    cov = xx[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    sd[sd <= 1e-12 * (1 + np.abs(mean))] = 1  # a constant
    beta = np.linalg.lstsq(cov / np.outer(sd, sd) + ridge * np.eye(len(sd)), (xy[1:] - mean * xy[0]) / sd, rcond=None)[0] / sd
    return np.concatenate([[xy[0] / n - mean @ beta], beta])


#: The names of ``scores``.
SCORES = ("n", "mse", "rmse", "mae", "r2", "sign_accuracy")
_VOLUME = ["volume_imbalance", "absolute_volume", "signed_sqrt_volume", "signed_log_volume"]
_FLOW = ["order_flow_imbalance", "absolute_flow", "signed_sqrt_flow"]
#: Nested models of impact and a ridge over all features.
MODELS = {
    "volume": (["volume_imbalance"], 0.0),
    "volume_transforms": (_VOLUME, 0.0),
    "volume_and_flow": ([*_VOLUME, "order_flow_imbalance"], 0.0),
    "flow_transforms": ([*_VOLUME, *_FLOW], 0.0),
    "ridge": ([*_VOLUME, *_FLOW], 1.0),
}


def model_table(split: DataFrame, y: str, models: dict | None = None) -> DataFrame:
    """model and the scores of ``scores`` on the test sessions, best first. One aggregate serves all fits, as their sums are
    parts of the sums over all features; a second takes the scores of all models at once."""
    models = models or MODELS
    every = sorted({f for features, _ in models.values() for f in features})
    xx, xy, _, _ = gram(split.where("NOT is_test"), every, y)
    predicted = {}
    for name, (features, ridge) in models.items():
        at = [0, *[1 + every.index(f) for f in features]]
        beta = solve(xx[np.ix_(at, at)], xy[at], ridge)
        predicted[f"p_{name}"] = sum((float(b) * F.col(f) for f, b in zip(features, beta[1:], strict=True)), F.lit(float(beta[0])))
    told = split.where("is_test").withColumns(predicted).agg(*[F.struct(*scores(y, f"p_{name}")).alias(name) for name in models])
    rows = told.select(F.explode(F.array(*[F.struct(F.lit(name).alias("model"), *[F.col(name)[c].alias(c) for c in SCORES]) for name in models])).alias("r")).select("r.*")
    return rows.orderBy(F.asc_nulls_last("mse"))


def nested_contributions(split: DataFrame, y: str, base: str = "volume_transforms", plus: str = "volume_and_flow") -> DataFrame:
    """date, n, y_sum, y_squares, base_sse, plus_sse per test session, of two models fitted on the training rows. One
    aggregate serves both fits."""
    every = sorted({f for name in (base, plus) for f in MODELS[name][0]})
    xx, xy, _, _ = gram(split.where("NOT is_test"), every, y)
    error = {}
    for name in (base, plus):
        features, ridge = MODELS[name]
        at = [0, *[1 + every.index(f) for f in features]]
        beta = solve(xx[np.ix_(at, at)], xy[at], ridge)
        error[name] = F.col(y) - sum((float(b) * F.col(f) for b, f in zip(beta[1:], features, strict=True)), F.lit(float(beta[0])))
    return split.where("is_test").groupBy("date").agg(
        F.count("*").alias("n"), F.sum(y).alias("y_sum"), F.sum(F.col(y) * F.col(y)).alias("y_squares"),
        F.sum(error[base] * error[base]).alias("base_sse"), F.sum(error[plus] * error[plus]).alias("plus_sse"),
    )


def walk_forward(data: DataFrame, x: str, y: str, folds: int, initial: float) -> DataFrame:
    """Scores per fold: sessions after the initial share in ``folds`` runs, earlier ones longer by one where they
    don't divide; each is predicted by the fit on all sessions before it."""
    w = Window.orderBy("date")  # a row per session
    days = data.select("date").distinct().withColumns({"r": F.row_number().over(w), "m": F.count("*").over(Window.partitionBy(F.lit(0)))})
    first = F.floor(initial * F.col("m"))
    rest = F.col("m") - first
    short, longer = F.floor(rest / folds), rest % folds
    at = F.col("r") - first - 1
    fold = F.when(at < 0, None).when(at < longer * (short + 1), F.floor(at / (short + 1))).otherwise(longer + F.floor((at - longer * (short + 1)) / F.greatest(short, F.lit(1))))
    days = days.select("date", "r", fold.cast("long").alias("fold"))
    c = lambda n: F.col(n).cast("double")
    sums = {"n": F.count("*"), "sx": F.sum(c(x)), "sy": F.sum(c(y)), "sxx": F.sum(c(x) * c(x)), "sxy": F.sum(c(x) * c(y))}
    per = data.groupBy("date").agg(*[v.alias(k) for k, v in sums.items()]).join(days, "date")
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    upto = per.select("r", "fold", *[F.sum(k).over(before).alias(k) for k in sums])
    start = upto.where("fold IS NOT NULL").groupBy("fold").agg(*[F.min_by(k, "r").alias(k) for k in sums])
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fits = start.withColumn("slope", slope).select("fold", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))
    return with_prediction(data.join(days.where("fold IS NOT NULL"), "date"), fits, x, ["fold"]).groupBy("fold").agg(*scores(y, "fitted"))


def kyle_lambdas(windows: DataFrame, central: float = 0.35) -> DataFrame:
    """Cents per share by horizon over the windows with the smaller imbalances."""
    cut = windows.groupBy("horizon").agg(F.percentile(F.abs("volume_imbalance"), central).alias("cut"))
    rows = windows.join(cut, "horizon").where(F.abs("volume_imbalance") <= F.col("cut")).withColumn("cents", 100.0 * F.col("impact"))
    return rows.groupBy("horizon").agg(
        F.regr_slope("cents", "volume_imbalance").alias("kyle_lambda"), F.regr_intercept("cents", "volume_imbalance").alias("intercept"), F.count("*").alias("n")
    )


def kyle_decay(lambdas: DataFrame) -> DataFrame:
    x, y = F.log("horizon"), F.log("kyle_lambda")
    return lambdas.where("kyle_lambda > 0").agg((-F.regr_slope(y, x)).alias("decay"), F.regr_intercept(y, x).alias("log_scale"), F.count("*").alias("horizons"))


def loglog_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, its standard error, intercept, R2 and residual deviation of log y on log x."""
    rows = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log(x).alias("x"), F.log(y).alias("y"))
    s = rows.agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.regr_count("y", "x").alias("n"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"),
    )
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / F.when(F.col("n") > 2, F.col("n") - 2))
    return s.select("slope", "intercept", (sd / F.sqrt("sxx")).alias("slope_se"), "r2", sd.alias("residual_sd"), "n")


def exponents(fluctuations: DataFrame) -> DataFrame:
    return fluctuations.where("fluctuation > 0").groupBy("date").agg(F.regr_slope(F.log("fluctuation"), F.log("scale")).alias("exponent"), F.count("*").alias("scales"))


def master_curve(x: Column, alpha: float, beta: float) -> Column:
    return x / F.pow(1 + F.pow(F.abs(x), F.lit(alpha)), F.lit(beta / alpha))


def collapse(curve: DataFrame, scales: DataFrame, x_scale: str, y_scale: str) -> DataFrame:
    joined = curve.join(scales.select("horizon", F.col(x_scale).alias("_x"), F.col(y_scale).alias("_y")), "horizon")
    return joined.select("horizon", "bin", (F.col("x_mean") / F.col("_x")).alias("x"), (F.col("y_mean") / F.col("_y")).alias("y"))


# Where the shape starts, and the bounds of the logs of widths, heights, alpha and beta.
SHAPE_START = (1.2, 1.3)
WIDTH_BOUNDS, HEIGHT_BOUNDS, ALPHA_BOUNDS, BETA_BOUNDS = (-30.0, 30.0), (-30.0, 5.0), (np.log(0.1), np.log(8.0)), (np.log(0.1), np.log(5.0))


def _soft_l1(residuals: Callable[[np.ndarray], np.ndarray], p: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int) -> tuple[np.ndarray, float, bool]:
    """Parameters, half the sum of 2 (sqrt(1 + e e) - 1), and whether it settled: damped Gauss-Newton within bounds."""
    loss = lambda e: float(np.sum(np.sqrt(1 + e * e) - 1))
    damping, e = 1e-3, residuals(p)
    for _ in range(steps):
        jac = np.stack([(residuals(p + 1e-6 * v) - residuals(p - 1e-6 * v)) / 2e-6 for v in np.eye(len(p))], axis=1)
        w = 1 / np.sqrt(1 + e * e)
        a, g = jac.T @ (jac * w[:, None]), jac.T @ (w * e)
        free = ~((p <= low) & (g > 0) | (p >= high) & (g < 0))  # what would leave its bounds stays
        if not free.any():
            return p, loss(e), True
        a, change = a[np.ix_(free, free)], np.zeros(len(p))
        change[free] = np.linalg.lstsq(a + damping * np.diag(np.maximum(np.diag(a), 1e-300)), g[free], rcond=None)[0]
        moved = np.clip(p - change, low, high)
        now = residuals(moved)
        gain = loss(e) - loss(now)
        if gain >= 0:
            settled = gain <= 1e-10 * loss(e) or np.abs(moved - p).max() < 1e-8
            p, e, damping = moved, now, max(damping / 5, 1e-12)
            if settled:
                return p, loss(e), True
        else:
            damping *= 10
            if damping > 1e15:
                return p, loss(e), True  # no direction lowers the loss
    return p, loss(e), False


def volume_curve_scales(curve: DataFrame, steps: int = 2000) -> DataFrame:
    """Width and height per horizon and the shared shape of y = R f(x / Q), f the master curve, by soft-L1 least squares on
    the logs of the parameters; a point counts by the root of its observations. ``cost`` is the loss, ``success`` whether
    the search settled. The curve has a few points per horizon, which the driver gets."""
    points = curve.orderBy("horizon", "bin").toPandas()
    schema = "horizon long, x_scale double, y_scale double, alpha double, beta double, cost double, success boolean"
    if points.empty:
        return curve.sparkSession.createDataFrame([], schema)
    horizons, h = np.unique(points["horizon"], return_inverse=True)
    x, y, w = points["x_mean"].to_numpy(float), points["y_mean"].to_numpy(float), np.sqrt(points["n"].to_numpy(float))
    w, k = w / w.max(), len(horizons)
    spread = lambda v, least: np.array([max(float(np.std(v[h == i], ddof=1)) if (h == i).sum() > 1 else 0.0, least) for i in range(k)])
    start = np.log(np.concatenate([spread(x, 1e-9), spread(y, 1e-12), SHAPE_START]))
    bounds = [WIDTH_BOUNDS] * k + [HEIGHT_BOUNDS] * k + [ALPHA_BOUNDS, BETA_BOUNDS]
    low, high = (np.array([b[i] for b in bounds]) for i in (0, 1))

    def residuals(p: np.ndarray) -> np.ndarray:
        q, r, a, b = np.exp(p[:k])[h], np.exp(p[k : 2 * k])[h], np.exp(p[-2]), np.exp(p[-1])
        z = x / q
        return w * (r * z / (1 + np.abs(z) ** a) ** (b / a) - y)

    p, cost, success = _soft_l1(residuals, np.clip(start, low, high), low, high, steps)
    rows = [(int(v), float(np.exp(p[i])), float(np.exp(p[k + i])), float(np.exp(p[-2])), float(np.exp(p[-1])), cost, success) for i, v in enumerate(horizons)]
    return curve.sparkSession.createDataFrame(rows, schema)


def scaling_laws(scales: DataFrame) -> DataFrame:
    """law (width, height) with the log-log fit of its scale on the horizon."""
    part = lambda name, c: loglog_fit(scales, "horizon", c).select(F.lit(name).alias("law"), "*")
    return part("width", "x_scale").unionByName(part("height", "y_scale"))

"""Queries over executions and trade sessions: orders, windows, impact, scaling, signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.operators import liquidity as L
from tickforge.operators import orders as O
from tickforge.operators import persistence as H
from tickforge.operators import regression as R
from tickforge.operators import scores as S
from tickforge.operators import windows as W
from tickforge.plans.books import FLOW_SQL, flow
from tickforge.plans.linear import eliminate_sql
from tickforge.plans.registry import add
from tickforge.sources.adapters import TRADES_SQL, trades
from tickforge.sources.settle import settled

HORIZONS = [5, 10, 20, 50, 100]
T = 10
SCALING = W.SCALING_HORIZONS
TRADE_CTES = TRADES_SQL

# market orders
_PRE = """CASE WHEN trade_sign = 1 THEN {0} ELSE {1} END"""


def _order_sql(rows: str, count: str) -> str:
    return f"""SELECT date, ts_us, trade_sign, min(event_row) AS first_event_row, max(event_row) AS last_event_row, count(*) AS {count}, sum(size) AS size,
      arg_min(qm2, event_row) / 20000.0 AS mid_price_before, arg_min(qm2, event_row) AS midpoint_twice_before_raw, arg_max(m2, event_row) AS midpoint_twice_after_raw,
      arg_min(qap - qbp, event_row) / 10000.0 AS spread_before, arg_min({_PRE.format('qas', 'qbs')}, event_row) AS opposite_best_size_before,
      arg_min({_PRE.format('qbs', 'qas')}, event_row) AS same_side_best_size_before, sum(price / CAST(10000 AS DOUBLE) * size) / sum(size) AS execution_price_vwap FROM ({rows}) GROUP BY date, ts_us, trade_sign"""


ORDER_COLUMNS = "date:s ts_us:l trade_sign:l first_event_row:l last_event_row:l "
add(
    "q_visible_orders", ORDER_COLUMNS + "execution_count:l size:l mid_price_before:d midpoint_twice_before_raw:l midpoint_twice_after_raw:l spread_before:d opposite_best_size_before:l same_side_best_size_before:l execution_price_vwap:d",
    lambda s, d: O.visible_orders(flow(s, d)), _order_sql("SELECT *, -direction AS trade_sign FROM flow WHERE event_type = 4 AND qm2 IS NOT NULL", "execution_count"), FLOW_SQL,
)
add(
    "q_scaling_transactions", ORDER_COLUMNS + "transaction_count:l size:l mid_price_before:d execution_price_vwap:d", lambda s, d: O.scaling_transactions(flow(s, d)),
    _order_sql("SELECT * FROM (SELECT *, CAST(sign(price / CAST(10000 AS DOUBLE) - (qap / CAST(10000 AS DOUBLE) + qbp / CAST(10000 AS DOUBLE)) / 2) AS INT) AS trade_sign FROM flow WHERE event_type IN (4, 5) AND qm2 IS NOT NULL) WHERE trade_sign <> 0", "transaction_count"), FLOW_SQL,
)


# windows of trades
def windows_sql(horizons: list[int], stride: int | None = None) -> str:
    parts = [
        f"""SELECT date, {t} AS horizon, row0, lead(v, {t}) OVER w - v AS volume_imbalance, lead(n, {t}) OVER w - n AS order_flow_imbalance, (lead(mid_raw, {t}) OVER w - mid_raw) / CAST(10000 AS DOUBLE) AS impact,
        10000 * ln(CAST(lead(mid_raw, {t}) OVER w AS DOUBLE) / mid_raw) AS impact_bps FROM pv WINDOW w AS (PARTITION BY date ORDER BY row0)"""
        for t in horizons
    ]
    keep = " UNION ALL ".join(f"SELECT * FROM ({p}) WHERE impact IS NOT NULL AND row0 % {stride or t} = 0" for p, t in zip(parts, horizons, strict=True))
    return keep


PV = TRADES_SQL + """,
pv AS (SELECT *, coalesce(sum(sign * size) OVER w, 0) AS v, coalesce(sum(sign) OVER w, 0) AS n FROM trades
  WINDOW w AS (PARTITION BY date ORDER BY row0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
WINDOW = "date:s horizon:l row0:l volume_imbalance:l order_flow_imbalance:l impact:d impact_bps:d"
windows = lambda s, d, horizons=HORIZONS: W.prediction_windows(trades(s, d), horizons)
add("q_prediction_windows_tumbling", WINDOW, windows, windows_sql(HORIZONS), PV)
add("q_prediction_windows_sliding", WINDOW, lambda s, d: W.prediction_windows(trades(s, d), [20], 5), windows_sql([20], 5), PV)
FEATURES_CTE = PV + f""",
win AS ({windows_sql([T])}),
feat AS (SELECT *, 100.0 * impact AS impact_cents, CAST(abs(volume_imbalance) AS DOUBLE) AS absolute_volume, sign(volume_imbalance) * sqrt(CAST(abs(volume_imbalance) AS DOUBLE)) AS signed_sqrt_volume,
  sign(volume_imbalance) * ln(1 + CAST(abs(volume_imbalance) AS DOUBLE)) AS signed_log_volume, sign(order_flow_imbalance) * sqrt(CAST(abs(order_flow_imbalance) AS DOUBLE)) AS signed_sqrt_flow FROM win),
dates AS (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS m FROM (SELECT DISTINCT date FROM feat)),
sp AS (SELECT feat.*, r > greatest(1, least(m - 1, floor(0.8 * m))) AS is_test FROM feat JOIN dates USING (date))"""
FEATURES = "impact_cents:d absolute_volume:d signed_sqrt_volume:d signed_log_volume:d signed_sqrt_flow:d"
features = lambda s, d: W.impact_features(windows(s, d, [T]))
#: Fits read their windows several times, so those are written once.
kept_features = lambda s, d: W.impact_features(settled(windows(s, d, [T]).drop("impact_bps")))
split = lambda s, d: W.with_split(kept_features(s, d))
add("q_impact_features", "date:s row0:l " + FEATURES, features, "SELECT * FROM feat", FEATURES_CTE)
add("q_train_test_split", "date:s is_test:b n:l", lambda s, d: split(s, d).groupBy("date", "is_test").agg(F.count("*").alias("n")), "SELECT date, is_test, count(*) AS n FROM sp GROUP BY ALL", FEATURES_CTE)
add(
    "q_sigma_filter", "date:s row0:l volume_imbalance:l impact_cents:d", lambda s, d: W.sigma_filter(split(s, d), ["volume_imbalance", "impact_cents"]),
    """SELECT sp.* FROM sp, (SELECT avg(volume_imbalance) AS vm, stddev_pop(volume_imbalance) AS vs, avg(impact_cents) AS im, stddev_pop(impact_cents) AS isd FROM sp WHERE NOT is_test)
    WHERE volume_imbalance BETWEEN vm - 3 * vs AND vm + 3 * vs AND impact_cents BETWEEN im - 3 * isd AND im + 3 * isd""", FEATURES_CTE,
)


def curve_sql(source: str, key: str, x: str, y: str, bins: int) -> str:
    points = ", ".join(f"CAST({i} AS DOUBLE) / {bins}" for i in range(bins + 1))
    return f"""SELECT {key}, bin, avg({x}) AS x_mean, avg({y}) AS y_mean, stddev_samp({y}) / sqrt(count({y})) AS standard_error, count(*) AS n FROM (SELECT s.*, greatest(1, len(list_filter(edges, lambda e: e < s.{x}))) - 1 AS bin FROM {source} s
      JOIN (SELECT {key}, list_distinct(quantile_cont(CAST({x} AS DOUBLE), [{points}])) AS edges FROM {source} GROUP BY {key}) USING ({key})) GROUP BY {key}, bin"""


ALL_WIN = PV + f", win AS ({windows_sql(HORIZONS)})"
add("q_impact_curve_qcut", "horizon:l bin:l x_mean:d y_mean:d n:l", lambda s, d: W.quantile_curve(windows(s, d), ["horizon"], "volume_imbalance", "impact", 21), curve_sql("win", "horizon", "volume_imbalance", "impact", 21), ALL_WIN)


# regressions on one feature, fitted on the training sessions
def fitted(s: SparkSession, d: str) -> DataFrame:
    return R.simple_fit(split(s, d), "volume_imbalance", "impact_cents")


FIT = """,
ft AS (SELECT regr_slope(impact_cents, volume_imbalance) AS slope, regr_intercept(impact_cents, volume_imbalance) AS intercept, regr_r2(impact_cents, volume_imbalance) AS r2, count(*) AS n FROM sp WHERE NOT is_test),
pr AS (SELECT sp.*, ft.intercept + ft.slope * volume_imbalance AS fitted FROM sp, ft)"""
FIT_CTES = FEATURES_CTE + FIT
SCORES_SQL = """count(*) AS n, avg((impact_cents - fitted) ** 2) AS mse, sqrt(avg((impact_cents - fitted) ** 2)) AS rmse, avg(abs(impact_cents - fitted)) AS mae,
  1 - sum((impact_cents - fitted) ** 2) / nullif(var_pop(impact_cents) * count(*), 0) AS r2, avg(CASE WHEN impact_cents <> 0 AND fitted <> 0 THEN CASE WHEN sign(impact_cents) = sign(fitted) THEN 1.0 ELSE 0.0 END END) AS sign_accuracy"""
SCORES = "n:l mse:d rmse:d mae:d r2:d sign_accuracy:d"
predicted = lambda s, d: R.with_prediction(split(s, d), fitted(s, d), "volume_imbalance")
add("q_ols_signed_volume", "slope:d intercept:d r2:d n:l", fitted, "SELECT * FROM ft", FIT_CTES)
add("q_ols_scores", "is_test:b " + SCORES, lambda s, d: predicted(s, d).groupBy("is_test").agg(*R.scores("impact_cents", "fitted")), f"SELECT is_test, {SCORES_SQL} FROM pr GROUP BY is_test", FIT_CTES)
add("q_monthly_scores", "month:s " + SCORES, lambda s, d: predicted(s, d).where("is_test").groupBy(F.substring("date", 1, 7).alias("month")).agg(*R.scores("impact_cents", "fitted")), f"SELECT date[1:7] AS month, {SCORES_SQL} FROM pr WHERE is_test GROUP BY 1", FIT_CTES)
add("q_calibration_curve", "is_test:b bin:l x_mean:d y_mean:d standard_error:d n:l", lambda s, d: W.quantile_curve(predicted(s, d), ["is_test"], "fitted", "impact_cents", 10), curve_sql("pr", "is_test", "fitted", "impact_cents", 10), FIT_CTES)
add(
    "q_residual_by_count", "order_flow_imbalance:l residual:d standard_error:d dates:l windows:l",
    lambda s, d: R.residuals_by_count(predicted(s, d).where("is_test"), "order_flow_imbalance", "impact_cents", "fitted"),
    "SELECT order_flow_imbalance, avg(m) AS residual, stddev_samp(m) / sqrt(count(*)) AS standard_error, count(*) AS dates, sum(c) AS windows FROM (SELECT order_flow_imbalance, date, avg(impact_cents - fitted) AS m, count(*) AS c FROM pr WHERE is_test GROUP BY ALL) GROUP BY order_flow_imbalance", FIT_CTES,
)

_EVERY = sorted({f for features, _ in R.MODELS.values() for f in features})


def _models_sql() -> tuple[str, str]:
    """(common tables, body): features standardised over the training rows, each model's equations, and its scores."""
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in _EVERY)
    z = ", ".join(f"({f} - m_{f}) / s_{f}" for f in _EVERY)
    flows = "abs(order_flow_imbalance) AS absolute_flow"
    tables = [FEATURES_CTE, f"zf AS MATERIALIZED (SELECT *, {flows} FROM sp)", f"zs AS MATERIALIZED (SELECT {stats}, avg(impact_cents) AS y_mean FROM zf WHERE NOT is_test)", f"zz AS MATERIALIZED (SELECT is_test, impact_cents, y_mean, [{z}] AS z FROM zf, zs)"]
    parts = []
    for k, (name, (features, ridge)) in enumerate(R.MODELS.items()):
        n, at = len(features), "[" + ", ".join(str(_EVERY.index(f) + 1) for f in features) + "]"
        entry = f"sum(z[{at}[i]] * CASE WHEN j = {n + 1} THEN impact_cents ELSE z[{at}[j]] END) + CASE WHEN i = j THEN {ridge} ELSE 0 END"
        tables.append(eliminate_sql(f"om{k}", f"SELECT i, j, {entry} AS v FROM zz, (SELECT unnest(range(1, {n + 1})) AS i), (SELECT unnest(range(1, {n + 2})) AS j) WHERE NOT is_test GROUP BY i, j", n))
        fitted = f"y_mean + list_sum(list_transform(range(1, {n + 1}), lambda i: z[{at}[i]] * b[i]))"
        parts.append(f"SELECT '{name}' AS model, {SCORES_SQL} FROM (SELECT impact_cents, {fitted} AS fitted FROM zz, (SELECT list(v ORDER BY i) AS b FROM om{k}) WHERE is_test)")
    return ",\n".join(tables), " UNION ALL ".join(parts)


add("q_ols_models", "model:s " + SCORES, lambda s, d: R.model_table(split(s, d), "impact_cents"), _models_sql()[1], _models_sql()[0])

# what the count of trades adds to the transforms of volume, on the test sessions
_ADDED = ["volume_imbalance", "absolute_volume", "signed_sqrt_volume", "signed_log_volume", "order_flow_imbalance"]


def nested_sql(features: list[str]) -> str:
    """Least squares by projection: each feature in turn, less what those before it explain in training, is taken out of
    the later ones and of y. e is y's rest without the last feature and f with it."""
    k = len(features)
    kept = lambda i: [f"x{j}" for j in range(i, k)] + ["e"]
    means = ", ".join(f"avg({c}) AS {c}" for c in kept(0))
    out = f""",
k AS (SELECT date, is_test, impact_cents AS y, impact_cents AS e, {", ".join(f"CAST({f} AS DOUBLE) AS x{j}" for j, f in enumerate(features))} FROM sp),
k0 AS (SELECT date, is_test, y, {", ".join(f"k.{c} - m.{c} AS {c}" for c in kept(0))} FROM k, (SELECT {means} FROM k WHERE NOT is_test) m)"""
    for i in range(k):
        later = kept(i + 1)
        slopes = ", ".join(f"sum({c} * x{i}) / sum(x{i} * x{i}) AS {c}" for c in later)
        rest = ", ".join(f"a.{c} - b.{c} * a.x{i} AS {c}" for c in later)
        before = ", a.e AS without" if i == k - 1 else ""
        out += f""",
k{i + 1} AS (SELECT date, is_test, y, {rest}{before} FROM k{i} a, (SELECT {slopes} FROM k{i} WHERE NOT is_test) b)"""
    return out + f""",
dc AS (SELECT date, count(*) AS n, sum(y) AS y_sum, sum(y * y) AS y_squares, sum(without * without) AS base_sse, sum(e * e) AS plus_sse, row_number() OVER (ORDER BY date) - 1 AS r, count(*) OVER () AS sessions FROM k{k} WHERE is_test GROUP BY date)"""


contributions = lambda s, d: R.nested_contributions(split(s, d), "impact_cents")
CONTRIBUTIONS = FEATURES_CTE + nested_sql(_ADDED)
add(
    "q_model_contributions", "date:s n:l y_mean:d y_square:d base_mse:d plus_mse:d",
    lambda s, d: contributions(s, d).selectExpr("date", "n", "y_sum / n AS y_mean", "y_squares / n AS y_square", "base_sse / n AS base_mse", "plus_sse / n AS plus_mse"),
    "SELECT date, n, y_sum / n AS y_mean, y_squares / n AS y_square, base_sse / n AS base_mse, plus_sse / n AS plus_mse FROM dc", CONTRIBUTIONS,
)
MODEL_REPLICATES, MODEL_SEED = 10_000, 42
_PARTS = [("", None), ("_lower", 0.025), ("_median", 0.5), ("_upper", 0.975)]
_GAINS = {"delta_r2": "(sum(base_sse) - sum(plus_sse)) / (sum(y_squares) - sum(y_sum) ** 2 / sum(n))", "mse_reduction": "1 - sum(plus_sse) / sum(base_sse)"}
add(
    "q_model_intervals", "sessions:l replicates:l " + " ".join(f"{m}{part}:d" for m in _GAINS for part, _ in _PARTS) + " share_not_positive:d",
    lambda s, d: S.model_intervals(contributions(s, d), MODEL_REPLICATES, MODEL_SEED),
    f"""SELECT (SELECT count(*) FROM dc) AS sessions, count(*) AS replicates, {", ".join(f"quantile_cont({m}, {q}) AS {m}{part}" if q else f"(SELECT {sql} FROM dc) AS {m}" for m, sql in _GAINS.items() for part, q in _PARTS)},
    avg(CASE WHEN delta_r2 <= 0 THEN 1.0 ELSE 0.0 END) AS share_not_positive FROM (SELECT rep, {", ".join(f"{sql} AS {m}" for m, sql in _GAINS.items())} FROM
      (SELECT rep, {S.mixed_sql('rep', 'pos', MODEL_SEED)} % n_ AS r FROM (SELECT unnest(range({MODEL_REPLICATES})) AS rep), (SELECT unnest(range((SELECT count(*) FROM dc))) AS pos, (SELECT count(*) FROM dc) AS n_)) JOIN dc USING (r) GROUP BY rep)""",
    CONTRIBUTIONS,
)


def walk_forward(s: SparkSession, d: str) -> DataFrame:
    """Five expanding folds: each is fitted on all sessions before it, by sums per session and prefix sums."""
    return R.walk_forward(kept_features(s, d), "volume_imbalance", "impact_cents", folds=5, initial=0.4)


_WALK = FEATURES_CTE + """,
wd AS (SELECT date, r, m, CAST(floor(0.4 * m) AS BIGINT) AS first FROM dates),
wf AS (SELECT date, r, first, CASE WHEN r > first THEN CASE WHEN r - first <= ((m - first) % 5) * ((m - first) // 5 + 1) THEN (r - first - 1) // ((m - first) // 5 + 1)
  ELSE (m - first) % 5 + (r - first - 1 - ((m - first) % 5) * ((m - first) // 5 + 1)) // greatest(1, (m - first) // 5) END END AS fold FROM wd),
fs AS (SELECT fold, min(r) AS start FROM wf WHERE fold IS NOT NULL GROUP BY fold),
wt AS (SELECT fs.fold, regr_slope(impact_cents, volume_imbalance) AS slope, regr_intercept(impact_cents, volume_imbalance) AS intercept FROM fs JOIN wf ON wf.r < fs.start JOIN feat USING (date) GROUP BY fs.fold),
wp AS (SELECT wf.fold, impact_cents, intercept + slope * volume_imbalance AS fitted FROM feat JOIN wf USING (date) JOIN wt ON wt.fold = wf.fold)"""
add("q_walk_forward", "fold:l " + SCORES, walk_forward, f"SELECT fold, {SCORES_SQL} FROM wp GROUP BY fold", _WALK)
_HR = ALL_WIN + """, hd AS (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS m FROM (SELECT DISTINCT date FROM win)),
hs AS (SELECT win.*, 100.0 * impact AS impact_cents, r > greatest(1, least(m - 1, floor(0.8 * m))) AS is_test FROM win JOIN hd USING (date)),
hf AS (SELECT horizon, regr_slope(impact_cents, volume_imbalance) AS slope, regr_intercept(impact_cents, volume_imbalance) AS intercept FROM hs WHERE NOT is_test GROUP BY horizon),
hp AS (SELECT hs.*, intercept + slope * volume_imbalance AS fitted FROM hs JOIN hf USING (horizon) WHERE is_test)"""


def horizon_robustness(s: SparkSession, d: str) -> DataFrame:
    data = W.with_split(settled(windows(s, d).drop("impact_bps"))).withColumn("impact_cents", 100.0 * F.col("impact"))
    fits = R.simple_fit(data, "volume_imbalance", "impact_cents", ["horizon"])
    return R.with_prediction(data.where("is_test"), fits, "volume_imbalance", ["horizon"]).groupBy("horizon").agg(*R.scores("impact_cents", "fitted"))


add("q_horizon_robustness", "horizon:l " + SCORES, horizon_robustness, f"SELECT horizon, {SCORES_SQL} FROM hp GROUP BY horizon", _HR)

# price impact per share and its decay
_KYLE = ALL_WIN + """, kq AS (SELECT horizon, quantile_cont(CAST(abs(volume_imbalance) AS DOUBLE), 0.35) AS cut FROM win GROUP BY horizon),
ky AS (SELECT horizon, regr_slope(100.0 * impact, volume_imbalance) AS kyle_lambda, regr_intercept(100.0 * impact, volume_imbalance) AS intercept, count(*) AS n FROM win JOIN kq USING (horizon) WHERE abs(volume_imbalance) <= cut GROUP BY horizon)"""
kyle = lambda s, d: R.kyle_lambdas(settled(windows(s, d).drop("impact_bps")))
add("q_kyle_lambda", "horizon:l kyle_lambda:d intercept:d n:l", kyle, "SELECT * FROM ky", _KYLE)
add("q_kyle_decay", "decay:d log_scale:d horizons:l", lambda s, d: R.kyle_decay(kyle(s, d)), "SELECT -regr_slope(ln(kyle_lambda), ln(horizon)) AS decay, regr_intercept(ln(kyle_lambda), ln(horizon)) AS log_scale, count(*) AS horizons FROM ky WHERE kyle_lambda > 0", _KYLE)

# scaling
_SCALE = TRADES_SQL + f""",
sd AS (SELECT date, sum(size) AS day_size FROM trades GROUP BY date),
sb AS (SELECT t.*, (SELECT avg(day_size) FROM sd) / day_size AS scale, lead(mid_raw) OVER (PARTITION BY date ORDER BY row0) - mid_raw AS step FROM trades t JOIN sd USING (date)),
sw AS (SELECT date, horizon, row0 // horizon AS w, count(*) AS n, sum(sign * size * scale) AS q, sum(sign) AS e, avg(sign) AS mean_sign, arg_min(mid_raw, row0) AS opened, arg_max(mid_raw, row0) + arg_max_null(step, row0) AS closed,
  avg(CASE WHEN step IS NULL THEN NULL WHEN step <> 0 THEN 1.0 ELSE 0.0 END) AS price_change_probability, avg(sign(step)) AS return_sign_imbalance FROM sb, (SELECT unnest({SCALING}) AS horizon) GROUP BY ALL),
sc AS (SELECT *, ln(CAST(closed AS DOUBLE) / opened) AS impact_log FROM sw WHERE n = horizon AND closed IS NOT NULL)"""
scaling = lambda s, d: W.scaling_windows(trades(s, d), SCALING)
add("q_scaling_windows", "date:s horizon:l w:l q:d e:l mean_sign:d impact_log:d price_change_probability:d return_sign_imbalance:d", scaling, "SELECT * FROM sc", _SCALE)
add("q_scaling_curve", "horizon:l bin:l x_mean:d y_mean:d n:l", lambda s, d: W.quantile_curve(scaling(s, d), ["horizon"], "e", "impact_log", 7), curve_sql("sc", "horizon", "e", "impact_log", 7), _SCALE)
_VAR = "SELECT horizon, stddev_samp(q) AS volume_scale, stddev_samp(e) AS flow_scale, stddev_samp(impact_log) AS return_scale, count(*) AS n FROM sc GROUP BY horizon"
variance = lambda s, d: scaling(s, d).groupBy("horizon").agg(F.stddev_samp("q").alias("volume_scale"), F.stddev_samp("e").alias("flow_scale"), F.stddev_samp("impact_log").alias("return_scale"), F.count("*").alias("n"))
add("q_variance_scaling", "horizon:l volume_scale:d flow_scale:d return_scale:d n:l", variance, _VAR, _SCALE)
LOGLOG = "slope:d intercept:d slope_se:d r2:d residual_sd:d n:l"
add("q_loglog_fit", LOGLOG, lambda s, d: R.loglog_fit(variance(s, d), "horizon", "flow_scale"), f"""SELECT slope, intercept, r2, n, sqrt(sse / (n - 2)) / sqrt(sxx) AS slope_se, sqrt(sse / (n - 2)) AS residual_sd FROM (
  SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_count(y, x) AS n, regr_sxx(y, x) AS sxx, greatest(0, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) AS sse FROM (SELECT ln(horizon) AS x, ln(flow_scale) AS y FROM ({_VAR}) WHERE flow_scale > 0))""", _SCALE)


def collapse(s: SparkSession, d: str) -> DataFrame:
    cells = W.curve_cells(scaling(s, d), ["horizon"], "e", "impact_log")
    return R.collapse(W.cell_curve(cells, ["horizon"], 7), W.cell_scales(cells, ["horizon"], "flow_scale", "return_scale"), "flow_scale", "return_scale")


add("q_collapse", "horizon:l bin:l x:d y:d", collapse, f"SELECT horizon, bin, x_mean / flow_scale AS x, y_mean / return_scale AS y FROM ({curve_sql('sc', 'horizon', 'e', 'impact_log', 7)}) JOIN ({_VAR}) USING (horizon)", _SCALE)
add("q_master_curve", "horizon:l bin:l x:d y:d", lambda s, d: collapse(s, d).withColumn("y", R.master_curve(F.col("x"), 1.5, 0.75)), f"SELECT horizon, bin, x_mean / flow_scale AS x, (x_mean / flow_scale) / pow(1 + pow(abs(x_mean / flow_scale), 1.5), 0.5) AS y FROM ({curve_sql('sc', 'horizon', 'e', 'impact_log', 7)}) JOIN ({_VAR}) USING (horizon)", _SCALE)
curve_scales = lambda s, d: R.volume_curve_scales(W.quantile_curve(scaling(s, d), ["horizon"], "q", "impact_log", 15))
add("q_volume_curve_scales", "horizon:l x_scale:d y_scale:d alpha:d beta:d cost:d success:b", curve_scales)
add("q_scaling_laws", "law:s " + LOGLOG, lambda s, d: R.scaling_laws(curve_scales(s, d)))
add("q_sample_summary", "trades:l median_size:d p10:d p90:d p99:d buy_share:d size_sd:d", lambda s, d: trades(s, d).agg(F.count("*").alias("trades"), F.percentile("size", 0.5).alias("median_size"), F.percentile("size", 0.1).alias("p10"), F.percentile("size", 0.9).alias("p90"), F.percentile("size", 0.99).alias("p99"), F.avg((F.col("sign") == 1).cast("double")).alias("buy_share"), F.stddev_samp("size").alias("size_sd")),
    "SELECT count(*) AS trades, quantile_cont(size, 0.5) AS median_size, quantile_cont(size, 0.1) AS p10, quantile_cont(size, 0.9) AS p90, quantile_cont(size, 0.99) AS p99, avg(CASE WHEN sign = 1 THEN 1.0 ELSE 0.0 END) AS buy_share, stddev_samp(size) AS size_sd FROM trades", TRADES_SQL)

# signs: lags, first-order autoregression, expectedness
_AR = TRADES_SQL + """,
lg AS (SELECT *, lag(sign, 1) OVER w AS l1, lag(sign, 2) OVER w AS l2, lag(sign, 3) OVER w AS l3 FROM trades WINDOW w AS (PARTITION BY date ORDER BY row0)),
ad AS (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS m FROM (SELECT DISTINCT date FROM trades)),
al AS (SELECT lg.*, r > greatest(1, least(m - 1, floor(0.8 * m))) AS is_test FROM lg JOIN ad USING (date) WHERE l1 IS NOT NULL),
ar AS (SELECT regr_slope(sign, l1) AS phi, regr_intercept(sign, l1) AS mu, count(*) AS n FROM al WHERE NOT is_test),
ex AS (SELECT al.*, mu + phi * l1 AS expected, sign * (mu + phi * l1) AS expectedness, size * CAST(1 AS DOUBLE) / (1 + row0 % 7) AS response, row0 % 4 AS stratum FROM al, ar)"""
add("q_sign_lags", "date:s row0:l l1:l l2:l l3:l", lambda s, d: L.with_lags(trades(s, d), 3), "SELECT date, row0, l1, l2, l3 FROM lg WHERE l3 IS NOT NULL", _AR)


def lagged(s: SparkSession, d: str, order: int) -> DataFrame:
    """Trades with their lags and the split, whose sessions are those of more trades than lags."""
    t = trades(s, d)
    return W.with_split(L.with_lags(t, order), sessions=t.groupBy("date").count().where(F.col("count") > order))


add("q_sign_ar1", "phi:d mu:d n:l", lambda s, d: L.first_order(lagged(s, d, 1)), "SELECT * FROM ar", _AR)
_LAGS = 10
_AR_TABLES = TRADES_SQL + f""",
la AS MATERIALIZED (SELECT * FROM (SELECT date, sign, list(sign::DOUBLE) OVER (PARTITION BY date ORDER BY row0 ROWS BETWEEN {_LAGS} PRECEDING AND 1 PRECEDING) AS prev FROM trades) WHERE len(prev) = {_LAGS}),
ld AS (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS m FROM (SELECT DISTINCT date FROM la)),
lx AS MATERIALIZED (SELECT sign, list_prepend(1.0::DOUBLE, list_reverse(prev)) AS x FROM la JOIN ld USING (date) WHERE r <= greatest(1, least(m - 1, floor(0.8 * m)))),
""" + eliminate_sql("le", f"SELECT i, j, sum(x[i] * CASE WHEN j = {_LAGS + 2} THEN sign::DOUBLE ELSE x[j] END) AS v FROM lx, (SELECT unnest(range(1, {_LAGS + 2})) AS i), (SELECT unnest(range(1, {_LAGS + 3})) AS j) GROUP BY i, j", _LAGS + 1)
add("q_sign_ar_coefficients", "lag:l coefficient:d", lambda s, d: L.autoregression(lagged(s, d, _LAGS).where("NOT is_test"), _LAGS), "SELECT i - 1 AS lag, v AS coefficient FROM le", _AR_TABLES)


def scored(s: SparkSession, d: str) -> DataFrame:
    """Test adapter for the line-item trades, which have no book: the sign expected from the one before (fitted on the
    training sessions), a made-up response and stratum from the row number, and a continuous score that breaks ties.
    The analysis of real orders is ``L.asymmetric_liquidity``."""
    data = lagged(s, d, 1)
    fit = L.first_order(data).first()
    expected = F.lit(fit["mu"]) + F.lit(fit["phi"]) * F.col("l1")
    out = data.withColumn("expected", expected).withColumn("expectedness", F.col("sign") * F.col("expected"))
    return out.withColumns(
        {
            "response": F.col("size").cast("double") / (1 + F.col("row0") % 7),
            "stratum": F.col("row0") % 4,
            "score": F.col("expectedness") + F.col("size") * F.lit(0.001),
        }
    )


add(
    "q_expectedness_bins", "sign:l bin:l n:l expected:d size:d size_ratio:d", lambda s, d: L.expectedness_bins(scored(s, d).where("is_test"), 5),
    """SELECT sign, bin, count(*) AS n, avg(expectedness) AS expected, avg(size) AS size, sum(response) / sum(size) AS size_ratio FROM (SELECT ex.*, len(list_filter(inner_, lambda e: e <= ex.expectedness + ex.size * 0.001)) AS bin FROM ex
      JOIN (SELECT sign, quantile_cont(expectedness + size * 0.001, [0.2, 0.4, 0.6, 0.8]) AS inner_ FROM ex WHERE is_test GROUP BY sign) USING (sign) WHERE is_test) GROUP BY sign, bin""", _AR,
)
_TAIL = "tl AS (SELECT *, CASE WHEN expectedness + size * 0.001 <= lo THEN 'surprising' WHEN expectedness + size * 0.001 >= hi THEN 'expected' END AS tail FROM ex JOIN (SELECT sign, quantile_cont(expectedness + size * 0.001, 0.1) AS lo, quantile_cont(expectedness + size * 0.001, 0.9) AS hi FROM ex WHERE is_test GROUP BY sign) USING (sign) WHERE is_test)"
tails = lambda s, d: L.tails(scored(s, d).where("is_test"))
add("q_tail_stats", "date:s sign:l tail:s n:l size:l response:d", lambda s, d: L.tail_statistics(tails(s, d)), "SELECT date, sign, tail, count(*) AS n, sum(size) AS size, sum(response) AS response FROM tl WHERE tail IS NOT NULL GROUP BY ALL", _AR + "," + _TAIL)
_CONTRAST = """SELECT date, sign, sum(w * (me - ms)) / sum(w) AS contrast, count(*) AS strata, sum(ns + ne) AS covered FROM (
  SELECT date, sign, stratum, count(*) FILTER (WHERE tail = 'surprising') AS ns, count(*) FILTER (WHERE tail = 'expected') AS ne, avg(response) FILTER (WHERE tail = 'surprising') AS ms, avg(response) FILTER (WHERE tail = 'expected') AS me,
  CAST(ns * ne AS DOUBLE) / nullif(ns + ne, 0) AS w FROM tl {0} GROUP BY date, sign, stratum) WHERE ns > 0 AND ne > 0 GROUP BY date, sign"""
add("q_stratified_contrast", "date:s sign:l contrast:d strata:l covered:l", lambda s, d: L.stratified_contrast(tails(s, d)), _CONTRAST.format(""), _AR + "," + _TAIL)
add("q_conditional_contrast", "date:s sign:l contrast:d strata:l covered:l", lambda s, d: L.stratified_contrast(tails(s, d).where("response > 5")), _CONTRAST.format("WHERE response > 5"), _AR + "," + _TAIL)
add("q_confusion", "sign:l tp:l fp:l fn:l tn:l precision_:d recall_:d", lambda s, d: L.confusion(scored(s, d).where("is_test"), F.col("expectedness") > 0, F.col("size") > 25),
    """SELECT sign, tp, fp, fn, tn, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision_, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall_ FROM (SELECT sign, count(*) FILTER (WHERE p AND o) AS tp, count(*) FILTER (WHERE p AND NOT o) AS fp,
      count(*) FILTER (WHERE NOT p AND o) AS fn, count(*) FILTER (WHERE NOT p AND NOT o) AS tn FROM (SELECT sign, expectedness > 0 AS p, size > 25 AS o FROM ex WHERE is_test) GROUP BY sign)""", _AR)  # fmt: skip

# persistence of signs
DFA, PERMUTATIONS = W.DFA_SCALES, 199
_DFA = TRADES_SQL + f""",
dc AS (SELECT *, sign - avg(sign) OVER (PARTITION BY date) AS c, count(*) OVER (PARTITION BY date) AS n FROM trades),
dy AS (SELECT *, sum(c) OVER (PARTITION BY date ORDER BY row0 ROWS UNBOUNDED PRECEDING) AS y FROM dc),
dp AS (SELECT date, scale, way, CASE way WHEN 'f' THEN row0 // scale ELSE CAST(floor((row0 - n % scale) / CAST(scale AS DOUBLE)) AS BIGINT) END AS seg, CASE way WHEN 'f' THEN row0 % scale ELSE (row0 - n % scale + scale) % scale END AS i, y, n // scale AS whole
  FROM dy, (SELECT unnest({DFA}) AS scale), (SELECT unnest(['f', 'b']) AS way) WHERE n >= scale),
dg AS (SELECT date, scale, way, seg, sum(y) AS sy, sum(y * y) AS syy, sum(i * y) AS siy FROM dp WHERE seg >= 0 AND seg < whole GROUP BY ALL),
df AS (SELECT date, scale, sqrt(avg(greatest(0, syy - sy * sy / scale - (siy - (scale - 1) / 2.0 * sy) ** 2 / (scale * (scale * scale - 1) / CAST(12 AS DOUBLE))) / scale)) AS fluctuation, count(*) AS segments FROM dg GROUP BY date, scale)"""
dfa = lambda s, d: W.dfa_fluctuations(trades(s, d), DFA)
add("q_dfa_fluctuations", "date:s scale:l fluctuation:d segments:l", dfa, "SELECT * FROM df", _DFA)
add("q_dfa_exponent", "date:s exponent:d scales:l", lambda s, d: R.exponents(dfa(s, d)), "SELECT date, regr_slope(ln(fluctuation), ln(scale)) AS exponent, count(*) AS scales FROM df WHERE fluctuation > 0 GROUP BY date", _DFA)
own_signs = lambda s, d: H.session_exponents(trades(s, d), DFA, 1, PERMUTATIONS).where("exponent IS NOT NULL")
add("q_sign_persistence", "date:s exponent:d p_value:d replicates:l", lambda s, d: own_signs(s, d).withColumn("replicates", F.lit(PERMUTATIONS)))
# the protocol over sessions of a least size; the months of the smaller tables hold some 750 trades, so it is lower here
LEAST = 512
_SESSIONS = f"""SELECT date, n AS trades, buys AS buy_fraction, n >= {LEAST} AS included, CASE WHEN n >= {LEAST} THEN exponent END AS exponent FROM (SELECT date, count(*) AS n, avg(CASE WHEN sign = 1 THEN 1.0 ELSE 0.0 END) AS buys FROM trades GROUP BY date)
  LEFT JOIN (SELECT date, regr_slope(ln(fluctuation), ln(scale)) AS exponent FROM df WHERE fluctuation > 0 GROUP BY date) USING (date)"""
protocol = lambda s, d, permutations: H.session_exponents(trades(s, d), DFA, LEAST, permutations)
included = lambda s, d: protocol(s, d, 1).where("included").select("date", F.round("exponent", 12).alias("exponent"))
add("q_persistence_sessions", "date:s trades:l buy_fraction:d included:b exponent:d", lambda s, d: protocol(s, d, 1), _SESSIONS, _DFA)
add("q_persistence_family", "sessions:l trades:l lower_quartile:d median:d upper_quartile:d null_lower:d null_median:d null_upper:d p_value:d permutations:l", lambda s, d: H.family_test(protocol(s, d, PERMUTATIONS)))
_MEDIAN = " UNION ALL ".join(
    f"""SELECT {b} AS block, any_value(n) AS sessions, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper, count(*) AS replicates FROM (SELECT rep, any_value(n) AS n, quantile_cont(exponent, 0.5) AS m FROM
      (SELECT rep, n, {f'{S.mixed_sql("rep", "pos", H.SEED)} % n' if b == 1 else f'({S.mixed_sql("rep", f"(pos // {b})", H.SEED)} % n + pos % {b}) % n'} AS r FROM (SELECT unnest(range({H.REPLICATES})) AS rep), (SELECT unnest(range(n)) AS pos, n FROM (SELECT count(*) AS n FROM pe))) JOIN pe USING (r) GROUP BY rep)"""
    for b in H.BLOCKS
)
add("q_persistence_medians", "block:l sessions:l median:d lower:d upper:d replicates:l", lambda s, d: H.median_intervals(included(s, d)), f"SELECT *, (SELECT quantile_cont(exponent, 0.5) FROM pe) AS median FROM ({_MEDIAN})", _DFA + f", pe AS MATERIALIZED (SELECT date, round(exponent, 12) AS exponent, row_number() OVER (ORDER BY date) - 1 AS r FROM ({_SESSIONS}) WHERE included AND exponent IS NOT NULL)")


def broken_signs(s: SparkSession, d: str) -> DataFrame:
    """The trades with signs of zero and places twice."""
    t = settled(trades(s, d)).withColumn("sign", F.when(F.col("row0") % 100 == 7, 0).otherwise(F.col("sign")))
    return t.unionByName(t.where("row0 = 3"))


_SIGNS = "SELECT 'sign_not_unit' AS rule, count(*) FILTER (WHERE sign NOT IN (-1, 1)) AS violations FROM {0} UNION ALL SELECT 'order_not_unique', count(*) FROM (SELECT 1 FROM {0} GROUP BY date, row0 HAVING count(*) > 1)"
add("q_contract_signs", "rule:s violations:l", lambda s, d: H.sign_violations(trades(s, d)), _SIGNS.format("trades"), TRADES_SQL)
add("q_contract_signs_broken", "rule:s violations:l", lambda s, d: H.sign_violations(broken_signs(s, d)), _SIGNS.format("bs"), TRADES_SQL + ", b1 AS (SELECT * REPLACE (CASE WHEN row0 % 100 = 7 THEN 0 ELSE sign END AS sign) FROM trades), bs AS (SELECT * FROM b1 UNION ALL SELECT * FROM b1 WHERE row0 = 3)")

"""Queries of the analysis of visible orders. The SQL solves the same 51 normal equations by elimination, one common table
for each unknown, so that scores, bins, tails and intervals are checked from the fit on."""

from __future__ import annotations


from tickforge.operators import fits as M
from tickforge.operators import liquidity as L
from tickforge.operators import orders as O
from tickforge.operators import scores as S
from tickforge.plans.books import FLOW_SQL, flow
from tickforge.plans.evaluations import REPLICATES, intervals_sql
from tickforge.plans.linear import eliminate_sql
from tickforge.plans.registry import add
from tickforge.plans.trades import _order_sql
from tickforge.sources.settle import settled

LIQUIDITY_FROM = "2024-01-20"
_K = L.LAGS + 1


def orders(s, d):
    return settled(O.visible_orders(flow(s, d)))


def liquidity(s, d, name: str):
    return L.asymmetric_liquidity(orders(s, d), LIQUIDITY_FROM)[name]


_FEATURES = f"""vo AS MATERIALIZED ({_order_sql("SELECT *, -direction AS trade_sign FROM flow WHERE event_type = 4 AND qm2 IS NOT NULL", "execution_count")}),
vf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY date ORDER BY first_event_row) - 1 AS row0, trade_sign AS sign, midpoint_twice_after_raw - midpoint_twice_before_raw AS mv,
  CASE WHEN size >= opposite_best_size_before THEN 1.0::DOUBLE ELSE 0.0 END AS penetrated_best, CASE WHEN midpoint_twice_after_raw <> midpoint_twice_before_raw THEN 1.0::DOUBLE ELSE 0.0 END AS midpoint_changed,
  10000.0::DOUBLE * trade_sign * (midpoint_twice_after_raw - midpoint_twice_before_raw) / midpoint_twice_before_raw AS {L.RESPONSE},
  ln(size) AS log_order_size, ln(opposite_best_size_before) AS log_opposite_depth, ln(size) - ln(opposite_best_size_before) AS log_size_to_depth, ln(same_side_best_size_before) AS log_same_side_depth,
  ln(opposite_best_size_before) - ln(same_side_best_size_before) AS log_opposite_to_same_depth, ln(spread_before) AS log_spread, floor((ts_us - {L.OPEN_US}) / {L.BUCKET_US}::DOUBLE) AS intraday_bucket FROM vo),
vl AS MATERIALIZED (SELECT * FROM (SELECT *, list(sign::DOUBLE) OVER (PARTITION BY date ORDER BY row0 ROWS BETWEEN {L.LAGS} PRECEDING AND 1 PRECEDING) AS prev FROM vf) WHERE len(prev) = {L.LAGS}),
vx AS MATERIALIZED (SELECT *, list_prepend(1.0::DOUBLE, list_reverse(prev)) AS x FROM vl)"""
_STEPS = eliminate_sql(
    "gx",
    f"""SELECT i, j, sum(x[i] * CASE WHEN j = {_K + 1} THEN sign::DOUBLE ELSE x[j] END) AS v FROM (SELECT x, sign FROM vx WHERE date < '{LIQUIDITY_FROM}'), (SELECT unnest(range(1, {_K + 1})) AS i), (SELECT unnest(range(1, {_K + 2})) AS j) GROUP BY i, j""",
    _K,
)
_SCORED = f"""vb AS MATERIALIZED (SELECT list(v ORDER BY i) AS b FROM gx),
vs AS MATERIALIZED (SELECT vx.* EXCLUDE (prev, x), list_sum(list_transform(range(1, {_K + 1}), lambda i: x[i] * b[i])) AS predicted_sign FROM vx, vb),
ve AS MATERIALIZED (SELECT *, sign * predicted_sign AS expectedness FROM vs),
vq AS MATERIALIZED (SELECT sign, quantile_cont(expectedness, {[i / L.BINS for i in range(L.BINS + 1)]}) AS edges FROM ve WHERE date < '{LIQUIDITY_FROM}' GROUP BY sign),
vt AS MATERIALIZED (SELECT ve.*, len(list_filter(edges[2:{L.BINS}], lambda e: e <= ve.expectedness)) AS bin FROM ve JOIN vq USING (sign) WHERE date >= '{LIQUIDITY_FROM}')"""
CTES = FLOW_SQL + ",\n" + _FEATURES + ",\n" + _STEPS + ",\n" + _SCORED
_METRICS = " ".join(f"{m}:d" for m in L.METRICS)
add("q_liquidity_coefficients", "lag:l coefficient:d", lambda s, d: liquidity(s, d, "coefficients"), "SELECT i - 1 AS lag, v AS coefficient FROM gx", CTES)
add(
    "q_liquidity_bins", f"sign:l bin:l n:l mean_expectedness:d penetration_probability:d midpoint_moves:l midpoint_move_probability:d mean_{L.RESPONSE}:d {L.CONDITIONAL}:d " + " ".join(f"mean_{m}:d" for m in L.METRICS[3:]) + " mean_spread:d",
    lambda s, d: liquidity(s, d, "bins"),
    f"""SELECT sign, bin, count(*) AS n, avg(expectedness) AS mean_expectedness, avg(penetrated_best) AS penetration_probability, sum(midpoint_changed) AS midpoint_moves, avg(midpoint_changed) AS midpoint_move_probability,
      avg({L.RESPONSE}) AS mean_{L.RESPONSE}, sum({L.RESPONSE}) / nullif(sum(midpoint_changed), 0) AS {L.CONDITIONAL}, {', '.join(f'avg({m}) AS mean_{m}' for m in L.METRICS[3:])}, avg(spread_before) AS mean_spread FROM vt GROUP BY sign, bin""", CTES,
)
_TAILS = f"SELECT date, sign, CASE WHEN bin = 0 THEN 'surprising' ELSE 'expected' END AS tail, count(*) AS n, {', '.join(f'sum({m}) AS {m}' for m in L.METRICS)} FROM vt WHERE bin IN (0, {L.BINS - 1}) GROUP BY ALL"
add("q_liquidity_tails", "date:s sign:l tail:s n:l " + _METRICS, lambda s, d: liquidity(s, d, "tails"), _TAILS, CTES)


def _strata_sql(source: str, metrics: tuple[str, ...]) -> str:
    part = lambda b, f, c: f"{f}({c}) FILTER (WHERE bin = {b})"
    means = ", ".join(f"{part(L.BINS - 1, 'avg', m)} - {part(0, 'avg', m)} AS {m}" for m in metrics)
    return f"""SELECT date, sign, sum(w) AS weight, {', '.join(f'coalesce(sum(w * {m}), 0) AS {m}' for m in metrics)} FROM (SELECT *, CASE WHEN ns > 0 AND ne > 0 THEN ns * ne / CAST(ns + ne AS DOUBLE) ELSE 0 END AS w FROM
      (SELECT date, sign, intraday_bucket, {part(0, 'count', '*')} AS ns, {part(L.BINS - 1, 'count', '*')} AS ne, {means} FROM {source} WHERE bin IN (0, {L.BINS - 1}) GROUP BY date, sign, intraday_bucket)) GROUP BY date, sign"""


_RAW = " UNION ALL ".join(f"SELECT 'raw' AS kind, '{name}' AS metric, date, sign, CASE WHEN tail = 'expected' THEN 1 ELSE -1 END AS part, {top} AS top, {under} AS under FROM lt" for name, top, under in [*((m, m, "n") for m in L.METRICS), (L.CONDITIONAL, L.RESPONSE, "midpoint_changed")])
_OWN = " UNION ALL ".join(f"SELECT 'intraday', '{name}', date, sign, 1, {m}, weight FROM {table}" for name, m, table in [*((m, m, "ls") for m in L.METRICS), (L.CONDITIONAL, L.RESPONSE, "lm")])
_DATES = "SELECT DISTINCT date FROM vt"


def _contrast_sql(block: int) -> str:
    index = f"{S.mixed_sql('rep', 'pos', L.SEED)} % n" if block == 1 else f"({S.mixed_sql('rep', f'(pos // {block})', L.SEED)} % n + pos % {block}) % n"
    return f"""SELECT kind, metric, {block} AS block_length, CASE WHEN count(v) = {REPLICATES} THEN quantile_cont(v, 0.025) END AS lower, CASE WHEN count(v) = {REPLICATES} THEN quantile_cont(v, 0.5) END AS median,
      CASE WHEN count(v) = {REPLICATES} THEN quantile_cont(v, 0.975) END AS upper, CASE WHEN count(v) = {REPLICATES} THEN avg(CASE WHEN v >= 0 THEN 1.0 ELSE 0.0 END) END AS share_not_negative FROM
      (SELECT kind, metric, rep, round(CASE WHEN count(t / nullif(u, 0)) = count(*) AND count(*) = any_value(cells) THEN sum(part * t / nullif(u, 0)) / 2 END, {M.PLACES}) AS v FROM
        (SELECT kind, metric, rep, sign, part, sum(m * top) AS t, sum(m * under) AS u FROM lx JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r FROM ({_DATES})) USING (date)
         JOIN (SELECT rep, r, count(*) AS m FROM (SELECT rep, {index} AS r FROM (SELECT unnest(range({REPLICATES})) AS rep), (SELECT unnest(range(n)) AS pos, n FROM (SELECT count(*) AS n FROM ({_DATES})))) GROUP BY rep, r) USING (r) GROUP BY ALL)
        JOIN (SELECT kind, CASE WHEN kind = 'raw' THEN 4 ELSE 2 END AS cells FROM (VALUES ('raw'), ('intraday')) k(kind)) USING (kind) GROUP BY kind, metric, rep) GROUP BY kind, metric"""


add(
    "q_liquidity_contrasts", "kind:s metric:s block_length:l expected_minus_surprising:d lower:d median:d upper:d share_not_negative:d replicates:l", lambda s, d: liquidity(s, d, "contrasts"),
    f"""SELECT *, {REPLICATES} AS replicates FROM ({' UNION ALL '.join(_contrast_sql(b) for b in L.BLOCKS)}) JOIN (SELECT kind, metric, CASE WHEN count(t / nullif(u, 0)) = count(*) AND count(*) = any_value(CASE WHEN kind = 'raw' THEN 4 ELSE 2 END) THEN sum(part * t / nullif(u, 0)) / 2 END AS expected_minus_surprising
      FROM (SELECT kind, metric, sign, part, sum(top) AS t, sum(under) AS u FROM lx GROUP BY ALL) GROUP BY kind, metric) USING (kind, metric)""",
    CTES + f",\nlt AS MATERIALIZED ({_TAILS}), ls AS MATERIALIZED ({_strata_sql('vt', L.METRICS)}), lm AS MATERIALIZED ({_strata_sql('(SELECT * FROM vt WHERE midpoint_changed = 1)', (L.RESPONSE,))}), lx AS MATERIALIZED ({_RAW} UNION ALL {_OWN})",
)
add(
    "q_liquidity_prediction", "block_length:l estimate:d lower:d median:d upper:d share_not_positive:d replicates:l", lambda s, d: liquidity(s, d, "prediction"),
    f"SELECT *, block AS block_length FROM ({intervals_sql('lp', _DATES, 'kind', 'a', 'b', True, L.BLOCKS, L.SEED)})",
    CTES + f", lp AS MATERIALIZED (SELECT 'signs' AS kind, date, sum((sign - predicted_sign) ** 2) AS a, sum((sign - mean_sign) ** 2) AS b FROM vt, (SELECT avg(sign) AS mean_sign FROM vx WHERE date < '{LIQUIDITY_FROM}') GROUP BY date)",
)

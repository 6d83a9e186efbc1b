"""Queries of the chronological evaluations: fits of all groups, scores, comparisons, selections and economics.

The SQL fits by the same Newton steps, written out as common tables, so that fits themselves are checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.operators import economics as N
from tickforge.operators import evaluate as E
from tickforge.operators import fits as M
from tickforge.operators import scores as S
from tickforge.plans import books as K
from tickforge.plans.registry import add
from tickforge.plans.signals import CELLS, FRACTIONS, REPLICATES, SAMPLE, SEED, TEST_FROM, quantile_sql
from tickforge.sources.settle import settled

SELECTION_FROM = "2024-01-18"
LOSS = "up_moves * (1 - p) ** 2 + down_moves * p ** 2"
STEPS = 16


def cells(s: SparkSession, d: str) -> DataFrame:
    return settled(K.G.order_flow_bins(K.lab(s, d), K.BINS).where(F.col("sample") == SAMPLE))


def using(keys: str) -> str:
    return f"USING ({keys})"


def able_sql(name: str, source: str, keys: str, test_from: str = TEST_FROM) -> str:
    parts = " AND ".join(f"coalesce(sum({c}) FILTER (WHERE date {op} '{test_from}'), 0) > 0" for c in ("up_moves", "down_moves") for op in ("<", ">="))
    return f"{name} AS MATERIALIZED (SELECT {keys} FROM {source} GROUP BY {keys} HAVING {parts})"


def fits_sql(name: str, source: str, keys: str, models: dict[str, tuple[str, ...]], steps: int = STEPS) -> str:
    """Common tables of Newton steps; the last is ``name``: keys, model, b0, b1, b2. source: keys, q, o, u, d."""
    listed = ", ".join(f"('{m}', {'queue_center' in f}, {'ofi_center' in f})" for m, f in models.items())
    by = f"{keys}, model"
    out = [
        f"""{name}_c AS MATERIALIZED (SELECT {by}, CASE WHEN uq THEN q ELSE 0 END AS x1, CASE WHEN uo THEN o ELSE 0 END AS x2, CAST(sum(u) AS DOUBLE) AS u, CAST(sum(d) AS DOUBLE) AS d
      FROM ({source}), (VALUES {listed}) m(model, uq, uo) GROUP BY ALL)""",
        f"{name}_0 AS MATERIALIZED (SELECT {by}, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM {name}_c GROUP BY {by} HAVING sum(u) > 0 AND sum(d) > 0)",
    ]
    for i in range(1, steps + 1):
        out.append(f"""{name}_h{i} AS MATERIALIZED (SELECT {by}, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(r) AS g0, sum(r * x1) AS g1, sum(r * x2) AS g2,
      sum(v) AS h00, sum(v * x1) AS h01, sum(v * x2) AS h02, coalesce(nullif(sum(v * x1 * x1), 0), 1) AS h11, sum(v * x1 * x2) AS h12, coalesce(nullif(sum(v * x2 * x2), 0), 1) AS h22
      FROM (SELECT *, u - (u + d) * p AS r, (u + d) * p * (1 - p) AS v FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM {name}_c JOIN {name}_{i - 1} {using(by)})) GROUP BY {by})""")
        last = name if i == steps else f"{name}_{i}"
        det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
        rows = (
            "(h11 * h22 - h12 * h12) * g0 + (h02 * h12 - h01 * h22) * g1 + (h01 * h12 - h02 * h11) * g2",
            "(h02 * h12 - h01 * h22) * g0 + (h00 * h22 - h02 * h02) * g1 + (h01 * h02 - h00 * h12) * g2",
            "(h01 * h12 - h02 * h11) * g0 + (h01 * h02 - h00 * h12) * g1 + (h00 * h11 - h01 * h01) * g2",
        )
        out.append(f"{last} AS MATERIALIZED (SELECT {by}, " + ", ".join(f"b{j} + greatest(-5.0, least(5.0, ({row}) / {det})) AS b{j}" for j, row in enumerate(rows)) + f" FROM {name}_h{i})")
    return ",\n".join(out)


def scored_sql(name: str, source: str, fits: str, keys: str, where: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT g.*, model, round(1 / (1 + exp(-(b0 + b1 * queue_center + b2 * ofi_center))), {M.PLACES}) AS p FROM {source} g JOIN {fits} {using(keys)} WHERE {where})"


def scores_sql(source: str, keys: str) -> str:
    by, n = f"{keys}, model", "sum(up_moves + down_moves)"
    held = f"least(greatest(p, {S.EPS}), 1 - {S.EPS})"
    return f"""SELECT * FROM (SELECT {by}, {n} AS n, sum({LOSS}) / {n} AS brier, -sum(up_moves * ln({held}) + down_moves * ln(1 - {held})) / {n} AS log_loss,
      sum(CASE WHEN p >= 0.5 THEN up_moves ELSE down_moves END) / {n} AS accuracy FROM {source} GROUP BY {by}) JOIN
      (SELECT {by}, sum(u * (below + 0.5 * d)) / nullif(CAST(sum(u) * sum(d) AS DOUBLE), 0) AS auc FROM (SELECT *, coalesce(sum(d) OVER (PARTITION BY {by} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {by}, p, sum(up_moves) AS u, sum(down_moves) AS d FROM {source} GROUP BY {by}, p)) GROUP BY {by}) {using(by)}"""


def intervals_sql(source: str, calendar: str, keys: str, a: str, b: str, improvement: bool = False, blocks: tuple[int, ...] = (1,), seed: int = SEED) -> str:
    """keys, block, clusters, replicates and the interval. source: keys, date, a, b; calendar: date."""
    parts = []
    for block in blocks:
        index = f"{S.mixed_sql('rep', 'pos', seed)} % n" if block == 1 else f"({S.mixed_sql('rep', f'(pos // {block})', seed)} % n + pos % {block}) % n"
        value = "1 - sum(m * {0}) / sum(m * {1})" if improvement else "sum(m * {0}) / sum(m * {1})"
        parts.append(f"""SELECT {keys}, {block} AS block, any_value(n) AS clusters, count(v) AS replicates, quantile_cont(v, 0.025) AS lower, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.975) AS upper,
      avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END) AS share_not_positive FROM (SELECT {keys}, rep, any_value(n) AS n, round({value.format(a, b)}, {M.PLACES}) AS v FROM {source} JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r, count(*) OVER () AS n FROM ({calendar})) USING (date)
      JOIN (SELECT rep, r, count(*) AS m FROM (SELECT rep, {index} AS r FROM (SELECT unnest(range({REPLICATES})) AS rep), (SELECT unnest(range(n)) AS pos, n FROM (SELECT count(*) AS n FROM ({calendar})))) GROUP BY rep, r) USING (r)
      GROUP BY {keys}, rep HAVING sum(m * {b}) > 0) GROUP BY {keys}""")
    whole = f"1 - sum({a}) / sum({b})" if improvement else f"sum({a}) / sum({b})"
    return f"SELECT * FROM (SELECT {keys}, {whole} AS estimate FROM {source} GROUP BY {keys}) JOIN ({' UNION ALL '.join(parts)}) {using(keys)}"


def paired_sql(name: str, source: str, keys: str, pairs: tuple[tuple[str, str], ...], per: str = "date") -> str:
    listed = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f"""{name}_l AS MATERIALIZED (SELECT {keys}, model, {per} AS date, sum({LOSS}) AS loss FROM {source} GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {keys}, challenger, reference, date, a.loss AS a, b.loss AS b FROM (VALUES {listed}) q(challenger, reference) JOIN {name}_l a ON a.model = challenger
  JOIN (SELECT {keys}, model, date, loss FROM {name}_l) b {using(f"{keys}, date")} WHERE b.model = reference)"""


TEST = f"date >= '{TEST_FROM}'"
TRAIN = f"date < '{TEST_FROM}'"
SCORES = "spread_bucket:s model:s n:l brier:d log_loss:d accuracy:d auc:d"
INTERVAL = "clusters:l replicates:l estimate:d lower:d median:d upper:d share_not_positive:d"
_FITTED = "SELECT {keys}, queue_center AS q, ofi_center AS o, up_moves AS u, down_moves AS d FROM {source} SEMI JOIN able {using} WHERE {where}"


def fitted_sql(source: str, keys: str, models: dict[str, tuple[str, ...]]) -> str:
    """able, fit and ev: the groups with both outcomes, their fits before the test, and the test cells with probabilities."""
    return ",\n".join(
        [able_sql("able", source, keys), fits_sql("fit", _FITTED.format(keys=keys, source=source, using=using(keys), where=TRAIN), keys, models), scored_sql("ev", source, "fit", keys, TEST)]
    )


_CL = CELLS + ", cx AS MATERIALIZED (SELECT * EXCLUDE (p, reference) FROM cl)"
_FLOW = _CL + ",\n" + fitted_sql("cx", "spread_bucket", M.MODELS)

add(
    "q_logit_fit", "spread_bucket:s feature:s coefficient:d", lambda s, d: E.logit_table(cells(s, d)),
    "SELECT spread_bucket, unnest(['intercept', 'queue_center', 'ofi_center']) AS feature, unnest([b0, b1, b2]) AS coefficient FROM fit",
    _CL + ",\n" + fits_sql("fit", "SELECT spread_bucket, queue_center AS q, ofi_center AS o, up_moves AS u, down_moves AS d FROM cx", "spread_bucket", {"both": M.FEATURES}),
)
add("q_order_flow_evaluation", SCORES, lambda s, d: E.evaluate_models(cells(s, d), TEST_FROM, M.MODELS), scores_sql("ev", "spread_bucket"), _FLOW)
add(
    "q_order_flow_comparisons", "spread_bucket:s challenger:s reference:s " + INTERVAL, lambda s, d: E.compare_models(cells(s, d), TEST_FROM, REPLICATES, SEED),
    intervals_sql("pd", f"SELECT DISTINCT date FROM cx WHERE {TEST}", "spread_bucket, challenger, reference", "a", "b", True), _FLOW + ",\n" + paired_sql("pd", "ev", "spread_bucket", M.PAIRS),
)

# the grid of the queue alone
_QUEUE = f"SELECT date, spread_bucket, {K.center_sql('bin', K.QUEUE_BINS)} AS queue_center, 0.0::DOUBLE AS ofi_center, observations, up_moves, down_moves FROM ({K.QUEUE_GRID}) WHERE sample = '{SAMPLE}'"
_QUEUE_CTES = K.LAB_SQL + f", cx AS MATERIALIZED ({_QUEUE}),\n" + fitted_sql("cx", "spread_bucket", {m: M.MODELS[m] for m in ("intercept", "queue")})


def queue_cells(s: SparkSession, d: str) -> DataFrame:
    own = K.G.queue_bins(K.lab(s, d), K.QUEUE_BINS).where(F.col("sample") == SAMPLE)
    return settled(own.withColumnRenamed("bin_center", "queue_center").withColumn("ofi_center", F.lit(0.0)))


add("q_queue_evaluation", SCORES, lambda s, d: E.evaluate_models(queue_cells(s, d), TEST_FROM, {m: M.MODELS[m] for m in ("intercept", "queue")}), scores_sql("ev", "spread_bucket"), _QUEUE_CTES)
add("q_queue_comparison", "spread_bucket:s challenger:s reference:s " + INTERVAL, lambda s, d: E.compare_models(queue_cells(s, d), TEST_FROM, REPLICATES, SEED, (("queue", "intercept"),)), intervals_sql("pd", f"SELECT DISTINCT date FROM cx WHERE {TEST}", "spread_bucket, challenger, reference", "a", "b", True), _QUEUE_CTES + ",\n" + paired_sql("pd", "ev", "spread_bucket", (("queue", "intercept"),)))
add("q_queue_calibration", "spread_bucket:s queue_center:d n:l up_moves:l predicted:d observed:d", lambda s, d: E.queue_calibration(queue_cells(s, d), TEST_FROM), "SELECT spread_bucket, queue_center, sum(up_moves + down_moves) AS n, sum(up_moves) AS up_moves, max(p) AS predicted, sum(up_moves) / sum(up_moves + down_moves) AS observed FROM ev WHERE model = 'queue' GROUP BY spread_bucket, queue_center", _QUEUE_CTES)

# several resolutions, joined one to one with their comparisons
_GRIDS = "SELECT grid_bins_per_axis, g.* EXCLUDE (grid_bins_per_axis) FROM (" + " UNION ALL ".join(f"SELECT {n} AS grid_bins_per_axis, * FROM ({K.flow_grid_sql(n)}) WHERE sample = '{SAMPLE}'" for n in (21, 31, 41)) + ") g"
_GRID_KEYS = "grid_bins_per_axis, spread_bucket"


def grids(s: SparkSession, d: str) -> DataFrame:
    n = F.col("grid_bins_per_axis")
    own = K.several_grids(s, d).where(F.col("sample") == SAMPLE)
    return settled(own.withColumns({c: -1.0 + 2.0 * (F.col(b) + 0.5) / n for c, b in (("queue_center", "queue_bin"), ("ofi_center", "ofi_bin"))}))


add(
    "q_order_flow_grids", "grid_bins_per_axis:l " + SCORES + " estimate:d lower:d median:d upper:d share_not_positive:d", lambda s, d: E.evaluate_grids(grids(s, d), TEST_FROM, REPLICATES, SEED),
    f"SELECT * FROM ({scores_sql('ev', _GRID_KEYS)}) JOIN (SELECT * EXCLUDE (reference, challenger, block, clusters, replicates), challenger AS model FROM ({intervals_sql('pd', f'SELECT DISTINCT date FROM cx WHERE {TEST}', _GRID_KEYS + ', challenger, reference', 'a', 'b', True)})) USING ({_GRID_KEYS}, model)",
    K.LAB_SQL + f", cx AS MATERIALIZED ({_GRIDS}),\n" + fitted_sql("cx", _GRID_KEYS, M.MODELS) + ",\n" + paired_sql("pd", "ev", _GRID_KEYS, tuple(p for p in M.PAIRS if p[1] == "intercept")),
)

# horizons: chosen on the selection sessions, tested afterwards
_HK = "spread_bucket, horizon_kind, horizon_value"
_HORIZON_COLUMNS = "baseline_estimate:d baseline_lower:d baseline_upper:d price_spell_estimate:d price_spell_lower:d price_spell_upper:d"
_SIDE = "SELECT {keys}, queue_center AS q, ofi_center AS o, up_moves AS u, down_moves AS d FROM cx WHERE {where}"
_HORIZON_SQL = (
    K.HORIZON_CTES + f", cx AS MATERIALIZED ({K.centered(K.HORIZON_GRID)}),\n"
    + fits_sql("early", _SIDE.format(keys=_HK, where=f"date < '{SELECTION_FROM}'"), _HK, E.HORIZON_MODELS) + ",\n"
    + scored_sql("mid", "cx", "early", _HK, f"date >= '{SELECTION_FROM}' AND {TRAIN}") + ",\n"
    + fits_sql("outer_fit", _SIDE.format(keys=_HK, where=TRAIN), _HK, {"intercept": ()} | E.HORIZON_MODELS) + ",\n"
    + scored_sql("late", "cx", "outer_fit", _HK, TEST)
    + f""",
sb AS MATERIALIZED (SELECT {_HK}, model, round(sum({LOSS}) / sum(up_moves + down_moves), {M.PLACES}) AS selection_brier FROM mid GROUP BY {_HK}, model),
best AS MATERIALIZED (SELECT spread_bucket, model, horizon_kind, horizon_value FROM (SELECT *, row_number() OVER (PARTITION BY spread_bucket, model ORDER BY selection_brier, horizon_kind = 'clock_us', horizon_value) AS place FROM sb WHERE horizon_kind <> 'price_spell') WHERE place = 1),
tb AS MATERIALIZED (SELECT {_HK}, model, sum({LOSS}) / sum(up_moves + down_moves) AS test_brier FROM late GROUP BY {_HK}, model),
hl AS MATERIALIZED (SELECT {_HK}, model, date, sum({LOSS}) AS loss FROM late GROUP BY ALL),
own AS MATERIALIZED (SELECT b.spread_bucket, b.model AS selected_model, l.date, l.loss FROM best b JOIN hl l USING ({_HK}, model)),
pd AS MATERIALIZED (SELECT o.*, 'baseline' AS reference, o.loss AS a, l.loss AS b FROM own o JOIN best s ON s.spread_bucket = o.spread_bucket AND s.model = o.selected_model JOIN hl l ON l.spread_bucket = s.spread_bucket AND l.horizon_kind = s.horizon_kind AND l.horizon_value = s.horizon_value AND l.model = 'intercept' AND l.date = o.date
  UNION ALL SELECT o.*, 'price_spell', o.loss, l.loss FROM own o JOIN hl l ON l.spread_bucket = o.spread_bucket AND l.horizon_kind = 'price_spell' AND l.model = o.selected_model AND l.date = o.date),
iv AS MATERIALIZED ({intervals_sql('pd', f'SELECT DISTINCT date FROM cx WHERE {TEST}', 'spread_bucket, selected_model, reference', 'a', 'b', True)}),
gn AS (SELECT spread_bucket, selected_model AS model, {', '.join(f"max({c}) FILTER (WHERE reference = '{n}') AS {n}_{c}" for n in ('baseline', 'price_spell') for c in ('estimate', 'lower', 'upper'))} FROM iv GROUP BY ALL)"""
)
add(
    "q_horizon_selection", "spread_bucket:s model:s horizon_kind:s horizon_value:l selection_brier:d chosen:b test_brier:d " + _HORIZON_COLUMNS,
    lambda s, d: E.select_horizon(settled(K.horizon_grid(s, d)), SELECTION_FROM, TEST_FROM, REPLICATES, SEED),
    f"""SELECT sb.*, best.horizon_value IS NOT NULL AS chosen, CASE WHEN best.horizon_value IS NOT NULL OR horizon_kind = 'price_spell' THEN test_brier END AS test_brier,
      {', '.join(f"CASE WHEN best.horizon_value IS NOT NULL THEN {c.split(':')[0]} END AS {c.split(':')[0]}" for c in _HORIZON_COLUMNS.split())}
      FROM sb LEFT JOIN best USING ({_HK}, model) LEFT JOIN tb USING ({_HK}, model) LEFT JOIN gn USING (spread_bucket, model)""",
    _HORIZON_SQL,
)

# expanding origins over the landmark grid; the events table spans a month, so its units are weeks here
FIRST, UNIT, BLOCKS = 2, "week", (1, 2, 3)
_OK = "spread_bucket, origin"
_ORIGIN = "strftime(date_trunc('week', CAST(date AS DATE)), '%Y-%m-%d')"
_STABLE = (
    K.LANDMARK_CTES + f""", cx AS MATERIALIZED (SELECT *, {_ORIGIN} AS origin FROM ({K.centered(K.LANDMARK_GRID)}) WHERE latency_us = 0),
og AS MATERIALIZED (SELECT origin FROM (SELECT origin, row_number() OVER (ORDER BY origin) AS unit FROM (SELECT DISTINCT origin FROM cx)) WHERE unit > {FIRST}),
"""
    + fits_sql("fit", "SELECT spread_bucket, og.origin, queue_center AS q, ofi_center AS o, up_moves AS u, down_moves AS d FROM cx JOIN og ON cx.origin < og.origin", _OK, M.MODELS) + ",\n"
    + scored_sql("ev", "(SELECT * FROM cx SEMI JOIN og USING (origin))", "fit", _OK, "true")
)


def rolling(s: SparkSession, d: str) -> DataFrame:
    return settled(E.rolling_scored(settled(K.landmark_grid(s, d).where("latency_us = 0")), FIRST, UNIT))


_FOLDS = f"SELECT f.*, 1 - brier / base AS improvement FROM ({scores_sql('ev', _OK)}) f JOIN (SELECT {_OK}, sum({LOSS}) / sum(up_moves + down_moves) AS base FROM ev WHERE model = 'intercept' GROUP BY {_OK}) {using(_OK)}"
add("q_signal_stability", "spread_bucket:s origin:s model:s n:l brier:d log_loss:d accuracy:d auc:d improvement:d", lambda s, d: E.rolling_folds(rolling(s, d)), _FOLDS, _STABLE)
add("q_stability_summary", "spread_bucket:s model:s folds:l positive_folds:l pooled_improvement:d least_improvement:d median_improvement:d", lambda s, d: E.stability_summary(E.rolling_folds(rolling(s, d)).withColumns({"brier": F.round("brier", 12), "improvement": F.round("improvement", 9)})), f"SELECT spread_bucket, model, count(*) AS folds, count(*) FILTER (WHERE improvement > 0) AS positive_folds, 1 - sum(brier * n) / sum(brier / (1 - improvement) * n) AS pooled_improvement, min(improvement) AS least_improvement, quantile_cont(improvement, 0.5) AS median_improvement FROM (SELECT * REPLACE (round(brier, 12) AS brier, round(improvement, 9) AS improvement) FROM ({_FOLDS})) GROUP BY spread_bucket, model", _STABLE)
_PAIR_KEYS = "spread_bucket, challenger, reference"
add(
    "q_stability_comparisons", "spread_bucket:s challenger:s reference:s block:l " + INTERVAL + " positive_months:l months:l", lambda s, d: E.rolling_comparisons(rolling(s, d), REPLICATES, SEED, BLOCKS),
    f"SELECT * FROM ({intervals_sql('pd', 'SELECT DISTINCT date FROM ev', _PAIR_KEYS, 'a', 'b', True, BLOCKS)}) JOIN (SELECT {_PAIR_KEYS}, count(*) FILTER (WHERE a < b) AS positive_months, count(*) AS months FROM pm GROUP BY {_PAIR_KEYS}) {using(_PAIR_KEYS)}",
    _STABLE + ",\n" + paired_sql("pd", "ev", "spread_bucket", E.STABILITY_PAIRS) + ",\n" + paired_sql("pm", "ev", "spread_bucket", E.STABILITY_PAIRS, "origin"),
)


def broken_landmarks(s: SparkSession, d: str) -> DataFrame:
    """The landmark grid with moves added, cells twice and a bucket gone."""
    grid = settled(K.landmark_grid(s, d)).where("NOT (latency_us = 0 AND spread_bucket = 'one_tick')")
    grid = grid.withColumn("up_moves", F.when(F.col("queue_bin") == 3, F.col("up_moves") + 1).otherwise(F.col("up_moves")))
    return grid.unionByName(grid.where("ofi_bin = 15"))


_BROKEN = f"b0 AS (SELECT * REPLACE (CASE WHEN queue_bin = 3 THEN up_moves + 1 ELSE up_moves END AS up_moves) FROM ({K.centered(K.LANDMARK_GRID)}) WHERE NOT (latency_us = 0 AND spread_bucket = 'one_tick')), bg AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE ofi_bin = 15)"
_RULES = """SELECT 'moves_match' AS rule, count(*) FILTER (WHERE signals <> up_moves + down_moves) AS violations FROM {0} UNION ALL SELECT 'negative_counts', count(*) FILTER (WHERE least(signals, up_moves, down_moves) < 0) FROM {0}
  UNION ALL SELECT 'duplicate_cells', count(*) FROM (SELECT 1 FROM {0} WHERE latency_us = 0 GROUP BY date, spread_bucket, queue_bin, ofi_bin HAVING count(*) > 1)
  UNION ALL SELECT 'missing_buckets', 2 - count(DISTINCT spread_bucket) FILTER (WHERE latency_us = 0 AND spread_bucket IN ('all_spreads', 'one_tick')) FROM {0}"""
add("q_contract_stability", "rule:s violations:l", lambda s, d: E.stability_violations(K.landmark_grid(s, d)), _RULES.format("bg"), K.LANDMARK_CTES + f", bg AS ({K.centered(K.LANDMARK_GRID)})")
add("q_contract_stability_broken", "rule:s violations:l", lambda s, d: E.stability_violations(broken_landmarks(s, d)), _RULES.format("bg"), K.LANDMARK_CTES + ", " + _BROKEN)

# economics with fits, for every bucket, model, fraction and policy axis
_BY = "spread_bucket, model"
_PART = [1 - f for f in FRACTIONS if f < 1]


def economics_sql(ctes: str, grid: str, outcomes: N.Outcomes) -> tuple[str, str]:
    """(common tables, body) of ``signal_economics``."""
    axes, trips = ", ".join(outcomes.axes), "shares" in outcomes.axes
    first = "latency_us = 0" + (" AND shares = 1" if trips else "")
    side = lambda what: f"CASE WHEN p >= 0.5 THEN long_{what} ELSE short_{what} END"
    move = "CASE WHEN p >= 0.5 THEN 1 ELSE -1 END * midpoint_move_sum_bps"
    sums = {x: side(f"{x}_sum_bps") for x in outcomes.sums} if trips else {"gross": move, "half_spread": "half_spread_sum_bps", "net": f"{move} - half_spread_sum_bps"}
    executed = side("fills") if trips else "executable"
    meets = f"conf >= cutoff OR abs(conf - cutoff) <= {S.EPS}"
    policy = f"{_BY}, fraction, {axes}"
    tables = ctes + f""", mg AS MATERIALIZED ({K.centered(grid)}), cx AS MATERIALIZED (SELECT * FROM mg WHERE {first}),
{able_sql('able', 'cx', 'spread_bucket')},
{fits_sql('fit', _FITTED.format(keys='spread_bucket', source='cx', using=using('spread_bucket'), where=TRAIN), 'spread_bucket', N.MODELS)},
{scored_sql('tr', 'cx', 'fit', 'spread_bucket', TRAIN)}, te AS MATERIALIZED (SELECT *, abs(p - 0.5) AS conf, up_moves + down_moves AS w FROM tr),
{scored_sql('ev', 'mg', 'fit', 'spread_bucket', TEST)},
cut AS MATERIALIZED (SELECT {_BY}, round(1 - point, 9) AS fraction, round(value, {M.PLACES}) AS cutoff FROM ({quantile_sql('te', 'conf', _PART, keys=_BY)}) UNION ALL SELECT DISTINCT {_BY}, 1.0, 0.0 FROM te),
ach AS (SELECT {_BY}, fraction, sum(w) FILTER (WHERE {meets}) / sum(w) AS train_fraction FROM te JOIN cut {using(_BY)} GROUP BY ALL),
dy AS MATERIALIZED (SELECT {policy}, date, sum(signals) AS signals, sum({outcomes.arrived}) AS arrived, sum({executed}) AS executions, {', '.join(f'sum({c}) AS {x}' for x, c in sums.items())}
  FROM (SELECT *, abs(p - 0.5) AS conf FROM ev) JOIN cut {using(_BY)} WHERE {meets} GROUP BY ALL),
tot AS (SELECT {policy}, sum(signals) AS signals, sum(arrived) AS arrived, sum(executions) AS executions, {', '.join(f'sum({x}) / nullif(sum(executions), 0) AS {x}_bps' for x in sums)} FROM dy GROUP BY ALL),
iv AS MATERIALIZED ({intervals_sql('dy', f'SELECT DISTINCT date FROM mg WHERE {TEST}', policy, outcomes.sums[-1], 'executions')})"""
    body = f"""SELECT {policy}, cutoff, train_fraction, coalesce(signals, 0) AS signals, coalesce(arrived, 0) AS arrived, coalesce(executions, 0) AS executions, {', '.join(f'{x}_bps' for x in sums)}, clusters, lower, median, upper, share_not_positive
      FROM cut JOIN (SELECT DISTINCT spread_bucket, {axes} FROM mg WHERE {TEST}) USING (spread_bucket) LEFT JOIN ach USING ({_BY}, fraction) LEFT JOIN tot USING ({policy}) LEFT JOIN iv USING ({policy})"""
    return tables, body


_TAIL = " clusters:l lower:d median:d upper:d share_not_positive:d"
_HEAD = "spread_bucket:s model:s fraction:d latency_us:l cutoff:d train_fraction:d signals:l arrived:l executions:l "
for _name, _grid, _ctes, _sql, _kind in (
    ("q_markout_evaluation", K.markouts, K.MARKOUT_CTES, K.MARKOUT_GRID, N.MARKOUTS),
    ("q_landmark_evaluation", K.landmark_grid, K.LANDMARK_CTES, K.LANDMARK_GRID, N.MARKOUTS),
    ("q_round_trip_evaluation", K.trip_grid, K.TRIP_CTES, K.TRIP_GRID, N.ROUND_TRIPS),
):
    _tables, _body = economics_sql(_ctes, _sql, _kind)
    _spec = (_HEAD.replace("cutoff:d", "shares:l cutoff:d") if "shares" in _kind.axes else _HEAD) + " ".join(f"{x}_bps:d" for x in _kind.sums) + _TAIL
    add(_name, _spec, lambda s, d, g=_grid, k=_kind: N.signal_economics(settled(g(s, d)), TEST_FROM, k, FRACTIONS, REPLICATES, SEED), _body, _tables)
_DIRECTION = K.MARKOUT_CTES + f", cx AS MATERIALIZED (SELECT * FROM ({K.centered(K.MARKOUT_GRID)}) WHERE latency_us = 0),\n" + fitted_sql("cx", "spread_bucket", {"intercept": ()} | N.MODELS)
add(
    "q_markout_direction", SCORES + " " + INTERVAL, lambda s, d: N.direction_scores(settled(K.markouts(s, d).where("latency_us = 0")), TEST_FROM, REPLICATES, SEED),
    f"SELECT * FROM ({scores_sql('ev', 'spread_bucket')}) JOIN (SELECT * EXCLUDE (challenger, reference, block), challenger AS model FROM ({intervals_sql('pd', f'SELECT DISTINCT date FROM cx WHERE {TEST}', _PAIR_KEYS, 'a', 'b', True)})) USING (spread_bucket, model)",
    _DIRECTION + ",\n" + paired_sql("pd", "ev", "spread_bucket", tuple((m, "intercept") for m in N.MODELS)),
)

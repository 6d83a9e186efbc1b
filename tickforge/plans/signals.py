"""Queries over grids: scores of signals, cutoffs, economics, resampling and the chronological evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.operators import evaluate as E
from tickforge.operators import scores as S
from tickforge.plans import books as K
from tickforge.plans.registry import add
from tickforge.sources.settle import settled

QUEUE, OFI = 1.3, 1.1
FRACTIONS = [1.0, 0.2, 0.1, 0.05]
TEST_FROM = "2024-01-25"
REPLICATES, SEED = 10_000, 17
SAMPLE = "best_quote_updates"


def cells(s: SparkSession, d: str) -> DataFrame:
    """The order-flow grid at best-quote updates with a fixed-coefficient probability."""
    grid = K.G.order_flow_bins(K.lab(s, d), K.BINS).where(F.col("sample") == SAMPLE)
    return grid.withColumn("p", S.logit_probability(QUEUE, OFI)).withColumn("reference", S.logit_probability(QUEUE, 0.0))


_P = "1 / (1 + exp(-({0} * queue_center + {1} * ofi_center)))"
CELLS = K.LAB_SQL + f""",
cl AS (SELECT *, {_P.format(QUEUE, OFI)} AS p, {_P.format(QUEUE, 0)} AS reference FROM ({K.flow_grid_sql(K.BINS)}) WHERE sample = '{SAMPLE}'),
cw AS (SELECT *, abs(p - 0.5) AS conf, up_moves + down_moves AS w FROM cl)"""
add("q_compressed_rows", "spread_bucket:s target:l rows:l weight:l", lambda s, d: S.binary_rows(cells(s, d)).groupBy("spread_bucket", "target").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight")), "SELECT spread_bucket, target, count(*) AS rows, sum(weight) AS weight FROM (SELECT spread_bucket, 1 AS target, up_moves AS weight FROM cl UNION ALL SELECT spread_bucket, 0, down_moves FROM cl) WHERE weight > 0 GROUP BY ALL", CELLS)
_LOSS = "up_moves * (1 - {0}) ** 2 + down_moves * {0} ** 2"
add("q_brier_logloss", "spread_bucket:s n:l brier:d log_loss:d accuracy:d", lambda s, d: S.binary_scores(cells(s, d), ["spread_bucket"]), f"SELECT spread_bucket, sum(w) AS n, sum({_LOSS.format('p')}) / sum(w) AS brier, -sum(up_moves * ln(p) + down_moves * ln(1 - p)) / sum(w) AS log_loss, sum(CASE WHEN p >= 0.5 THEN up_moves ELSE down_moves END) / sum(w) AS accuracy FROM cw GROUP BY spread_bucket", CELLS)
# probabilities are rounded before they are ranked, so that both engines see the same ties
ranked = lambda s, d: cells(s, d).withColumn("p", F.round("p", 12))
RANKED = CELLS + ", ck AS (SELECT date, spread_bucket, queue_bin, ofi_bin, queue_center, ofi_center, observations, up_moves, down_moves, w, round(p, 12) AS p, abs(round(p, 12) - 0.5) AS conf, reference FROM cw)"
add("q_weighted_auc", "spread_bucket:s up:l down:l auc:d", lambda s, d: S.auc(ranked(s, d), ["spread_bucket"]), "SELECT spread_bucket, sum(u) AS up, sum(d) AS down, sum(u * (below + 0.5 * d)) / nullif(CAST(sum(u) * sum(d) AS DOUBLE), 0) AS auc FROM (SELECT *, coalesce(sum(d) OVER (PARTITION BY spread_bucket ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT spread_bucket, p, sum(up_moves) AS u, sum(down_moves) AS d FROM ck GROUP BY spread_bucket, p)) GROUP BY spread_bucket", RANKED)


def quantile_sql(source: str, x: str, points: list[float], where: str = "true", keys: str = "spread_bucket") -> str:
    listed = ", ".join(f"CAST({p!r} AS DOUBLE)" for p in points)
    return f"""SELECT {keys}, point, max(value) AS value FROM (SELECT {keys}, point, CASE WHEN first AND point <= pos THEN x WHEN point > pos AND next_pos IS NULL THEN x
      WHEN point > pos AND point <= next_pos THEN x + (point - pos) / (next_pos - pos) * (next_x - x) END AS value FROM (SELECT *, lead(pos) OVER o AS next_pos, lead(x) OVER o AS next_x, row_number() OVER o = 1 AS first FROM
      (SELECT {keys}, date, queue_bin, ofi_bin, {x} AS x, (sum(w) OVER (PARTITION BY {keys} ORDER BY {x}, date, queue_bin, ofi_bin ROWS UNBOUNDED PRECEDING) - 0.5 * w) / CAST(sum(w) OVER (PARTITION BY {keys}) AS DOUBLE) AS pos FROM {source} WHERE w > 0 AND {where})
      WINDOW o AS (PARTITION BY {keys} ORDER BY x, date, queue_bin, ofi_bin)), (SELECT unnest([{listed}]) AS point)) WHERE value IS NOT NULL GROUP BY {keys}, point"""


PART = [1 - f for f in FRACTIONS if f < 1]
CUTOFF_SQL = f"SELECT spread_bucket, round(1 - point, 9) AS fraction, value AS cutoff FROM ({quantile_sql('ck', 'conf', PART)}) UNION ALL SELECT DISTINCT spread_bucket, 1.0, 0.0 FROM ck"
cutoffs = lambda s, d: S.confidence_cutoffs(ranked(s, d), ["spread_bucket"], FRACTIONS)
add("q_confidence_cutoff", "spread_bucket:s fraction:d cutoff:d", cutoffs, CUTOFF_SQL, RANKED)
DECILES = [i / 10 for i in range(1, 10)]


def edges(s: SparkSession, d: str) -> DataFrame:
    rows = ranked(s, d).where(F.col("date") < TEST_FROM).withColumn("w", F.col("up_moves") + F.col("down_moves"))
    return S.weighted_quantiles(rows, ["spread_bucket"], "p", "w", DECILES, S.CELL_ORDER)


EDGES_SQL = quantile_sql("ck", "p", DECILES, f"date < '{TEST_FROM}'")
add("q_weighted_quantile_edges", "spread_bucket:s point:d value:d", edges, EDGES_SQL, RANKED)


def calibration(s: SparkSession, d: str) -> DataFrame:
    inner = edges(s, d).groupBy("spread_bucket").agg(F.collect_set("value").alias("inner_edges"))  # nine values each
    rows = ranked(s, d).where(F.col("date") >= TEST_FROM).join(inner, "spread_bucket")
    w = F.col("up_moves") + F.col("down_moves")
    rows = rows.withColumn("bin", F.size(F.filter("inner_edges", lambda e: F.round(e, 9) <= F.round("p", 9))))
    return rows.groupBy("spread_bucket", "bin").agg(F.sum(w).alias("n"), (F.sum(F.col("p") * w) / F.sum(w)).alias("predicted"), (F.sum("up_moves") / F.sum(w)).alias("observed"))


add("q_prob_calibration", "spread_bucket:s bin:l n:l predicted:d observed:d", calibration, f"SELECT spread_bucket, bin, sum(w) AS n, sum(p * w) / sum(w) AS predicted, sum(up_moves) / sum(w) AS observed FROM (SELECT ck.*, len(list_filter(e, lambda x: round(x, 9) <= round(ck.p, 9))) AS bin FROM ck JOIN (SELECT spread_bucket, list(DISTINCT value) AS e FROM ({EDGES_SQL}) GROUP BY spread_bucket) USING (spread_bucket) WHERE date >= '{TEST_FROM}') GROUP BY spread_bucket, bin", RANKED)

# resampling of whole sessions
daily = lambda s, d: cells(s, d).where("spread_bucket = 'all_spreads'").groupBy("date").agg(S.squared_loss("p").alias("challenger"), S.squared_loss("reference").alias("reference"))
DAILY = CELLS + f", dl AS (SELECT date, sum({_LOSS.format('p')}) AS challenger, sum({_LOSS.format('reference')}) AS reference, row_number() OVER (ORDER BY date) - 1 AS r, count(*) OVER () AS n FROM cl WHERE spread_bucket = 'all_spreads' GROUP BY date)"
INTERVAL = "estimate:d lower:d median:d upper:d share_not_positive:d replicates:l"


def interval_sql(index: str) -> str:
    return f"""SELECT (SELECT 1 - sum(challenger) / sum(reference) FROM dl) AS estimate, quantile_cont(gain, 0.025) AS lower, quantile_cont(gain, 0.5) AS median, quantile_cont(gain, 0.975) AS upper,
      avg(CASE WHEN gain <= 0 THEN 1.0 ELSE 0.0 END) AS share_not_positive, count(*) AS replicates FROM (SELECT rep, 1 - sum(challenger) / sum(reference) AS gain FROM
      (SELECT rep, pos, {index} AS r FROM (SELECT unnest(range({REPLICATES})) AS rep), (SELECT unnest(range((SELECT max(n) FROM dl))) AS pos, (SELECT max(n) FROM dl) AS n)) JOIN dl USING (r) GROUP BY rep)"""


def interval(s: SparkSession, d: str, block: int | None = None) -> DataFrame:
    return S.improvement_interval(daily(s, d), REPLICATES, SEED, block)


add("q_cluster_bootstrap", INTERVAL, interval, interval_sql(f"{S.mixed_sql('rep', 'pos', SEED)} % n"), DAILY)
add("q_circular_block_bootstrap", INTERVAL, lambda s, d: interval(s, d, 5), interval_sql(f"({S.mixed_sql('rep', '(pos // 5)', SEED)} % n + pos % 5) % n"), DAILY)

# economics of selected signals
FEW = ["spread_bucket"]


def chosen_cutoffs(s: SparkSession, d: str) -> DataFrame:
    return cutoffs(s, d).withColumns({"cutoff": F.round("cutoff", 9), "fraction": F.round("fraction", 9)})


probability = lambda df: df.withColumn("p", F.round(S.logit_probability(QUEUE, OFI), 9))


def markout_economics(s: SparkSession, d: str) -> DataFrame:
    return E.markout_economics(S.selected(probability(K.markouts(s, d)), chosen_cutoffs(s, d), FEW))


def _chosen(grid: str) -> str:
    return f"""sel AS (SELECT g.*, fraction, CASE WHEN p >= 0.5 THEN 1 ELSE -1 END AS action FROM (SELECT *, round({_P.format(QUEUE, OFI)}, 9) AS p FROM ({grid})) g
      JOIN (SELECT spread_bucket, fraction, round(cutoff, 9) AS cutoff FROM ({CUTOFF_SQL})) c USING (spread_bucket) WHERE abs(p - 0.5) >= cutoff OR abs(abs(p - 0.5) - cutoff) <= {S.EPS})"""


add("q_markout_economics", "spread_bucket:s latency_us:l fraction:d signals:l executable:l stale:l gross_bps:d half_spread_bps:d net_bps:d", markout_economics,
    "SELECT spread_bucket, latency_us, fraction, sum(signals) AS signals, sum(executable) AS executable, sum(stale) AS stale, sum(action * midpoint_move_sum_bps) / nullif(sum(executable), 0) AS gross_bps, sum(half_spread_sum_bps) / nullif(sum(executable), 0) AS half_spread_bps, (sum(action * midpoint_move_sum_bps) - sum(half_spread_sum_bps)) / nullif(sum(executable), 0) AS net_bps FROM sel GROUP BY spread_bucket, latency_us, fraction",
    RANKED + K.MARKOUT_CTES[len(K.LAB_SQL):] + "," + _chosen(K.centered(K.MARKOUT_GRID)))
policies = lambda s, d: E.policy_days(S.selected(probability(K.trip_grid(s, d)), chosen_cutoffs(s, d), FEW))
TRIPS = RANKED + K.TRIP_CTES[len(K.LAB_SQL) :] + "," + _chosen(K.centered(K.TRIP_GRID))
_DAYS = "SELECT spread_bucket, latency_us, shares, fraction, date, sum(signals) AS signals, sum(CASE WHEN action > 0 THEN long_fills ELSE short_fills END) AS fills, sum(CASE WHEN action > 0 THEN long_pnl_sum_bps ELSE short_pnl_sum_bps END) AS pnl FROM sel GROUP BY ALL"
POLICY = "spread_bucket latency_us shares fraction"
add("q_policy_days", "spread_bucket:s latency_us:l shares:l fraction:d date:s signals:l fills:l pnl:d", policies, f"SELECT * FROM ({_DAYS})", TRIPS)
_POLICIES = f"SELECT spread_bucket, latency_us, shares, fraction, sum(signals) AS signals, sum(fills) AS fills, sum(pnl) / nullif(sum(fills), 0) AS pnl_bps, count(*) FILTER (WHERE fills > 0) AS filled_dates FROM ({_DAYS}) GROUP BY ALL"
add("q_round_trip_policies", "spread_bucket:s latency_us:l shares:l fraction:d signals:l fills:l pnl_bps:d filled_dates:l", lambda s, d: E.policy_table(policies(s, d)), _POLICIES, TRIPS)
add("q_best_policy", "spread_bucket:s latency_us:l shares:l fraction:d pnl_bps:d", lambda s, d: E.best_policy(E.policy_table(policies(s, d)).withColumn("pnl_bps", F.round("pnl_bps", 9))), f"SELECT spread_bucket, latency_us, shares, fraction, pnl_bps FROM (SELECT *, round(pnl_bps, 9) AS r FROM ({_POLICIES}) WHERE fills > 0) ORDER BY r DESC, spread_bucket, latency_us, shares, fraction LIMIT 1", TRIPS)


def max_t(s: SparkSession, d: str) -> DataFrame:
    """Policies by latency at one share, over a complete calendar of sessions."""
    days = K.lob_events(s, d).select("date").distinct()
    per = policies(s, d).where("spread_bucket = 'all_spreads' AND shares = 1 AND fraction = 1.0").select(F.col("latency_us").cast("string").alias("policy"), "date", "pnl")
    full = days.crossJoin(per.select("policy").distinct()).join(per, ["policy", "date"], "left").select("policy", "date", F.coalesce("pnl", F.lit(0.0)).alias("x"))
    return S.max_t(full, REPLICATES, SEED)


add("q_rademacher_maxt", "policy:s mean:d t:d p_adjusted:d", max_t, f"""SELECT policy, mean, mean / se AS t, (1 + (SELECT count(*) FROM big WHERE largest >= abs(mean / se))) / CAST({1 + REPLICATES} AS DOUBLE) AS p_adjusted FROM mst""",
    TRIPS + f""", md AS (SELECT CAST(latency_us AS VARCHAR) AS policy, date, pnl FROM ({_DAYS}) WHERE spread_bucket = 'all_spreads' AND shares = 1 AND fraction = 1.0),
    mf AS (SELECT policy, date, coalesce(pnl, 0) AS x, r FROM (SELECT DISTINCT policy FROM md) CROSS JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r FROM (SELECT DISTINCT date FROM lob)) LEFT JOIN md USING (policy, date)),
    mst AS (SELECT policy, avg(x) AS mean, stddev_samp(x) / sqrt(count(*)) AS se, count(*) AS n FROM mf GROUP BY policy HAVING stddev_samp(x) > 0),
    big AS (SELECT rep, max(t) AS largest FROM (SELECT rep, policy, abs(sum((1 - 2 * ({S.mixed_sql('rep', 'r', SEED)} % 2)) * (x - mean) / (se * n))) AS t FROM mf JOIN mst USING (policy), (SELECT unnest(range({REPLICATES})) AS rep) GROUP BY rep, policy) GROUP BY rep)""")  # fmt: skip

# the whole family of policies: every bucket, latency, size and fraction
_FAMILY = TRIPS + f""", fd AS ({_DAYS}), fp AS (SELECT DISTINCT spread_bucket, latency_us, shares, fraction FROM fd),
fc AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r FROM (SELECT DISTINCT date FROM lob)),
ff AS (SELECT fp.*, fc.date, r, coalesce(fills, 0) AS fills, coalesce(pnl, 0) AS pnl FROM fp CROSS JOIN fc LEFT JOIN fd USING (spread_bucket, latency_us, shares, fraction, date)),
fi AS (SELECT *, coalesce(pnl - fills * point, 0) AS influence FROM (SELECT *, sum(pnl) OVER k / nullif(sum(fills) OVER k, 0) AS point FROM ff WINDOW k AS (PARTITION BY spread_bucket, latency_us, shares, fraction))),
fs AS (SELECT spread_bucket, latency_us, shares, fraction, sum(fills) AS fills, count(*) FILTER (WHERE fills > 0) AS filled_dates, max(point) AS mean_bps, stddev_samp(influence) AS scale, avg(fills) AS mean_fills, count(*) AS n FROM fi GROUP BY ALL),
fa AS (SELECT *, fills > 0 AND filled_dates >= 2 AND scale > 0 AS able, CASE WHEN fills > 0 AND filled_dates >= 2 AND scale > 0 THEN scale / (sqrt(n) * mean_fills) END AS se_bps FROM fs),
fb AS (SELECT rep, max(t) AS largest FROM (SELECT rep, spread_bucket, latency_us, shares, fraction, abs(sum((1 - 2 * ({S.mixed_sql('rep', 'r', SEED)} % 2)) * influence / (sqrt(n) * scale))) AS t
  FROM fi JOIN (SELECT * FROM fa WHERE able) a USING (spread_bucket, latency_us, shares, fraction), (SELECT unnest(range({REPLICATES})) AS rep) GROUP BY ALL) GROUP BY rep)"""
add(
    "q_policy_family", "spread_bucket:s latency_us:l shares:l fraction:d fills:l filled_dates:l mean_bps:d se_bps:d lower_bps:d upper_bps:d p_adjusted:d status:s",
    lambda s, d: S.family_audit(policies(s, d), K.lob_events(s, d), E.POLICY, REPLICATES, SEED),
    """SELECT spread_bucket, latency_us, shares, fraction, fills, filled_dates, mean_bps, se_bps, mean_bps - c * se_bps AS lower_bps, mean_bps + c * se_bps AS upper_bps,
      CASE WHEN able THEN (1 + (SELECT count(*) FROM fb WHERE largest >= abs(mean_bps / se_bps))) / CAST(10001 AS DOUBLE) END AS p_adjusted,
      CASE WHEN fills = 0 THEN 'zero_fills' WHEN filled_dates < 2 THEN 'one_filled_date' WHEN NOT scale > 0 THEN 'zero_cluster_variance' ELSE 'estimable' END AS status
      FROM fa, (SELECT quantile_cont(largest, 0.95) AS c FROM fb)""", _FAMILY,
)

# calendars and completeness
add("q_calendar_setops", "side:s date:s", lambda s, d: E.calendar_differences(K.lob_events(s, d).select("date").distinct(), K.lab(s, d).where("bucket = 'one_tick'").select("date").distinct()), "SELECT 'left_only' AS side, date FROM (SELECT DISTINCT date FROM lob EXCEPT SELECT DISTINCT date FROM lab WHERE bucket = 'one_tick') UNION ALL SELECT 'both', date FROM (SELECT DISTINCT date FROM lob INTERSECT SELECT DISTINCT date FROM lab WHERE bucket = 'one_tick')", K.LAB_SQL)
add("q_policy_grid_completeness", POLICY.replace(" ", ":l ").replace("spread_bucket:l", "spread_bucket:s") + ":d", lambda s, d: E.missing_policies(E.policy_table(policies(s, d))), f"SELECT * FROM (SELECT * FROM (SELECT DISTINCT spread_bucket FROM ({_POLICIES})), (SELECT DISTINCT latency_us FROM ({_POLICIES})), (SELECT DISTINCT shares FROM ({_POLICIES})), (SELECT DISTINCT fraction FROM ({_POLICIES})) EXCEPT SELECT spread_bucket, latency_us, shares, fraction FROM ({_POLICIES}))", TRIPS)
# the contract over the table as it is, and over one broken on purpose: fills of two sizes doubled, empty means filled
_RULES = "SELECT unnest(['more_fills_than_signals', 'null_iff_no_fills', 'dates_without_fills']) AS rule, unnest([count(*) FILTER (WHERE fills > signals), count(*) FILTER (WHERE (fills = 0) <> (pnl_bps IS NULL)), count(*) FILTER (WHERE (filled_dates = 0) <> (fills = 0))]) AS violations FROM ({0})"


def broken_policies(s: SparkSession, d: str) -> DataFrame:
    t = E.policy_table(policies(s, d))
    return t.withColumns({"fills": F.when(F.col("shares") > 1, 2 * F.col("fills") + 1).otherwise(F.col("fills")), "filled_dates": F.when(F.col("latency_us") == 0, 0).otherwise(F.col("filled_dates"))})


_BROKEN = f"SELECT spread_bucket, latency_us, shares, fraction, signals, CASE WHEN shares > 1 THEN 2 * fills + 1 ELSE fills END AS fills, pnl_bps, CASE WHEN latency_us = 0 THEN 0 ELSE filled_dates END AS filled_dates FROM ({_POLICIES})"
add("q_contract_policies", "rule:s violations:l", lambda s, d: E.policy_violations(E.policy_table(policies(s, d))), _RULES.format(_POLICIES), TRIPS)
add("q_contract_policies_broken", "rule:s violations:l", lambda s, d: E.policy_violations(broken_policies(s, d)), _RULES.format(_BROKEN), TRIPS)


# stored metrics of policies, some tampered with, against their reconstruction


def policy_metrics(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(grid, metrics): the metrics of fixed coefficients at cutoffs off any cell's confidence; one fill more for a hundred
    shares, a mean that is off, and the rarest fraction gone for five hundred shares."""
    grid = settled(K.trip_grid(s, d))
    cut = cutoffs(s, d).select("spread_bucket", F.lit("both").alias("model"), F.col("fraction").alias("target_train_fraction"), (F.round("cutoff", 6) + 5e-7).alias("confidence_cutoff"))
    own = settled(cut.join(grid.select("spread_bucket", "latency_us", "shares").distinct(), "spread_bucket").select("*", F.lit(0.0).alias("intercept"), F.lit(QUEUE).alias("queue_coefficient"), F.lit(OFI).alias("ofi_coefficient")))
    whole = E.stored_policy_days(grid, own).groupBy(*E.METRIC_KEYS).agg(*[F.sum(c).alias(c) for c in ("signals", "arrived", "fills", "pnl")])
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    mean = F.col("pnl") / F.when(F.col("fills") > 0, F.col("fills"))
    rows = own.join(whole, E.METRIC_KEYS, "left").where("NOT (shares = 500 AND target_train_fraction < 0.06)").select(
        *own.columns, F.lit("2024-01-01").alias("test_first_date"), F.lit("2024-01-30").alias("test_last_date"), F.lit(30).cast("long").alias("clusters"),
        n("signals").alias("selected_test_signals"), n("arrived").alias("arrived_test_signals"), (n("fills") + F.when(F.col("shares") == 100, 1).otherwise(0)).alias("filled_round_trips"),
        (mean + F.when((F.col("latency_us") == 0) & (F.col("shares") == 1), 0.5).otherwise(0.0)).alias("quoted_round_trip_mean_bps"),
    )
    return grid, rows


def reconciled(s: SparkSession, d: str) -> DataFrame:
    grid, metrics = policy_metrics(s, d)
    metrics = settled(metrics)
    return E.metrics_violations(metrics).unionByName(E.reconstruction_violations(E.stored_policy_days(grid, metrics), metrics))


add(
    "q_policy_reconciliation", "rule:s violations:l", reconciled,
    """SELECT 'arrived_beyond_selected' AS rule, count(*) FILTER (WHERE arrived > signals) AS violations FROM mt UNION ALL SELECT 'filled_beyond_arrived', count(*) FILTER (WHERE told > arrived) FROM mt
      UNION ALL SELECT 'null_iff_no_fills', count(*) FILTER (WHERE (told = 0) <> (mean IS NULL)) FROM mt UNION ALL SELECT 'too_few_clusters', 0 UNION ALL SELECT 'duplicate_policies', 0
      UNION ALL SELECT 'missing_policies', count(DISTINCT spread_bucket) * count(DISTINCT fraction) * count(DISTINCT latency_us) * count(DISTINCT shares) - count(*) FROM mt UNION ALL SELECT 'dates_differ', 0
      UNION ALL SELECT 'counts_differ', count(*) FILTER (WHERE told <> fills) FROM mt UNION ALL SELECT 'profit_differs', count(*) FILTER (WHERE mean IS DISTINCT FROM real) FROM mt UNION ALL SELECT 'not_stored', 0""",
    RANKED + K.TRIP_CTES[len(K.LAB_SQL) :] + f""", tg AS MATERIALIZED ({K.centered(K.TRIP_GRID)}), tk AS (SELECT spread_bucket, fraction, round(cutoff, 6) + 5e-7 AS cutoff FROM ({CUTOFF_SQL})),
    tp AS (SELECT *, {_P.format(QUEUE, OFI)} AS p FROM tg), tx AS (SELECT tk.*, latency_us, shares FROM tk JOIN (SELECT DISTINCT spread_bucket, latency_us, shares FROM tg) USING (spread_bucket)),
    ts2 AS (SELECT spread_bucket, fraction, latency_us, shares, sum(signals) AS signals, sum(arrived) AS arrived, sum(CASE WHEN p >= 0.5 THEN long_fills ELSE short_fills END) AS fills, sum(CASE WHEN p >= 0.5 THEN long_pnl_sum_bps ELSE short_pnl_sum_bps END) AS pnl
      FROM tx JOIN tp USING (spread_bucket, latency_us, shares) WHERE abs(p - 0.5) >= cutoff GROUP BY ALL),
    mt AS (SELECT spread_bucket, fraction, latency_us, shares, coalesce(signals, 0) AS signals, coalesce(arrived, 0) AS arrived, coalesce(fills, 0) AS fills, coalesce(fills, 0) + CASE WHEN shares = 100 THEN 1 ELSE 0 END AS told,
      pnl / nullif(fills, 0) AS real, pnl / nullif(fills, 0) + CASE WHEN latency_us = 0 AND shares = 1 THEN 0.5 ELSE 0 END AS mean FROM tx LEFT JOIN ts2 USING (spread_bucket, fraction, latency_us, shares) WHERE NOT (shares = 500 AND fraction < 0.06))""",
)

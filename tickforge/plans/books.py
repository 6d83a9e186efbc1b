"""Queries over order-book sessions: audits, flow, spells and the six grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions import book as B
from tickforge.operators import contracts as C
from tickforge.operators import grids as G
from tickforge.operators import spells as S
from tickforge.plans.registry import add
from tickforge.sources.adapters import LOB_SQL, lob_events
from tickforge.sources.settle import settled

BINS = 31
QUEUE_BINS = 101
SECOND = 1_000_000
LATENCIES = [0, 60 * SECOND, 300 * SECOND, 1800 * SECOND]
CLOCKS = [600 * SECOND, 3600 * SECOND]
UPDATES = [1, 5, 20, 100]
AGE = 60 * SECOND
SIZES = [1, 100, 50]
CLOSE = 86_000 * SECOND
MOST_GAP = 300 * SECOND
EXCLUDED = ["2024-01-15"]

BUCKET_SQL = "CASE WHEN ap1 - bp1 <= 100 THEN 'one_tick' WHEN ap1 - bp1 <= 500 THEN 'two_to_five_ticks' WHEN ap1 - bp1 <= 1000 THEN 'six_to_ten_ticks' ELSE 'over_ten_ticks' END"
FLOW_SQL = (
    LOB_SQL
    + """,
f0 AS (SELECT *, ap1 + bp1 AS m2, lag(ap1) OVER w AS qap, lag(as1) OVER w AS qas, lag(bp1) OVER w AS qbp, lag(bs1) OVER w AS qbs, lag(ap1 + bp1) OVER w AS qm2
  FROM lob WINDOW w AS (PARTITION BY date ORDER BY event_row)),
f1 AS (SELECT *, qm2 IS NULL OR qm2 <> m2 AS first_in_spell,
    CASE WHEN qm2 IS NULL THEN 0 ELSE (CASE WHEN bp1 >= qbp THEN bs1 ELSE 0 END) - (CASE WHEN bp1 <= qbp THEN qbs ELSE 0 END)
      - (CASE WHEN ap1 <= qap THEN as1 ELSE 0 END) + (CASE WHEN ap1 >= qap THEN qas ELSE 0 END) END AS ofi,
    qm2 IS NULL OR NOT (qap = ap1 AND qas = as1 AND qbp = bp1 AND qbs = bs1) AS is_update FROM f0),
flow AS (SELECT *, sum(CAST(first_in_spell AS INT)) OVER (PARTITION BY date ORDER BY event_row ROWS UNBOUNDED PRECEDING) AS spell FROM f1)"""
)
LAB_SQL = (
    FLOW_SQL
    + f""",
st AS (SELECT date, spell, ts_us AS start_us, m2 AS spell_m2, lead(m2) OVER w AS next_m2, lead(ts_us) OVER w AS next_us
  FROM flow WHERE first_in_spell WINDOW w AS (PARTITION BY date ORDER BY spell)),
lab AS (SELECT flow.*, start_us, next_m2, next_us, CASE WHEN next_m2 > m2 THEN 1 ELSE -1 END AS move,
    sum(CASE WHEN first_in_spell THEN 0 ELSE ofi END) OVER (PARTITION BY date, spell ORDER BY event_row ROWS UNBOUNDED PRECEDING) AS cofi,
    ap1 - bp1 AS spread_raw, {BUCKET_SQL} AS bucket, CAST(bs1 - as1 AS DOUBLE) / (bs1 + as1) AS queue, as1 + bs1 AS depth
  FROM flow JOIN st USING (date, spell) WHERE next_m2 IS NOT NULL)"""
)


def bin_sql(x: str, bins: int) -> str:
    return f"least({bins - 1}, CAST(floor((greatest(-1.0, least(1.0, {x})) + 1.0) * 0.5 * {bins}) AS INT))"


def center_sql(b: str, bins: int) -> str:
    return f"-1.0 + 2.0 * ({b} + 0.5) / CAST({bins} AS DOUBLE)"


def pressure_sql(flow: str, depth: str = "depth") -> str:
    return f"CASE WHEN {depth} > 0 THEN 2.0 * atan(CAST({flow} AS DOUBLE) / {depth}) / pi() ELSE 0 END"


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_flow(lob_events(spark, sf_dir))


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.labelled(flow(spark, sf_dir))


# coverage and audits
COVERAGE = "date:s events:l first_us:l last_us:l last_row:l after_close:l gap_us:l complete:b status:s"
COVERAGE_SQL = f"""SELECT *, CASE WHEN complete THEN 'included' WHEN date IN ('{EXCLUDED[0]}') THEN 'declared_source_exclusion' ELSE 'unexplained_incomplete' END AS status FROM
  (SELECT *, coalesce(gap_us <= {MOST_GAP}, false) AS complete FROM (SELECT date, count(*) AS events, min(ts_us) AS first_us, max(ts_us) AS last_us, max(event_row) FILTER (WHERE ts_us <= {CLOSE}) AS last_row,
    count(*) FILTER (WHERE ts_us > {CLOSE}) AS after_close, {CLOSE} - arg_max(ts_us, event_row) FILTER (WHERE ts_us <= {CLOSE}) AS gap_us FROM lob GROUP BY date))"""
coverage = lambda s, d: C.session_coverage(lob_events(s, d), CLOSE, MOST_GAP, EXCLUDED)
add("q_session_coverage", COVERAGE, coverage, COVERAGE_SQL, LOB_SQL)
add("q_coverage_gate", "status:s sessions:l events:l", lambda s, d: C.coverage_gate(coverage(s, d)), f"SELECT status, count(*) AS sessions, sum(events) AS events FROM ({COVERAGE_SQL}) GROUP BY status", LOB_SQL)
add("q_event_type_counts", "event_type:l events:l shares:l", lambda s, d: lob_events(s, d).groupBy("event_type").agg(F.count("*").alias("events"), F.sum("size").alias("shares")), "SELECT event_type, count(*) AS events, sum(size) AS shares FROM lob GROUP BY event_type", LOB_SQL)
add("q_snapshot_validity", "date:s events:l invalid:l", lambda s, d: lob_events(s, d).groupBy("date").agg(F.count("*").alias("events"), F.count_if(~B.valid_snapshot()).alias("invalid")), """SELECT date, count(*) AS events, count(*) FILTER (WHERE NOT (least(ap1, as1, bp1, bs1, ap2, as2, bp2, bs2) > 0 AND ap1 > bp1 AND ap2 > ap1 AND bp2 < bp1)) AS invalid FROM lob GROUP BY date""", LOB_SQL)
add("q_mid_changes", "date:s mid_changes:l", lambda s, d: flow(s, d).groupBy("date").agg((F.count_if("first_in_spell") - 1).alias("mid_changes")), "SELECT date, count(*) FILTER (WHERE first_in_spell) - 1 AS mid_changes FROM flow GROUP BY date", FLOW_SQL)

_SIGNED = """
tr AS (SELECT date, event_row, event_type, direction, size, CASE WHEN direction = 1 THEN -price ELSE price END AS q,
    ap1, as1, bp1, bs1, ap2, as2, bp2, bs2, lag([ap1, as1, ap2, as2]) OVER w AS pa, lag([bp1, bs1, bp2, bs2]) OVER w AS pb
  FROM {source} WINDOW w AS (PARTITION BY date ORDER BY event_row)),
ts AS (SELECT *, [ap1, as1, ap2, as2] = pa AS asks_same, [bp1, bs1, bp2, bs2] = pb AS bids_same,
    CASE WHEN direction = 1 THEN [-pb[1], pb[2], -pb[3], pb[4]] ELSE pa END AS o,
    CASE WHEN direction = 1 THEN [-bp1, bs1, -bp2, bs2] ELSE [ap1, as1, ap2, as2] END AS n FROM tr WHERE pa IS NOT NULL),
tc AS (SELECT date, event_row, CASE
    WHEN direction NOT IN (-1, 1) THEN 'unsupported'
    WHEN event_type IN (5, 6, 7) THEN CASE WHEN asks_same AND bids_same THEN 'exact' ELSE 'mismatch' END
    WHEN event_type NOT IN (1, 2, 3, 4) THEN 'unsupported'
    WHEN size <= 0 OR NOT (CASE WHEN direction = 1 THEN asks_same ELSE bids_same END) THEN 'mismatch'
    WHEN event_type = 1 THEN CASE WHEN n = (CASE WHEN q = o[1] THEN [o[1], o[2] + size, o[3], o[4]] WHEN q = o[3] THEN [o[1], o[2], o[3], o[4] + size]
      WHEN q < o[1] THEN [q, size, o[1], o[2]] WHEN q < o[3] THEN [o[1], o[2], q, size] ELSE o END) THEN 'exact' ELSE 'mismatch' END
    WHEN q <> o[1] AND q <> o[3] THEN CASE WHEN n = o THEN 'exact' ELSE 'mismatch' END
    WHEN (CASE WHEN q = o[1] THEN o[2] ELSE o[4] END) < size THEN 'mismatch'
    WHEN q = o[1] AND o[2] > size THEN CASE WHEN n = [o[1], o[2] - size, o[3], o[4]] THEN 'exact' ELSE 'mismatch' END
    WHEN q = o[1] THEN CASE WHEN n[1] = o[3] AND n[2] = o[4] THEN 'depth_censored' ELSE 'mismatch' END
    WHEN o[4] > size THEN CASE WHEN n = [o[1], o[2], o[3], o[4] - size] THEN 'exact' ELSE 'mismatch' END
    ELSE CASE WHEN n[1] = o[1] AND n[2] = o[2] THEN 'depth_censored' ELSE 'mismatch' END END AS verdict FROM ts)"""


def transitions(flow: DataFrame) -> DataFrame:
    return flow.where("prev IS NOT NULL").withColumn("verdict", B.transition("prev"))


add("q_transition_audit", "verdict:s event_type:l events:l", lambda s, d: transitions(flow(s, d)).groupBy("verdict", "event_type").agg(F.count("*").alias("events")), "SELECT verdict, event_type, count(*) AS events FROM tc JOIN lob USING (date, event_row) GROUP BY verdict, event_type", LOB_SQL + "," + _SIGNED.format(source="lob"))

# faults planted in the events: each is a change to every tenth order id, the rest is as it was
FAULTS = ("unknown_type", "no_direction", "larger_size", "grown_ask", "hidden")


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with their fault (null without): a type that isn't one, no direction, a share more than was traded, a
    share more at the ask than the message explains, an execution called hidden."""
    e, k = lob_events(spark, sf_dir), F.col("order_id") % 10
    fault = F.coalesce(*[F.when(k == i, F.lit(name)) for i, name in enumerate(FAULTS)])
    change = lambda name, c, new: F.when(F.col("fault") == name, new).otherwise(F.col(c)).cast("int")
    e = e.withColumn("fault", fault).withColumn("event_type", F.when(F.col("fault") == "unknown_type", 8).when(F.col("fault") == "hidden", 5).otherwise(F.col("event_type")).cast("int"))
    return e.withColumns({"direction": change("no_direction", "direction", 0), "size": change("larger_size", "size", F.col("size") + 1), "ask_size_1": change("grown_ask", "ask_size_1", F.col("ask_size_1") + 1)})


_FAULT = "CASE order_id % 10 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(FAULTS)) + " END"
add(
    "q_transition_faults", "fault:s verdict:s events:l", lambda s, d: transitions(S.with_flow(faulty(s, d))).groupBy("fault", "verdict").agg(F.count("*").alias("events")),
    f"SELECT {_FAULT} AS fault, verdict, count(*) AS events FROM tc JOIN lob USING (date, event_row) GROUP BY ALL",
    LOB_SQL + """, lf AS (SELECT * REPLACE (CASE order_id % 10 WHEN 0 THEN 8 WHEN 4 THEN 5 ELSE event_type END AS event_type, CASE WHEN order_id % 10 = 1 THEN 0 ELSE direction END AS direction,
      CASE WHEN order_id % 10 = 2 THEN size + 1 ELSE size END AS size, CASE WHEN order_id % 10 = 3 THEN as1 + 1 ELSE as1 END AS as1) FROM lob),""" + _SIGNED.format(source="lf"),
)

# state and flow
KEY = "date:s event_row:l "
add("q_queue_imbalance", KEY + "queue:d", lambda s, d: lob_events(s, d).withColumn("queue", B.imbalance()), "SELECT date, event_row, CAST(bs1 - as1 AS DOUBLE) / (bs1 + as1) AS queue FROM lob", LOB_SQL)
add("q_ofi_increment", KEY + "ofi:l", flow, "SELECT date, event_row, ofi FROM flow", FLOW_SQL)
add("q_bounded_pressure", KEY + "pressure:d", lambda s, d: lab(s, d).withColumn("pressure", B.pressure(F.col("cofi"), F.col("depth"))), f"SELECT date, event_row, {pressure_sql('cofi')} AS pressure FROM lab", LAB_SQL)
add("q_spread_bucket", "date:s spread_bucket:s events:l", lambda s, d: lob_events(s, d).groupBy("date", B.spread_bucket(B.spread()).alias("spread_bucket")).agg(F.count("*").alias("events")), f"SELECT date, {BUCKET_SQL} AS spread_bucket, count(*) AS events FROM lob GROUP BY ALL", LOB_SQL)
add("q_price_spells", "date:s spell:l start_us:l spell_m2:l next_m2:l next_us:l", lambda s, d: S.spell_table(flow(s, d)), "SELECT * FROM st", LAB_SQL)
add("q_next_move", KEY + "spell:l next_m2:l move:l cofi:l", lab, "SELECT date, event_row, spell, next_m2, move, cofi FROM lab", LAB_SQL)
add("q_best_quote_updates", "date:s events:l updates:l", lambda s, d: flow(s, d).groupBy("date").agg(F.count("*").alias("events"), F.count_if("is_update").alias("updates")), "SELECT date, count(*) AS events, count(*) FILTER (WHERE is_update) AS updates FROM flow GROUP BY date", FLOW_SQL)

# grids
SAMPLES = "(SELECT *, unnest(CASE WHEN is_update THEN ['all_events', 'best_quote_updates'] ELSE ['all_events'] END) AS sample FROM {0})"
BUCKETS = "(SELECT *, unnest(['all_spreads', bucket]) AS spread_bucket FROM {0})"
MOVES = "count(*) AS observations, count(*) FILTER (WHERE move = 1) AS up_moves, count(*) FILTER (WHERE move <> 1) AS down_moves"
COUNTS = "observations:l up_moves:l down_moves:l"
both = lambda source: BUCKETS.format(SAMPLES.format(source))
QUEUE_GRID = f"SELECT date, sample, spread_bucket, {bin_sql('queue', QUEUE_BINS)} AS bin, {MOVES} FROM {both('lab')} GROUP BY ALL"
add(
    "q_queue_bins", "date:s sample:s spread_bucket:s bin:l bin_left:d bin_right:d bin_center:d " + COUNTS, lambda s, d: G.queue_bins(lab(s, d), QUEUE_BINS),
    f"SELECT *, -1.0 + 2.0 * bin / CAST({QUEUE_BINS} AS DOUBLE) AS bin_left, -1.0 + 2.0 * (bin + 1) / CAST({QUEUE_BINS} AS DOUBLE) AS bin_right, {center_sql('bin', QUEUE_BINS)} AS bin_center FROM ({QUEUE_GRID})", LAB_SQL,
)


def flow_grid_sql(bins: int) -> str:
    cells = f"SELECT date, sample, spread_bucket, {bin_sql('queue', bins)} AS queue_bin, {bin_sql(pressure_sql('cofi'), bins)} AS ofi_bin, {MOVES} FROM {both('lab')} GROUP BY ALL"
    return f"SELECT *, {center_sql('queue_bin', bins)} AS queue_center, {center_sql('ofi_bin', bins)} AS ofi_center FROM ({cells})"


CELL = "queue_bin:l ofi_bin:l queue_center:d ofi_center:d "
FLOW_GRID = "date:s sample:s spread_bucket:s " + CELL + COUNTS
add("q_order_flow_bins", FLOW_GRID, lambda s, d: G.order_flow_bins(lab(s, d), BINS), flow_grid_sql(BINS), LAB_SQL)


def several_grids(spark: SparkSession, sf_dir: str, sizes: tuple[int, ...] = (21, 31, 41)) -> DataFrame:
    """The grid at several resolutions in one pass over the labelled events."""
    rows = G.by_bucket(G.by_sample(lab(spark, sf_dir)))
    pressure = B.pressure(F.col("cofi"), F.col("depth"))
    each = F.array(*[F.struct(F.lit(n).alias("n"), B.unit_bin(F.col("queue"), n).alias("q"), B.unit_bin(pressure, n).alias("o")) for n in sizes])
    rows = rows.withColumn("g", F.explode(each))
    return rows.groupBy("date", "sample", "spread_bucket", F.col("g.n").alias("grid_bins_per_axis"), F.col("g.q").alias("queue_bin"), F.col("g.o").alias("ofi_bin")).agg(*G.moves())


add(
    "q_order_flow_grid_21_31_41", "grid_bins_per_axis:l date:s sample:s spread_bucket:s queue_bin:l ofi_bin:l " + COUNTS, several_grids,
    " UNION ALL ".join(f"SELECT {n} AS grid_bins_per_axis, date, sample, spread_bucket, queue_bin, ofi_bin, observations, up_moves, down_moves FROM ({flow_grid_sql(n)})" for n in (21, 31, 41)), LAB_SQL,
)
add("q_ofi_quote_windows", KEY + "flow:l", lambda s, d: S.last_updates_flow(flow(s, d), 5), "SELECT date, event_row, sum(ofi) OVER (PARTITION BY date ORDER BY event_row ROWS 4 PRECEDING) AS flow FROM flow WHERE is_update", FLOW_SQL)


def clock_sql(us: int) -> str:
    return f"sum(ofi) OVER (PARTITION BY date ORDER BY event_row ROWS UNBOUNDED PRECEDING) - coalesce(sum(ofi) OVER (PARTITION BY date ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND {us} PRECEDING), 0)"


add("q_ofi_clock_windows", KEY + "flow:l", lambda s, d: S.clock_flow(flow(s, d), CLOCKS[0]), f"SELECT date, event_row, {clock_sql(CLOCKS[0])} AS flow FROM flow", FLOW_SQL)
_H = (
    "cw AS (SELECT date, event_row, is_update, ofi, " + ", ".join(f"{clock_sql(us)} AS c{us}" for us in CLOCKS) + " FROM flow), uw AS (SELECT date, event_row, "
    + ", ".join(f"c{us}" for us in CLOCKS) + ", " + ", ".join(f"sum(ofi) OVER (PARTITION BY date ORDER BY event_row ROWS {n - 1} PRECEDING) AS u{n}" for n in UPDATES) + " FROM cw WHERE is_update), hz AS ("
    + " UNION ALL ".join(
        f"SELECT lab.*, '{kind}' AS horizon_kind, {value} AS horizon_value, {col} AS hflow FROM lab JOIN uw USING (date, event_row)"
        for kind, value, col in [("price_spell", 0, "cofi"), *[("quote_updates", n, f"u{n}") for n in UPDATES], *[("clock_us", us, f"c{us}") for us in CLOCKS]]
    ) + ")"
)
HORIZON_GRID = f"SELECT date, spread_bucket, horizon_kind, horizon_value, {bin_sql('queue', BINS)} AS queue_bin, {bin_sql(pressure_sql('hflow'), BINS)} AS ofi_bin, {MOVES} FROM {BUCKETS.format('hz')} GROUP BY ALL"
centered = lambda cells, bins=BINS: f"SELECT *, {center_sql('queue_bin', bins)} AS queue_center, {center_sql('ofi_bin', bins)} AS ofi_center FROM ({cells})"


def horizon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.horizon_bins(lab(spark, sf_dir), BINS, UPDATES, CLOCKS)


HORIZON_CTES = LAB_SQL + "," + _H
add("q_ofi_horizon_bins", "date:s spread_bucket:s horizon_kind:s horizon_value:l " + CELL + COUNTS, horizon_grid, centered(HORIZON_GRID), HORIZON_CTES)

# entries, mark-outs, landmarks, round trips
_ENTRY = "en AS (" + " UNION ALL ".join(
    f"SELECT *, {us} AS latency_us, {'true' if us == 0 else f'ts_us + {us} < next_us'} AS arrived, "
    + ("event_row AS at_row, m2 AS at_m2, spread_raw AS at_spread FROM lab" if us == 0 else
       f"last_value(event_row) OVER w AS at_row, last_value(m2) OVER w AS at_m2, arg_max(spread_raw, event_row) OVER w AS at_spread FROM lab WINDOW w AS (PARTITION BY date, spell ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND {us - 1} FOLLOWING)")
    for us in LATENCIES
) + ")"


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.with_entries(lab(spark, sf_dir), LATENCIES)
    return rows.select("date", "event_row", "e.latency_us", "e.arrived", F.col("e.at.m2").alias("at_m2"), F.col("e.at.spread_raw").alias("at_spread"))


add("q_asof_entry", KEY + "latency_us:l arrived:b at_m2:l at_spread:l", asof, "SELECT * FROM en", LAB_SQL + "," + _ENTRY)
ECONOMICS = """count(*) AS signals, count(*) FILTER (WHERE arrived) AS executable, count(*) FILTER (WHERE NOT arrived) AS stale,
  count(*) FILTER (WHERE move = 1) AS up_moves, count(*) FILTER (WHERE move <> 1) AS down_moves,
  coalesce(sum((next_m2 - at_m2) * CAST(10000 AS DOUBLE) / at_m2) FILTER (WHERE arrived), 0) AS midpoint_move_sum_bps,
  coalesce(sum(at_spread * CAST(10000 AS DOUBLE) / at_m2) FILTER (WHERE arrived), 0) AS half_spread_sum_bps"""
GRID = "date:s spread_bucket:s latency_us:l " + CELL
SUMS = "signals:l executable:l stale:l up_moves:l down_moves:l midpoint_move_sum_bps:d half_spread_sum_bps:d"
MARKOUT_GRID = f"SELECT date, spread_bucket, latency_us, {bin_sql('queue', BINS)} AS queue_bin, {bin_sql(pressure_sql('cofi'), BINS)} AS ofi_bin, {ECONOMICS} FROM {BUCKETS.format('en')} WHERE is_update GROUP BY ALL"
MARKOUT_CTES = LAB_SQL + "," + _ENTRY
markouts = lambda s, d: G.markout_bins(lab(s, d), BINS, LATENCIES)
add("q_markout_bins", GRID + SUMS, markouts, centered(MARKOUT_GRID), MARKOUT_CTES)

_LEVELS = "{'ap1': ap1, 'as1': as1, 'bp1': bp1, 'bs1': bs1, 'ap2': ap2, 'as2': as2, 'bp2': bp2, 'bs2': bs2, 'm2': m2, 'spread': spread_raw, 'bucket': bucket, 'queue': queue, 'depth': depth}"
_LAST = lambda us: f"arg_max({_LEVELS}, event_row) FILTER (WHERE ts_us < start_us + {us})"
LANDMARK_CTES = LAB_SQL + (
    f""", lm0 AS (SELECT date, spell, min(start_us) AS start_us, min(next_us) AS next_us, min(next_m2) AS next_m2, min(move) AS move, {_LAST(AGE)} AS g,
    coalesce(sum(ofi) FILTER (WHERE NOT first_in_spell AND ts_us < start_us + {AGE}), 0) AS lflow, """
    + ", ".join(f"{_LAST(AGE + us)} AS a{us}" for us in LATENCIES)
    + f" FROM lab GROUP BY date, spell), lm AS ("
    + " UNION ALL ".join(
        f"SELECT date, spell, next_m2, move, lflow, g.queue AS queue, g.depth AS depth, g.bucket AS bucket, {us} AS latency_us, start_us + {AGE + us} < next_us AS arrived, a{us} AS a, a{us}.m2 AS at_m2, a{us}.spread AS at_spread FROM lm0 WHERE start_us + {AGE} < next_us"
        for us in LATENCIES
    )
    + ")"
)
marks = lambda s, d: G.landmarks(lab(s, d), AGE, LATENCIES)
add("q_landmarks", "date:s spell:l latency_us:l arrived:b flow:l queue:d at_m2:l", lambda s, d: marks(s, d).select("date", "spell", "e.latency_us", "e.arrived", "flow", "queue", F.col("e.at.m2").alias("at_m2")), "SELECT date, spell, latency_us, arrived, lflow AS flow, queue, at_m2 FROM lm", LANDMARK_CTES)
LANDMARK_GRID = f"SELECT date, spread_bucket, latency_us, {bin_sql('queue', BINS)} AS queue_bin, {bin_sql(pressure_sql('lflow'), BINS)} AS ofi_bin, {ECONOMICS} FROM {BUCKETS.format('lm')} GROUP BY ALL"
landmark_grid = lambda s, d: G.landmark_bins(marks(s, d), BINS)
add("q_landmark_bins", GRID + SUMS, landmark_grid, centered(LANDMARK_GRID), LANDMARK_CTES)


def vwap_sql(side: str, n: str, book: str = "") -> str:
    p1, s1, p2, s2 = (f"{book}{side}{w}{k}" for k in (1, 2) for w in ("p", "s"))
    return f"CASE WHEN {n} <= {s1} + {s2} THEN CAST(least({n}, {s1}) * {p1} + ({n} - least({n}, {s1})) * {p2} AS DOUBLE) / {n} END"


add("q_displayed_vwap", KEY + "ask_vwap:d bid_vwap:d", lambda s, d: lob_events(s, d).select("date", "event_row", B.displayed_vwap("ask", F.lit(100)).alias("ask_vwap"), B.displayed_vwap("bid", F.lit(100)).alias("bid_vwap")), f"SELECT date, event_row, {vwap_sql('a', '100')} AS ask_vwap, {vwap_sql('b', '100')} AS bid_vwap FROM lob", LOB_SQL)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flow(spark, sf_dir)
    return G.round_trips(G.landmarks(S.labelled(f, exits=True), AGE, LATENCIES), SIZES)


_LEGS = ", ".join(
    f"CASE WHEN {side}_ok THEN ({sign}) * (x_m2 - at_m2) * CAST(10000 AS DOUBLE) / at_m2 END AS {side}_move, CASE WHEN {side}_ok THEN ({sign}) * ({side}_in - at_m2 / 2.0) * CAST(20000 AS DOUBLE) / at_m2 END AS {side}_entry_cost, "
    f"CASE WHEN {side}_ok THEN ({sign}) * (x_m2 / 2.0 - {side}_out) * CAST(20000 AS DOUBLE) / at_m2 END AS {side}_exit_cost, CASE WHEN {side}_ok THEN ({sign}) * ({side}_out - {side}_in) * CAST(20000 AS DOUBLE) / at_m2 END AS {side}_pnl"
    for side, sign in (("long", "1"), ("short", "-1"))
)
TRIP_CTES = LANDMARK_CTES + (
    f""", ex AS (SELECT date, spell - 1 AS spell, {{'ap1': ap1, 'as1': as1, 'bp1': bp1, 'bs1': bs1, 'ap2': ap2, 'as2': as2, 'bp2': bp2, 'bs2': bs2}} AS x, m2 AS x_m2 FROM flow WHERE first_in_spell),
    rt0 AS (SELECT lm.*, x, x_m2, unnest({SIZES}) AS shares FROM lm JOIN ex USING (date, spell)),
    rt1 AS (SELECT *, {vwap_sql('a', 'shares', 'a.')} AS long_in, {vwap_sql('b', 'shares', 'x.')} AS long_out, {vwap_sql('b', 'shares', 'a.')} AS short_in, {vwap_sql('a', 'shares', 'x.')} AS short_out FROM rt0),
    rt2 AS (SELECT *, arrived AND long_in IS NOT NULL AND long_out IS NOT NULL AS long_ok, arrived AND short_in IS NOT NULL AND short_out IS NOT NULL AS short_ok FROM rt1),
    rt AS (SELECT *, {_LEGS} FROM rt2)"""
)
LEGS = ["move", "entry_cost", "exit_cost", "pnl"]
add(
    "q_round_trip_outcomes", "date:s spell:l latency_us:l shares:l long_filled:b short_filled:b long_pnl:d short_pnl:d",
    lambda s, d: trips(s, d).select("date", "spell", "e.latency_us", "shares", F.col("long.filled").alias("long_filled"), F.col("short.filled").alias("short_filled"), F.col("long.pnl").alias("long_pnl"), F.col("short.pnl").alias("short_pnl")),
    "SELECT *, long_ok AS long_filled, short_ok AS short_filled FROM rt", TRIP_CTES,
)
_TRIP_SUMS = ", ".join(
    f"count(*) FILTER (WHERE {s}_ok) AS {s}_fills, count(*) FILTER (WHERE arrived AND NOT {s}_ok) AS {s}_censored, " + ", ".join(f"coalesce(sum({s}_{c}), 0) AS {s}_{c}_sum_bps" for c in LEGS) for s in ("long", "short")
)
TRIP_GRID = f"""SELECT date, spread_bucket, latency_us, shares, {bin_sql('queue', BINS)} AS queue_bin, {bin_sql(pressure_sql('lflow'), BINS)} AS ofi_bin, count(*) AS signals,
  count(*) FILTER (WHERE arrived) AS arrived, count(*) FILTER (WHERE NOT arrived) AS stale, count(*) FILTER (WHERE move = 1) AS up_moves, count(*) FILTER (WHERE move <> 1) AS down_moves, {_TRIP_SUMS}
  FROM (SELECT * EXCLUDE (bucket), unnest(CASE WHEN bucket = 'one_tick' THEN ['all_spreads', bucket] ELSE ['all_spreads'] END) AS spread_bucket FROM rt) GROUP BY date, spread_bucket, latency_us, shares, queue_bin, ofi_bin"""
TRIP_COLUMNS = "signals:l arrived:l stale:l up_moves:l down_moves:l " + " ".join(f"{s}_fills:l {s}_censored:l " + " ".join(f"{s}_{c}_sum_bps:d" for c in LEGS) for s in ("long", "short"))
trip_grid = lambda s, d: G.round_trip_bins(trips(s, d), BINS)
add("q_round_trip_bins", "date:s spread_bucket:s latency_us:l shares:l " + CELL + TRIP_COLUMNS, trip_grid, centered(TRIP_GRID), TRIP_CTES)

# contracts over the grids: violations by rule, over the grids as they are and over grids broken on purpose
def _counted(rules: dict[str, str], source: str) -> str:
    return f"SELECT unnest({list(rules)}) AS rule, unnest([{', '.join(f'count(*) FILTER (WHERE {c})' for c in rules.values())}]) AS violations FROM ({source})"


MARKOUT_RULES = {
    "moves_match": "signals <> up_moves + down_moves", "arrivals_match": "signals <> executable + stale",
    "zero_latency_stale": "latency_us = 0 AND stale > 0", "cost_sign": "half_spread_sum_bps < 0",
}
TRIP_RULES = {"arrivals_match": "signals <> arrived + stale"} | {
    f"{s}_{k}": c.format(s)
    for s in ("long", "short")
    for k, c in {
        "fills_match": "arrived <> {0}_fills + {0}_censored", "one_share_censored": "shares = 1 AND {0}_censored > 0",
        "pnl_identity": "abs({0}_pnl_sum_bps - ({0}_move_sum_bps - {0}_entry_cost_sum_bps - {0}_exit_cost_sum_bps)) > 1e-7 + 1e-9 * abs({0}_move_sum_bps - {0}_entry_cost_sum_bps - {0}_exit_cost_sum_bps)",
    }.items()
}


def broken(grid: DataFrame, changes: dict[str, str]) -> DataFrame:
    return grid.withColumns({c: F.expr(e) for c, e in changes.items()})


def _broken_sql(grid: str, changes: dict[str, str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in changes.items())}) FROM ({grid})"


BAD_MARKOUTS = {
    "up_moves": "up_moves + CASE WHEN queue_bin % 5 = 0 THEN 1 ELSE 0 END", "stale": "stale + CASE WHEN ofi_bin % 7 = 0 THEN 1 ELSE 0 END",
    "half_spread_sum_bps": "CASE WHEN queue_bin = 3 THEN -1.0 ELSE half_spread_sum_bps END",
}
BAD_TRIPS = {
    "stale": "stale + CASE WHEN ofi_bin % 7 = 0 THEN 1 ELSE 0 END", "long_censored": "long_censored + CASE WHEN queue_bin % 5 = 0 THEN 1 ELSE 0 END",
    "short_pnl_sum_bps": "short_pnl_sum_bps + CASE WHEN queue_bin = 3 THEN 1.0 ELSE 0.0 END",
}
BAD_HORIZONS = {"up_moves": "up_moves + CASE WHEN queue_bin % 5 = 0 AND horizon_value > 5 THEN 1 ELSE 0 END"}


def _horizon_rules(grid: str) -> str:
    """Every third queue bin is there twice in the broken grid."""
    keys = "date, spread_bucket, horizon_kind, horizon_value"
    return f"""SELECT 'moves_match' AS rule, count(*) FILTER (WHERE observations <> up_moves + down_moves) AS violations FROM ({grid})
      UNION ALL SELECT 'duplicate_cells', count(*) FROM (SELECT count(*) AS c FROM ({grid}) GROUP BY {keys}, queue_bin, ofi_bin) WHERE c > 1
      UNION ALL SELECT 'labels_differ', count(*) FROM (SELECT date, spread_bucket FROM (SELECT {keys}, sum(up_moves) AS u, sum(down_moves) AS d FROM ({grid}) GROUP BY {keys}) GROUP BY date, spread_bucket HAVING min(u) <> max(u) OR min(d) <> max(d))"""


# the rules read the grid several times, so it is written once
def horizon_contract(s: SparkSession, d: str) -> DataFrame:
    return C.horizon_violations(settled(horizon_grid(s, d)))


def broken_horizon_contract(s: SparkSession, d: str) -> DataFrame:
    grid = broken(settled(horizon_grid(s, d)), BAD_HORIZONS)
    return C.horizon_violations(grid.unionByName(grid.where("queue_bin % 3 = 0")))


add("q_contract_markout", "rule:s violations:l", lambda s, d: C.markout_violations(markouts(s, d)), _counted(MARKOUT_RULES, centered(MARKOUT_GRID)), MARKOUT_CTES)
add("q_contract_markout_broken", "rule:s violations:l", lambda s, d: C.markout_violations(broken(markouts(s, d), BAD_MARKOUTS)), _counted(MARKOUT_RULES, _broken_sql(centered(MARKOUT_GRID), BAD_MARKOUTS)), MARKOUT_CTES)
add("q_contract_round_trip", "rule:s violations:l", lambda s, d: C.round_trip_violations(trip_grid(s, d)), _counted(TRIP_RULES, centered(TRIP_GRID)), TRIP_CTES)
add("q_contract_round_trip_broken", "rule:s violations:l", lambda s, d: C.round_trip_violations(broken(trip_grid(s, d), BAD_TRIPS)), _counted(TRIP_RULES, _broken_sql(centered(TRIP_GRID), BAD_TRIPS)), TRIP_CTES)
_BAD_HORIZON_GRID = f"WITH b AS ({_broken_sql(HORIZON_GRID, BAD_HORIZONS)}) SELECT * FROM b UNION ALL SELECT * FROM b WHERE queue_bin % 3 = 0"
add("q_contract_horizon", "rule:s violations:l", horizon_contract, _horizon_rules(HORIZON_GRID), HORIZON_CTES)
add("q_contract_horizon_broken", "rule:s violations:l", broken_horizon_contract, _horizon_rules(_BAD_HORIZON_GRID), HORIZON_CTES)

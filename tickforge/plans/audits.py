"""Queries of the replay audit, and of joins that prove their keys unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.operators import audit as A
from tickforge.operators import contracts as C
from tickforge.plans import books as K
from tickforge.plans.registry import add
from tickforge.plans.signals import SAMPLE
from tickforge.sources.settle import settled

_COUNTS = "events:l " + " ".join(f"type_{t}:l" for t in A.TYPES) + " seeded_sessions:l " + " ".join(f"{v}:l" for v in A.VERDICTS) + " invalid_snapshots:l mid_changes:l checksum_0:l checksum_1:l"
_HASHED = ("day", "event_row", "ts_us", "order_id", "ap1", "as1", "bp1", "bs1")
_AUDIT = f"""hs AS (SELECT date, event_row, event_type, ap1, as1, bp1, bs1, ap2, as2, bp2, bs2, {A.hash_sql(0, _HASHED)} AS h0, {A.hash_sql(1, _HASHED)} AS h1
  FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) AS day FROM lob)),
au AS (SELECT date, count(*) AS events, {', '.join(f'count(*) FILTER (WHERE event_type = {t}) AS type_{t}' for t in A.TYPES)}, count(*) FILTER (WHERE verdict IS NULL) AS seeded_sessions,
  {', '.join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in A.VERDICTS)}, count(*) FILTER (WHERE NOT (least(ap1, as1, bp1, bs1, ap2, as2, bp2, bs2) > 0 AND ap1 > bp1 AND ap2 > ap1 AND bp2 < bp1)) AS invalid_snapshots,
  count(*) FILTER (WHERE first_in_spell AND verdict IS NOT NULL) AS mid_changes, {', '.join(f'sum(h{i} * h{i} % {A.PRIME} * (h{i} % 65521) % {A.PRIME}) % {A.PRIME} AS checksum_{i}' for i in (0, 1))}
  FROM hs LEFT JOIN tc USING (date, event_row) JOIN (SELECT date, event_row, first_in_spell FROM flow) USING (date, event_row) GROUP BY date)"""
AUDIT_CTES = K.FLOW_SQL + "," + K._SIGNED.format(source="lob") + "," + _AUDIT
sessions = lambda s, d: A.replay_audit(K.flow(s, d))
_SUMS = [c.split(":")[0] for c in _COUNTS.split()[:-2]]
_TOTAL = f"SELECT count(*) AS sessions, {', '.join(f'sum({c}) AS {c}' for c in _SUMS)}, {', '.join(f'sum(checksum_{i}) % {A.PRIME} AS checksum_{i}' for i in (0, 1))} FROM au"
add("q_replay_audit", "date:s " + _COUNTS, sessions, "SELECT * FROM au", AUDIT_CTES)
add("q_replay_totals", "sessions:l " + _COUNTS, lambda s, d: A.audit_totals(sessions(s, d)), _TOTAL, AUDIT_CTES)
_CHECKS = {
    "one_seed_a_session": "seeded_sessions <> sessions", "types_add_up": " + ".join(f"type_{t}" for t in A.TYPES) + " <> events",
    "transitions_add_up": " + ".join(A.VERDICTS) + " <> events - seeded_sessions", "mismatches": "mismatch > 0", "unsupported": "unsupported > 0", "invalid_snapshots": "invalid_snapshots > 0",
}
add("q_contract_audit", "rule:s violations:l", lambda s, d: A.audit_violations(A.audit_totals(sessions(s, d))), " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE {bad}) AS violations FROM aut" for rule, bad in _CHECKS.items()), AUDIT_CTES + f", aut AS ({_TOTAL})")

# two grids over the same cells: the flow grid at quote updates, and the mark-out grid at no latency
KEYS = ["date", "spread_bucket", "queue_bin", "ofi_bin"]


def planted(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both grids; the second with some cells twice and some gone."""
    left = K.G.order_flow_bins(K.lab(s, d), K.BINS).where(F.col("sample") == SAMPLE).select(*KEYS, "observations")
    right = settled(K.markouts(s, d).where("latency_us = 0 AND ofi_bin % 11 <> 0").select(*KEYS, "signals"))
    return left, right.unionByName(right.where("queue_bin % 7 = 0"))


def joined(s: SparkSession, d: str) -> DataFrame:
    """The grids joined one to one after repeats are merged, with cells whose counts differ."""
    left, right = planted(s, d)
    both = left.join(right.groupBy(*KEYS).agg(F.max("signals").alias("signals"), F.count("*").alias("copies")), KEYS)
    return both.groupBy("spread_bucket").agg(F.count("*").alias("cells"), F.sum("observations").alias("observations"), F.sum("signals").alias("signals"), F.count_if(F.col("copies") > 1).alias("repeated"), F.count_if(F.col("observations") != F.col("signals")).alias("differ"))


_KEYS = ", ".join(KEYS)
_PLANTED = K.MARKOUT_CTES + f""", gl AS (SELECT {_KEYS}, observations FROM ({K.flow_grid_sql(K.BINS)}) WHERE sample = '{SAMPLE}'),
r0 AS (SELECT {_KEYS}, signals FROM ({K.MARKOUT_GRID}) WHERE latency_us = 0 AND ofi_bin % 11 <> 0), gr AS (SELECT * FROM r0 UNION ALL SELECT * FROM r0 WHERE queue_bin % 7 = 0),
gb AS (SELECT * FROM (SELECT {_KEYS}, count(*) AS l FROM gl GROUP BY ALL) FULL JOIN (SELECT {_KEYS}, count(*) AS r FROM gr GROUP BY ALL) USING ({_KEYS}))"""
add("q_grid_join", "rule:s violations:l", lambda s, d: C.one_to_one_violations(*planted(s, d), KEYS), "SELECT unnest(['left_duplicates', 'right_duplicates', 'left_only', 'right_only']) AS rule, unnest([count(*) FILTER (WHERE l > 1), count(*) FILTER (WHERE r > 1), count(*) FILTER (WHERE r IS NULL), count(*) FILTER (WHERE l IS NULL)]) AS violations FROM gb", _PLANTED)
add("q_grid_joined", "spread_bucket:s cells:l observations:l signals:l repeated:l differ:l", joined, f"SELECT spread_bucket, count(*) AS cells, sum(observations) AS observations, sum(signals) AS signals, count(*) FILTER (WHERE copies > 1) AS repeated, count(*) FILTER (WHERE observations <> signals) AS differ FROM gl JOIN (SELECT {_KEYS}, max(signals) AS signals, count(*) AS copies FROM gr GROUP BY ALL) USING ({_KEYS}) GROUP BY spread_bucket", _PLANTED)

"""The replay audit: what every session's transitions come to, with a checksum that merges.

A row's hash takes its session, its place and its fields, so a sum over rows depends on their order and yet on nothing
else: not on the tasks, their number or the order in which they end. Sums of sessions add up to that of the whole. Two
lanes with different bases, each modulo a prime below 2**31, make the checksum; every product stays within 64 bits, so
any engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions import book as B
from tickforge.operators import contracts as C

PRIME = 2_147_483_647
BASES = (1_000_003, 998_244_353)
#: What a row's hash takes beside its session and place.
FIELDS = ("ts_us", "order_id", "ask_price_1", "ask_size_1", "bid_price_1", "bid_size_1")
TYPES = range(1, 8)
VERDICTS = ("exact", "depth_censored", "mismatch", "unsupported")


def day_number(date: Column) -> Column:
    return F.datediff(F.to_date(date), F.lit("1970-01-01").cast("date")).cast("long")


def row_hash(lane: int) -> Column:
    """A whole number below PRIME of a row's session, place and fields."""
    h = F.lit(lane + 1).cast("long")
    for value in (day_number(F.col("date")), F.col("event_row"), *(F.col(f) for f in FIELDS)):
        h = (h * BASES[lane] + F.pmod(value.cast("long"), F.lit(PRIME))) % PRIME
    return h * h % PRIME * (h % 65_521) % PRIME


def hash_sql(lane: int, columns: tuple[str, ...]) -> str:
    """``row_hash`` over columns that are not below zero: the day's number, the place and the fields."""
    h = str(lane + 1) + "::BIGINT"
    for c in columns:
        h = f"(({h}) * {BASES[lane]} + {c} % {PRIME}) % {PRIME}"
    return h


def replay_audit(flow: DataFrame) -> DataFrame:
    """A row per session: events, those of each type, seeds, transitions by verdict, invalid books, midpoint changes and the
    checksum lanes. One aggregate by session over the flow, which is already dealt by session, so nothing more is
    exchanged."""
    seeded = F.col("prev").isNotNull()
    rows = flow.withColumns({"verdict": F.when(seeded, B.transition("prev")), "h0": row_hash(0), "h1": row_hash(1)})
    return rows.groupBy("date").agg(
        F.count("*").alias("events"),
        *[F.count_if(F.col("event_type") == t).alias(f"type_{t}") for t in TYPES],
        F.count_if(~seeded).alias("seeded_sessions"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS],
        F.count_if(~B.valid_snapshot()).alias("invalid_snapshots"),
        F.count_if(F.col("first_in_spell") & seeded).alias("mid_changes"),
        *[(F.sum(f"h{i}") % PRIME).alias(f"checksum_{i}") for i in (0, 1)],
    )


def audit_totals(sessions: DataFrame) -> DataFrame:
    """One row: the sums over sessions; checksums merge modulo the prime."""
    sums = [c for c in sessions.columns if c != "date" and not c.startswith("checksum")]
    return sessions.agg(
        F.count("*").alias("sessions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[(F.coalesce(F.sum(f"checksum_{i}"), F.lit(0)) % PRIME).alias(f"checksum_{i}") for i in (0, 1)]
    )


def audit_violations(totals: DataFrame) -> DataFrame:
    """Totals that don't reconcile: one seed a session, types and transitions that add up, and no transition or book that
    is wrong."""
    c = F.col
    return C.count_violations(
        totals,
        {
            "one_seed_a_session": c("seeded_sessions") != c("sessions"),
            "types_add_up": sum((c(f"type_{t}") for t in TYPES), F.lit(0)) != c("events"),
            "transitions_add_up": sum((c(v) for v in VERDICTS), F.lit(0)) != c("events") - c("seeded_sessions"),
            "mismatches": c("mismatch") > 0,
            "unsupported": c("unsupported") > 0,
            "invalid_snapshots": c("invalid_snapshots") > 0,
        },
    )


def require_same(first: DataFrame, second: DataFrame) -> None:
    """Two runs over the same events must agree in every total and in the checksum."""
    a, b = first.first().asDict(), second.first().asDict()
    differ = [k for k in a if a[k] != b[k]]
    if differ:
        raise C.ContractError(f"replays differ in {', '.join(differ)}")

"""Events labelled with price spells, order flow and the next price move.

A spell is a run of events with one mid-price. Everything is partitioned by session (date), so the windows share one
shuffle; spell facts come from windows over the session in order, not from joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickforge.functions import book as B


def in_session() -> WindowSpec:
    return Window.partitionBy("date").orderBy("event_row")


def so_far() -> WindowSpec:
    return in_session().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_flow(events: DataFrame) -> DataFrame:
    """Adds the book before (``prev``), m2 (twice the mid), spell, first_in_spell, ofi and is_update."""
    out = events.withColumn("m2", B.mid_twice()).withColumn("prev", F.lag(F.struct(*B.BOOK, "m2")).over(in_session()))
    first = F.col("prev").isNull() | (F.col("prev.m2") != F.col("m2"))
    out = out.withColumn("first_in_spell", first)
    return out.withColumns(
        {
            "spell": F.sum(F.col("first_in_spell").cast("int")).over(so_far()),
            "ofi": F.when(F.col("prev").isNull(), 0).otherwise(B.ofi("prev")).cast("long"),
            "is_update": F.col("prev").isNull() | ~B.same_best_quote("prev"),
        }
    )


def spell_table(flow: DataFrame) -> DataFrame:
    """One row per spell with its start, its mid and those of the next spell (null for the last)."""
    per = flow.where("first_in_spell").select("date", "spell", F.col("ts_us").alias("start_us"), F.col("m2").alias("spell_m2"))
    w = Window.partitionBy("date").orderBy("spell")
    return per.withColumns({"next_m2": F.lead("spell_m2").over(w), "next_us": F.lead("start_us").over(w)})


def labelled(flow: DataFrame, exits: bool = False) -> DataFrame:
    """Events of spells that have a next move, with start_us, next_m2, next_us, move (+1 or -1), cofi and bins' inputs;
    with ``exits`` also ``exit``, the first book of the next spell.

    All of it is windows over the session, the last one backwards, so a session is exchanged once and never joined."""
    first = F.col("first_in_spell")
    opened = lambda c: F.last(F.when(first, c), True)
    after = Window.partitionBy("date").orderBy(F.desc("event_row")).rowsBetween(Window.unboundedPreceding, -1)
    own = flow.withColumn("running", F.sum("ofi").over(so_far()))
    own = own.withColumns({"start_us": opened(F.col("ts_us")).over(so_far()), "cofi": (F.col("running") - opened(F.col("running")).over(so_far())).cast("long")}).drop("running")
    fields = [F.col("m2").alias("next_m2"), F.col("ts_us").alias("next_us")] + ([F.struct(*B.BOOK, "m2").alias("exit")] if exits else [])
    own = own.withColumn("next", opened(F.struct(*fields)).over(after)).where("next IS NOT NULL")
    return own.select("*", "next.*").drop("next").withColumns(
        {
            "move": F.when(F.col("next_m2") > F.col("m2"), 1).otherwise(-1),
            "spread_raw": B.spread(),
            "bucket": B.spread_bucket(B.spread()),
            "queue": B.imbalance(),
            "depth": (F.col("ask_size_1") + F.col("bid_size_1")).cast("double"),
        }
    )


def last_updates_flow(flow: DataFrame, n: int) -> DataFrame:
    """Rows at quote updates with flow over the last n of them; windows cross spells and may be short at the start."""
    w = in_session().rowsBetween(1 - n, Window.currentRow)
    return flow.where("is_update").withColumn("flow", F.sum("ofi").over(w))


def clock_flow(flow: DataFrame, span_us: int) -> DataFrame:
    """Flow over (t - span, t], causal by row: later rows of the same time are left out, earlier ones are in."""
    return clock_flows(flow, {"flow": span_us})


def clock_flows(flow: DataFrame, spans_us: dict[str, int]) -> DataFrame:
    """A flow per name and span; the session is put in order by row once and by time once, whatever their number."""
    old = lambda us: F.sum("ofi").over(Window.partitionBy("date").orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -us))
    upto = flow.withColumn("_upto", F.sum("ofi").over(so_far()))
    return upto.withColumns({name: (F.col("_upto") - F.coalesce(old(us), F.lit(0))).cast("long") for name, us in spans_us.items()}).drop("_upto")


def entry(latency_us: int, value: Column) -> Column:
    """The value at the last event strictly before t + latency within the spell; without latency, the row's own."""
    if latency_us == 0:
        return value
    w = Window.partitionBy("date", "spell").orderBy("ts_us").rangeBetween(Window.unboundedPreceding, latency_us - 1)
    return F.max(F.struct(F.col("event_row"), value.alias("value"))).over(w)["value"]

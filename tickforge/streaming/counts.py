"""Structured Streaming forms of two session operators: event counts and price spells over a live feed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SPELLS = "date string, spell long, start_us long, m2 long, next_m2 long, next_us long"
STATE = "row long, spell long, start_us long, m2 long"


def event_counts(stream: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Counts by event type over tumbling windows of event time (``ts``); rows later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("size").alias("shares"))


def _close_spells(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emits each spell when the mid moves on. State is the open spell alone, whatever the length of the session."""
    rows = pd.concat(list(frames)).sort_values("event_row")
    last = list(state.get) if state.exists else None
    out = []
    for row, ts_us, m2 in rows[["event_row", "ts_us", "m2"]].itertuples(index=False):
        if last is None:
            last = [row, 1, ts_us, m2]
        elif m2 != last[3]:
            out.append((key[0], last[1], last[2], last[3], m2, ts_us))
            last = [row, last[1] + 1, ts_us, m2]
        else:
            last[0] = row
    state.update(tuple(int(x) for x in last))
    yield pd.DataFrame(out, columns=["date", "spell", "start_us", "m2", "next_m2", "next_us"])


ORDERED_STATE = "row long, spell long, start_us long, m2 long, rows array<long>, ts array<long>, mids array<long>"


def _ordered_spells(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Holds rows until the watermark has passed them, then closes spells in order of event_row."""
    row, spell, start_us, m2, rows, ts, mids = state.get if state.exists else (-1, 0, 0, 0, [], [], [])
    held = [*zip(rows, ts, mids, strict=True)]
    for frame in frames:
        held += [tuple(map(int, r)) for r in frame[["event_row", "ts_us", "m2"]].itertuples(index=False)]
    held.sort()
    day_us = int(pd.Timestamp(key[0], tz="UTC").value // 1000)
    passed = state.getCurrentWatermarkMs() * 1000 - day_us
    # a row waits behind an earlier one that hasn't been passed, so that order by row holds whatever the times
    ready = next((i for i, r in enumerate(held) if r[1] >= passed), len(held))
    out = []
    for r, at, mid in held[:ready]:
        if spell == 0 or mid != m2:
            if spell:
                out.append((key[0], spell, start_us, m2, mid, at))
            spell, start_us, m2 = spell + 1, at, mid
        row = r
    rest = held[ready:]
    state.update((row, spell, start_us, m2, *([r[i] for r in rest] for i in range(3))))
    if rest:
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (day_us + rest[0][1]) // 1000 + 1))
    yield pd.DataFrame(out, columns=["date", "spell", "start_us", "m2", "next_m2", "next_us"])


def ordered_spells(stream: DataFrame, late: str = "5 minutes") -> DataFrame:
    """The spells of each session as they end, whatever the order in which rows arrive within ``late``; rows later than
    the watermark are dropped. State is the open spell and the rows of that stretch of time. Input: date (yyyy-MM-dd),
    event_row, ts_us since midnight, m2."""
    at = F.timestamp_micros(F.unix_micros(F.to_timestamp("date", "yyyy-MM-dd")) + F.col("ts_us"))
    return (
        stream.select("date", "event_row", "ts_us", "m2", at.alias("at")).withWatermark("at", late).groupBy("date")
        .applyInPandasWithState(_ordered_spells, SPELLS, ORDERED_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def closed_spells(stream: DataFrame) -> DataFrame:
    """The spells of each session as they end. Input: date, event_row, ts_us, m2, in order of event_row."""
    return stream.groupBy("date").applyInPandasWithState(_close_spells, SPELLS, STATE, "append", GroupStateTimeout.NoTimeout)

"""The eight-row session, from raw CSV pairs to all six grids, against its published cells (fixed values)."""

import pytest
from pyspark.sql import functions as F

from tickforge import cli
from tickforge.functions import book as B
from tickforge.operators import contracts as C
from tickforge.operators import grids as G
from tickforge.operators import spells as S
from tickforge.plans.books import transitions
from tickforge.sources import raw

DAY = "2019-07-03"
MESSAGES = """46799.999992,5,1,1,1000000,-1,x
46799.999993,1,2,10,990000,1,x
46799.999994,2,3,5,1010000,-1
46799.999994,4,4,15,1010000,-1
46799.999996,1,5,25,1010000,-1
46799.999998,3,6,40,990000,1
46800.000000,1,7,12,990000,1
46800.000001,5,8,1,1000000,-1
"""
BOOKS = """1010000,20,990000,30,1020000,40,980000,50
1010000,20,990000,40,1020000,40,980000,50
1010000,15,990000,40,1020000,40,980000,50
1020000,40,990000,40,1030000,60,980000,50
1010000,25,990000,40,1020000,40,980000,50
1010000,25,980000,50,1020000,40,970000,60
1010000,25,990000,12,1020000,40,980000,50
1010000,25,990000,12,1020000,40,980000,50
"""
BINS = 11


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw")
    (path / f"XYZ_{DAY}_34200000_57600000_message_2.csv").write_text(MESSAGES)
    (path / f"XYZ_{DAY}_34200000_57600000_orderbook_2.csv").write_text(BOOKS)
    return str(path)


@pytest.fixture(scope="module")
def flow(spark, folder):
    return S.with_flow(raw.read_sessions(spark, folder, "XYZ", 2019, close_ns={DAY: 46_800_000_000_000})).persist()


@pytest.fixture(scope="module")
def lab(flow):
    return S.labelled(flow, exits=True).persist()


def cells(df, *cols):
    return {(r["queue_bin"], r["ofi_bin"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_decoding(flow):
    rows = flow.orderBy("event_row").collect()
    assert len(rows) == 7 and rows[0]["ts_ns"] == 46_799_999_992_000 and [r["spell"] for r in rows] == [1, 1, 1, 2, 3, 4, 5]
    assert flow.where(B.valid_snapshot()).count() == 7
    counts = {r["verdict"]: r["n"] for r in transitions(flow).groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    assert counts == {"exact": 4, "depth_censored": 2}


def test_queue_bins(lab):
    grid = G.queue_bins(lab, BINS).where("sample = 'best_quote_updates' AND spread_bucket = 'all_spreads'")
    assert {r["bin"]: (r["observations"], r["up_moves"], r["down_moves"]) for r in grid.collect()} == {5: (1, 0, 1), 6: (2, 1, 1), 7: (2, 2, 0), 8: (1, 1, 0)}


def test_order_flow_bins(lab):
    grid = G.order_flow_bins(lab, BINS).where("sample = 'best_quote_updates' AND spread_bucket = 'all_spreads'")
    got = cells(grid, "observations", "up_moves", "down_moves")
    assert len(got) == 5 and got[6, 5] == (2, 1, 1) and got[7, 6] == (1, 1, 0)


def test_horizon_bins(flow, lab):
    grid = G.horizon_bins(lab, BINS, [1, 2], [1, 2]).where("spread_bucket = 'all_spreads'").persist()
    one = lambda kind, value: cells(grid.where((F.col("horizon_kind") == kind) & (F.col("horizon_value") == value)), "observations", "up_moves", "down_moves")
    assert one("price_spell", 0)[6, 5] == (2, 1, 1) and one("quote_updates", 1)[6, 4] == (1, 0, 1) and one("clock_us", 2)[7, 3] == (1, 1, 0)
    C.require(C.horizon_violations(grid))


def test_markout_bins(lab):
    grid = G.markout_bins(lab, BINS, [0, 1]).where("spread_bucket = 'all_spreads'")
    cols = ("signals", "executable", "stale", "up_moves", "down_moves", "midpoint_move_sum_bps", "half_spread_sum_bps")
    assert cells(grid.where("latency_us = 0"), *cols)[7, 6] == (1, 1, 0, 1, 0, pytest.approx(50), pytest.approx(100))
    assert cells(grid.where("latency_us = 1"), *cols)[7, 6] == (1, 0, 1, 1, 0, 0, 0)
    C.require(C.markout_violations(grid))


def test_landmark_and_round_trip_bins(flow, lab):
    marks = G.landmarks(lab, 1, [0, 1])
    cols = ("signals", "executable", "stale", "up_moves", "down_moves", "midpoint_move_sum_bps", "half_spread_sum_bps")
    grid = G.landmark_bins(marks, BINS).where("spread_bucket = 'all_spreads'").persist()
    now = cells(grid.where("latency_us = 0"), *cols)
    assert now[5, 5] == (1, 1, 0, 0, 1, pytest.approx(-49.7512437811), pytest.approx(149.253731343))
    assert now[6, 5] == (2, 2, 0, 1, 1, pytest.approx(0), pytest.approx(200))
    assert now[7, 5] == (1, 1, 0, 1, 0, pytest.approx(50.2512562814), pytest.approx(150.753768844))
    assert cells(grid.where("latency_us = 1"), *cols)[6, 5] == (2, 0, 2, 1, 1, 0, 0)
    trips = G.round_trip_bins(G.round_trips(marks, [1, 70]), BINS).where("spread_bucket = 'all_spreads'").persist()
    legs = lambda s: [f"{s}_fills", f"{s}_censored", *[f"{s}_{c}_sum_bps" for c in ("move", "entry_cost", "exit_cost", "pnl")]]
    at = lambda us, n: cells(trips.where((F.col("latency_us") == us) & (F.col("shares") == n)), "signals", "arrived", "stale", "up_moves", "down_moves", *legs("long"), *legs("short"))
    near = lambda *v: tuple(x if isinstance(x, int) else pytest.approx(x) for x in v)
    assert at(0, 1)[5, 5] == near(1, 1, 0, 0, 1, 1, 0, -49.7512437811, 149.253731343, 99.5024875622, -298.507462687, 1, 0, 49.7512437811, 149.253731343, 99.5024875622, -199.004975124)
    assert at(0, 70)[6, 5] == near(2, 2, 0, 1, 1, 0, 2, 0.0, 0.0, 0.0, 0.0, 1, 1, -50.0, 157.142857143, 192.857142857, -400.0)
    assert at(1, 1)[6, 5] == near(2, 0, 2, 1, 1, 0, 0, 0.0, 0.0, 0.0, 0.0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    C.require(C.round_trip_violations(trips))


def test_broken_sessions(spark, folder, tmp_path):
    (tmp_path / f"XYZ_{DAY}_34200000_57600000_message_2.csv").write_text(MESSAGES)
    with pytest.raises(C.ContractError, match="both files"):
        raw.discover(spark, str(tmp_path))
    (tmp_path / f"XYZ_{DAY}_34200000_57600000_orderbook_2.csv").write_text(BOOKS.split("\n", 1)[1])
    with pytest.raises(C.ContractError, match="differ in number"):
        raw.read_sessions(spark, str(tmp_path))
    with pytest.raises(C.ContractError, match="no sessions"):
        raw.discover(spark, folder, "ABC")


def test_command_line(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    assert cli.main(["prepare-events", "--raw-dir", folder, "--output", out], spark) == {"events": 8}
    counts = cli.main(["prepare-visible", "--events", f"{out}/events", "--output", out, "--format", "csv"], spark)
    assert counts["visible_orders"] >= 1


def test_two_symbols_need_a_name(spark, tmp_path):
    for symbol in ("XYZ", "ABC"):
        (tmp_path / f"{symbol}_{DAY}_34200000_57600000_message_2.csv").write_text(MESSAGES)
        (tmp_path / f"{symbol}_{DAY}_34200000_57600000_orderbook_2.csv").write_text(BOOKS)
    with pytest.raises(raw.ContractError, match="ABC, XYZ"):
        raw.read_sessions(spark, str(tmp_path))
    rows = raw.read_sessions(spark, str(tmp_path), "ABC").collect()
    assert len(rows) == len(MESSAGES.strip().splitlines()) and {r["symbol"] for r in rows} == {"ABC"}


def test_errors_name_file_and_line(spark, tmp_path):
    lines = MESSAGES.strip().splitlines()
    lines[2] = lines[2].replace(",", ",x", 1)
    (tmp_path / f"XYZ_{DAY}_34200000_57600000_message_2.csv").write_text("\n".join(lines))
    (tmp_path / f"XYZ_{DAY}_34200000_57600000_orderbook_2.csv").write_text(BOOKS)
    with pytest.raises(Exception, match=r"message_2\.csv:3 \(byte 63\): bad number"):
        raw.read_sessions(spark, str(tmp_path), "XYZ").collect()

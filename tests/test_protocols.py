"""The persistence protocol, ordered streams, idempotent sessions, decode errors and calendars, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge import cli
from tickforge.operators import contracts as C
from tickforge.operators import liquidity as L
from tickforge.operators import persistence as H
from tickforge.operators import scores as S
from tickforge.operators import windows as W
from tickforge.sources import policy, raw
from tickforge.streaming import counts

SCALES = [4, 8, 16, 32]


def made_signs(seed: int, sizes: dict[str, int]) -> list[tuple]:
    rng, rows = np.random.default_rng(seed), []
    for date, n in sizes.items():
        sign = 1
        for i in range(n):
            sign = sign if rng.random() < 0.7 else -sign
            rows.append((date, i, sign))
    return rows


def test_persistence_protocol(spark):
    sizes = {"d1": 150, "d2": 90, "d3": 200, "d4": 160, "d5": 40}
    rows = made_signs(1, sizes)
    tables = H.persistence(spark.createDataFrame(rows, "date string, row0 long, sign int").repartition(3), SCALES, 100, 30, (1, 2), 400, 5)
    signs = {d: np.array([s for date, _, s in rows if date == d], float) for d in sizes}
    exponent = lambda x: float(L.sign_exponents(x[None], SCALES)[0])
    got = {r["date"]: r for r in tables["sessions"].collect()}
    assert {d: (r["trades"], r["included"]) for d, r in got.items()} == {d: (n, n >= 100) for d, n in sizes.items()}
    kept = [d for d, n in sizes.items() if n >= 100]
    nulls = {d: [exponent(H.shuffled(signs[d], rep, 5)) for rep in range(30)] for d in kept}
    for d in kept:
        assert got[d]["exponent"] == pytest.approx(exponent(signs[d])) and got[d]["buy_fraction"] == pytest.approx(np.mean(signs[d] == 1))
        assert got[d]["p_value"] == pytest.approx((1 + sum(v >= exponent(signs[d]) for v in nulls[d])) / 31)
    assert got["d2"]["exponent"] is None
    real = np.array([exponent(signs[d]) for d in kept])
    null = np.median([nulls[d] for d in kept], axis=0)
    r = tables["family"].first()
    assert (r["sessions"], r["trades"], r["permutations"]) == (3, 510, 30)
    assert [r["lower_quartile"], r["median"], r["upper_quartile"]] == pytest.approx(np.quantile(real, [0.25, 0.5, 0.75]).tolist())
    assert [r["null_lower"], r["null_median"], r["null_upper"]] == pytest.approx(np.quantile(null, [0.025, 0.5, 0.975]).tolist())
    assert r["p_value"] == pytest.approx((1 + (null >= np.median(real)).sum()) / 31)
    for r in tables["medians"].collect():
        at = S.drawn(np.arange(400), 3, 5, r["block"] if r["block"] > 1 else None)
        assert [r["lower"], r["upper"]] == pytest.approx(np.quantile(np.median(real[at], axis=1), [0.025, 0.975]).tolist())
    with pytest.raises(Exception, match="longer than the included"):
        H.median_intervals(tables["sessions"].where("included").select("date", "exponent"), (4,), 10).collect()


def test_shuffles_are_permutations_that_differ():
    x = np.arange(500.0)
    a, b = H.shuffled(x, 0, 1), H.shuffled(x, 1, 1)
    assert sorted(a) == sorted(b) == x.tolist() and (a != b).mean() > 0.95
    assert abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.15


def test_persistence_refuses_bad_input(spark):
    for scales in ([16], [16, 8], [16, 16], [2, 8], [16, 200]):
        with pytest.raises(C.ContractError, match="scales"):
            H.require_scales(scales, 100)
    frame = lambda rows: spark.createDataFrame(rows, "date string, row0 long, sign int")
    with pytest.raises(C.ContractError, match="sign_not_unit: 1"):
        H.persistence(frame([("d", 0, 1), ("d", 1, 0)]), SCALES, 100)
    with pytest.raises(C.ContractError, match="order_not_unique: 1"):
        H.persistence(frame([("d", 0, 1), ("d", 0, -1)]), SCALES, 100)


def test_stream_of_shuffled_rows_equals_the_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for date in ("2024-01-02", "2024-01-03"):
        mids = np.cumsum(rng.integers(-1, 2, 120)) + 500
        rows += [(date, i, 1_000_000 * i + int(rng.integers(0, 3)) * 1000, int(m)) for i, m in enumerate(mids)]
    schema = "date string, event_row long, ts_us long, m2 long"
    expected = []
    for date in ("2024-01-02", "2024-01-03"):
        spell = 0
        last = None
        for _, _, ts, m2 in (r for r in rows if r[0] == date):
            if last is None or m2 != last[1]:
                if last:
                    expected.append((date, spell, last[0], last[1], m2, ts))
                spell, last = spell + 1, (ts, m2)
    # neighbours within half a minute change places over batches; a last row far ahead moves the watermark on
    batches = [[] for _ in range(8)]
    for i, r in enumerate(sorted(rows, key=lambda r: (r[0], r[2] + 15_000_000 * rng.random()))):
        batches[i // 30].append(r)
    batches.append([("2024-01-05", 0, 0, 1)])
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").option("latestFirst", "false").parquet(f"{tmp_path}/in")
    query = counts.ordered_spells(stream, "60 seconds").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(240)
    got = sorted(tuple(r[c] for c in ("date", "spell", "start_us", "m2", "next_m2", "next_us")) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(expected)


MESSAGES = "34200.0,1,5,10,1000000,-1\n34201.0,1,6,10,990000,1\n57601.0,1,7,10,990000,1\n"
BOOKS = "1010000,20,990000,30,1020000,40,980000,50\n" * 3


def written(folder, date: str, messages: str = MESSAGES, books: str = BOOKS) -> str:
    (folder / f"XYZ_{date}_34200000_57600000_message_2.csv").write_text(messages)
    (folder / f"XYZ_{date}_34200000_57600000_orderbook_2.csv").write_text(books)
    return str(folder)


def test_errors_name_file_line_and_byte(spark, tmp_path):
    lines = MESSAGES.splitlines()
    for k, (bad, reason) in enumerate([("34201.0,1,x,10,990000,1", "bad number x"), ("34201.0,9,6,10,990000,1", "unknown event type 9"), ("34201.0,1,6,10", "unexpected number of fields"), ("3x,1,6,10,1,1", "bad time 3x")]):
        folder = tmp_path / str(k)
        folder.mkdir()
        path = written(folder, "2024-01-02", f"{lines[0]}\n{bad}\n{lines[2]}\n")
        with pytest.raises(Exception, match=rf"message_2\.csv:2 \(byte {len(lines[0]) + 1}\): {reason}"):
            raw.read_sessions(spark, path, "XYZ").collect()
    folder = tmp_path / "crlf"
    folder.mkdir()
    path = written(folder, "2024-01-02", MESSAGES.replace("\n", "\r\n").replace(",6,10", ",y,10"), BOOKS.replace("\n", "\r\n"))
    with pytest.raises(Exception, match=rf":2 \(byte {len(lines[0]) + 2}\): bad number y"):
        raw.read_sessions(spark, path, "XYZ").collect()


def test_coverage_counts_rows_after_the_close(spark, tmp_path):
    events = raw.read_sessions(spark, written(tmp_path, "2024-01-02"), "XYZ", after_close=True)
    r = C.session_coverage(events, F.col("close_us"), 60_000_000, []).first()
    assert (r["events"], r["after_close"], r["last_row"], r["gap_us"], r["status"]) == (3, 1, 1, 57_600_000_000 - 34_201_000_000, "unexplained_incomplete")
    assert raw.read_sessions(spark, str(tmp_path), "XYZ").count() == 2
    late = C.session_coverage(events.where("event_row = 2"), F.col("close_us"), 60_000_000, []).first()
    assert (late["last_row"], late["gap_us"], late["complete"]) == (None, None, False)


def test_a_day_added_twice_stands_once(spark, tmp_path):
    made = lambda day, n: spark.range(n).select(F.lit(day).alias("date"), F.col("id").alias("event_row"))
    path = str(tmp_path / "events")
    for day, n in (("2024-01-02", 5), ("2024-01-03", 7), ("2024-01-03", 6)):
        raw.write_events(made(day, n), path)
    assert {str(r["date"]): r["count"] for r in spark.read.parquet(path).groupBy("date").count().collect()} == {"2024-01-02": 5, "2024-01-03": 6}


POLICY = """symbol=XYZ
year=2024
source_availability=licensed
maximum_session_end_gap_seconds=60
expected_delivered_sessions=4
expected_included_sessions=3
expected_development_sessions=1
expected_selection_sessions=1
expected_test_sessions=1
source_exclusion=2024-01-05
development_end=2024-01-02
selection_start=2024-01-03
selection_end=2024-01-03
test_start=2024-01-04
"""
FULL = MESSAGES.replace("57601.0", "57599.5")


def test_calendars_are_reconciled(spark, tmp_path):
    folder, rules = tmp_path / "raw", tmp_path / "policy.conf"
    folder.mkdir()
    rules.write_text(POLICY)
    for day in ("02", "03", "04"):
        written(folder, f"2024-01-{day}", FULL)
    written(folder, "2024-01-05", MESSAGES)

    def run(verb="audit-session-coverage", *more, text=POLICY):
        rules.write_text(text)
        return cli.main([verb, "--raw-dir", str(folder), "--analysis-policy", str(rules), "--output", str(tmp_path / "out"), *more], spark)

    assert run()["session_coverage"] == 4
    assert run("prepare-events", "--symbol", "XYZ")["events"] == 9
    for text, match in (
        (POLICY.replace("sessions=4", "sessions=5").replace("included_sessions=3", "included_sessions=4").replace("test_sessions=1", "test_sessions=2"), "delivered_count"),
        (POLICY.replace("exclusion=2024-01-05", "exclusion=2024-01-08"), "unexplained_incomplete: 1; exclusion_not_delivered: 1"),
        (POLICY.replace("exclusion=2024-01-05", "exclusion=2024-01-03"), "declared_but_complete: 1"),
    ):
        with pytest.raises(C.ContractError, match=match):
            run(text=text)
    assert run("audit-session-coverage", "--lenient", text=POLICY.replace("exclusion=2024-01-05", "exclusion=2024-01-03"))["coverage_gate"] == 2
    with pytest.raises(C.ContractError, match="not ABC 2024"):
        run("prepare-events", "--symbol", "ABC")
    with pytest.raises(C.ContractError, match="XYZ 2023"):
        run("prepare-events", "--year", "2024", text=POLICY.replace("year=2024", "year=2023"))
    with pytest.raises(C.ContractError, match="boundaries_missing"):
        run("prepare-events", text=POLICY.replace("test_start=2024-01-04", "test_start=2024-01-06"))
    assert W.DFA_SCALES[-1] <= H.MINIMUM and policy.parse(POLICY).exclusions == ("2024-01-05",)

"""Grids in files: round trips, broken files, N=PATH, joins that must be one to one, and the audit."""

import pytest
from pyspark.sql import functions as F

from tickforge import cli
from tickforge.operators import audit as A
from tickforge.operators import contracts as C
from tickforge.operators import evaluate as E
from tickforge.plans import books as K
from tickforge.sources import grids as X

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def flow_grid(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grids") / "flow")
    X.write_grid(K.G.order_flow_bins(K.lab(spark, SF), 11), path, "order_flow")
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_round_trip_of_every_kind(spark, tmp_path):
    made = {"order_flow": K.G.order_flow_bins(K.lab(spark, SF), 5), "landmark": K.landmark_grid(spark, SF), "round_trip": K.trip_grid(spark, SF)}
    for kind, grid in made.items():
        path = str(tmp_path / kind)
        X.write_grid(grid, path, kind, 100)
        assert spark.read.option("header", "true").csv(path).columns == X.COLUMNS[kind]
        back = X.read_grid(spark, path, kind)
        shared = [c for c in back.columns if c in grid.columns]
        assert rows(back.select(shared)) == rows(grid.select([F.col(c).cast(back.schema[c].dataType).alias(c) for c in shared]))


def test_broken_files_are_refused(spark, tmp_path):
    header = ",".join(X.COLUMNS["order_flow"])
    good = "2024-01-01,all_events,all_spreads,1,2,-0.5,0.5,3,1,2"
    def written(name, *lines):
        (tmp_path / name).mkdir()
        for i, text in enumerate(lines):
            (tmp_path / name / f"{i}.csv").write_text(text)
        return str(tmp_path / name)

    assert X.read_grid(spark, written("good", f"{header}\n{good}\n"), "order_flow").count() == 1
    with pytest.raises(C.ContractError, match="missing columns ofi_bin"):
        X.read_grid(spark, written("short", header.replace("ofi_bin,", "") + "\n"), "order_flow")
    for name, line, match in (
        ("text", good.replace(",3,1,2", ",x,1,2"), "bad observations x"), ("minus", good.replace(",3,1,2", ",3,-1,2"), "bad up_moves -1"),
        ("nan", good.replace("-0.5", "NaN"), "bad queue_center NaN"), ("empty", good.replace(",all_spreads,", ",,"), "bad spread_bucket"),
    ):
        with pytest.raises(Exception, match=match):
            X.read_grid(spark, written(name, f"{header}\n{good}\n{line}\n"), "order_flow").collect()
    other = ",".join(reversed(X.COLUMNS["order_flow"]))
    with pytest.raises(Exception, match="(?i)header"):
        X.read_grid(spark, written("mixed", f"{header}\n{good}\n", f"{other}\n{good}\n"), "order_flow").collect()
    for spec in ("21", "x=p", "21="):
        with pytest.raises(C.ContractError, match="N=PATH"):
            X.read_grids(spark, [spec], "order_flow")


def test_verbs_read_files(spark, flow_grid, tmp_path):
    direct = E.evaluate_models(X.read_grid(spark, flow_grid, "order_flow").where("sample = 'best_quote_updates'"), "2024-01-25", cli.M.MODELS)
    counts = cli.main(["analyze-order-flow", "--bins", flow_grid, "--test-start", "2024-01-25", "--output", str(tmp_path / "one")], spark)
    assert counts["metrics"] == direct.count() and counts["comparisons"] > 0
    assert rows(spark.read.parquet(str(tmp_path / "one/metrics"))) == rows(direct)
    both = ["--bins", f"11={flow_grid}", "--bins", f"12={flow_grid}"]
    assert cli.main(["analyze-order-flow-grid", *both, "--test-start", "2024-01-25", "--output", str(tmp_path / "two")], spark)["metrics"] > 0
    with pytest.raises(C.ContractError, match="two grids"):
        cli.main(["analyze-order-flow-grid", *both[:2], "--test-start", "2024-01-25", "--output", str(tmp_path / "three")], spark)
    with pytest.raises(ValueError, match="not a session"):
        cli.main(["analyze-order-flow", "--bins", flow_grid, "--test-start", "2025-01-25", "--output", str(tmp_path / "four")], spark)
    twice = X.read_grid(spark, flow_grid, "order_flow")
    X.write_grid(twice.unionByName(twice.where("queue_bin = 3")), str(tmp_path / "twice"), "order_flow")
    with pytest.raises(C.ContractError, match="duplicate_cells"):
        cli.main(["analyze-order-flow", "--bins", str(tmp_path / "twice"), "--test-start", "2024-01-25", "--output", str(tmp_path / "five")], spark)


def test_tampered_metrics_are_refused(spark, tmp_path):
    grid = K.trip_grid(spark, SF)
    X.write_grid(grid, str(tmp_path / "trips"), "round_trip", 100)
    test = grid.where("date >= '2024-01-25'")
    policies = spark.createDataFrame([(f,) for f in (1.0, 0.2)], "target_train_fraction double").crossJoin(test.select("spread_bucket", "latency_us", "shares").distinct())
    policies = policies.select(
        "*", F.lit("both").alias("model"), F.when(F.col("target_train_fraction") == 1, 0.0).otherwise(0.123456).alias("confidence_cutoff"), F.lit(0.1).alias("intercept"), F.lit(1.0).alias("queue_coefficient"), F.lit(0.7).alias("ofi_coefficient")
    )
    days = E.stored_policy_days(test, policies).groupBy(*E.METRIC_KEYS).agg(*[F.sum(c).alias(c) for c in ("signals", "arrived", "fills", "pnl")])
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    metrics = policies.join(days, E.METRIC_KEYS, "left").select(
        *policies.columns, F.lit("2024-01-25").alias("test_first_date"), F.lit("2024-01-30").alias("test_last_date"), F.lit(6).alias("clusters"), n("signals").alias("selected_test_signals"),
        n("arrived").alias("arrived_test_signals"), n("fills").alias("filled_round_trips"), (F.col("pnl") / F.when(F.col("fills") > 0, F.col("fills"))).alias("quoted_round_trip_mean_bps"),
    )
    metrics = spark.createDataFrame(metrics.collect(), metrics.schema)

    def audit(table, name):
        X.write_grid(table, str(tmp_path / name), "policy_metrics")
        return cli.main(["audit-round-trip-policies", "--bins", str(tmp_path / "trips"), "--metrics", str(tmp_path / name), "--test-start", "2024-01-25", "--output", str(tmp_path / f"{name}-out")], spark)

    assert audit(metrics, "good")["policy_audit"] > 0
    one = (F.col("shares") == 1) & (F.col("latency_us") == 0)
    for name, table, match in (
        ("fills", metrics.withColumn("filled_round_trips", F.when(one, F.col("filled_round_trips") - 1).otherwise(F.col("filled_round_trips"))), "counts_differ"),
        ("profit", metrics.withColumn("quoted_round_trip_mean_bps", F.col("quoted_round_trip_mean_bps") * F.when(one, 1.000001).otherwise(1.0)), "profit_differs"),
        ("gone", metrics.where(~(one & (F.col("target_train_fraction") == 1))), "missing_policies"),
        ("twice", metrics.unionByName(metrics.where(one)), "duplicate_policies"),
    ):
        with pytest.raises(C.ContractError, match=match):
            audit(table, name)


def test_one_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "d"), (3, "e"), (4, "f"), (4, "g")], "k int, y string")
    got = {r["rule"]: r["violations"] for r in C.one_to_one_violations(left, right, ["k"]).collect()}
    assert got == {"left_duplicates": 1, "right_duplicates": 1, "left_only": 1, "right_only": 2}
    with pytest.raises(C.ContractError, match="left_duplicates"):
        C.one_to_one(left, right, ["k"])
    assert rows(C.one_to_one(left.where("k < 2"), right.where("k < 4"), ["k"])) == [(1, "a", "d")]


def test_checksum_merges_and_keeps_order(spark):
    events = K.lob_events(spark, SF).where("date < '2024-01-04'")
    events = spark.createDataFrame(events.collect(), events.schema)
    totals = lambda e: A.audit_totals(A.replay_audit(K.S.with_flow(e)))
    whole = totals(events.repartition(1)).first()
    assert totals(events.repartition(16)).first() == whole
    A.require_same(totals(events), totals(events.orderBy(F.desc("event_row"))))
    per = A.replay_audit(K.S.with_flow(events)).collect()
    assert sum(r["checksum_0"] for r in per) % A.PRIME == whole["checksum_0"]
    swapped = events.withColumn("event_row", F.when((F.col("date") == "2024-01-02") & F.col("event_row").isin(3, 4), 7 - F.col("event_row")).otherwise(F.col("event_row")))
    with pytest.raises(C.ContractError, match="checksum_0"):
        A.require_same(totals(events), totals(swapped))
    moved = events.withColumn("date", F.when(F.col("date") == "2024-01-02", F.lit("2024-01-09")).otherwise(F.col("date")))
    assert totals(moved).first()["checksum_1"] != whole["checksum_1"]
    plain = [0, 0]
    for r in events.collect():
        day = (__import__("datetime").date.fromisoformat(r["date"]) - __import__("datetime").date(1970, 1, 1)).days
        for lane in (0, 1):
            h = lane + 1
            for v in (day, r["event_row"], *(r[f] for f in A.FIELDS)):
                h = (h * A.BASES[lane] + v % A.PRIME) % A.PRIME
            plain[lane] += h * h % A.PRIME * (h % 65_521) % A.PRIME
    assert [p % A.PRIME for p in plain] == [whole["checksum_0"], whole["checksum_1"]]

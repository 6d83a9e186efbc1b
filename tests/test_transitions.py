"""Verdicts on single messages."""

from pyspark.sql import functions as F

from tickforge.functions import book as B

# Ten cases of one message each: type, direction, price, size, the four levels after it, and the verdict.
BEFORE = (101, 20, 99, 30, 102, 40, 98, 50)
CASES = [
    ("submission", 1, -1, 100, 10, (100, 10, 99, 30, 101, 20, 98, 50), "exact"),
    ("partial_cancel", 2, -1, 101, 5, (101, 15, 99, 30, 102, 40, 98, 50), "exact"),
    ("deletion", 3, -1, 102, 10, (101, 20, 99, 30, 102, 30, 98, 50), "exact"),
    ("visible_execution", 4, 1, 99, 10, (101, 20, 99, 20, 102, 40, 98, 50), "exact"),
    ("depletion", 4, -1, 101, 20, (102, 40, 99, 30, 103, 60, 98, 50), "depth_censored"),
    ("hidden_execution", 5, -1, 101, 5, (101, 20, 99, 30, 102, 40, 98, 50), "exact"),
    ("hidden_changes_book", 5, -1, 101, 5, (101, 15, 99, 30, 102, 40, 98, 50), "mismatch"),
    ("depletion_breaks_prefix", 3, -1, 101, 20, (103, 60, 99, 30, 104, 70, 98, 50), "mismatch"),
    ("bad_direction", 1, 0, 100, 10, (101, 20, 99, 30, 102, 40, 98, 50), "unsupported"),
    ("bad_type", 8, -1, 101, 5, (101, 20, 99, 30, 102, 40, 98, 50), "unsupported"),
]


def test_ten_cases(spark):
    columns = "name string, event_type int, direction int, price int, size int, " + ", ".join(f"{c} int" for c in B.BOOK)
    rows = spark.createDataFrame([(name, kind, way, price, size, *after) for name, kind, way, price, size, after, _ in CASES], columns)
    before = F.struct(*[F.lit(v).alias(c) for c, v in zip(B.BOOK, BEFORE, strict=True)])
    got = {r["name"]: r["verdict"] for r in rows.withColumn("prev", before).withColumn("verdict", B.transition("prev")).collect()}
    assert got == {c[0]: c[-1] for c in CASES}

"""Importance resampling against a plain version, with nulls, repeats, ties, long texts and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_operators import SCHEMA, fixture_rows
from tickforge.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TARGET = ["w1 w2 w3 W4 w5, w6; w7", None, "", "w1 w2 w1 w2", "日本語 é"]


def buckets(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def plain_report(rows, target):
    own = [buckets(text) for _, text in rows]
    corpus, wanted = Counter(b for x in own for b in x), Counter(b for x in target for b in buckets(x))
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((corpus[b] + 1) * (t + 10_000))))
    out = []
    for (doc_id, _), b in zip(rows, own, strict=True):
        weight = math.floor(sum(map(gain, b)) / len(b)) if b else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(t,) for t in TARGET], "text string")


def test_report_equals_plain_version(spark, target):
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, resampling.resampling_report(docs, target).collect()), key=repr)
    assert got == plain_report([r[:2] for r in rows], TARGET)


def test_ranks_are_whole_over_many_partitions_and_ties(spark, target):
    base = " ".join(f"w{i}" for i in range(25))
    rows = [(i // 3, base) for i in range(900)] + [(None, base)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [r["rank"] for r in resampling.resampling_report(docs, target).collect()]
    assert sorted(r for r in got if r is not None) == list(range(1, 25 * 950 // 100 + 1))


def test_draw_keeps_all_columns(spark, target):
    rows = [r for r in fixture_rows() if r[0] is not None]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("own"), "b": F.lit(1), "rank": F.lit(None).cast("int")})
    drawn = resampling.draw(docs, target)
    assert drawn.columns == docs.columns
    told = plain_report([r[:2] for r in rows], TARGET)
    last = max((r for r in told if r[4] is not None), key=lambda r: r[4])
    # rows that agree with the last drawn one in score and id stay together
    expected = Counter(r[0] for r in told if r[4] is not None or (r[1] >= 39 and (r[3], r[0]) == (last[3], last[0])))
    assert Counter(r["doc_id"] for r in drawn.collect()) == expected


def test_empty_tables(spark, target):
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.resampling_report(none, target).count() == 0
    assert resampling.draw(none, target).count() == 0
    docs = spark.createDataFrame(fixture_rows(), SCHEMA)
    got = sorted(map(tuple, resampling.resampling_report(docs, none).collect()), key=repr)
    assert got == plain_report([r[:2] for r in fixture_rows()], [])


def test_scoring_explodes_and_joins_nothing(spark, target):
    b = resampling.bucket_array(F.col("text"))
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = docs.select(resampling.weight_of(b, list(range(10_000))))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Generate|Join|Exchange|Python", plan)

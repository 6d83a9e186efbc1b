"""Personal data: base spans against plain patterns, added spans against planted ones, and the defined cases."""

import random
import re
import time

import numpy as np
import pytest

from tests.llm.test_llm_operators import SCHEMA, fixture_rows, prose
from tickforge.llm import pii
from tickforge.llm.common import Scratch

# The contract's patterns as written.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(spark.createDataFrame(fixture_rows(), SCHEMA), Scratch(spark, "piitest"))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    for _ in range(6000):
        text = "".join(rng.choice(["a", "b@", "@", ".", "-", "+", "1", "25", "300", " ", "(", ")", "é", "_", "4111 1111 1111 1111", "x.y"]) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("piece", ["1 ", "a", "+1", "1.2.", "a@b ", "AB12 ", "a at b dot ", "12:34:", "a.", "(1) ", "token 1-"])
def test_scans_are_linear(piece):
    def took(n):
        text, start = piece * (n // len(piece)), time.process_time()
        pii.base_spans(text)
        sum(1 for _ in pii.proposals(text))
        return time.process_time() - start

    assert took(800_000) < 8 * took(200_000) + 0.5


def test_added_spans_on_planted_rows(model):
    rng = random.Random(77)
    texts, truth = [], []
    for _ in range(1200):
        good = rng.random() < 0.5
        made, tell = (pii.personal if good else pii.alike)(rng)
        lead = prose(rng, 12) + (f" {tell}: " if tell else " ")
        texts.append(f"{lead}{made}, {prose(rng, 5)}")
        truth.append((good, len(lead), len(lead) + len(made)))
    found = pii.spans_of(texts, model)
    hit = [any(x[1:] == t[1:] for x in f) for f, t in zip(found, truth, strict=True) if t[0]]
    wrong = [any(x[0] >= pii.BASE_KINDS for x in f) for f, t in zip(found, truth, strict=True) if not t[0]]
    assert np.mean(hit) >= 0.9
    assert np.mean(wrong) <= 0.02


def test_added_spans_overlap_nothing(model):
    text = "call (212) 555-0199 or phone: 212-555-0188, mail a@b.com, SSN 123-45-6789 and +1 212 555 0100 " * 40
    spans = sorted(x[1:] for x in pii.spans_of([text], model)[0])
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert {x for x in pii.spans_of([text], model)[0] if x[0] < 4} == set(plain_spans(text))


def test_report_and_redact(spark, model):
    rows = [*fixture_rows(), (900, "mail a.b@c.example or 10.0.0.1", "en", "a", 3, "k", 1, "r")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pii.scan_pii(docs, model).collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r["doc_id"] == 900)
    assert (one["n_email"], one["n_ip"], one["spans"]) == (1, 1, "email:5:18,ip:22:30")
    redacted = pii.redact(docs, model)
    assert redacted.columns == docs.columns
    assert next(r for r in redacted.collect() if r["doc_id"] == 900)["text"] == "mail [email] or [ip]"
    assert sum(r["text"] is None for r in redacted.collect()) == sum(r[1] is None for r in rows)


def test_empty_table_learns_from_made_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = pii.learn(none, Scratch(spark, "piiempty"))
    assert np.isfinite(model.thresholds[pii.BASE_KINDS :]).all()
    assert pii.scan_pii(none, model).count() == 0


def test_scores_equal_those_of_the_fitted_trees(spark):
    """The arrays score rows as Spark's own model does."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)).round(1)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "f array<double>, label double").withColumn("x", array_to_vector("f"))
    fitted = GBTClassifier(maxIter=8, maxDepth=pii.DEPTH, featuresCol="x", seed=1).fit(rows.coalesce(1))
    own = pii.Boosted([t._call_java("rootNode") for t in fitted.trees], list(fitted.treeWeights))
    told = fitted.transform(rows).select("f", F.get(vector_to_array("probability"), 1).alias("p")).collect()
    assert np.allclose(own.scores(np.array([r["f"] for r in told])), [r["p"] for r in told])

"""A quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

A text's features are its word forms and pairs of neighbouring forms, hashed into ``2**BITS`` places, each counted
once and scaled so that a text's vector has length 1. A form is a word in lower case, its shape (letters, capitals,
digits, other signs) or its ending signs, so that kinds of words unseen in learning still count. Training runs
FTRL-Proximal with per-coordinate rates over a bounded sample of the labelled rows, ``SAMPLE`` of them chosen by a
hash of the id; that bound is the size of what the driver holds. Scoring is a sparse dot product on the executors.

Defined cases: null and empty texts have the bias alone; labels that are null or belong to no document are ignored; a
document labelled twice is learned twice; without labels every score is 0.5; repeated rows are scored each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import table
from tickforge.llm.rolling import BYTE_VALUES, Prefix, mix64, word_bounds

BITS = 18
SAMPLE = 6000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
FOLDS, HELD_OUT = 5, 0
CUT = 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Shape of a byte: 1 small letter, 2 capital, 3 digit, 4 part of a letter outside ASCII, 5 other sign.
_SHAPE = np.full(256, 5, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 3, 4


def features(data: bytes, bits: int = BITS) -> np.ndarray:
    """The sorted distinct places of a text's features; place 0 is the bias, in every text."""
    raw = np.frombuffer(data, dtype=np.uint8)
    lo, hi = word_bounds(raw)
    if not len(lo):
        return np.zeros(1, dtype=np.int64)
    words = Prefix(BYTE_VALUES[_LOWER[raw]]).windows(lo, hi)
    # shapes with runs of one kind as one sign
    kind = _SHAPE[raw]
    fresh = np.ones(len(raw), dtype=bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[lo] = True
    runs = Prefix(BYTE_VALUES[kind[fresh]])
    at = np.concatenate([[0], np.cumsum(fresh)])
    shapes = mix64(runs.windows(at[lo], at[hi]) + np.uint64(1))
    # the signs at a word's end: its last byte, twice if the one before is no letter or digit either
    last = raw[hi - 1].astype(np.uint64)
    before = np.where(hi - lo > 1, raw[np.maximum(hi - 2, 0)], 0).astype(np.uint64)
    ends = mix64(np.where(kind[hi - 1] == 5, last + np.uint64(256) * before * (_SHAPE[before.astype(np.uint8)] == 5), 0) + np.uint64(7919))
    pair = lambda x, salt: mix64(x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] + np.uint64(salt))
    all_ = np.concatenate([words, shapes, ends, pair(words, 1), pair(shapes, 2), pair(ends, 3)])
    return np.unique(np.concatenate([[0], (all_ >> np.uint64(64 - bits)).astype(np.int64)]))


class Ftrl:
    """FTRL-Proximal for logistic loss with per-coordinate learning rates."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float, weight: float = 1.0) -> None:
        value = 1 / np.sqrt(len(at))
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum() * value, -35, 35)))
        g = (p - label) * value * weight
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t.as_buffer().to_pybytes() if t.is_valid else b"").astype(np.int32) for t in batch.column("text")]
        if made:
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("quality"), pa.array(made, pa.list_(pa.int32()))], ["at", "quality", "features"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights per place. Input: docs doc_id, text; labels doc_id, quality."""
    # the sample is chosen among the labels, so only its bounded ids meet the texts
    at = F.xxhash64(F.lit("quality"), F.col("doc_id"))
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality", at.alias("at")).orderBy("at", "doc_id", "quality").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("at", "quality", "text")
    found = rows.mapInArrow(_featured, "at long, quality int, features array<int>").toArrow().sort_by([("at", "ascending"), ("quality", "ascending")])
    model = Ftrl(1 << BITS)
    marks = found.column("quality").to_numpy() if found.num_rows else np.zeros(0)
    made = [np.asarray(x.values) for x in found.column("features")] if found.num_rows else []
    order = sorted(range(len(made)), key=lambda i: (found.column("at")[i].as_py(), marks[i], made[i].tobytes()))
    for epoch in range(EPOCHS):
        for i in order if epoch % 2 == 0 else order[::-1]:
            model.learn(made[i], float(marks[i] > 0))
    return model.weights()


def _scored(shared) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            score = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column("text")):
                at = features(t.as_buffer().to_pybytes() if t.is_valid else b"")
                score[i] = 1 / (1 + np.exp(-np.clip(weights[at].sum() / np.sqrt(len(at)), -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return each


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. A null id is in no fold."""
    held = lambda c: F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weights = train(texts, labels.where(~held("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return texts.withColumn("held_out", held("doc_id")).mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

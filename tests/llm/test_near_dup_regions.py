"""Crowded regions and regions cut by a task's boundary lose no link."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickforge.llm import near_dup
from tickforge.llm.common import Scratch, row_key


def pairs_at_the_threshold(n: int, seed: int) -> list[tuple[str, str]]:
    """Texts of 100 words of their own, and copies with five words changed: similarity 89 / 109."""
    rng, out = random.Random(seed), []
    for i in range(n):
        own = [f"v{i}x{j}" for j in range(100)]
        other = list(own)
        for j in rng.sample(range(2, 98, 3), 5):
            other[j] = f"n{i}x{j}"
        out.append((" ".join(own), " ".join(other)))
    return out


def similarity(a: str, b: str) -> float:
    x, y = (set(near_dup.shingle_set(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_round_two_alone_finds_links_of_crowded_regions(spark, monkeypatch):
    """No roots are given, so nothing was found before; with WORK = 0 every region is crowded on every level but the last."""
    pairs = pairs_at_the_threshold(700, 3)
    assert all(0.8 <= similarity(*p) < 0.83 for p in pairs[:50])
    texts = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string").withColumn("rk", row_key())
    scratch = Scratch(spark, "regions")
    _, nodes, sketches, forest = near_dup.grown(texts, scratch, 2)
    roots = spark.createDataFrame([], "id long, root long")
    ids = {r["cls"]: r["doc_id"] for r in nodes.collect()}
    for work in (0, near_dup.WORK):
        monkeypatch.setattr(near_dup, "WORK", work)
        involved = near_dup.across(forest.select("key", "tree", "cls", "n"), sketches, roots, scratch)
        cells = involved.groupBy("cell").agg(F.collect_set("cls").alias("c")).collect()
        met = {frozenset((ids[a], ids[b])) for r in cells for a in r["c"] for b in r["c"] if ids[a] + 1 == ids[b] and ids[a] % 2 == 0}
        assert len(met) >= 0.99 * len(pairs), work


def test_pairs_fall_back_to_their_next_region_when_the_first_is_crowded(spark, monkeypatch):
    """Only the regions of one tree are crowded: a large group of near copies of it. No pair may be left to them."""
    rng = random.Random(9)
    base = [f"b{j}" for j in range(100)]
    texts = []
    for i in range(120):
        own = list(base)
        for j in rng.sample(range(2, 98, 3), 4):
            own[j] = f"c{i}x{j}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dup, "NEIGHBOURS", 1)
    monkeypatch.setattr(near_dup, "WORK", 3000)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_dup_report(docs).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}


def test_boundary_regions_are_told(spark):
    def batch(keys):
        ahead = pa.array([bytes(near_dup.N_VALUES)] * len(keys), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(range(len(keys))), pa.array([5] * len(keys)), ahead], ["key", "cls", "n", "ahead"])

    rows = [r for b in near_dup._neighbours(2)(iter([batch([1, 1, 2]), batch([3, 4])])) for r in b.to_pylist()]
    assert [r["key"] for r in rows if r["a"] is None] == [1, 4]
    assert {(r["key"], r["a"]) for r in rows if r["a"] is not None} == {(1, 0), (1, 1)}
    assert list(near_dup._neighbours(2)(iter([]))) == []


def test_orders_of_a_region_follow_from_its_key():
    """Classes of one region get equal keys where their picked values agree; other regions pick other values."""
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 256, near_dup.WIDTH).astype(np.uint8)
    other = sketch.copy()
    other[rng.permutation(near_dup.N_VALUES)[:51]] += 1  # a fifth of the values differ
    shared = []
    for key in range(400):
        rows = pa.RecordBatch.from_arrays([pa.array([key, key]), pa.array([1, 2]), pa.array([9, 9]), pa.array([1, 2]), pa.array([sketch.tobytes(), other.tobytes()])], ["key", "cls", "n", "root", "sketch"])
        keys = {(i, r["cls"]): r["key"] for i, b in enumerate(near_dup._deepened(iter([rows]))) for r in b.to_pylist()}
        shared.append(sum(keys[i, 1] == keys[i, 2] for i in range(near_dup.SUBTREES)))
    assert abs(np.mean(shared) / near_dup.SUBTREES - 0.8**near_dup.DEPTH) < 0.05
    assert np.mean(np.array(shared) == 0) < 0.05


def test_prints_that_deceive_bring_no_pairs_of_every_class(spark, monkeypatch):
    """Prints of few bits let nearly all pairs of a group pass, of which few are links. The pairs to confirm grow with the
    classes of the cells, not with their square, and all links are found, by whole sets."""
    rng, texts = random.Random(4), []
    base = [f"b{j}" for j in range(600)]
    for i in range(100):
        own = list(base)
        for j in rng.sample(range(2, 598, 3), 21):
            own[j] = f"p{i}x{j}"
        texts.append(" ".join(own))
        if i % 5 == 0:
            for j in rng.sample(range(3, 598, 3), 12):
                own[j] = f"q{i}x{j}"
            texts.append(" ".join(own))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    asked, confirm = [], near_dup.confirm

    def counted(picks, *rest):
        asked.append(picks.count())
        return confirm(picks, *rest)

    monkeypatch.setattr(near_dup, "NEIGHBOURS", 1)
    monkeypatch.setattr(near_dup, "confirm", counted)
    # 9 bits of each hash, in the three bytes of a print
    monkeypatch.setattr(near_dup, "prints", lambda found: ((found >> np.uint64(55)) << np.uint64(15)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_dup_report(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and 60 < len(set(got.values())) < len(texts)
    assert sum(asked) <= 8 * len(texts), asked  # of 7,140 pairs

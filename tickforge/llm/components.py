"""Connected components of a link table, on the cluster: local contraction, then alternating large and small stars.

Each round first contracts the links of every partition to stars, ``LOCAL`` links at a time, which alone solves what
fits one partition. What remains goes through the two star steps, a few shuffles over the links, and is written to the
shared folder, so the plan stays short. Nodes with very many links cost a partial minimum and a join that Spark
splits; nothing is gathered by node or on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import Scratch

LOCAL = 250_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of each component to its least id."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        # hook the roots of linked ends to the lesser one, then shorten all paths
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    rest = root != np.arange(len(ids))
    return ids[rest], ids[root[rest]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((np.asarray(batch.column("u")), np.asarray(batch.column("v"))))
        size += batch.num_rows
        if size > LOCAL:
            u, v = stars(*map(np.concatenate, zip(*held, strict=True)))
            if len(u) > LOCAL // 2:  # this much is settled here; further links start anew
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                u, v = u[:0], v[:0]
            held, size = [(u, v)], len(u)
    if size:
        u, v = stars(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root: for every id (long) in links (a, b) with a link to another, the least id that it reaches."""
    edges = scratch.put(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    state = _state(edges)
    while state[0]:
        parts = -(-state[0] // LOCAL)
        local = edges.coalesce(parts).mapInArrow(_contracted, "u long, v long")
        if parts == 1:
            edges = scratch.put(local)
            break
        both = local.unionByName(local.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = scratch.put(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = _state(following)
        scratch.clear(edges)
        edges = following
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )

"""Substring dedup by seed and extend: word passages that a document with a smaller id has too are removed.

Documents meet on winnowed anchors (16 of their words). A match is extended both ways from its anchor, first by the
whole context that windows with the anchor can reach: where contexts agree, all their windows are matches. Where
contexts of an anchor differ, one document per context, that with the least id, is extended word by word, as windows
of every alignment, and the windows meet in turn. Matches are joined to maximal repeats per document. Nothing is
paired up within a group: contexts and windows keep their least id, so work is linear in the anchors.

Defined cases: null texts have no words; documents with a null id keep all words and are no reason for others to lose
theirs; repeated rows, having one id, don't remove each other; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import KeyFilter, Scratch, table
from tickforge.llm.repeats import CONTEXTS, KEYS, WINDOWS, Seeds, contexts_pass, covered, keys_pass, marked, places_of, texts, windows_pass

LENGTH, GRAM = 50, 16


def repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """rk, lo, hi: ranges of words that a smaller id has too, maximal up to overlaps."""
    seeds, read = Seeds(True, length, gram), texts(docs)
    held = read.mapInArrow(keys_pass(seeds), KEYS).groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    shared = KeyFilter(scratch.put(held.where("a < b").select("key")))
    found = scratch.put(read.mapInArrow(contexts_pass(seeds, shared), CONTEXTS))
    least = scratch.put(found.groupBy("key", "context").agg(F.min("doc_id").alias("least")))
    # what joins follow on is written first: an exchange shared with an aggregate could not be split where a key is hot
    several = scratch.put(least.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("open")))
    known = least.join(several, "key", "left")
    judged = scratch.put(
        found.join(known, ["key", "context"]).where("doc_id > least OR open").select("rk", "at", "lo", "hi", (F.col("doc_id") > F.col("least")).alias("repeat"))
    )
    opened = KeyFilter(scratch.put(places_of(judged.where("NOT repeat")).distinct()), room=8)
    windows = scratch.put(read.mapInArrow(windows_pass(seeds, shared, opened), WINDOWS))
    first = scratch.put(windows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key", "least"))
    matched = windows.join(first, "key").where("doc_id > least").select("rk", "lo", (F.col("lo") + length).alias("hi"))
    return scratch.put(judged.where("repeat").select("rk", "lo", "hi").unionByName(matched))


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = text.as_buffer().to_pybytes().split()
            gone = covered(spans.as_py(), len(words))
            kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x] if gone.any() else words
            rows.append((len(words), int(np.count_nonzero(gone)), hashlib.sha256(b" ".join(kept)).hexdigest()))
        if rows:
            n, removed, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )


def substring_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    scratch = Scratch(docs.sparkSession, "substring")
    spans = repeats(docs, scratch)
    return marked(docs, spans, scratch).mapInArrow(_reports, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT rid, doc_id, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
k AS (SELECT s.rid, s.doc_id, s.i, md5(array_to_string(w.w[s.i:s.i + 49], ' ')) AS k FROM s JOIN w ON s.rid = w.rid),
m AS (SELECT rid, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM k) WHERE doc_id > first),
g AS (SELECT DISTINCT rid, i + j AS i FROM m, (SELECT unnest(range(50)) AS j)),
gone AS (SELECT rid, list(i) AS gone FROM g GROUP BY rid),
e AS (SELECT w.rid, w.w[i] AS x, i FROM w, unnest(range(1, len(w.w) + 1)) AS t(i)),
kept AS (SELECT e.rid, string_agg(e.x, ' ' ORDER BY e.i) AS t FROM e LEFT JOIN g ON e.rid = g.rid AND e.i = g.i WHERE g.i IS NULL GROUP BY e.rid)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(gone.gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.rid = gone.rid LEFT JOIN kept ON w.rid = kept.rid
"""

"""Importance resampling towards a target distribution.

Features are the words of a text and the pairs of consecutive words, hashed into ``BUCKETS`` buckets. A bucket's gain is
the log ratio of its smoothed shares in the target and in the corpus. Scoring never explodes: higher-order functions
make each document's array of buckets, and its weight is an aggregate over lookups in one literal array of gains. Of
the corpus only the bucket totals shuffle. Adding Gumbel noise that is a hash of the id and taking the highest scores
draws documents without replacement, in proportion to their weights.

Ranks come from a distributed sort: a histogram of scores (whole numbers of a bounded range) gives the score at which
the draw ends, and only rows that reach it are sorted and numbered across partitions.

Defined cases: null texts have no words, weight 0 and are never drawn; null ids draw the noise of the empty string and
come after equal scores; repeated rows are documents each; an empty corpus gives an empty result and an empty target
counts as nothing in every bucket; ``draw`` leaves all columns untouched, whatever their names, and keeps rows that
agree with the last drawn one in score and id together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import Scratch, table
from tickforge.llm.numbering import literal_array, numbered

BUCKETS = 10_000
# What stands between words, the least words of a document that may be drawn, the share drawn, the seed.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_WORDS, PER_CENT, SEED = 20, 25, 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def bucket_array(text: Column) -> Column:
    """The bucket of each feature of a text: its words, then its pairs."""
    words = F.filter(F.split(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")), GAPS), lambda w: w != "")
    bucket = lambda feature: F.pmod(F.crc32(feature), F.lit(BUCKETS)).cast("int")

    def features(w: Column) -> Column:
        pairs = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(
            F.transform(w, bucket),
            F.zip_with(F.slice(w, F.lit(1), pairs), F.slice(w, F.lit(2), pairs), lambda a, b: bucket(F.concat(a, F.lit(" "), b))),
        )

    return _bound(words, features)


def totals(buckets: DataFrame) -> list[int]:
    """How often each bucket occurs; buckets: a column ``b`` of arrays. A task emits at most ``BUCKETS`` rows."""
    counts = [0] * BUCKETS
    for bucket, n in buckets.select(F.explode("b").alias("bucket")).groupBy("bucket").count().collect():
        counts[bucket] = n
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    s, t = sum(corpus) + BUCKETS, sum(target) + BUCKETS
    return [math.floor(1000 * math.log(float((b + 1) * s) / float((a + 1) * t))) for a, b in zip(corpus, target, strict=True)]


def weight_of(buckets: Column, gain: list[int]) -> Column:
    """The floored mean of the gains of a document's buckets; 0 without any."""
    of = literal_array(gain)
    total = F.aggregate(buckets, F.lit(0).cast("bigint"), lambda acc, b: acc + F.element_at(of, b + 1))
    return F.when(F.size(buckets) > 0, F.floor(total / F.size(buckets))).otherwise(F.lit(0)).cast("bigint")


def noise_of(doc_id: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def _scored(docs: DataFrame, target: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """doc_id, n_features, weight and score of every row, and the gains."""
    made = scratch.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), bucket_array(F.col("text")).alias("b")))
    gain = gains(totals(made), totals(target.select(bucket_array(F.col("text")).alias("b"))))
    weighed = made.select("doc_id", F.size("b").cast("long").alias("n_features"), weight_of(F.col("b"), gain).alias("weight"))
    scored = scratch.put(weighed.withColumn("score", F.col("weight") + noise_of(F.col("doc_id"))))
    scratch.clear(made)
    return scored, gain


#: n words have 2n - 1 features.
ELIGIBLE = f"n_features >= {2 * LEAST_WORDS - 1}"


def _lowest_drawn(scored: DataFrame, per_cent: int) -> tuple[int, int | None]:
    """How many documents are drawn, and the score of the last of them. The driver sees a row per score; scores are
    whole numbers within what gains and noise can reach, some tens of thousands at most."""
    histogram = scored.where(ELIGIBLE).groupBy("score").count().collect()
    n = per_cent * sum(r["count"] for r in histogram) // 100
    seen = 0
    for score, count in sorted(histogram, key=lambda r: -r[0]):
        seen += count
        if n and seen >= n:
            return n, score
    return 0, None


def _ranked(scored: DataFrame, per_cent: int, scratch: Scratch) -> DataFrame:
    n, lowest = _lowest_drawn(scored, per_cent)
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    reached = F.expr(f"{ELIGIBLE} AND score >= {lowest}")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"))  # the tie spreads rows that agree in all else
    first = scored.where(reached).withColumn("tie", F.monotonically_increasing_id()).orderBy(*order).drop("tie")
    drawn, _ = numbered(first, "rank", scratch, start=1)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return drawn.unionByName(scored.where(~reached).withColumn("rank", F.lit(None).cast("long")))


def resampling_report(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and its rank among those drawn."""
    scratch = Scratch(docs.sparkSession, "resampling")
    return _ranked(_scored(docs, target, scratch)[0], per_cent, scratch)


def draw(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """The drawn documents with all their columns: one filter over the input, nothing joined."""
    scratch = Scratch(docs.sparkSession, "resampling")
    scored, gain = _scored(docs, target, scratch)
    ranked = _ranked(scored, per_cent, scratch)
    last = ranked.where("rank IS NOT NULL").agg(F.max_by(F.struct("score", "doc_id"), "rank").alias("last")).first()["last"]
    if last is None:
        return docs.limit(0)
    doc_id, lowest = F.col("doc_id").cast("long"), last["score"]

    def reaches(b: Column) -> Column:
        score = weight_of(b, gain) + noise_of(doc_id)
        tied = F.lit(True) if last["doc_id"] is None else F.coalesce(doc_id <= last["doc_id"], F.lit(False))
        return (F.size(b) >= 2 * LEAST_WORDS - 1) & ((score > lowest) | ((score == lowest) & tied))

    return docs.where(_bound(bucket_array(F.col("text")), reaches))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
             FROM (SELECT unnest(range(256)) AS i)),
texts AS (SELECT row_number() OVER () AS rid, doc_id, text, false AS target FROM documents
          UNION ALL SELECT -row_number() OVER (), item_id, text, true FROM benchmark),
w AS (SELECT rid, doc_id, target, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
f AS (SELECT rid, target, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
n AS (SELECT rid, target, f, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
        lambda c, x: xor(c >> 8, crc.t[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS b FROM d, crc),
k AS (SELECT b, sum(n) FILTER (NOT target) AS s, sum(n) FILTER (target) AS t FROM n JOIN b USING (f) GROUP BY b),
a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM k),
g AS (SELECT b, floor(1000 * ln(((coalesce(k.t, 0) + 1) * (a.s + 10000))::DOUBLE / ((coalesce(k.s, 0) + 1) * (a.t + 10000))::DOUBLE))::BIGINT AS g FROM k, a),
m AS (SELECT rid, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM n JOIN b USING (f) JOIN g USING (b) WHERE NOT target GROUP BY rid),
r AS (SELECT w.rid, w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(w.doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM w LEFT JOIN m USING (rid) WHERE NOT target),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS p, count(*) OVER (PARTITION BY n_words >= 20) AS c FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND p <= 25 * c // 100 THEN p END AS rank FROM o
"""

"""Quality rules whose thresholds adapt to each language and source.

Native DataFrame code only. Every document gets a few integer rates. The documents that pass the base rules feed one
quantile sketch per rate, language and source: a histogram over log-linear buckets (exact below 32, 1/16 relative
error above), which merges by adding counts, so it is an ordinary partial aggregate. A group's sketch is blended with
that of its language, which weighs as much as ``PRIOR`` documents, so that small groups lean on their language and
large ones on themselves; no size switches from one to the other. The fence of a rate is

    q85 + SPREADS * (q85 - q50) + 1000 * UNITS / median size

with the quantiles of the group's rate and the median of what the rate is a share of (lines, words or letters): a rate
that differs by fewer than ``UNITS`` lines, words or letters of a usual document of the group is not unusual. A document
beyond a fence of its group is rejected. Up to 15 in 100 documents of a group may be junk before a fence gives way.

Defined cases: null text has no words; null lang and null source are groups of their own; repeated rows are judged
each; an empty table gives an empty result; extra columns pass through ``filter_quality`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.llm.common import Scratch, table, words

#: What each rate is a share of, and how many of these make a difference.
UNITS = {"symbol_rate": ("word_chars", 20), "upper_rate": ("word_chars", 40), "dup_line_rate": ("n_lines", 2), "repeat_rate": ("n_words", 60)}
SPREADS = 3
PRIOR = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_measures(docs: DataFrame) -> DataFrame:
    """Adds ``_m``, a struct of the counts of every document, by built-in functions alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    out = docs.withColumns({"_w": words(F.col("text")), "_l": lines})
    n = F.size("_w")
    # three-word windows as (hash, position), sorted so that equal windows stand side by side
    h = F.transform("_w", lambda w: F.xxhash64(w))
    pairs = F.zip_with(h, F.slice(h, 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    grams = F.zip_with(pairs, F.slice(h, 3, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    grams = F.slice(grams, 1, F.greatest(n - 2, F.lit(0)))
    out = out.withColumn("_g", F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    twins = F.filter(
        F.zip_with(
            "_g",
            F.slice("_g", 2, F.greatest(F.size("_g"), F.lit(1))),
            lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])),
        ),
        lambda x: x.isNotNull(),
    )
    repeated = F.array_distinct(
        F.flatten(F.transform(F.flatten(twins), lambda i: F.array(i, i + 1, i + 2)))
    )
    gone = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    blanks = gone(" \t\n\x0b\x0c\r")
    long = lambda c: c.cast("long")
    return out.withColumn(
        "_m",
        F.struct(
            long(n).alias("n_words"),
            long(F.length(text) - blanks).alias("word_chars"),
            long(gone(SYMBOLS)).alias("n_symbols"),
            long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
            long(F.size(repeated)).alias("n_repeat_words"),
            long(F.size("_l")).alias("n_lines"),
            long(gone(UPPER)).alias("n_upper"),
        ),
    ).drop("_w", "_l", "_g")


def rates(m: str) -> dict[str, Column]:
    c = lambda name: F.col(f"{m}.{name}")
    per = lambda a, b: F.floor(1000 * c(a) / F.greatest(c(b), F.lit(1))).cast("long")
    return {
        "symbol_rate": per("n_symbols", "word_chars"),
        "upper_rate": per("n_upper", "word_chars"),
        "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
    }


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def bucket_of(v: Column) -> Column:
    """Log-linear bucket of a whole number from 0 on."""
    up = F.length(F.bin(v)) - 5
    return F.when(v < 32, v).otherwise(16 * up + F.call_function("shiftright", v, F.greatest(up, F.lit(0)))).cast("long")


def value_of(b: Column) -> Column:
    """The least value of a bucket."""
    up = F.greatest(F.floor(b / 16) - 1, F.lit(0)).cast("int")
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", F.pmod(b, F.lit(16)) + 16, up)).cast("long")


def sketch(measured: DataFrame) -> DataFrame:
    """The mergeable histograms of documents that pass the base rules: lang, source, rate, bucket, n. Sizes are among the
    rates."""
    measures = rates("_m") | {k: F.col(f"_m.{k}") for k in ("n_words", "n_lines", "word_chars")}
    each = F.array(*[F.struct(F.lit(k).alias("rate"), bucket_of(v).alias("bucket")) for k, v in measures.items()])
    return (
        measured.where(~base_failed("_m")).select("lang", "source", F.explode(each).alias("s"))
        .groupBy("lang", "source", F.col("s.rate").alias("rate"), F.col("s.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def fences(sketches: DataFrame) -> DataFrame:
    """One row per lang and source: the fence of each rate, from the group's histograms blended with its language's."""
    by_lang = sketches.groupBy(F.col("lang").alias("_lang"), F.col("rate").alias("_rate"), F.col("bucket").alias("_bucket")).agg(F.sum("n").alias("of_lang"))
    by_lang = by_lang.withColumn("all_lang", F.sum("of_lang").over(Window.partitionBy("_lang", "_rate")))
    groups = sketches.select("lang", "source").distinct()
    full = groups.join(by_lang, groups["lang"].eqNullSafe(by_lang["_lang"]))
    own = sketches.select(*[F.col(c).alias(f"o_{c}") for c in sketches.columns])
    same = full["lang"].eqNullSafe(own["o_lang"]) & full["source"].eqNullSafe(own["o_source"]) & (full["_rate"] == own["o_rate"]) & (full["_bucket"] == own["o_bucket"])
    weight = F.coalesce("o_n", F.lit(0)).cast("double") * F.col("all_lang") + PRIOR * F.col("of_lang").cast("double")
    blended = full.join(own, same, "left").select("lang", "source", F.col("_rate").alias("rate"), F.col("_bucket").alias("bucket"), weight.alias("w"))
    group = Window.partitionBy("lang", "source", "rate")
    at = blended.withColumns({"total": F.sum("w").over(group), "upto": F.sum("w").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))})
    quantile = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("total"), value_of(F.col("bucket"))))
    q = at.groupBy("lang", "source", "rate").agg(quantile(50).alias("q50"), quantile(85).alias("q85"))
    of = lambda rate, c: F.max(F.when(F.col("rate") == rate, F.col(c)))
    fence = lambda k, size, units: (
        (1 + SPREADS) * of(k, "q85") - SPREADS * of(k, "q50") + F.floor(1000 * units / F.greatest(of(size, "q50"), F.lit(1))).cast("long")
    )
    return q.groupBy("lang", "source").agg(*[fence(k, size, units).alias(k) for k, (size, units) in UNITS.items()])


def judge(measured: DataFrame) -> DataFrame:
    """Adds ``_kept`` to rows with ``_m``, lang and source: joined filtering by the fences of each group. Groups in which
    no document passes the base rules have no fences and need none."""
    own = fences(sketch(measured)).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*UNITS).alias("_f"))
    joined = measured.join(own, measured["lang"].eqNullSafe(own["_lang"]) & measured["source"].eqNullSafe(own["_source"]), "left")
    inside = F.lit(True)
    for k, v in rates("_m").items():
        inside = inside & F.coalesce(v <= F.col(f"_f.{k}"), F.lit(True))
    return joined.withColumn("_kept", ~base_failed("_m") & inside).drop("_lang", "_source", "_f")


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, ``base_failed`` and ``kept``. Text is read once."""
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.put(with_measures(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judge(measured).select("doc_id", "_m.*", base_failed("_m").alias("base_failed"), F.col("_kept").alias("kept"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns. Other columns travel in one struct, so that their
    names can't clash with those used here."""
    rest = [c for c in docs.columns if c not in ("text", "lang", "source")]
    packed = docs.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"))
    # written once: the sketches and the filter would else measure every text again
    measured = Scratch(docs.sparkSession, "quality").put(with_measures(packed))
    kept = judge(measured).where("_kept")
    return kept.select(*[F.col(c if c in ("text", "lang", "source") else f"_rest.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, row_number() OVER () AS rid, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
gg AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM gg, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (
  SELECT d.doc_id, lang, source, d.rid, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN rep ON d.rid = rep.rid),
r AS (
  SELECT rid, lang, source, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed, unnest([
    {'rate': 'symbol_rate', 'v': 1000 * n_symbols // greatest(word_chars, 1)}, {'rate': 'upper_rate', 'v': 1000 * n_upper // greatest(word_chars, 1)},
    {'rate': 'dup_line_rate', 'v': 1000 * n_dup_lines // greatest(n_lines, 1)}, {'rate': 'repeat_rate', 'v': 1000 * n_repeat_words // greatest(n_words, 1)},
    {'rate': 'n_words', 'v': n_words}, {'rate': 'n_lines', 'v': n_lines}, {'rate': 'word_chars', 'v': word_chars}], recursive := true) FROM m),
b AS (SELECT *, CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 5)) << (length(bin(v)) - 5) END AS low FROM r),
own AS (SELECT lang, source, rate, low, count(*) AS n FROM b WHERE NOT failed GROUP BY lang, source, rate, low),
l AS (SELECT *, sum(n) OVER (PARTITION BY lang, rate) AS every FROM (SELECT lang, rate, low, sum(n) AS n FROM own GROUP BY lang, rate, low)),
grp AS (SELECT DISTINCT lang, source FROM own),
w AS (SELECT grp.lang, grp.source, l.rate, l.low, CAST(coalesce(own.n, 0) AS DOUBLE) * l.every + 8 * CAST(l.n AS DOUBLE) AS w
      FROM grp JOIN l ON grp.lang IS NOT DISTINCT FROM l.lang
      LEFT JOIN own ON own.lang IS NOT DISTINCT FROM grp.lang AND own.source IS NOT DISTINCT FROM grp.source AND own.rate = l.rate AND own.low = l.low),
c AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, rate ORDER BY low) AS upto, sum(w) OVER (PARTITION BY lang, source, rate) AS total FROM w),
q AS (SELECT lang, source, rate, min(low) FILTER (WHERE 100 * upto >= 50 * total) AS q50, min(low) FILTER (WHERE 100 * upto >= 85 * total) AS q85
      FROM c GROUP BY lang, source, rate),
f AS (SELECT q.lang, q.source, q.rate, 4 * q.q85 - 3 * q.q50 + 1000 * u.units // greatest(z.q50, 1) AS fence
      FROM q JOIN (VALUES ('symbol_rate', 'word_chars', 20), ('upper_rate', 'word_chars', 40), ('dup_line_rate', 'n_lines', 2), ('repeat_rate', 'n_words', 60)) u(rate, size, units)
        ON q.rate = u.rate JOIN q z ON z.rate = u.size AND z.lang IS NOT DISTINCT FROM q.lang AND z.source IS NOT DISTINCT FROM q.source),
out_ AS (
  SELECT DISTINCT b.rid FROM b JOIN f ON b.rate = f.rate AND b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
  WHERE b.v > f.fence)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND out_.rid IS NULL AS kept
FROM m LEFT JOIN out_ ON m.rid = out_.rid
"""

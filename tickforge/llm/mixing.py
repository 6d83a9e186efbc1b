"""Mixing sources to target weights.

Native DataFrame code only. The tokens (words) of a source, in the order of its documents, are packed into blocks of
``BLOCK_WORDS``; the last one may be short. The mix is cut into output shards of ``SHARD_BLOCKS`` slots. For each
shard, multinomial source counts are drawn with the target shares; the slots of a source, counted over the shards,
run through its blocks once per epoch in the order of a pseudorandom permutation, and blocks join slots by index.
A settlement shard takes what the draws leave open, and each source's last slot is cut short, so every source's words
come to its rounded target. A target never passes ``MOST_EPOCHS`` times its source, hence no block is used more often.

Prefix sums use two levels: documents are dealt over about ``2 * sqrt(n)`` buckets a source, so neither the order
within a bucket nor the order of buckets ever gathers a source in one task.

Defined cases: null text has size 0 and takes nothing; null source is a source, last in order; repeated rows are
documents of their own; an empty table gives an empty mix; extra columns pass through ``mix`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.llm.common import WORD, Scratch, table, words

BLOCK_WORDS = 512
SHARD_BLOCKS = 1024
MOST_EPOCHS = 3
CYCLE = 3  # weights 1, 2, 3, repeating
SEED = 20_011
CELLS = 4096  # of the guide table for the draws
UNIT = 1 << 40  # draws are whole numbers below this


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: sid, weight, source_size, target. Input: source, size.

    Weighed shares of the whole, held at MOST_EPOCHS times a source's size. The excess is reshared by weight: with
    sources in order of cap/weight, the common level is the largest of (total - caps before) / weights from here on.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))  # as many rows as sources, not documents
    ranked = per.withColumn("sid", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumns({"weight": (F.col("sid") % CYCLE + 1).cast("long"), "cap": MOST_EPOCHS * F.col("source_size")})
    before = every.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("sid")).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    return (
        ranked.withColumn("level", level)
        .withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight")))
        .select("source", "sid", "weight", "source_size", "target")
    )


def _hash_mod(modulus: Column, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), modulus)


def _rounds(x: Column, side: Column, *key: Column, back: bool = False) -> Column:
    """A four-round Feistel permutation of 0..side**2-1, or its inverse."""
    left, right = F.floor(x / side).cast("long"), F.pmod(x, side)
    sign = -1 if back else 1
    for turn in (3, 2, 1, 0) if back else (0, 1, 2, 3):
        if turn % 2 == 0:
            left = F.pmod(left + sign * _hash_mod(side, *key, F.lit(turn), right), side)
        else:
            right = F.pmod(right + sign * _hash_mod(side, *key, F.lit(turn), left), side)
    return left * side + right


def permuted(x: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """Where the permutation of 0..n-1 that belongs to the key takes x: rounds over a square of at least n, walked on
    while outside. A walk is no longer than the square has places outside, so the bound below is never a cut."""
    side = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    once = _rounds(x, side, *key, back=back)
    walk = F.aggregate(
        F.sequence(F.lit(1).cast("long"), side * side - n + 1),
        once,
        lambda at, _: F.when(at < n, at).otherwise(_rounds(at, side, *key, back=back)),
    )
    return F.when(once < n, once).otherwise(walk)


def with_quota(sources: DataFrame) -> DataFrame:
    """Adds what each source gives: n_blocks, full epochs, rest words, n_slots, and the size of its short last block."""
    size, want = F.col("source_size"), F.least(F.round("target").cast("long"), MOST_EPOCHS * F.col("source_size"))
    out = sources.withColumn("n_blocks", F.ceil(size / BLOCK_WORDS).cast("long"))
    out = out.withColumns(
        {
            "epochs": F.when(size > 0, F.floor(want / F.greatest(size, F.lit(1)))).otherwise(0).cast("long"),
            "missing": F.col("n_blocks") * BLOCK_WORDS - size,
        }
    )
    out = out.withColumn("rest", want - F.col("epochs") * size)
    n = F.greatest(F.col("n_blocks"), F.lit(1))
    out = out.withColumn("short_at", permuted(n - 1, n, F.lit(SEED), F.col("sid"), F.col("epochs"), back=True))
    plain = F.ceil(F.col("rest") / BLOCK_WORDS).cast("long")
    with_short = F.ceil((F.col("rest") + F.col("missing")) / BLOCK_WORDS).cast("long")
    out = out.withColumn("rest_slots", F.when(F.col("short_at") < plain, with_short).otherwise(plain))
    return out.withColumn("n_slots", F.col("epochs") * F.col("n_blocks") + F.col("rest_slots"))


def draw_counts(spark: SparkSession, quota: DataFrame, n_shards: int) -> DataFrame:
    """shard, sid, n: multinomial counts of SHARD_BLOCKS draws per shard by target share.

    A draw is a hash below UNIT; a guide table maps its cell to the brackets of the sources that overlap it, so the
    lookup is an equi-join on the cell.
    """
    every = Window.partitionBy(F.lit(0))
    share = F.floor(UNIT * F.sum("n_slots").over(every.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n_slots").over(every))
    ends = quota.where("n_slots > 0").select("sid", share.cast("long").alias("hi"))
    brackets = ends.withColumn("lo", F.coalesce(F.lag("hi").over(every.orderBy("sid")), F.lit(0).cast("long")))
    width = UNIT // CELLS
    guide = brackets.where("hi > lo").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    )
    draws = spark.range(n_shards * SHARD_BLOCKS).select(
        F.floor(F.col("id") / SHARD_BLOCKS).alias("shard"), _hash_mod(F.lit(UNIT), F.lit(SEED), F.lit("draw"), F.col("id")).alias("u")
    )
    hit = draws.withColumn("cell", F.floor(F.col("u") / width)).join(guide, "cell").where("u >= lo AND u < hi")
    return hit.groupBy("shard", "sid").agg(F.count("*").alias("n"))


def slots(spark: SparkSession, quota: DataFrame) -> DataFrame:
    """shard, sid, slot, epoch, block, limit: every slot of the mix with the block it takes and the words taken of it."""
    total = quota.agg(F.sum("n_slots")).first()[0] or 0
    n_shards = math.ceil(total / SHARD_BLOCKS)
    counts = draw_counts(spark, quota, n_shards)
    along = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = counts.withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0)).cast("long"))
    drawn = drawn.join(quota.select("sid", "n_slots"), "sid").withColumn("n", F.least(F.col("n"), F.col("n_slots") - F.col("start")))
    settled = quota.select("sid", "n_slots").join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").select(
        "sid", F.coalesce("got", F.lit(0)).cast("long").alias("start"), (F.col("n_slots") - F.coalesce("got", F.lit(0))).alias("n")
    )
    runs = drawn.select("shard", "sid", "start", "n").unionByName(settled.select(F.lit(n_shards).cast("long").alias("shard"), "sid", "start", "n"))
    each = runs.where("n > 0").withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
    each = each.select("shard", "sid", "slot").join(quota.drop("source"), "sid")
    each = each.withColumns({"epoch": F.floor(F.col("slot") / F.col("n_blocks")), "i": F.pmod("slot", F.col("n_blocks"))})
    each = each.withColumn("block", permuted(F.col("i"), F.col("n_blocks"), F.lit(SEED), F.col("sid"), F.col("epoch")))
    before = F.col("i") * BLOCK_WORDS - F.when(F.col("short_at") < F.col("i"), F.col("missing")).otherwise(0)
    limit = F.when(F.col("epoch") < F.col("epochs"), F.lit(BLOCK_WORDS)).otherwise(F.least(F.lit(BLOCK_WORDS), F.col("rest") - before))
    return each.select("shard", "sid", "slot", "epoch", "block", limit.cast("long").alias("limit"))


def with_starts(sized: DataFrame, n_docs: int) -> DataFrame:
    """Adds ``start``, the number of words of the source in the documents before. Input: sid, size, tie, doc_id."""
    buckets = max(1, math.ceil(2 * math.sqrt(n_docs)))
    dealt = sized.withColumn("bucket", _hash_mod(F.lit(buckets), F.lit(SEED), F.col("doc_id"), F.col("tie")))
    sums = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("all"))
    order = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    opened = sums.select("sid", "bucket", F.coalesce(F.sum("all").over(order), F.lit(0)).cast("long").alias("opened"))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("long"))
        .join(opened, ["sid", "bucket"])
        .withColumn("start", F.col("opened") + F.col("within"))
        .drop("bucket", "within", "opened")
    )


def pieces(started: DataFrame) -> DataFrame:
    """Explodes documents into the parts of them that lie in each block: block, lo, hi (words of the source), and their text
    where the input has it."""
    last = F.col("start") + F.col("size") - 1
    lo = lambda b: F.greatest(F.col("start"), b * BLOCK_WORDS)
    hi = lambda b: F.least(F.col("start") + F.col("size"), (b + 1) * BLOCK_WORDS)
    cols = {"block": lambda b: b, "lo": lo, "hi": hi}
    rest = [F.col(c) for c in started.columns if c != "text"]
    if "text" in started.columns:
        # a piece takes only its own words along
        started = started.withColumn("_words", words(F.col("text")))
        cols["text"] = lambda b: F.array_join(F.slice("_words", (lo(b) - F.col("start") + 1).cast("int"), (hi(b) - lo(b)).cast("int")), " ")
    blocks = F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor(last / BLOCK_WORDS))
    each = F.transform(blocks, lambda b: F.struct(*[f(b).alias(c) for c, f in cols.items()]))
    return started.where("size > 0").select(*rest, F.explode(each).alias("_p")).select(*rest, "_p.*")


class Mix:
    """The plan of a mix over documents: ``sources``, ``started`` documents and ``uses`` of their pieces."""

    def __init__(self, docs: DataFrame, carry: list[str] = ()):
        spark = docs.sparkSession
        scratch = Scratch(spark, "mix")
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        sized = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("tie"), *carry)
        if not carry:
            sized = scratch.put(sized)
        self.sources = scratch.put(with_quota(source_targets(sized)))
        given = sized.join(
            self.sources.select(F.col("source").alias("_source"), "sid", "source_size", "target"), sized["source"].eqNullSafe(F.col("_source"))
        ).drop("_source")
        self.started = with_starts(given, docs.count() if carry else sized.count())
        if not carry:
            self.started = scratch.put(self.started)
        used = slots(spark, self.sources)
        self.uses = (
            pieces(self.started)
            .join(used, ["sid", "block"])
            .withColumn("cut", F.least(F.col("hi"), F.col("block") * BLOCK_WORDS + F.col("limit")))
            .where("cut > lo")
        )


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: size, source_size, target and the words of it that the mix takes, repeats counted."""
    plan = Mix(docs.select("doc_id", "text", "source"))
    taken = plan.uses.groupBy("sid", "start").agg(F.sum(F.col("cut") - F.col("lo")).alias("taken"))
    rows = plan.started.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
    return rows.join(taken.withColumnRenamed("start", "at"), ["sid", "at"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: a row per piece of a document in a slot, with all columns of the input, ``text`` and
    ``n_chars`` (where there is one) being the piece's. Words of a piece stand one blank apart."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    wrapped = docs.withColumn("_rest", F.struct(*[F.col(c) for c in rest]) if rest else F.lit(None).cast("int"))
    plan = Mix(wrapped, carry=["text", "_rest"])
    piece = F.when(F.col("cut") < F.col("hi"), F.expr("substring_index(text, ' ', cast(cut - lo AS int))")).otherwise(F.col("text"))
    out = plan.uses.withColumn("text", piece).select("doc_id", "text", "source", *[F.col(f"_rest.{c}").alias(c) for c in rest])
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))

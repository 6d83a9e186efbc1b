"""A trie of conversation prefixes by prefix-doubling naming.

Turns get dense names (equal turns, equal names). Blocks of 2**k turns are named in rounds: a block is the pair of its
halves' names, and distinct pairs are numbered. A prefix of d turns is the prefix without d's lowest binary digit
followed by one block, so prefixes are named in rounds too, from the largest blocks down: distinct pairs (prefix, block)
are numbered, and these numbers are the nodes. A conversation of n turns costs about 4 n rows over some 2 log2(n)
rounds, however deep the trie; a round is one join by position and one by the pair of names.

Sums over subtrees need no walk: every node is owned by its smallest member, whose turns pass through all ancestors. So
what a subtree holds is the sum, over the members of its top, of what each owns from that depth on: suffix sums along
each conversation, in blocks of ``BLOCK`` turns, added by node.

Positions within a conversation are differences of numbers over a distributed sort, and joins read written tables, so
that Spark can split a hot conversation, turn or node. Ids that end in one node are joined to strings of at most
``CHUNK`` ids over range partitions before a task reads them in order, as the digest of a list wants it.

Defined cases: rows without a conversation id belong to none and are left out; null roles and texts are empty; null
turns come first; turns of one number are ordered by the digest of role and text, so repeated rows are turns each; an
empty table gives an empty result; columns other than the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.llm.common import Scratch, table
from tickforge.llm.numbering import numbered

# Conversations come in families of five, whose later ones borrow up to eight first turns.
FAMILY, BORROWED = 5, 9
#: Turns of one stretch of the suffix sums.
BLOCK = 1024
#: Ids of one string before it is digested.
CHUNK = 4096


def positions(convs: DataFrame, scratch: Scratch) -> DataFrame:
    """c, pos, key, bytes: the turns of each conversation in order, from 0; key: the digest of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = convs.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes")
    )
    ordered = turns.withColumn("tie", F.monotonically_increasing_id()).orderBy("c", F.asc_nulls_first("turn"), "key", "tie")
    turns, _ = numbered(ordered.drop("turn", "tie"), "g", scratch)
    first = scratch.put(turns.groupBy("c").agg(F.min("g").alias("first")))
    return scratch.put(turns.join(first, "c").select("c", (F.col("g") - F.col("first")).alias("pos"), "key", "bytes"))


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(c, d, key, bytes) of every rebuilt turn, d from 1, and (c, n) of every conversation."""
    own = scratch.put(turns.groupBy("c").agg(F.count("*").alias("own")))
    base = own.select(F.col("c").alias("base"), F.col("own").alias("base_own"))
    families = own.select(
        "c", "own", (F.col("c") - F.col("c") % FAMILY).alias("base"), F.pmod(F.crc32(F.col("c").cast("string")), F.lit(BORROWED)).alias("h")
    )
    same = F.col("c") == F.col("base")
    families = families.join(base, "base", "left").select(
        "c", "base", F.when(same, 0).otherwise(F.col("h")).cast("long").alias("h"),
        F.when(same, 0).otherwise(F.least("h", F.coalesce("base_own", F.lit(0)))).cast("long").alias("lent"), "own",
    )
    families = scratch.put(families)
    heads = (
        families.where("lent > 0").select("c", "base", "lent")
        .join(turns.where(F.col("pos") < BORROWED - 1).select(F.col("c").alias("base"), "pos", "key", "bytes"), "base")
        .where("pos < lent").select("c", (F.col("pos") + 1).alias("d"), "key", "bytes")
    )
    tails = turns.join(families.select("c", "h", "lent"), "c").where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("lent") + 1).alias("d"), "key", "bytes")
    lengths = families.select("c", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return scratch.put(heads.unionByName(tails)), scratch.put(lengths)


def named(pairs: DataFrame, scratch: Scratch, start: int = 0) -> tuple[DataFrame, int]:
    """Pairs (l, r) with the dense name of each distinct one, from ``start``, and the next free name."""
    names, n = numbered(pairs.select("l", "r").distinct(), "name", scratch, start)
    return pairs.join(names, ["l", "r"]).drop("l", "r"), start + n


def nodes_of(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """c, d, node: the node of every prefix of every conversation; the root is node 0."""
    keys, _ = numbered(turns.select("key").distinct(), "name", scratch)
    blocks = scratch.put(turns.join(keys, "key").select("c", (F.col("d") - 1).alias("j"), "name"))
    longest = lengths.agg(F.max("n")).first()[0] or 0
    levels = [blocks]
    while 2 ** len(levels) <= longest:
        even = F.col("j") % 2 == 0
        halves = blocks.groupBy("c", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(even, F.col("name"))).alias("l"), F.max(F.when(~even, F.col("name"))).alias("r"))
        blocks = scratch.put(named(scratch.put(halves.where("r IS NOT NULL")), scratch)[0].select("c", "j", "name"))
        levels.append(blocks)
    found, free = lengths.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("node")), 1
    for k in reversed(range(len(levels))):
        # the block that ends a prefix whose lowest digit is 2**k stands at an even place among blocks of its size
        last = levels[k].where("j % 2 = 0").select("c", (F.col("j") * 2**k).alias("d"), F.col("name").alias("r"))
        at = last.where("d = 0").select("c", "d", F.lit(0).cast("long").alias("l"), "r")
        if k < len(levels) - 1:
            at = at.unionByName(last.where("d > 0").join(found.where("d > 0"), ["c", "d"]).select("c", "d", F.col("node").alias("l"), "r"))
        at, free = named(scratch.put(at), scratch, free)
        found = found.unionByName(scratch.put(at.select("c", (F.col("d") + 2**k).alias("d"), F.col("name").alias("node"))))
    return found


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, c in order -> node, first, ids: stretches of at most CHUNK ids of a node, joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node, c = np.asarray(batch.column("node")), np.asarray(batch.column("c"))
        cuts = sorted({0, *range(0, len(node), CHUNK), *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist()})
        ids = [",".join(map(str, c[lo:hi].tolist())) for lo, hi in zip(cuts, [*cuts[1:], len(c)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(node[cuts]), pa.array(c[cuts]), pa.array(ids)], ["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, first, ids in order -> node, ends_sha256; a node may go on in the next batch."""
    of, digest = None, None
    for batch in batches:
        done: list[tuple[int, str]] = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == of:
                digest.update(b",")
            else:
                if digest:
                    done.append((of, digest.hexdigest()))
                of, digest = node, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield _pairs(done)
    if digest:
        yield _pairs([(of, digest.hexdigest())])


def _pairs(done: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done])], ["node", "ends_sha256"])


def end_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """node, ends_sha256 of the nodes in which conversations end; ends: c, node."""
    joined = ends.repartitionByRange("node", "c").sortWithinPartitions("node", "c").mapInArrow(_strings, "node long, first long, ids string")
    return scratch.put(joined).repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node long, ends_sha256 string")


def _below(paths: DataFrame, owned: DataFrame, scratch: Scratch) -> DataFrame:
    """node, n_leaves, saved_tokens: sums over subtrees. owned: c, d, leaf, saved of each node at its smallest member."""
    at = scratch.put(paths.join(owned, ["c", "d"], "left").withColumn("block", F.shiftright("d", BLOCK.bit_length() - 1)))
    sums = ("leaf", "saved")
    later = Window.partitionBy("c").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = at.groupBy("c", "block").agg(*[F.sum(s).alias(s) for s in sums]).select("c", "block", *[F.sum(s).over(later).alias(f"{s}_later") for s in sums])
    within = Window.partitionBy("c", "block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    tails = at.select("c", "block", "node", *[F.sum(s).over(within).alias(s) for s in sums]).join(scratch.put(blocks), ["c", "block"])
    whole = lambda s: F.sum(F.coalesce(s, F.lit(0)) + F.coalesce(f"{s}_later", F.lit(0)))
    return tails.groupBy("node").agg(whole("leaf").alias("n_leaves"), whole("saved").alias("saved_tokens"))


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(convs.sparkSession, "trie")
    turns, lengths = rebuilt(positions(convs, scratch), scratch)
    paths = scratch.put(nodes_of(turns, lengths, scratch))
    ends = scratch.put(lengths.join(paths, (lengths["c"] == paths["c"]) & (lengths["n"] == paths["d"])).select(lengths["c"], "node"))
    groups = paths.groupBy("node").agg(F.min("c").alias("c"), F.max("d").alias("d"), F.count("*").alias("n_convs"))
    groups = scratch.put(groups.join(ends.groupBy("node").agg(F.count("*").alias("n_ends")), "node", "left"))
    above = paths.select("c", (F.col("d") + 1).alias("d"), F.col("node").alias("parent"))
    size = turns.select("c", "d", "bytes")
    groups = scratch.put(
        groups.join(above, ["c", "d"], "left").join(size, ["c", "d"], "left").select(
            "node", "c", "d", "parent", "n_convs", (F.coalesce("n_ends", F.lit(0)) == F.col("n_convs")).cast("long").alias("leaf"),
            ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved"),
        )
    )
    sums = scratch.put(_below(paths, groups.select("c", "d", "leaf", "saved"), scratch))
    children = scratch.put(groups.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    tops = groups.select(F.col("node").alias("parent"), F.col("c").alias("parent_conv_id"))
    return (
        groups.join(tops, "parent", "left").join(sums, "node").join(children, "node", "left").join(scratch.put(end_digests(ends, scratch)), "node", "left")
        .select(
            F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
             FROM (SELECT unnest(range(256)) AS i)),
t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, count(*) AS own, c - c % 5 AS base, hex(encode(c::VARCHAR)) AS x FROM t GROUP BY c),
q AS (SELECT c, own, base, CASE WHEN c = base THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
        lambda a, b: xor(a >> 8, crc.t[xor(a, b) % 256 + 1])), 4294967295) % 9 END AS h FROM o, crc),
f AS (SELECT q.*, CASE WHEN q.c = q.base THEN 0 ELSE least(q.h, coalesce(b.own, 0)) END AS lent FROM q LEFT JOIN o b ON b.c = q.base),
z AS (SELECT f.c, t.pos + 1 AS d, r, x FROM f JOIN t ON t.c = f.base AND t.pos < f.lent
      UNION ALL SELECT f.c, pos - h + lent + 1, r, x FROM f JOIN t ON t.c = f.c AND pos >= h),
p AS (SELECT c, d, strlen(x) AS bytes, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY d) AS p FROM z
      UNION ALL SELECT c, 0, 0, [] FROM f),
n AS (SELECT p, d, min(c) AS rep, count(*) AS n_convs FROM p GROUP BY p, d),
a AS (SELECT p.c, p.d, p.bytes, n.rep, n.n_convs, p.d = max(p.d) OVER (PARTITION BY p.c) AS is_end FROM p JOIN n ON n.p = p.p AND n.d = p.d),
g AS (SELECT rep, d, any_value(n_convs) AS n_convs, any_value(bytes) AS bytes, count(*) FILTER (is_end) = any_value(n_convs) AS leaf,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256 FROM a GROUP BY rep, d),
u AS (SELECT a.rep, a.d, count(*) FILTER (g.leaf) AS n_leaves, sum((g.n_convs - 1) * g.bytes) AS saved, count(*) FILTER (g.d = a.d + 1) AS n_children
      FROM g JOIN a ON a.c = g.rep AND a.d <= g.d GROUP BY a.rep, a.d)
SELECT g.rep AS conv_id, g.d AS depth, b.rep AS parent_conv_id, g.n_convs, u.n_children, u.n_leaves, u.saved::BIGINT AS saved_tokens, g.ends_sha256
FROM g JOIN u ON u.rep = g.rep AND u.d = g.d LEFT JOIN a b ON b.c = g.rep AND b.d = g.d - 1
"""

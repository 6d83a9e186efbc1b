"""Suffix-array dedup: every byte covered by a 200-byte string that starts twice or more in the corpus is removed.

The suffixes that can matter are found first: places share a winnowed anchor (64 bytes), and each has a context, all
that 200-byte strings with that anchor can reach. Places with equal contexts are one node of the tree with a string as
long as the context, so all of them are marked. Where an anchor has several contexts, one place per context is taken
and the contexts of an anchor come to one task, where they are joined to a text with an enhanced suffix array of the
suffixes whose strings differ in the letter before them. A stack scan over its common prefixes walks the tree of
common-prefix intervals of at least 200; an interval whose left extensions differ is a maximal repeat, and all its
occurrences are marked, not only neighbours. ``repeat_groups`` returns the maximal repeats with all occurrences.

An anchor with more than ``GROUP`` contexts is divided by longer anchors: the strings that hold it fall into two
halves by where it lies in them, those of a half share 132 bytes, then 166 in quarters and so on, each with contexts
that shrink to the strings themselves. So a task never holds more than ``GROUP`` contexts of an anchor, and where
division ends the strings of an anchor are all equal.

Defined cases: null texts are empty; repeated rows count as different places, so they remove each other; a string
that recurs within a document counts, overlaps too; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import KeyFilter, Scratch, table
from tickforge.llm.repeats import Anchors, Out, Seeds, covered, each_text, keys_pass, marked, texts
from tickforge.llm.rolling import BYTE_VALUES, Prefix, mix64

LENGTH, GRAM = 200, 64
GROUP = 1024
#: Bytes of contexts in one suffix array.
CHUNK = 1 << 19
#: Crowded contexts joined to one text.
JOINED = 1024


class SuffixArray:
    """Some suffixes of contexts joined to one text, each up to the end of its context, in order, with the common
    prefix of each with the one before."""

    def __init__(self, data: np.ndarray, prefix: Prefix, at: np.ndarray, ends: np.ndarray):
        """at: starts of the suffixes; ends: for each of them the end of its context."""
        raw = data.tobytes()
        keys = [raw[i:e] for i, e in zip(at.tolist(), ends.tolist(), strict=True)]
        order = np.array(sorted(range(len(at)), key=keys.__getitem__), dtype=np.int64)
        self.at, ends = at[order], ends[order]
        # common prefixes by bisection on window hashes
        a, b = self.at[:-1], self.at[1:]
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(ends[:-1] - a, ends[1:] - b)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = prefix.windows(a, a + middle) == prefix.windows(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        self.common = np.concatenate([[0], low])


def intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the nodes of the common-prefix interval tree with length at least ``least``, by a stack
    scan; children before parents."""
    high = np.flatnonzero(common >= least)
    if not len(high):
        return
    breaks = np.flatnonzero(np.diff(high) > 1)
    for lo, hi in zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(high) - 1]]), strict=True):
        first, last = int(high[lo]) - 1, int(high[hi])
        stack = [(0, first)]
        for i, c in enumerate([*common[first + 1 : last + 1].tolist(), 0], first + 1):
            left = i - 1
            while stack[-1][0] > c:
                length, left = stack.pop()
                yield length, left, i - 1
            if stack[-1][0] < c:
                stack.append((c, left))


def coverage(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, where: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered runs of contexts joined to one text. Children come before their parents,
    so a position keeps the longest repeat that starts there and shorter ones add nothing."""
    longest = np.zeros(len(data), dtype=np.int64)
    for at, length in maximal_repeats(data, starts, sizes, where, least):
        longest[at[longest[at] == 0]] = length
    at = np.flatnonzero(longest)
    step = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + longest[at], -1)
    inside = np.cumsum(step)[:-1] > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[starts] = inside[starts]  # runs end with their context
    closes = np.zeros(len(data) + 1, dtype=bool)
    closes[1:] = inside
    closes[:-1] &= ~inside | opens
    return np.flatnonzero(opens), np.flatnonzero(closes)


def maximal_repeats(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, where: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int]]:
    """(positions, length) of the left-diverse intervals among contexts joined to one text. where: for each position
    the identity of its place in the corpus; an interval needs two places.

    A repeat of at least ``least`` lies within a class of equal strings of that length, and it is left-diverse only if
    the class is. So the suffixes of classes that have one place, or one letter before them, aren't sorted at all.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    ends = (starts + sizes)[row]
    whole = np.flatnonzero(np.arange(len(data)) + least <= ends)
    if not len(whole):
        return
    before = np.full(len(data), -1, dtype=np.int64)  # the start of a context is like no letter
    before[1:] = data[:-1]
    before[starts[sizes > 0]] = -1
    prefix = Prefix(BYTE_VALUES[data])
    hashes = prefix.windows(whole, whole + least)
    order = np.argsort(hashes, kind="stable")
    at, h = whole[order], hashes[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    bounds, of = np.flatnonzero(first), np.cumsum(first) - 1
    several = np.minimum.reduceat(where[at], bounds) != np.maximum.reduceat(where[at], bounds)
    lowest = np.minimum.reduceat(before[at], bounds)
    diverse = (lowest < 0) | (lowest != np.maximum.reduceat(before[at], bounds))
    at = at[(several & diverse)[of]]
    if not len(at):
        return
    array = SuffixArray(data, prefix, at, ends[at])
    at = array.at
    # changes among neighbours, so that an interval's diversity is a difference of two sums
    left = np.concatenate([[0], np.cumsum(before[at[1:]] != before[at[:-1]])])
    places = np.concatenate([[0], np.cumsum(where[at[1:]] != where[at[:-1]])])
    for length, lo, hi in intervals(array.common, least):
        if places[hi] > places[lo] and (left[hi] > left[lo] or before[at[lo]] < 0):
            yield at[lo : hi + 1], length


def levels(length: int, gram: int) -> int:
    """Divisions after which each part is one string."""
    return int(length - gram).bit_length()


def divided(found: Anchors, level: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, part, key, lo, hi) of the 2**level parts of each anchor that hold a string. A part has the strings in
    which the anchor starts between ``near`` and ``far`` bytes from the start; its key is of the bytes that they share."""
    n = 1 << level
    edges = np.arange(n + 1) * (length - gram + 1) // n
    row, part = np.repeat(np.arange(len(found.at)), n), np.tile(np.arange(n), len(found.at))
    near, far, at = edges[part], edges[part + 1] - 1, found.at[row]
    lo, hi = np.maximum(found.lo[row], at - far), np.minimum(found.hi[row], at - near + length)
    some = (hi - lo >= length) & (far >= near)
    row, part, near, far, at, lo, hi = (x[some] for x in (row, part, near, far, at, lo, hi))
    if not level:
        return row, part, found.key[row], lo, hi
    shared = found.prefix.windows(at - near, at - far + length)
    return row, part, mix64(shared + mix64((np.uint64(level) << np.uint64(32)) + part.astype(np.uint64))), lo, hi


def _spot(rk: np.ndarray, at: np.ndarray, level: int, part: np.ndarray) -> np.ndarray:
    """A key of a part of a place."""
    place = mix64(mix64(rk.view(np.uint64)) + at.astype(np.uint64))
    return mix64(place + (np.uint64(level + 1) << np.uint64(40)) + part.astype(np.uint64)).view(np.int64)


@dataclass
class Parts:
    """Parts of the anchors of one text, or of several contexts joined to one: bounds in the text, and for each part
    the row key, the anchor's place and the bounds in the document."""

    found: Anchors
    row: np.ndarray
    part: np.ndarray
    key: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    rk: np.ndarray
    at: np.ndarray
    shift: np.ndarray
    level: int

    def take(self, keep: np.ndarray) -> Parts:
        return Parts(self.found, *(x[keep] for x in (self.row, self.part, self.key, self.lo, self.hi, self.rk, self.at, self.shift)), self.level)

    def spots(self, level: int | None = None) -> np.ndarray:
        """The keys of the parts, or of those on a level above that they came from."""
        level = self.level if level is None else level
        return _spot(self.rk, self.at, level, self.part >> (self.level - level))

    def contexts(self) -> np.ndarray:
        """Hashes of the bytes of the parts and of where the anchor lies in them."""
        at = self.found.at[self.row]
        shape = (at - self.lo + (1 << 18)).astype(np.uint64) * np.uint64(1 << 20) + (self.hi - at + (1 << 18)).astype(np.uint64)
        return mix64(self.found.prefix.windows(self.lo, self.hi) + mix64(shape + (self.part.astype(np.uint64) << np.uint64(44)))).view(np.int64)


def _of_texts(seeds: Seeds, shared: KeyFilter) -> Callable:
    """Batches of texts -> (data, parts) of their shared anchors, undivided."""

    def each(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Parts]]:
        for _, rk, data in each_text([batch]):
            found = seeds.anchors(data)
            if found is None:
                continue
            found = found.take(shared.has(found.key))
            if len(found.at):
                row, part, key, lo, hi = divided(found, 0, seeds.length, seeds.gram)
                yield data, Parts(found, row, part, key, lo, hi, np.full(len(row), rk), found.at[row], np.zeros(len(row), np.int64), 0)

    return each


def _of_stock(seeds: Seeds, level: int, crowded: list[KeyFilter]) -> Callable:
    """Batches of crowded contexts -> (data, parts) that come from parts crowded on each level above."""

    def some(batch: pa.RecordBatch) -> tuple[np.ndarray, Parts]:
        rk, at, low, key = (np.asarray(batch.column(c)).astype(np.int64) for c in ("rk", "at", "lo", "key"))
        parts = batch.column("data").to_pylist()
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        found = Anchors(Prefix(BYTE_VALUES[data]), starts + at - low, key.view(np.uint64), starts, starts + sizes)
        row, part, key, lo, hi = divided(found, level, seeds.length, seeds.gram)
        out = Parts(found, row, part, key, lo, hi, rk[row], at[row], (low - starts)[row], level)
        for above, wanted in enumerate(crowded[:level]):
            out = out.take(wanted.has(out.spots(above)))
        return data, out

    def each(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Parts]]:
        for start in range(0, batch.num_rows, JOINED):
            yield some(batch.slice(start, JOINED))

    return each


CONTEXTS = "key long, context long, rk long, spot long, lo int, hi int"


def _contexts(source: Callable) -> Callable:
    """-> key, context, rk, spot, lo, hi: the parts with their contexts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(**dict.fromkeys(("key", "context", "rk", "spot"), pa.int64()), lo=pa.int32(), hi=pa.int32())
        for batch in batches:
            for _, p in source(batch) if batch.num_rows else ():
                if out.add(len(p.row), p.key.view(np.int64), p.contexts(), p.rk, p.spots(), p.lo + p.shift, p.hi + p.shift):
                    yield out.batch()
        if out.rows:
            yield out.batch()

    return each


CONTEXT_BYTES = "key long, context long, rk long, at int, lo int, data binary"


def _context_bytes(source: Callable, chosen: KeyFilter) -> Callable:
    """-> key, context, rk, at, lo, data: the contexts of the chosen parts."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["key", "context", "rk", "at", "lo", "data"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for data, p in source(batch) if batch.num_rows else ():
                p = p.take(chosen.has(p.spots()))
                if not len(p.row):
                    continue
                raw, (lo, hi) = data.tobytes(), (p.lo.tolist(), p.hi.tolist())
                cols = [p.key.view(np.int64), p.contexts(), p.rk, p.at, p.lo + p.shift]
                rows += zip(*(c.tolist() for c in cols), (raw[a:b] for a, b in zip(lo, hi, strict=True)), strict=True)
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return each


class Chunk:
    """Some contexts joined to one text."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, int, bytes]] = []
        self.size = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[4])

    def read(self) -> None:
        self.key, self.context, self.rk, base = (np.array(c, dtype=np.int64) for c in list(zip(*self.rows, strict=True))[:4])
        self.sizes = np.array([len(r[4]) for r in self.rows], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(r[4] for r in self.rows), dtype=np.uint8)
        self.row = np.repeat(np.arange(len(self.rows)), self.sizes)
        self.offset = np.arange(len(self.data)) - np.repeat(self.starts, self.sizes)
        self.at = base[self.row] + self.offset
        self.where = mix64(mix64(self.rk.view(np.uint64))[self.row] + self.at.astype(np.uint64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Whole anchors of contexts sorted by key, several at a time."""
    chunk = Chunk()
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("key", "context", "rk", "lo", "data")], strict=True):
            if chunk.size > CHUNK and row[0] != chunk.rows[-1][0]:
                chunk.read()
                yield chunk
                chunk = Chunk()
            chunk.add(row)
    if chunk.size:
        chunk.read()
        yield chunk


def _suffixes(least: int) -> Callable:
    """Contexts sorted by key -> rk, lo, hi: what the maximal repeats of each anchor's contexts cover."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(rk=pa.int64(), lo=pa.int32(), hi=pa.int32())
        for c in _chunks(batches):
            lo, hi = coverage(c.data, c.starts, c.sizes, c.where, least)
            first = c.at[lo]
            if out.add(len(lo), c.rk[c.row[lo]], first, first + hi - lo):
                yield out.batch()
        if out.rows:
            yield out.batch()

    return each


def _groups(least: int) -> Callable:
    """Contexts sorted by key -> string, length, key, context, offset: the maximal repeats and where in which contexts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(string=pa.int64(), length=pa.int64(), key=pa.int64(), context=pa.int64(), offset=pa.int32())
        for c in _chunks(batches):
            prefix = Prefix(BYTE_VALUES[c.data])
            for at, length in maximal_repeats(c.data, c.starts, c.sizes, c.where, least):
                string = prefix.windows(at, at + length).view(np.int64)
                if out.add(len(at), string, length, c.key[c.row[at]], c.context[c.row[at]], c.offset[at]):
                    yield out.batch()
        if out.rows:
            yield out.batch()

    return each


def _searched(docs: DataFrame, scratch: Scratch, length: int, gram: int, keep: bool = False) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """(marks, contexts, bytes): for each level the ranges rk, lo, hi of places with equal contexts, and the places
    themselves if they are kept; and the bytes of contexts that meet others of their anchor."""
    seeds, read = Seeds(False, length, gram), texts(docs)
    held = read.mapInArrow(keys_pass(seeds), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    shared = KeyFilter(scratch.put(held.where("n > 1").select("key")))
    marks, kept, crowded, data = [], [], [], None
    stock, source = read, _of_texts(seeds, shared)
    for level in range(levels(length, gram) + 1):
        found = scratch.put(stock.mapInArrow(_contexts(source), CONTEXTS))
        contexts = scratch.put(found.groupBy("key", "context").agg(F.count("*").alias("n"), F.min("spot").alias("spot")))
        marks.append(scratch.put(found.join(contexts.where("n > 1").select("key", "context"), ["key", "context"], "left_semi").select("rk", "lo", "hi")))
        kept += [found] if keep else []
        # written, so that AQE can split the join on a crowded anchor
        several = scratch.put(contexts.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
        opened = scratch.put(contexts.join(several, "key").select("m", F.col("spot").alias("key")))
        scratch.clear(contexts, several, *([] if keep else [found]))
        few = stock.mapInArrow(_context_bytes(source, KeyFilter(opened.where(F.col("m") <= GROUP), room=6)), CONTEXT_BYTES)
        data = few if data is None else data.unionByName(few)
        crowd = KeyFilter(opened.where(F.col("m") > GROUP), room=8)
        if not crowd.n:
            break
        if not level:  # one place for each crowded context; further levels read these alone
            stock = scratch.put(stock.mapInArrow(_context_bytes(source, crowd), CONTEXT_BYTES))
        crowded.append(crowd)
        source = _of_stock(seeds, level + 1, list(crowded))
    return marks, kept, data.repartition("key").sortWithinPartitions("key", "context", "rk", "lo")


def repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """rk, lo, hi: ranges of bytes covered by strings that start twice or more."""
    marks, _, data = _searched(docs, scratch, length, gram)
    out = scratch.put(data.mapInArrow(_suffixes(length), "rk long, lo int, hi int"))
    for more in marks:
        out = out.unionByName(more)
    return out


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per occurrence of a maximal repeat of at least ``length`` bytes among differing contexts: string (a hash
    of it), length, rk (the row's key), at. A repeat longer than a context shows as the repeats of its contexts."""
    scratch = Scratch(docs.sparkSession, "groups")
    _, kept, data = _searched(docs, scratch, length, gram, keep=True)
    places = kept[0]
    for more in kept[1:]:
        places = places.unionByName(more)
    groups = scratch.put(data.mapInArrow(_groups(length), "string long, length long, key long, context long, offset int"))
    return groups.join(places, ["key", "context"]).select("string", "length", "rk", (F.col("lo") + F.col("offset")).alias("at")).distinct()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
            gone = covered(spans.as_py(), len(data))
            n_spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
            rows.append((len(data), int(np.count_nonzero(gone)), n_spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        if rows:
            n, removed, spans_, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(digest)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def suffix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    scratch = Scratch(docs.sparkSession, "suffix")
    return marked(docs, repeats(docs, scratch), scratch).mapInArrow(_reports, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_report(table(spark, sf_dir, "documents"))

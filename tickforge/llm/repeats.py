"""The seeds that substring operators share: winnowed anchors of symbol sequences and the contexts around them.

A sequence is the bytes or the words of one text. Of its grams of ``gram`` symbols, winnowing keeps at least one in
every window of ``length`` symbols, chosen by content alone, so equal windows hold equal anchors at equal places.
The context of an anchor is all that windows holding it can reach: up to ``length - gram`` symbols before it and
``length`` from it on. Equal contexts settle all their windows at once.

Work goes in passes over the texts. Each reads them where they are, and what it emits passes a fixed-size bitmap of
the keys that the pass before found shared, so text itself isn't shuffled before the final pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import KeyFilter, row_key
from tickforge.llm.rolling import BYTE_VALUES, Prefix, mix64, winnow, word_bounds, word_hashes

#: Bytes of text whose arrays are held at a time.
SLICE_BYTES = 4_000_000


@dataclass(frozen=True)
class Seeds:
    """What counts as a symbol, and the lengths."""

    by_word: bool
    length: int
    gram: int

    def symbols(self, data: np.ndarray) -> np.ndarray:
        return word_hashes(data, *word_bounds(data)) if self.by_word else BYTE_VALUES[data]

    def anchors(self, data: np.ndarray) -> Anchors | None:
        symbols = self.symbols(data)
        if len(symbols) < self.length:
            return None
        prefix = Prefix(symbols)
        grams = prefix.grams(self.gram)
        at = winnow(grams, self.length - self.gram + 1)
        lo = np.maximum(0, at - (self.length - self.gram))
        hi = np.minimum(len(symbols), at + self.length)
        return Anchors(prefix, at, mix64(grams[at]), lo, hi)


@dataclass
class Anchors:
    """The anchors of one text: positions, hashes and the bounds of their contexts."""

    prefix: Prefix
    at: np.ndarray
    key: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def take(self, keep: np.ndarray) -> Anchors:
        return Anchors(self.prefix, self.at[keep], self.key[keep], self.lo[keep], self.hi[keep])

    def contexts(self) -> np.ndarray:
        """Hashes of the contexts and of where the anchor lies in them."""
        shape = (self.at - self.lo).astype(np.uint64) * np.uint64(1 << 20) + (self.hi - self.at).astype(np.uint64)
        return mix64(self.prefix.windows(self.lo, self.hi) + mix64(shape))


def place(rk: int, at: np.ndarray) -> np.ndarray:
    """A key of a place in a row."""
    return mix64(mix64(np.array([rk], dtype=np.int64).view(np.uint64)) + at.astype(np.uint64)).view(np.int64)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, rk, text: what the passes read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), F.coalesce("text", F.lit("")).alias("text"))


def each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, np.ndarray]]:
    for batch in batches:
        for doc_id, rk, text in zip(batch.column("doc_id"), batch.column("rk"), batch.column("text"), strict=True):
            yield doc_id.as_py(), rk.as_py(), np.frombuffer(text.as_buffer(), dtype=np.uint8)


class Out:
    """Collects columns of arrays and yields batches of a bounded size."""

    def __init__(self, **kinds: pa.DataType):
        self.kinds, self.parts, self.rows = kinds, [], 0

    def add(self, n: int, *cols) -> bool:
        """Adds n rows; a column is an array or one value for all. True once there is a batch's worth."""
        if n:
            self.parts.append([c if isinstance(c, np.ndarray) else np.full(n, c, dtype=np.int64) for c in cols])
            self.rows += n
        return self.rows >= 50_000

    def batch(self) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.rows = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, self.kinds.values(), strict=True)], list(self.kinds))


def keys_pass(seeds: Seeds) -> Callable:
    """-> key, n: the distinct anchors of each text, and 2 for those that it holds several times. With words, where
    only other documents count: key, doc_id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(key=pa.int64(), **{"doc_id" if seeds.by_word else "n": pa.int64()})
        for doc_id, _, data in each_text(batches):
            found = seeds.anchors(data)
            if found is None or (seeds.by_word and doc_id is None):
                continue
            key, n = np.unique(found.key, return_counts=True)
            if out.add(len(key), key.view(np.int64), doc_id if seeds.by_word else np.minimum(n, 2)):
                yield out.batch()
        if out.rows:
            yield out.batch()

    return each


def contexts_pass(seeds: Seeds, shared: KeyFilter) -> Callable:
    """-> key, context, doc_id, rk, at, lo, hi: the anchors that may be shared, with their contexts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "context", "doc_id", "rk")
        out = Out(**dict.fromkeys(names, pa.int64()), at=pa.int32(), lo=pa.int32(), hi=pa.int32())
        for doc_id, rk, data in each_text(batches):
            found = seeds.anchors(data)
            if found is None or (seeds.by_word and doc_id is None):
                continue
            found = found.take(shared.has(found.key))
            context = found.contexts().view(np.int64)
            if out.add(len(found.at), found.key.view(np.int64), context, doc_id if doc_id is not None else 0, rk, found.at, found.lo, found.hi):
                yield out.batch()
        if out.rows:
            yield out.batch()

    return each


def windows_pass(seeds: Seeds, shared: KeyFilter, places: KeyFilter) -> Callable:
    """-> key, doc_id, rk, lo: all windows that hold an anchor at one of the places."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(**dict.fromkeys(("key", "doc_id", "rk"), pa.int64()), lo=pa.int32())
        for doc_id, rk, data in each_text(batches):
            found = seeds.anchors(data)
            if found is None or (seeds.by_word and doc_id is None):
                continue
            found = found.take(shared.has(found.key))
            found = found.take(places.has(place(rk, found.at)))
            # every alignment of the window that holds the anchor, once each
            inside = np.zeros(len(found.prefix.sums) + 1, dtype=np.int32)
            np.add.at(inside, found.lo, 1)
            np.add.at(inside, found.hi - seeds.length + 1, -1)
            lo = np.flatnonzero(np.cumsum(inside) > 0)
            key = found.prefix.windows(lo, lo + seeds.length).view(np.int64)
            if out.add(len(lo), key, doc_id if doc_id is not None else 0, rk, lo):
                yield out.batch()
        if out.rows:
            yield out.batch()

    return each


WINDOWS = "key long, doc_id long, rk long, lo int"
CONTEXTS = "key long, context long, doc_id long, rk long, at int, lo int, hi int"
KEYS = "key long, doc_id long"



def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rk = np.asarray(batch.column("rk"))
        keys = mix64(mix64(rk.view(np.uint64)) + np.asarray(batch.column("at")).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def places_of(rows: DataFrame) -> DataFrame:
    """key: of the places (rk, at) of rows."""
    return rows.select("rk", "at").mapInArrow(_places, "key long")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges sorted by rk and lo -> the maximal runs they cover."""
    out = Out(rk=pa.int64(), lo=pa.int32(), hi=pa.int32())
    last: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rk, lo, hi = (np.asarray(batch.column(c)).astype(np.int64) for c in ("rk", "lo", "hi"))
        if last is not None:
            rk, lo, hi = (np.concatenate([[x], y]) for x, y in zip(last, (rk, lo, hi), strict=True))
        # ends reached so far within a row: rows are lifted apart by their number
        row = np.cumsum(np.concatenate([[0], rk[1:] != rk[:-1]])) << 32
        reach = np.maximum.accumulate(row + hi)
        opens = np.concatenate([[True], row[1:] + lo[1:] > reach[:-1]])
        at = np.flatnonzero(opens)
        ends = reach[np.append(at[1:], len(rk)) - 1] - row[at]
        if len(at) > 1 and out.add(len(at) - 1, rk[at[:-1]], lo[at[:-1]], ends[:-1]):
            yield out.batch()
        last = (int(rk[at[-1]]), int(lo[at[-1]]), int(ends[-1]))
    if last is not None:
        out.add(1, *(np.array([x]) for x in last))
    if out.rows:
        yield out.batch()


def marked(docs: DataFrame, marks: DataFrame, scratch: Scratch) -> DataFrame:
    """The texts with ``spans``, the disjoint ranges (lo, hi) that marks (rk, lo, hi) cover; null where there are none.
    Only texts that may have some are shuffled."""
    runs = marks.repartition("rk").sortWithinPartitions("rk", "lo").mapInArrow(_merged, "rk long, lo int, hi int")
    # a row has no more runs than its symbols
    per = scratch.put(runs.groupBy("rk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    some = KeyFilter(per, "rk", room=8)

    def split(wanted: bool) -> Callable:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(some.has(np.asarray(batch.column("rk"))) == wanted))

        return each

    schema, read = "doc_id long, rk long, text string", texts(docs)
    whole = read.mapInArrow(split(False), schema).select("doc_id", "text", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans"))
    return whole.unionByName(read.mapInArrow(split(True), schema).join(per, "rk", "left").select("doc_id", "text", "spans"))


def covered(spans: list[dict] | None, n: int) -> np.ndarray:
    """Which of n symbols the ranges cover."""
    gone = np.zeros(n, dtype=bool)
    for s in spans or []:
        gone[s["lo"] : s["hi"]] = True
    return gone

"""MinHash near-dedup by an LSH forest.

Every distinct shingle set (documents with equal sets are one class) gets ``N_VALUES`` min-hash values. A tree of the
forest is an order of the classes: by its own first ``DEPTH`` values, then by the values after them, a byte each. The
orders are range-partitioned by their content and sorted, so a crowded stretch spreads over tasks. Classes that share a
tree's first values share a region of it.

Round one takes the ``NEIGHBOURS`` classes on either side in every sorted order, which are those with the longest
common prefixes, estimates their similarity from sketches (8 bits a value), and picks one partner for each class: the
least class among those estimated similar, so that groups gather around few centers, or else the best. Picks are
confirmed on the full sets; components follow.

Round two looks for links that round one left between components. A region with several components is met whole: its
largest component (major) is met by the others (minor) in cells of bounded size; a pair that shares several such regions
is met in the first of them. Where that would be too much work, the region is crowded and deepened: its classes get
``SUBTREES`` new orders of ``DEPTH`` further values each, up to ``LEVELS`` times; what is left after that is met in cells
all the same. Which values an order takes follows from the key of the region it divides, so the crowded regions of a pair
miss it independently, and no pair is left to a region that is crowded. Regions that touch a boundary between the sorted
tasks of round one always take part, as their neighbours were not all compared. Pairs whose sketches and sizes allow a
link are compared by 24-bit prints of their shingles, which never undercount what sets have in common, and those that
pass are confirmed on the full sets, in each cell no more of them than it has components. Cells in which a print has
deceived are met again with the full sets themselves, again only by pairs that join components.

A pair of similarity 0.8 shares a region with probability p = 0.8**DEPTH. It is met there unless the region is crowded
and no order below is shared, which has probability m = (1 - p)**SUBTREES, about 0.015, and with further levels
m' = (1 - p (1 - m))**SUBTREES, about 0.016. If all its regions are crowded it is missed by all trees with
(1 - p (1 - m'))**TREES, below 5e-6, otherwise with less; or it is screened off by its sketch with 7.2e-5. Together that
is below 8e-5.

Defined cases: null texts and texts without words have no set and stand alone; ids that are null stand alone unless
their texts link; repeated rows link with each other; an empty table gives an empty result; ``keep_first`` leaves
extra columns untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.llm.common import KeyFilter, Scratch, row_key, table
from tickforge.llm.components import components
from tickforge.llm.rolling import mix64, word_bounds, word_hashes

TREES, DEPTH, N_VALUES = 24, 4, 256
#: Classes on either side in a sorted order that a class is compared with.
NEIGHBOURS = 8
#: A region whose minor classes times all its classes exceed WORK is deepened by SUBTREES orders, at most LEVELS times.
WORK, SUBTREES, LEVELS = 1 << 24, 8, 2
#: Minor classes of one block of a cell; a share of the major ones is twice that.
BLOCK = 512
#: Picks of one center that are confirmed in one task.
ARMS = 512
#: Sketches estimate similarity with a deviation of 0.025 at 0.8; down to four of them below, pairs are still confirmed.
LEAST_ESTIMATE = 0.70
PER_CENT = 80

#: A sketch is a byte of each value, then three bytes of each tree's key.
WIDTH = N_VALUES + 3 * TREES

_A = (mix64(np.arange(1, N_VALUES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = mix64(np.arange(1001, N_VALUES + 1001, dtype=np.uint64)).astype(np.uint32)
_TREE = mix64(np.arange(5001, 5001 + TREES, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_set(text: str | bytes, words: int = 2) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    data = _LOWER[np.frombuffer(text.encode() if isinstance(text, str) else text, dtype=np.uint8)]
    lo, hi = word_bounds(data)
    if not len(lo):
        return np.zeros(0, dtype=np.uint64)
    each = word_hashes(data, lo, hi)
    n = min(words, len(each))
    out = np.full(len(each) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + each[i : len(each) - n + 1 + i])
    return np.unique(out)


def class_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(N_VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(best, (x[i : i + 1024, None] * _A + _B).min(axis=0), out=best)
    return best


def tree_keys(values: np.ndarray) -> np.ndarray:
    own = values[: TREES * DEPTH].astype(np.uint64).reshape(TREES, DEPTH)
    key = _TREE.copy()
    for i in range(DEPTH):
        key = mix64(key + own[:, i])
    return key.view(np.int64)


FEATURES = "doc_id long, rk long, cls long, n_shingles long, keys array<long>, sketch binary"


def _features(words: int) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, keys, sketches = [], [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else b"", words)
                n.append(len(found))
                if len(found):
                    values = signature(found)
                    cls.append(class_of(found))
                    keys.append(tree_keys(values))
                    sketches.append(values.astype(np.uint8).tobytes() + keys[-1].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :3].tobytes())
                else:
                    cls.append(None)
                    keys.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), batch.column("rk"), pa.array(cls, pa.int64()), pa.array(n, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "rk", "cls", "n_shingles", "keys", "sketch"],
            )

    return each


FOREST = "key long, tree int, cls long, n long, ahead binary"


def _forest(shared: KeyFilter) -> Callable:
    """cls, n, keys, sketch -> key, tree, cls, n, ahead: a row for each tree in which the class shares a region. ahead:
    the values that follow in the tree's order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column("keys").flatten()).reshape(-1, TREES)
            row, tree = np.nonzero(shared.has(np.ascontiguousarray(keys).ravel()).reshape(keys.shape))
            sketch = _matrix(batch.column("sketch"))
            for lo in range(0, len(row), 20_000):
                r, t = row[lo : lo + 20_000], tree[lo : lo + 20_000]
                ahead = sketch[r[:, None], (DEPTH * (t[:, None] + 1) + np.arange(N_VALUES)) % N_VALUES]
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[r, t]), pa.array(t.astype(np.int32)), batch.column("cls").take(take), batch.column("n").take(take), _binary(ahead)],
                    ["key", "tree", "cls", "n", "ahead"],
                )

    return each


def _matrix(column: pa.Array | pa.ChunkedArray, width: int = WIDTH) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix of bytes."""
    return pa.array(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel().tolist(), pa.binary())


def _corrected(same: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal bytes of two sketches."""
    return (same / N_VALUES - 1 / 256) / (1 - 1 / 256)


def _sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PER_CENT * np.maximum(a, b)


NEAR = "key long, a long, center long, best long, estimate double"


def _neighbours(reach: int) -> Callable:
    """Rows of the forest in order -> key, a, center, best, estimate: what each class finds among its ``reach`` neighbours
    on either side in an order. Classes that find nothing give no row; the first and the last region of a task give a row
    without a class each, as their neighbours elsewhere are not seen."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(batch.column(c)) for c in ("key", "cls", "n")] + [_matrix(batch.column("ahead"), N_VALUES)]
            if before is None:
                yield _edge(now[0][0])
            last = now[0][-1]
            key, cls, n, ahead = now if before is None else [np.concatenate(x) for x in zip(before, now, strict=True)]
            before = [x[-reach:] for x in (key, cls, n, ahead)]
            center, best, most = cls.copy(), np.zeros(len(cls), np.int64), np.full(len(cls), -1.0)
            for d in range(1, min(reach, len(cls) - 1) + 1):
                at = np.flatnonzero((key[d:] == key[:-d]) & _sizes_allow(n[d:], n[:-d]))
                e = _corrected(np.count_nonzero(ahead[at] == ahead[at + d], axis=1))
                at, e = at[e >= LEAST_ESTIMATE], e[e >= LEAST_ESTIMATE]
                for x, y in ((at, at + d), (at + d, at)):
                    alike = e >= PER_CENT / 100
                    center[x[alike]] = np.minimum(center[x[alike]], cls[y[alike]])
                    closer = e > most[x]
                    most[x[closer]], best[x[closer]] = e[closer], cls[y[closer]]
            some = np.flatnonzero(most > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (key, cls, center, best, most)], ["key", "a", "center", "best", "estimate"])
        if last is not None:
            yield _edge(last)

    return each


def _edge(key: int) -> pa.RecordBatch:
    none = pa.array([None], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), none, none, none, pa.array([None], pa.float64())], ["key", "a", "center", "best", "estimate"])


def _deepened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of crowded regions under SUBTREES keys of DEPTH values each, which the region's key picks."""
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            key, sketch = np.asarray(batch.column("key")).view(np.uint64), _matrix(batch.column("sketch"))
            rows = np.arange(len(key))
            for sub in range(SUBTREES):
                own = mix64(key + np.uint64(sub + 1))
                picks = own.copy()
                for _ in range(DEPTH):
                    picks = mix64(picks)
                    own = mix64(own + sketch[rows, (picks % np.uint64(N_VALUES)).astype(np.int64)].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *(batch.column(c) for c in ("cls", "n", "root"))], ["key", "cls", "n", "root"])


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(key, its stretches) of batches sorted by key; a stretch is part of a batch."""

    def stretches() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            if batch.num_rows:
                k = np.asarray(batch.column(key))
                bounds = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
                for lo, hi in zip(bounds, bounds[1:], strict=False):
                    yield int(k[lo]), batch.slice(lo, hi - lo)

    for k, group in itertools.groupby(stretches(), key=lambda x: x[0]):
        yield k, (part for _, part in group)


INVOLVED = "cell long, cls long, root long, held boolean"


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells, the classes held first -> cell, cls, root, held: the classes whose sketch and size allow a link with a
    class of another component across the cell."""

    def arrays(part: pa.RecordBatch) -> list[np.ndarray]:
        return [np.asarray(part.column(c)) for c in ("cls", "root", "n", "tag", "crowded")] + [_matrix(part.column("sketch"))]

    def rows(cell: int, cls: np.ndarray, root: np.ndarray, held: bool) -> pa.RecordBatch:
        cols = [np.full(len(cls), cell), cls, root, np.full(len(cls), held)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["cell", "cls", "root", "held"])

    for cell, parts in grouped(batches, "cell"):
        own: list[list[np.ndarray]] = []
        held, involved, inner = None, None, False
        for part in parts:
            flag = np.asarray(part.column("held"))
            if flag.any():
                own.append(arrays(part.filter(pa.array(flag))))
                inner = bool(part.column("inner")[0].as_py())
            if flag.all():
                continue
            if held is None:
                held = [np.concatenate(x) for x in zip(*own, strict=True)] if own else []
                involved = np.zeros(len(held[0]) if held else 0, dtype=bool)
            if not held:
                continue
            others = arrays(part.filter(pa.array(~flag)))
            met = _allowed(held, others)
            involved |= met.any(axis=1)
            some = met.any(axis=0)
            if some.any():
                yield rows(cell, others[0][some], others[1][some], False)
        if held is None and own:
            held = [np.concatenate(x) for x in zip(*own, strict=True)]
            involved = np.zeros(len(held[0]), dtype=bool)
        if held:
            if inner:
                involved |= _allowed(held, held).any(axis=1)
            yield rows(cell, held[0][involved], held[1][involved], True)


def _allowed(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which of two lists of classes (cls, root, n, tag, crowded, sketch) may link: other components, fitting sizes and
    sketches. A pair is left to the first tree in which both share a region that isn't crowded (a bit for each tree); tag
    says which tree's region this is, -1 for one of a deeper level, where no pair is left to another."""
    out = np.empty((len(a[0]), len(b[0])), dtype=bool)
    tag = int(b[3][0]) if len(b[3]) else -1
    for i in range(0, len(a[0]), 64):
        own = slice(i, i + 64)
        some = (a[1][own, None] != b[1][None, :]) & _sizes_allow(a[2][own, None], b[2][None, :])
        x, y = np.nonzero(some)
        close = np.empty(len(x), dtype=bool)
        for j in range(0, len(x), 20_000):
            p, q = a[5][own][x[j : j + 20_000]], b[5][y[j : j + 20_000]]
            near = _corrected(np.count_nonzero(p[:, :N_VALUES] == q[:, :N_VALUES], axis=1)) >= LEAST_ESTIMATE
            if tag >= 0:
                at = np.flatnonzero(near)
                same = (p[at, N_VALUES:] == q[at, N_VALUES:]).reshape(-1, TREES, 3).all(axis=2)
                same &= (a[4][own][x[j : j + 20_000][at], None] >> np.arange(TREES)) & 1 == 0
                # the tag is that of the region's key itself
                first = same.argmax(axis=1)
                keys = p[at, N_VALUES:].reshape(-1, TREES, 3)[np.arange(len(at)), first].astype(np.int64)
                near[at] = keys[:, 0] + (keys[:, 1] << 8) + (keys[:, 2] << 16) == tag
            close[j : j + 20_000] = near
        some[x[~close], y[~close]] = False
        out[own] = some
    return out


def prints(found: np.ndarray) -> bytes:
    """24 bits of each shingle hash of a set, in order."""
    low = np.sort((found >> np.uint64(40)).astype("<u4"))
    return low.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unprinted(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), dtype=np.uint8)
    out[:, :3] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def whole(found: np.ndarray) -> bytes:
    return found.astype("<u8").tobytes()


def _printed(words: int, form: Callable) -> Callable:
    """cls, print of texts; form: prints, or whole for the full sets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [form(shingle_set(t.as_buffer().to_pybytes(), words)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(made, pa.binary())], ["cls", "print"])

    return each


class Held:
    """The prints of the classes held in a cell (or full sets: exact), by value, and the components joined so far."""

    def __init__(self, rows: list[tuple[int, int, bytes]], exact: bool):
        self.ids, self.roots = [r[0] for r in rows], [r[1] for r in rows]
        self.values_of = (lambda data: np.frombuffer(data, dtype="<u8")) if exact else _unprinted
        values = [self.values_of(r[2]) for r in rows]
        self.sizes = np.array([len(v) for v in values], dtype=np.int64)
        flat = np.concatenate(values) if values else np.zeros(0, dtype=np.uint32)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(rows)), self.sizes)[order]
        self.values, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.concatenate([self.starts[1:], [len(flat)]]).astype(np.int64)
        self.parent: dict[int, int] = {}

    def find(self, root: int) -> int:
        while (up := self.parent.get(root, root)) != root:
            root = up
        return root

    def passing(self, cls: int, root: int, data: bytes) -> Iterator[tuple[int, int]]:
        """Pairs of a class with those held whose prints allow a link (full sets: that link), each of which joins two
        components not yet joined here."""
        own = self.values_of(data)
        if not len(self.values) or not len(own):
            return
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        at = at[self.values[at] == own]
        counts = self.ends[at] - self.starts[at]
        flat = np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        both = np.bincount(self.owner[flat], minlength=len(self.ids))
        both = np.minimum(both, np.minimum(self.sizes, len(own)))
        for j in np.flatnonzero(100 * both >= PER_CENT * (len(own) + self.sizes - both)).tolist():
            a, b = self.find(root), self.find(self.roots[j])
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                yield cls, self.ids[j]


def _passing(exact: bool) -> Callable:
    """Cells with prints, the classes held first -> cell, a, b: pairs to confirm; with full sets (exact), links."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, parts in grouped(batches, "cell"):
            rows, held, found = [], None, []
            for part in parts:
                cols = [part.column(c).to_pylist() for c in ("cls", "root", "print", "held")]
                for cls, root, data, flag in zip(*cols, strict=True):
                    if flag:
                        rows.append((cls, root, data))
                        continue
                    held = held or Held(rows, exact)
                    found += held.passing(cls, root, data)
            held = held or Held(rows, exact)
            for row in rows:
                found += held.passing(*row)
            if found:
                ends = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), cell)), *ends], ["cell", "a", "b"])

    return each


def _texts_of(wanted: KeyFilter, words: int) -> Callable:
    """cls, text of the rows that stand for a class."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rows = [], []
            for i, text in enumerate(batch.column("text")):
                if text.is_valid:
                    found = shingle_set(text.as_buffer().to_pybytes(), words)
                    if len(found):
                        rows.append(i)
                        cls.append(class_of(found))
            cls = np.array(cls, dtype=np.int64)
            rows = np.array(rows, dtype=np.int64)
            ids = np.asarray(batch.column("doc_id").cast(pa.int64()).fill_null(-1))[rows]
            keep = wanted.has(member(cls, ids)) if len(cls) else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(cls[keep]), batch.column("text").take(pa.array(rows[keep]))], ["cls", "text"])

    return each


def member(cls: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A key for the row of a class with an id (null: -1)."""
    return mix64(mix64(cls.view(np.uint64)) + ids.view(np.uint64)).view(np.int64)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = member(np.asarray(batch.column("cls")), np.asarray(batch.column("doc_id").fill_null(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])


def _confirmed(words: int) -> Callable:
    """Texts sorted by center and salt, that of the center first -> a, b: the links of the center."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, known = None, None
        for batch in batches:
            found = []
            cols = [batch.column(c).to_pylist() for c in ("b", "salt", "cls", "head")]
            for b, salt, cls, head, text in zip(*cols, batch.column("text"), strict=True):
                own = shingle_set(text.as_buffer().to_pybytes(), words)
                if head:
                    of, known = (b, salt), own
                    continue
                assert of == (b, salt)
                both = len(np.intersect1d(known, own, assume_unique=True))
                if 100 * both >= PER_CENT * (len(known) + len(own) - both):
                    found.append((cls, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return each


def confirm(picks: DataFrame, stock: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """The links among picks (a, b) by full sets. Texts go to their centers b, each once a pick; a center with many
    picks is shared out over salts."""
    stars = picks.groupBy("b").agg(F.count("*").alias("n")).select("b", F.ceil(F.col("n") / ARMS).cast("long").alias("salts"))
    arms = picks.join(stars, "b").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), F.col("a").alias("cls"), F.lit(False).alias("head"))
    heads = stars.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("b").alias("cls"), F.lit(True).alias("head"))
    met = scratch.put(arms.unionByName(heads)).join(stock, "cls").repartition("b", "salt").sortWithinPartitions("b", "salt", F.desc("head"))
    return scratch.put(met.mapInArrow(_confirmed(words), "a long, b long"))


def _cells(rooted: DataFrame, stats: DataFrame) -> DataFrame:
    """The rows of regions dealt to cells: cell, held, inner, tag, cls, root, n. A cell holds a block of minor classes
    and meets a share of the major ones, or a later block of minor ones; pairs of one block meet in its first cell."""
    at = rooted.join(stats, "key")
    block = F.pmod(F.xxhash64(F.lit("block"), "cls"), F.col("blocks"))
    share = F.pmod(F.xxhash64(F.lit("share"), "cls"), F.col("shares"))
    count = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    place = lambda b, j, held: F.struct(b.alias("b"), j.alias("j"), F.lit(held).alias("held"))
    minor = F.concat(
        # held against all shares and all later blocks, and passing through the cells of earlier blocks
        F.transform(count(zero, F.col("shares") - 1), lambda j: place(block, j, True)),
        F.transform(count(block + 1, F.col("blocks") - 1), lambda j: place(block, F.col("shares") + j, True)),
        F.transform(count(zero, block - one), lambda b: place(b, F.col("shares") + block, False)),
    )
    major = F.transform(count(zero, F.col("blocks") - 1), lambda b: place(b, share, False))
    dealt = at.withColumn("p", F.explode(F.when(F.col("root") == F.col("major"), major).otherwise(minor)))
    return dealt.select(F.xxhash64("key", "p.b", "p.j").alias("cell"), "p.held", (F.col("p.held") & (F.col("p.j") == 0)).alias("inner"), "tag", "cls", "root", "n")


def across(forest: DataFrame, sketches: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """cell, cls, root, held: the classes that may link with another component, in the cells where they meet.
    forest: key, tree, cls, n; sketches: cls, sketch."""
    rooted = scratch.put(forest.join(roots, forest["cls"] == roots["id"], "left").select("key", "tree", "cls", "n", F.coalesce("root", "cls").alias("root")))
    found, known = None, sketches.withColumn("crowded", F.lit(0))
    for level in range(LEVELS + 1):
        per = scratch.put(rooted.groupBy("key", "root").agg(F.count("*").alias("n")))
        stats = per.groupBy("key").agg(F.sum("n").alias("all"), F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("most"), F.count("*").alias("roots"))
        rest = F.col("all") - F.col("most")
        stats = scratch.put(
            stats.where("roots > 1").select(
                "key", "major", (F.col("all") * rest).alias("work"), F.ceil(rest / BLOCK).cast("long").alias("blocks"),
                F.ceil(F.col("most") / (2 * BLOCK)).cast("long").alias("shares"), F.lit(-1).cast("long").alias("tag") if level else F.pmod("key", F.lit(1 << 24)).alias("tag"),
            )
        )
        crowded = stats.where(F.col("work") > WORK).select("key")
        ready = stats if level == LEVELS else stats.where(F.col("work") <= WORK)
        last = level == LEVELS or crowded.isEmpty()
        within = rooted if last else scratch.put(rooted.join(crowded, "key", "left_semi"))
        if level == 0 and not last:
            bits = within.groupBy("cls").agg(F.expr("bit_or(shiftleft(1, tree))").alias("crowded"))
            known = scratch.put(sketches.join(bits, "cls", "left").select("cls", "sketch", F.coalesce("crowded", F.lit(0)).alias("crowded")))
        met = _cells(rooted, ready.drop("work")).join(known, "cls").repartition("cell").sortWithinPartitions("cell", F.desc("held"))
        met = scratch.put(met.mapInArrow(_screened, INVOLVED))
        found = met if found is None else found.unionByName(met)
        if last:
            return found
        rooted = scratch.put(within.select("key", "cls", "n", "root").join(sketches, "cls").mapInArrow(_deepened, "key long, cls long, n long, root long"))
    return found


def grown(texts: DataFrame, scratch: Scratch, words: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, sketches, forest): doc_id, rk, cls, n_shingles of every document; cls, doc_id and cls, sketch of every
    class; and the rows of its trees."""
    made = scratch.put(texts.mapInArrow(_features(words), FEATURES))
    rows = scratch.put(made.select("doc_id", "rk", "cls", "n_shingles"))
    classes = scratch.put(
        made.where("cls IS NOT NULL").groupBy("cls")
        .agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch"))
    )
    scratch.clear(made)
    shared = scratch.put(classes.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").select("key"))
    forest = scratch.put(classes.select("cls", "n", "keys", "sketch").mapInArrow(_forest(KeyFilter(shared)), FOREST))
    nodes, sketches = scratch.put(classes.select("cls", "doc_id")), scratch.put(classes.select("cls", "sketch"))
    scratch.clear(classes, shared)
    return rows, nodes, sketches, forest


def link_classes(docs: DataFrame, scratch: Scratch, words: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): doc_id, rk, cls, n_shingles of every document, and cls, root of every class that has a link."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), "text")
    rows, nodes, sketches, forest = grown(texts, scratch, words)
    # the sorted orders: equal stretches are dealt by what follows in the order, so no region is bound to one task
    ordered = forest.repartitionByRange("key", F.substring("ahead", 1, 8), "cls").sortWithinPartitions("key", "ahead", "cls")
    near = scratch.put(ordered.mapInArrow(_neighbours(NEIGHBOURS), NEAR))
    best = near.where("a IS NOT NULL").groupBy("a").agg(F.min("center").alias("center"), F.max_by("best", F.struct("estimate", "best")).alias("best"))
    picked = best.select("a", F.when(F.col("center") < F.col("a"), F.col("center")).otherwise(F.col("best")).alias("b"))
    picks = scratch.put(picked.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max(F.struct("a", "b")).alias("p")).select("p.a", "p.b"))

    def texts_of(classes: DataFrame) -> DataFrame:
        wanted = KeyFilter(scratch.put(nodes.join(classes.distinct(), "cls").mapInArrow(_members, "key long")))
        return scratch.put(texts.mapInArrow(_texts_of(wanted, words), "cls long, text string"))

    stock = texts_of(picks.select(F.explode(F.array("a", "b")).alias("cls")))
    links = confirm(picks, stock, words, scratch)
    scratch.clear(stock)
    # where all pairs of a region were neighbours in one task and none looked alike, there is no link
    live = near.select("key").unionByName(forest.groupBy("key").count().where(F.col("count") > NEIGHBOURS + 1).select("key")).distinct()
    thin = scratch.put(forest.select("key", "tree", "cls", "n").join(live, "key", "left_semi"))
    scratch.clear(forest, near)
    involved = across(thin, sketches, components(links, scratch), scratch)
    scratch.clear(sketches)
    stock = texts_of(involved.select("cls"))

    def joining(involved: DataFrame, form: Callable) -> DataFrame:
        printed = scratch.put(stock.mapInArrow(_printed(words, form), "cls long, print binary"))
        met = involved.join(printed, "cls").repartition("cell").sortWithinPartitions("cell", F.desc("held"))
        pairs = met.mapInArrow(_passing(form is whole), "cell long, a long, b long")
        return scratch.put(pairs.withColumns({"a": F.greatest("a", "b"), "b": F.least("a", "b")}))

    pairs = joining(involved, prints)
    held = confirm(pairs.select("a", "b").distinct(), stock, words, scratch)
    links = links.unionByName(held)
    # cells in which a print deceived may have left out pairs for its sake
    wrong = scratch.put(pairs.join(held, ["a", "b"], "left_anti").select("cell").distinct())
    if not wrong.isEmpty():
        links = links.unionByName(joining(involved.join(wrong, "cell", "left_semi"), whole).select("a", "b"))
    roots = components(links, scratch)
    return rows, scratch.put(roots.select(F.col("id").alias("cls"), "root"))


def _judged(docs: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """doc_id, rk, cls, n_shingles, component_id, and first: the row key that stands for the component (null ids last)."""
    rows, roots = link_classes(docs, scratch, words)
    rooted = scratch.put(rows.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    # written, so that the join after it is not bound to the aggregate's partitions and a hot component can be split
    least = scratch.put(
        rooted.where("root IS NOT NULL").groupBy("root")
        .agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("one"))
        .select("root", "component_id", F.col("one.rk").alias("first"))
    )
    return rooted.join(least, "root", "left").select("doc_id", "rk", "cls", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "first")


def near_dup_report(docs: DataFrame, words: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    judged = _judged(docs, words, Scratch(docs.sparkSession, "neardup"))
    return judged.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, words: int = 2) -> DataFrame:
    """One row of each component, with all columns, and every row without a set. The row is that with the least id, or
    where ids are equal or null the least hash of id and text; of rows equal in id and text one stays."""
    scratch = Scratch(docs.sparkSession, "kept")
    judged = scratch.put(_judged(docs, words, scratch).select("rk", "cls", "first"))
    gone = scratch.put(judged.where("first IS NOT NULL AND rk <> first").select("rk").distinct())
    repeated = scratch.put(judged.where("first IS NOT NULL AND rk = first").groupBy("rk").count().where("count > 1").select("rk"))
    names = [f"_{i}" for i in range(len(docs.columns))]  # columns may have any name
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], row_key().alias("_rk"))
    # most rows are known to stay by a filter; only those that may go are joined
    doubtful = KeyFilter(scratch.put(gone.unionByName(repeated)), "rk")
    flagged = keyed.mapInArrow(_flagged(doubtful), T.StructType([*keyed.schema.fields, T.StructField("_doubt", T.BooleanType())]))
    stay, doubt = flagged.where("NOT _doubt"), flagged.where("_doubt").join(gone, F.col("_rk") == gone["rk"], "left_anti")
    once = doubt.join(repeated, F.col("_rk") == repeated["rk"], "left_semi").dropDuplicates(["_rk"])
    rest = doubt.join(repeated, F.col("_rk") == repeated["rk"], "left_anti")
    return stay.unionByName(rest).unionByName(once).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def _flagged(doubtful: KeyFilter) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_doubt", pa.array(doubtful.has(np.asarray(batch.column("_rk")))))

    return each


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_report(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
c AS (SELECT s, min(rid) AS cls, len(s) AS n FROM (SELECT list_sort(s) AS s, rid FROM s WHERE len(s) > 0) GROUP BY s),
e AS (SELECT cls, n, unnest(s) AS g FROM c),
p AS (SELECT a.cls AS a, b.cls AS b FROM e a JOIN e b ON a.g = b.g AND a.cls <> b.cls AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n
      GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT cls, cls FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT s.rid, s.doc_id, len(s.s) AS n, c.cls FROM s LEFT JOIN c ON list_sort(s.s) = c.s),
k AS (SELECT r.a AS cls, min(m.doc_id) AS id FROM r JOIN m ON m.cls = r.b GROUP BY r.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(k.id, doc_id) AS component_id, coalesce(k.id, doc_id) = doc_id AS kept
FROM m LEFT JOIN k ON m.cls = k.cls
"""

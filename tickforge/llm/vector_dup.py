"""Embedding near-dedup by an exact metric range join.

Vectors are brought to length 1; cosine at least ``LEAST`` then means Euclidean distance at most ``radius``. For each
label some vectors are pivots. A vector's home is the cell of its nearest pivot p. It is also sent as a guest to a
cell q of higher rank wherever a vector at home there may lie within the radius: the triangle inequality asks for
``d(x, q) - d(x, p) <= 2 * radius``, and the planes between pivots sharpen it to
``(d(x, q)**2 - d(x, p)**2) / (2 * d(p, q)) <= radius``. Each pair therefore meets exactly once, in the cell of
higher rank, and cells are joined independently. Cells of more than ``BLOCK`` vectors at home are cut into blocks by
a hash; guests visit all blocks and lower blocks visit higher ones, so a crowded cell is shared out and none of its
pairs is lost.

A cell counts links of each vector by matrix products in double precision and emits the counts and a spanning forest
of its links, never the pairs. Equal vectors of a label are one class with a multiplicity. In high dimension with
vectors far apart the inequality excludes little, as for every exact metric index; work then is that of a blocked
comparison within labels.

Defined cases: null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing and are their own component; only vectors of equal length are compared; repeated rows link with each other; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import Scratch, table
from tickforge.llm.components import components

LEAST = 0.93
BLOCK = 2048
#: Pivots of one (label, length) and of all together; 4096 vectors of 1000 doubles are 33 MB on the driver.
PIVOTS, ALL_PIVOTS = 64, 4096
PER_CELL = 1024
#: Widens the bounds beyond rounding.
SLACK = 1e-7


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    # the largest component first, so that no square overflows or vanishes
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


class Cells:
    """The pivots of every group (label and length) and the number of blocks of each cell."""

    def __init__(self, pivots: dict[tuple[int, int], np.ndarray], blocks: dict[tuple[int, int, int], int]):
        self.pivots, self.blocks = pivots, blocks

    def distances(self, group: tuple[int, int], x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * x @ self.pivots[group].T))

    def count(self, group: tuple[int, int]) -> int:
        return len(self.pivots[group]) if group in self.pivots else 1

    def homes(self, group: tuple[int, int], x: np.ndarray) -> np.ndarray:
        return self.distances(group, x).argmin(axis=1) if self.count(group) > 1 else np.zeros(len(x), dtype=np.int64)

    def guests(self, group: tuple[int, int], x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell of higher rank that a vector must visit."""
        if self.count(group) == 1:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        p, d = self.pivots[group], self.distances(group, x)
        home = d.argmin(axis=1)
        own = d[np.arange(len(x)), home][:, None]
        between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
        higher = np.arange(len(p))[None, :] > home[:, None]
        near = (d - own <= 2 * radius + SLACK) & ((d * d - own * own) <= 2 * between * (radius + SLACK) + SLACK)
        return np.nonzero(higher & near)


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    label, dim = np.asarray(batch.column("label")), np.asarray(batch.column("dim"))
    for group in sorted(set(zip(label.tolist(), dim.tolist(), strict=True))):
        yield group, np.flatnonzero((label == group[0]) & (dim == group[1]))


def _home_counts(cells: Cells) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (label, dim), at in _by_group(batch):
                x = unit(_rows(batch.column("vec").take(pa.array(at)), dim))
                cell, n = np.unique(cells.homes((label, dim), x), return_counts=True)
                same = [pa.array(np.full(len(cell), v, dtype=np.int64)) for v in (label, dim)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(cell.astype(np.int64)), pa.array(n)], ["label", "dim", "cell", "n"])

    return each


def _block_of(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % blocks.astype(np.uint64)).astype(np.int64)


def _dealt(cells: Cells, radius: float) -> Callable:
    """Each vector once at home and as a guest wherever it must go: label, dim, cell, block, guest, id, n, vec."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                for group, at in _by_group(batch):
                    ids = np.asarray(batch.column("id"))[at]
                    x = unit(_rows(batch.column("vec").take(pa.array(at)), group[1]))
                    counts = np.array([cells.blocks.get((*group, c), 1) for c in range(cells.count(group))])
                    home = cells.homes(group, x)
                    own = _block_of(ids, counts[home])
                    row, cell, block, away = [np.arange(len(at))], [home], [own], [np.zeros(len(at), dtype=bool)]
                    # lower blocks of a cell visit the higher ones; guests visit all blocks
                    later = counts[home] - own - 1
                    r = np.repeat(np.arange(len(at)), later)
                    step = np.arange(len(r)) - np.repeat(np.cumsum(later) - later, later)
                    row, cell, block, away = [*row, r], [*cell, home[r]], [*block, own[r] + 1 + step], [*away, np.ones(len(r), dtype=bool)]
                    r, c = cells.guests(group, x, radius)
                    many = counts[c]
                    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    row, cell = [*row, np.repeat(r, many)], [*cell, np.repeat(c, many)]
                    block, away = [*block, step], [*away, np.ones(len(step), dtype=bool)]
                    row, cell, block, away = map(np.concatenate, (row, cell, block, away))
                    take = pa.array(at[row])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[pa.array(np.full(len(row), v, dtype=np.int64)) for v in group],
                            pa.array(cell.astype(np.int64)), pa.array(block.astype(np.int64)), pa.array(away),
                            batch.column("id").take(take), batch.column("n").take(take), batch.column("vec").take(take),
                        ],
                        ["label", "dim", "cell", "block", "guest", "id", "n", "vec"],
                    )

    return each


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


class Cell:
    """The vectors at home in a block of a cell, met by themselves and then by guests, chunk by chunk."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray, least: float):
        self.ids, self.n, self.x, self.least = ids, n, x, least
        self.links = np.zeros(len(ids), dtype=np.int64)
        self.forest = Forest(len(ids))
        self.edges: list[tuple[int, int]] = []
        for i in range(0, len(ids), 512):
            hit = x[i : i + 512] @ x.T >= least
            hit[np.arange(len(hit)), np.arange(i, i + len(hit))] = False
            self.links[i : i + 512] += hit @ n
            for a in np.flatnonzero(hit.any(axis=1)):
                for j in self._apart(np.flatnonzero(hit[a])):
                    if self.forest.join(int(i + a), j):
                        self.edges.append((int(ids[i + a]), int(ids[j])))

    def _apart(self, near: np.ndarray) -> list[int]:
        """One of the positions per part of the forest."""
        roots = np.fromiter(map(self.forest.find, near.tolist()), dtype=np.int64, count=len(near))
        return near[np.unique(roots, return_index=True)[1]].tolist()

    def guests(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The links of the guests. A guest's edges may join parts of the forest, as later guests then find."""
        hit = x @ self.x.T >= self.least
        self.links += n @ hit
        edges = []
        for a in np.flatnonzero(hit.any(axis=1)):
            near = self._apart(np.flatnonzero(hit[a]))
            edges += [(int(ids[a]), int(self.ids[j])) for j in near]
            for j in near[1:]:
                self.forest.join(near[0], j)
        return hit @ self.n, edges


def _joined(least: float) -> Callable:
    """Blocks sorted by key, those at home first -> id, links, other: counts (other null) and forest links (links 0)."""

    def rows(ids: np.ndarray, links: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
        some = np.flatnonzero(links)
        out = [
            pa.array([*ids[some].tolist(), *(a for a, _ in edges)], pa.int64()),
            pa.array([*links[some].tolist(), *(0 for _ in edges)], pa.int64()),
            pa.array([*(None for _ in some), *(b for _, b in edges)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(out, ["id", "links", "other"])

    def arrays(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = [[np.asarray(b.column(c)) for b in parts] for c in ("id", "n")]
        dim = int(parts[0].column("dim")[0].as_py())
        return *map(np.concatenate, cols), unit(np.concatenate([_rows(b.column("vec"), dim) for b in parts]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_home: list[pa.RecordBatch] = []
        cell, key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(c)) for c in ("label", "dim", "cell", "block", "guest")]
            change = np.zeros(batch.num_rows - 1, dtype=bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                now = tuple(c[lo] for c in cols[:4])
                if now != key:
                    if at_home:
                        cell = Cell(*arrays(at_home), least)
                    if cell is not None:
                        yield rows(cell.ids, cell.links, cell.edges)
                    at_home, cell, key = [], None, now
                if not cols[4][lo]:
                    at_home.append(batch.slice(lo, hi - lo))
                    continue
                if at_home:
                    cell, at_home = Cell(*arrays(at_home), least), []
                for i in range(lo, hi if cell is not None else lo, 1024):
                    ids, n, x = arrays([batch.slice(i, min(1024, hi - i))])
                    yield rows(ids, *cell.guests(ids, n, x))
        if at_home:
            cell = Cell(*arrays(at_home), least)
        if cell is not None:
            yield rows(cell.ids, cell.links, cell.edges)

    return each


def _pivots(classes: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Pivots of the larger groups, by hash. Their number follows the group's size within fixed bounds; a group of up to
    PER_CELL vectors, or beyond the bound on all pivots, is one cell."""
    large = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > PER_CELL)
    sizes = {(r["label"], r["dim"]): r["n"] for r in large.orderBy(F.desc("n"), "label", "dim").limit(ALL_PIVOTS // 2).collect()}
    if not sizes:
        return {}
    share = max(1, min(PIVOTS, ALL_PIVOTS // len(sizes)))
    most = {g: max(1, min(share, math.ceil(n / PER_CELL))) for g, n in sizes.items()}
    at = F.xxhash64(F.lit("pivot"), F.col("id"))
    # about four times as many as needed pass by their hash; the least of them are taken
    rate = F.create_map(*[F.lit(x) for (label, dim), n in sizes.items() for x in (f"{label},{dim}", min(1 << 20, (most[(label, dim)] * 4 + 16) * (1 << 20) // n + 1))])
    passed = classes.where(F.pmod(at, F.lit(1 << 20)) < rate[F.concat_ws(",", "label", "dim")]).select("label", "dim", "vec", at.alias("at"))
    found: dict[tuple[int, int], list] = {g: [] for g in sizes}
    for r in passed.orderBy("at").toLocalIterator():
        group = (r["label"], r["dim"])
        if len(found[group]) < most[group]:
            found[group].append(r["vec"])
    return {group: unit(np.array(rows, dtype=np.float64)) for group, rows in found.items() if rows}


def vector_report(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    vec = F.col(vec_col)
    sound = (
        F.coalesce(F.size(vec) > 0, F.lit(False))
        & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(vec, lambda v: v != 0)
        & F.col(label_col).isNotNull()
    )
    rows = scratch.put(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"), F.coalesce(sound, F.lit(False)).alias("sound"))
        .withColumn("cls", F.when(F.col("sound"), F.xxhash64("label", "vec")))
    )
    # a class stands for equal vectors of a label; its id is the class key
    classes = scratch.put(
        rows.where("sound").groupBy("cls").agg(F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))
        .select(F.col("cls").alias("id"), "n", "label", F.size("vec").cast("long").alias("dim"), "vec")
    )
    pivots = _pivots(classes)
    homes = classes.mapInArrow(_home_counts(Cells(pivots, {})), "label long, dim long, cell long, n long")
    counts = homes.groupBy("label", "dim", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).collect()
    cells = Cells(pivots, {(r["label"], r["dim"], r["cell"]): math.ceil(r["n"] / BLOCK) for r in counts})
    radius = math.sqrt(2 - 2 * least)
    kind = dict(classes.dtypes)["vec"]
    dealt = classes.mapInArrow(_dealt(cells, radius), f"label long, dim long, cell long, block long, guest boolean, id long, n long, vec {kind}")
    key = ["label", "dim", "cell", "block"]
    met = scratch.put(dealt.repartition(*key).sortWithinPartitions(*key, "guest").mapInArrow(_joined(least), "id long, links long, other long"))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(met.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    known = classes.select("id", "n").join(links, "id", "left").join(roots, "id", "left")
    known = known.select(F.col("id").alias("cls"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    joined = rows.drop("vec").join(known, "cls", "left")
    smallest = joined.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = joined.join(smallest, "root", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_report(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT rid, vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r(a, b) AS (SELECT rid, rid FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT r.a AS rid, min(v.vec_id) AS id FROM r JOIN v ON v.rid = r.b GROUP BY r.a),
n AS (SELECT a AS rid, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, k.id AS component_id, k.id = v.vec_id AS kept
FROM v JOIN k ON v.rid = k.rid LEFT JOIN n ON v.rid = n.rid
"""

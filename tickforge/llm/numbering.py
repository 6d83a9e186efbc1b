"""Consecutive numbers over a distributed order, without one task for all rows."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import Scratch

#: monotonically_increasing_id puts the partition above this many bits and the place within it below.
PLACE_BITS = 33


def literal_array(values: list[int]) -> Column:
    """An array of whole numbers as one literal (Catalyst folds it)."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def numbered(df: DataFrame, column: str, scratch: Scratch, start: int = 0) -> tuple[DataFrame, int]:
    """The rows with consecutive numbers from ``start`` in the order of their partitions (after ``orderBy``: of the
    sort), and their count. The rows are written once; the driver sees one count per partition."""
    written = scratch.put(df.withColumn(column, F.monotonically_increasing_id()))
    part = F.shiftright(column, PLACE_BITS)
    counts = {r[0]: r[1] for r in written.groupBy(part.alias("part")).count().collect()}
    sizes = [counts.get(p, 0) for p in range(max(counts, default=-1) + 1)]
    ahead = list(itertools.accumulate(sizes, initial=start))
    place = F.col(column).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return written.withColumn(column, F.get(literal_array(ahead), part.cast("int")) + place), sum(sizes)

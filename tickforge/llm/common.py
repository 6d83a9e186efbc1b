"""What the operators of this package share: tables, shared storage, word rules and fixed-size key filters."""

from __future__ import annotations

import contextlib
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside this class (the six ASCII blanks).
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The array of words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 64-bit key of a row by id and text, also where either is null. Repeated rows share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets a temporary one; elsewhere
    executors would write to their own disks, so a missing setting is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_tickforge_shared", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors of {sc.master} share")
        found = sc._tickforge_shared = tempfile.mkdtemp(prefix="tickforge-")
    return found.rstrip("/")


_COLLECTORS: list[list[Scratch]] = []


@contextlib.contextmanager
def collected() -> Iterator[list[Scratch]]:
    """The Scratches made inside. Whoever has written what the operators returned may drop them, and no others."""
    made: list[Scratch] = []
    _COLLECTORS.append(made)
    try:
        yield made
    finally:
        _COLLECTORS[:] = [x for x in _COLLECTORS if x is not made]


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    ``put`` writes a DataFrame as Parquet and reads it again; ``clear`` deletes what is no longer needed and lets
    Spark drop the shuffle files of plans that are out of use. What an operator returns reads its tables until its
    caller has written it; ``drop`` deletes the tables of this one run, never those of another.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names = 0
        for made in _COLLECTORS:
            made.append(self)

    def put(self, df: DataFrame) -> DataFrame:
        self.names += 1
        path = f"{self.root}/{self.names}"
        df.write.parquet(path)
        self.spark._jvm.System.gc()  # shuffle files of finished plans are dropped once the driver collects them
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self, *frames: DataFrame) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


class KeyFilter:
    """A bitmap over the low bits of 64-bit keys: a filter without false negatives and of fixed size.

    It is built by a distributed bitmap aggregate, at most 2**28 bits (32 MB) whatever the number of keys, and
    is broadcast to the Python workers. Keys that pass by chance only cost work, never results.
    """

    MOST_BITS = 28

    def __init__(self, keys: DataFrame, column: str = "key", room: int = 4):
        """room: bits beyond those that number the keys; one in 2**room other keys passes."""
        spark = keys.sparkSession
        n = keys.count()
        self.n = n
        self.bits = min(self.MOST_BITS, max(18, math.ceil(math.log2(max(2, n))) + room))
        at = F.col(column).bitwiseAND(F.lit((1 << self.bits) - 1)) + 1  # the bitmap functions count from 1
        rows = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")
        )
        whole = np.zeros(max(4096, (1 << self.bits) // 8), dtype=np.uint8)
        for bucket, bitmap in rows.collect():  # at most 32 MB, in one job; an iterator would run one for each partition
            whole[(bucket - 1) * 4096 : bucket * 4096] |= np.frombuffer(bytes(bitmap), dtype=np.uint8)
        self.shared = spark.sparkContext.broadcast(whole)

    def __getstate__(self):
        return {"bits": self.bits, "shared": self.shared, "n": self.n}

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which keys (int64 or uint64) may be in the set."""
        at = keys.view(np.int64) & np.int64((1 << self.bits) - 1)
        return (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) > 0

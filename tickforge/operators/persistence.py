"""The protocol of sign persistence: which sessions count, shuffled signs, and intervals of the median exponent.

Shuffles follow the integer plan of ``scores``: a session's signs in the order of a number mixed from replicate and
position. The median over sessions isn't a sum, so its replicates are drawn from the sessions' exponents themselves, one
value a session.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.operators import contracts as C
from tickforge.operators import fits as M
from tickforge.operators import liquidity as L
from tickforge.operators import scores as S

MINIMUM, PERMUTATIONS, BLOCKS, REPLICATES, SEED = 8192, 199, (1, 5, 10), 10_000, 42


def require_scales(scales: list[int], minimum: int = MINIMUM) -> None:
    if len(scales) < 2 or sorted(set(scales)) != list(scales) or scales[0] < 4 or scales[-1] > minimum:
        raise C.ContractError("scales must be at least two, rise, start at 4 or more and not pass the least number of trades")


def sign_violations(trades: DataFrame) -> DataFrame:
    """Signs other than 1 and -1, and places that a session has twice."""
    own = C.count_violations(trades, {"sign_not_unit": ~F.coalesce(F.col("sign").isin(-1, 1), F.lit(False))})
    twice = C.duplicate_keys(trades, ["date", "row0"]).agg(F.count("*").alias("violations")).select(F.lit("order_not_unique").alias("rule"), "violations")
    return own.unionByName(twice)


@functools.cache
def _places() -> np.ndarray:
    """For each mixed number in order, the position below PRIME that has it in replicate 0 of seed 0."""
    a = np.arange(S.PRIME)
    b = a * a % S.PRIME
    roots = np.argsort(b * b % S.PRIME * a % S.PRIME)
    return roots * pow(S.STEP, -1, S.PRIME) % S.PRIME


def shuffled(signs: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """The signs in the order of their mixed numbers, equal ones by position. The numbers of PRIME neighbouring positions
    are all different and another replicate only shifts positions, so long sessions take the order from a table."""
    n = len(signs)
    if n < S.PRIME // 8:
        return signs[np.argsort(S._mixed(np.array([replicate]), np.arange(n), seed)[0], kind="stable")]
    shift = (replicate * S.REPLICATE + seed * S.SEEDED) * pow(S.STEP, -1, S.PRIME) % S.PRIME
    at = _places() - shift
    at[at < 0] += S.PRIME
    rounds = -(-n // S.PRIME)
    out, there = np.empty((S.PRIME, rounds), signs.dtype), np.ones((S.PRIME, rounds), bool)
    for r in range(rounds):
        own = signs[r * S.PRIME : (r + 1) * S.PRIME]
        there[:, r] = at < len(own)
        out[:, r] = np.take(own, at, mode="clip")
    return out[there]


SESSIONS = "date string, trades long, buy_fraction double, included boolean, exponent double, p_value double, nulls array<double>"
#: Rows of a run of signs, and shuffles that one row of work draws.
RUN, SHARE = 4096, 50


def session_exponents(trades: DataFrame, scales: list[int], minimum: int = MINIMUM, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """A row per session: trades, share of buys, whether it has the least number of trades, and if so its scaling exponent,
    the upper-tail p-value against its own shuffled signs and their exponents (null where fewer than two scales fit). A
    session's signs are put together from runs, a byte each; its shuffles are shared out, and drawn and measured one at a
    time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for date, lo, signs in zip(batch.column("date").to_pylist(), batch.column("lo").to_pylist(), batch.column("signs"), strict=True):
                x = np.asarray(signs.values)
                real, nulls = None, None
                if len(x) >= minimum and np.isfinite(real := float(L.sign_exponents(x[None], scales)[0])):
                    nulls = [float(L.sign_exponents(shuffled(x, rep, seed)[None], scales)[0]) for rep in range(lo, min(lo + SHARE, permutations))]
                out.append((date, lo, len(x), float(np.mean(x == 1)), len(x) >= minimum, real if nulls else None, nulls))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.bool_(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["date", "lo", "trades", "buy_fraction", "included", "exponent", "nulls"])

    ordered = lambda of, value: F.transform(F.sort_array(F.collect_list(of)), lambda r: r[value])
    runs = trades.groupBy("date", F.floor(F.col("row0") / RUN).alias("run")).agg(ordered(F.struct("row0", F.col("sign").cast("byte").alias("sign")), "sign").alias("signs"))
    sessions = runs.groupBy("date").agg(F.flatten(ordered(F.struct("run", "signs"), "signs")).alias("signs"))
    shares = sessions.withColumn("lo", F.explode(F.array(*[F.lit(lo) for lo in range(0, max(permutations, 1), SHARE)])))
    # work by the number of shuffles, not by bytes, so the count of partitions is given
    shares = shares.repartition(4 * trades.sparkSession.sparkContext.defaultParallelism, "date", "lo")
    parts = shares.mapInArrow(each, "date string, lo int, trades long, buy_fraction double, included boolean, exponent double, nulls array<double>")
    one = lambda c: F.max(c).alias(c)
    whole = parts.groupBy("date").agg(*[one(c) for c in ("trades", "buy_fraction", "included", "exponent")], F.flatten(ordered(F.struct("lo", "nulls"), "nulls")).alias("nulls"))
    beyond = F.size(F.filter("nulls", lambda v: ~F.isnan(v) & (v >= F.col("exponent"))))
    p = F.when(F.col("exponent").isNotNull(), (1 + beyond) / F.lit(1.0 + permutations))
    return whole.select("date", "trades", "buy_fraction", "included", "exponent", p.alias("p_value"), "nulls")


def family_test(sessions: DataFrame) -> DataFrame:
    """One row over the included sessions: their number, the quartiles of the exponent, the median of each replicate's
    shuffled exponents with its 95 % range, and the share of replicates (itself counted) that reach the median."""
    own = sessions.where("included")
    medians = own.select("date", F.posexplode("nulls").alias("rep", "v")).groupBy("rep").agg(F.percentile("v", 0.5).alias("m"))
    null = medians.agg(F.sort_array(F.collect_list("m")).alias("m"))  # as many numbers as permutations
    real = own.agg(F.count("*").alias("sessions"), F.percentile("exponent", [0.25, 0.5, 0.75]).alias("q"), F.sum("trades").alias("trades"))
    n = F.size("m")
    return real.crossJoin(F.broadcast(null)).select(
        "sessions", "trades", *[F.col("q")[i].alias(c) for i, c in enumerate(("lower_quartile", "median", "upper_quartile"))],
        *[S._percentile("m", q).alias(f"null_{c}") for q, c in ((0.025, "lower"), (0.5, "median"), (0.975, "upper"))],
        F.when(n > 0, (1 + F.size(F.filter("m", lambda v: v >= F.col("q")[1]))) / (1.0 + n)).alias("p_value"), n.alias("permutations"),
    )


MEDIANS = "block long, sessions long, median double, lower double, upper double, replicates long"


def median_intervals(exponents: DataFrame, blocks: tuple[int, ...] = BLOCKS, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """The median of the sessions' exponents with its 95 % interval over resampled sessions, in circular blocks. Input:
    date, exponent; one value a session meets in one row. A block longer than the sessions is an error."""
    days = exponents.where("exponent IS NOT NULL").join(M.ranked_calendar(exponents.where("exponent IS NOT NULL")), "date")
    rows = days.groupBy(F.lit(1).alias("one")).agg(F.sort_array(F.collect_list(F.struct("r", "exponent"))).alias("days")).select(F.transform("days", lambda d: d["exponent"]).alias("values"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in batch.column("values").to_pylist():
                x = np.array(values)
                for block in blocks:
                    if block > len(x):
                        raise ValueError("a block is longer than the included sessions")
                    step = max(1, (1 << 22) // len(x))
                    found = [np.median(x[S.drawn(np.arange(lo, min(replicates, lo + step)), len(x), seed, block if block > 1 else None)], axis=1) for lo in range(0, replicates, step)]
                    out.append((block, len(x), float(np.median(x)), *np.quantile(np.concatenate(found), [0.025, 0.975]).tolist(), replicates))
            kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in MEDIANS.split(", ")])

    return rows.mapInArrow(each, MEDIANS)


def persistence(trades: DataFrame, scales: list[int], minimum: int = MINIMUM, permutations: int = PERMUTATIONS, blocks: tuple[int, ...] = BLOCKS, replicates: int = REPLICATES, seed: int = SEED) -> dict[str, DataFrame]:
    """All tables of the protocol. trades: date, row0, sign."""
    require_scales(scales, minimum)
    C.require(sign_violations(trades))
    sessions = session_exponents(trades, scales, minimum, permutations, seed)
    return {"sessions": sessions.drop("nulls"), "family": family_test(sessions), "medians": median_intervals(sessions.where("included").select("date", "exponent"), blocks, replicates, seed)}

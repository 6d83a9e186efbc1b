"""Named queries, each with the DuckDB SQL of the same result where there is one.

Both sides get the same column types from one specification: l whole number, d double (rounded to nine places, as sums
of doubles depend on their order), s string, b boolean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
DUCK = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def typed(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        c = F.col(name).cast(SPARK[kind])
        out.append((F.round(c, 9) if kind == "d" else c).alias(name))
    return df.select(*out)


def typed_sql(ctes: str, body: str, spec: str) -> str:
    cols = ", ".join(
        f"round(CAST({n} AS DOUBLE), 9) AS {n}" if k == "d" else f"CAST({n} AS {DUCK[k]}) AS {n}" for n, k in _columns(spec)
    )
    return f"WITH {ctes + ',' if ctes else ''} result_ AS ({body}) SELECT {cols} FROM result_"


def add(name: str, spec: str, run: Callable[[SparkSession, str], DataFrame], body: str | None = None, ctes: str = "") -> None:
    """Registers a query: columns (name:kind ...), the Spark plan, and the body of its SQL after common tables."""
    QUERIES[name] = lambda spark, sf_dir: typed(run(spark, sf_dir), spec)
    if body is not None:
        SQL[name] = typed_sql(ctes, body, spec)

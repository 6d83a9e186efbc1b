"""SQL that solves linear equations: elimination with one common table for each unknown."""

from __future__ import annotations


def eliminate_sql(name: str, source: str, k: int) -> str:
    """Common tables; the last is ``name``: i, v, the k unknowns. source: i, j, v, with the right side as column k + 1."""
    out = [f"{name}_0 AS MATERIALIZED ({source})"]
    for p in range(1, k + 1):
        out.append(
            f"""{name}_{p} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {p} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v FROM {name}_{p - 1} a JOIN (SELECT j, v FROM {name}_{p - 1} WHERE i = {p}) r USING (j)
  JOIN (SELECT i, v FROM {name}_{p - 1} WHERE j = {p}) c USING (i), (SELECT v FROM {name}_{p - 1} WHERE i = {p} AND j = {p}) p)"""
        )
    return ",\n".join([*out, f"{name} AS MATERIALIZED (SELECT i, v FROM {name}_{k} WHERE j = {k + 1})"])

"""All queries of the engine."""

from __future__ import annotations

from tickforge.plans import audits, books, evaluations, signals, trades, visible
from tickforge.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audits", "books", "evaluations", "signals", "trades", "visible"]

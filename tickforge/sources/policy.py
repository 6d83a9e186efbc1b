"""The policy of an analysis: its scope, declared exclusions and split dates, from a ``key=value`` file."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.operators.contracts import ContractError

COUNTS = ("expected_delivered_sessions", "expected_included_sessions", "expected_development_sessions", "expected_selection_sessions", "expected_test_sessions")
DATES = ("development_end", "selection_start", "selection_end", "test_start")
TEXTS = ("symbol", "source_availability")
NUMBERS = ("year", "maximum_session_end_gap_seconds")
REPEATED = ("source_exclusion", "early_close")


@dataclass(frozen=True)
class Policy:
    values: dict[str, str | int | str]
    exclusions: tuple[str, ...] = ()
    early_closes: dict[str, int] = field(default_factory=dict)

    def __getitem__(self, key: str):
        return self.values[key]

    def close_ns(self) -> dict[str, int]:
        return {d: s * 1_000_000_000 for d, s in self.early_closes.items()}


def _date(text: str, key: str) -> str:
    try:
        return date.fromisoformat(text).isoformat()
    except ValueError as e:
        raise ContractError(f"{key}: {text!r} is no date") from e


def parse(text: str) -> Policy:
    """Reads the lines of a policy. Comments start with #; unknown, missing and repeated keys are errors, as are counts
    that don't add up and dates out of order."""
    values: dict = {}
    exclusions: list[str] = []
    closes: dict[str, int] = {}
    for i, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        key, eq, value = (x.strip() for x in line.partition("="))
        if not eq or not value:
            raise ContractError(f"line {i}: expected key=value")
        if key in values:
            raise ContractError(f"line {i}: {key} is repeated")
        if key == "source_exclusion":
            exclusions.append(_date(value, key))
        elif key == "early_close":
            day, _, seconds = value.partition(",")
            closes[_date(day.strip(), key)] = int(seconds)
        elif key in DATES:
            values[key] = _date(value, key)
        elif key in COUNTS or key in NUMBERS:
            if not value.isdigit():
                raise ContractError(f"line {i}: {key} must be a whole number")
            values[key] = int(value)
        elif key in TEXTS:
            values[key] = value
        else:
            raise ContractError(f"line {i}: unknown key {key}")
    missing = [k for k in (*TEXTS, *NUMBERS, *COUNTS, *DATES) if k not in values]
    if missing:
        raise ContractError(f"missing: {', '.join(missing)}")
    if len(set(exclusions)) < len(exclusions):
        raise ContractError("a source exclusion is repeated")
    if values["expected_delivered_sessions"] - len(exclusions) != values["expected_included_sessions"]:
        raise ContractError("delivered sessions less exclusions aren't the included ones")
    if sum(values[k] for k in COUNTS[2:]) != values["expected_included_sessions"]:
        raise ContractError("the parts don't add up to the included sessions")
    ordered = [values[k] for k in DATES]
    if not (ordered[0] < ordered[1] <= ordered[2] < ordered[3]):
        raise ContractError("split dates are out of order")
    return Policy(values, tuple(exclusions), closes)


def require_scope(policy: Policy, symbol: str, year: int) -> None:
    if (policy["symbol"], policy["year"]) != (symbol, year):
        raise ContractError(f"the policy is for {policy['symbol']} {policy['year']}, not {symbol} {year}")


def coverage_violations(sessions: DataFrame, policy: Policy) -> DataFrame:
    """rule, violations over ``contracts.session_coverage`` of all delivered sessions, excluded ones too: sessions that are
    incomplete without a declared exclusion, exclusions that are complete after all or weren't delivered, and counts that
    aren't the policy's. It is a three-way check of declared, delivered and complete calendars in one aggregate."""
    declared = F.col("date").isin(list(policy.exclusions)) if policy.exclusions else F.lit(False)
    one = sessions.agg(
        F.count_if(F.col("status") == "unexplained_incomplete").alias("unexplained_incomplete"),
        F.count_if(declared & F.col("complete")).alias("declared_but_complete"),
        (len(policy.exclusions) - F.count_if(declared)).alias("exclusion_not_delivered"),
        (F.count("*") != policy["expected_delivered_sessions"]).cast("long").alias("delivered_count"),
        (F.count_if("complete") != policy["expected_included_sessions"]).cast("long").alias("included_count"),
    )
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in one.columns])).alias("r")).select("r.*")


def universe_violations(dates: DataFrame, policy: Policy) -> DataFrame:
    """rule, violations over the distinct sessions of an analysis."""
    d, bounds = F.col("date"), [policy[k] for k in DATES]  # a selection of one session has one date twice
    n = F.count("*")
    part = lambda c: F.count_if(c)
    off = lambda got, want: (got != want).cast("long")
    one = dates.select("date").distinct().agg(
        F.count_if(~d.startswith(str(policy["year"]))).alias("other_year"),
        F.count_if(d.isin(list(policy.exclusions)) if policy.exclusions else F.lit(False)).alias("excluded_present"),
        off(n, policy["expected_included_sessions"]).alias("included_count"),
        off(part(d <= policy["development_end"]), policy["expected_development_sessions"]).alias("development_count"),
        off(part(d.between(policy["selection_start"], policy["selection_end"])), policy["expected_selection_sessions"]).alias("selection_count"),
        off(part(d >= policy["test_start"]), policy["expected_test_sessions"]).alias("test_count"),
        (len(set(bounds)) - F.count_distinct(F.when(d.isin(bounds), d))).alias("boundaries_missing"),
    )
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in one.columns])).alias("r")).select("r.*")

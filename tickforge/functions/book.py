"""Column expressions over a two-level book: ask_price_1, ask_size_1, bid_price_1, ... with prices in 1/10,000."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE_SCALE = 10_000
BOOK = [f"{side}_{what}_{level}" for level in (1, 2) for side in ("ask", "bid") for what in ("price", "size")]
SPREAD_BUCKETS = ((100, "one_tick"), (500, "two_to_five_ticks"), (1000, "six_to_ten_ticks"))
WIDEST = "over_ten_ticks"


def field(name: str, book: str | None = None) -> Column:
    return F.col(f"{book}.{name}" if book else name)


def mid_twice(book: str | None = None) -> Column:
    """Ask plus bid, a whole number."""
    return (field("ask_price_1", book) + field("bid_price_1", book)).cast("long")


def spread(book: str | None = None) -> Column:
    return (field("ask_price_1", book) - field("bid_price_1", book)).cast("long")


def spread_bucket(width: Column) -> Column:
    out = F.lit(WIDEST)
    for most, name in reversed(SPREAD_BUCKETS):
        out = F.when(width <= most, F.lit(name)).otherwise(out)
    return out


def imbalance(book: str | None = None) -> Column:
    """(bid - ask) / (bid + ask) of the best sizes; 0 without depth."""
    bid, ask = field("bid_size_1", book).cast("double"), field("ask_size_1", book).cast("double")
    return F.when(bid + ask > 0, (bid - ask) / (bid + ask)).otherwise(0.0)


def ofi(before: str, after: str | None = None) -> Column:
    """Order-flow increment between two books: bid added less bid removed less ask added plus ask removed."""
    b, a = lambda n: field(n, before), lambda n: field(n, after)
    part = lambda cond, c: F.when(cond, c).otherwise(0)
    return (
        part(a("bid_price_1") >= b("bid_price_1"), a("bid_size_1"))
        - part(a("bid_price_1") <= b("bid_price_1"), b("bid_size_1"))
        - part(a("ask_price_1") <= b("ask_price_1"), a("ask_size_1"))
        + part(a("ask_price_1") >= b("ask_price_1"), b("ask_size_1"))
    ).cast("long")


def pressure(flow: Column, depth: Column) -> Column:
    """Flow per depth brought into (-1, 1): 2 atan(x) / pi; 0 without depth."""
    return F.when(depth > 0, F.lit(2.0) * F.atan(flow.cast("double") / depth) / F.lit(math.pi)).otherwise(0.0)


def unit_bin(x: Column, bins: int) -> Column:
    """Equal-width bin of a value held to [-1, 1]; 1 falls in the last."""
    held = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return F.least(F.lit(bins - 1), F.floor((held + 1.0) * 0.5 * bins)).cast("int")


def bin_center(b: Column, bins: int) -> Column:
    return -1.0 + 2.0 * (b + 0.5) / bins


def displayed_vwap(side: str, shares: Column, book: str | None = None) -> Column:
    """Average price of taking shares from the two displayed levels of a side; null where they don't suffice."""
    p1, s1, p2, s2 = (field(f"{side}_{w}_{k}", book) for k in (1, 2) for w in ("price", "size"))
    q1 = F.least(shares, s1)
    q2 = F.least(shares - q1, s2)
    return F.when(q1 + q2 == shares, (q1 * p1 + q2 * p2).cast("double") / shares)


def valid_snapshot(book: str | None = None) -> Column:
    """Positive prices and sizes, not crossed, levels in order."""
    positive = F.lit(True)
    for c in BOOK:
        positive = positive & (field(c, book) > 0)
    f = lambda n: field(n, book)
    return positive & (f("ask_price_1") > f("bid_price_1")) & (f("ask_price_2") > f("ask_price_1")) & (f("bid_price_2") < f("bid_price_1"))


def same_best_quote(a: str, b: str | None = None) -> Column:
    out = F.lit(True)
    for n in ("ask_price_1", "ask_size_1", "bid_price_1", "bid_size_1"):
        out = out & field(n, a).eqNullSafe(field(n, b))
    return out


def transition(before: str, after: str | None = None) -> Column:
    """Class of a message's effect on the book: exact, depth_censored, mismatch or unsupported.

    Prices of the side are signed so that lower is better on both sides.
    """
    kind, direction, price, size = (F.col(c) for c in ("event_type", "direction", "price", "size"))
    on_bids = direction == 1
    sign = F.when(on_bids, -1).otherwise(1)
    pick = lambda book, what, k: F.when(on_bids, field(f"bid_{what}_{k}", book)).otherwise(field(f"ask_{what}_{k}", book))
    p1, s1, p2, s2 = (pick(before, w, k) * (sign if w == "price" else 1) for k in (1, 2) for w in ("price", "size"))
    a1, z1, a2, z2 = (pick(after, w, k) * (sign if w == "price" else 1) for k in (1, 2) for w in ("price", "size"))
    q = price * sign

    def same(names: list[str]) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & (field(n, before) == field(n, after))
        return out

    sides = {s: [c for c in BOOK if c.startswith(s)] for s in ("ask", "bid")}
    unchanged, other_same = same(BOOK), F.when(on_bids, same(sides["ask"])).otherwise(same(sides["bid"]))
    side_same = F.when(on_bids, same(sides["bid"])).otherwise(same(sides["ask"]))
    becomes = lambda w1, x1, w2, x2: (a1 == w1) & (z1 == x1) & (a2 == w2) & (z2 == x2)
    added = (
        F.when(q == p1, becomes(p1, s1 + size, p2, s2))
        .when(q == p2, becomes(p1, s1, p2, s2 + size))
        .when(q < p1, becomes(q, size, p1, s1))
        .when(q < p2, becomes(p1, s1, q, size))
        .otherwise(side_same)
    )
    verdict = lambda c: F.when(c, "exact").otherwise("mismatch")
    left = F.when(q == p1, s1 - size).otherwise(s2 - size)
    reduced = F.when(q == p1, becomes(p1, left, p2, s2)).otherwise(becomes(p1, s1, p2, left))
    depleted = F.when(q == p1, (a1 == p2) & (z1 == s2)).otherwise((a1 == p1) & (z1 == s1))
    removed = (
        F.when((q != p1) & (q != p2), verdict(side_same))
        .when(left < 0, "mismatch")
        .when(left > 0, verdict(reduced))
        .otherwise(F.when(depleted, "depth_censored").otherwise("mismatch"))
    )
    sound = (size > 0) & other_same
    return (
        F.when(~direction.isin(-1, 1), "unsupported")
        .when(kind.isin(5, 6, 7), verdict(unchanged))
        .when(kind == 1, F.when(sound, verdict(added)).otherwise("mismatch"))
        .when(kind.isin(2, 3, 4), F.when(sound, removed).otherwise("mismatch"))
        .otherwise("unsupported")
    )

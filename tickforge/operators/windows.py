"""Windows of a fixed number of trades, and what regressions take from them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickforge.sources.settle import settled

PRICE_SCALE = 10_000.0
#: 28 geometric horizons of scaling windows, from 10 to 5000 trades, and the scales of sign persistence.
SCALING_HORIZONS = [int(h) for h in np.unique(np.rint(np.geomspace(10, 5_000, 28)))]
DFA_SCALES = [16, 32, 64, 128, 256, 512, 1024]


def in_order() -> WindowSpec:
    """Trades of a session in order."""
    return Window.partitionBy("date").orderBy("row0")


def prediction_windows(trades: DataFrame, horizons: list[int], stride: int | None = None) -> DataFrame:
    """Per session and horizon T, windows [k, k + T) of trades whose next trade exists: signed size, summed signs, and
    the change of the mid over the window. Without a stride windows tumble; with one they start at its multiples.

    Sums come from prefix differences, so a window's cost doesn't grow with T, and only the rows where a window starts or
    ends go on.
    """
    so_far = in_order().rowsBetween(Window.unboundedPreceding, -1)
    before = trades.withColumns(
        {
            "v": F.coalesce(F.sum(F.col("sign") * F.col("size")).over(so_far), F.lit(0)),
            "n": F.coalesce(F.sum("sign").over(so_far), F.lit(0)),
        }
    )
    step = {t: math.gcd(t, stride or t) for t in horizons}
    rows = _at_multiples(before.select("date", "row0", "v", "n", "mid_raw"), step)
    of = lambda value: F.coalesce(*[F.when(F.col("horizon").isin([t for t in horizons if t // step[t] == k]), value(k)) for k in sorted({t // step[t] for t in horizons})])
    out = rows.withColumns({f"end_{c}": of(lambda k, c=c: F.lead(c, k).over(_by_horizon())) for c in ("v", "n", "mid_raw")})
    starts = F.lit(True) if stride is None else F.col("row0") % stride == 0
    return out.where(F.col("end_mid_raw").isNotNull() & starts).select(
        "date",
        "horizon",
        "row0",
        (F.col("end_v") - F.col("v")).cast("long").alias("volume_imbalance"),
        (F.col("end_n") - F.col("n")).cast("long").alias("order_flow_imbalance"),
        ((F.col("end_mid_raw") - F.col("mid_raw")) / F.lit(PRICE_SCALE)).alias("impact"),
        (F.lit(1e4) * F.log(F.col("end_mid_raw").cast("double") / F.col("mid_raw"))).alias("impact_bps"),
    )


def _at_multiples(rows: DataFrame, step: dict[int, int]) -> DataFrame:
    """Each row for the horizons whose step divides its place."""
    each = F.array_compact(F.array(*[F.when(F.col("row0") % g == 0, F.lit(t)) for t, g in step.items()]))
    return rows.withColumn("horizon", F.explode(each))


def _by_horizon() -> WindowSpec:
    return Window.partitionBy("date", "horizon").orderBy("row0")


def impact_features(windows: DataFrame) -> DataFrame:
    """Cents of impact; absolute value, signed root and signed log of the volume imbalance; absolute value and signed root of the count."""
    v, n = F.col("volume_imbalance").cast("double"), F.col("order_flow_imbalance").cast("double")
    signed = lambda x, f: F.signum(x) * f(F.abs(x))
    out = windows.withColumns(
        {
            "impact_cents": 100.0 * F.col("impact"),
            "absolute_volume": F.abs(v),
            "signed_sqrt_volume": signed(v, F.sqrt),
            "signed_log_volume": signed(v, F.log1p),
            "absolute_flow": F.abs(n),
            "signed_sqrt_flow": signed(n, F.sqrt),
        }
    )
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return out.where(finite(F.col("impact_cents")) & finite(v))


def with_split(data: DataFrame, test_fraction: float = 0.2, test_start: str | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Adds ``is_test``: sessions from the boundary on, which is given or leaves the first (1 - f) n of n sessions,
    at least one on each side. Where the sessions of the data are known without its plan, they give the boundary as a
    value that filters can carry down to the source."""
    if test_start is not None:
        return data.withColumn("is_test", F.col("date") >= test_start)
    if sessions is not None:
        start = _ranked(sessions, test_fraction).agg(F.min(F.when(F.col("is_test"), F.col("date")))).first()[0]
        return data.where("date IS NOT NULL").withColumn("is_test", F.lit(False) if start is None else F.col("date") >= start)
    return data.join(_ranked(data, test_fraction), "date")


def _ranked(data: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    dates = data.select("date").distinct()
    w = Window.orderBy("date")  # a row per session
    ranked = dates.withColumns({"r": F.row_number().over(w), "m": F.count("*").over(Window.partitionBy(F.lit(0)))})
    cut = F.greatest(F.lit(1), F.least(F.col("m") - 1, F.floor((1 - test_fraction) * F.col("m"))))
    return ranked.select("date", (F.col("r") > cut).alias("is_test"))


def sigma_filter(split: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """Rows of both parts within mean plus or minus k population deviations of the training part, in every column."""
    train = ~F.col("is_test")
    bounds = split.agg(*[F.struct(F.avg(F.when(train, F.col(c))).alias("m"), F.stddev_pop(F.when(train, F.col(c))).alias("s")).alias(c) for c in columns]).first()
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).between(bounds[c]["m"] - k * bounds[c]["s"], bounds[c]["m"] + k * bounds[c]["s"])
    return split.where(keep)


def quantile_edges(df: DataFrame, keys: list[str], x: str, bins: int) -> DataFrame:
    """keys, edges: distinct linear-interpolated quantiles; a bin is right-closed and the least value is in the first."""
    points = [i / bins for i in range(bins + 1)]
    return df.groupBy(*keys).agg(F.array_distinct(F.percentile(x, points)).alias("edges"))


def right_closed_bin(x: Column, edges: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e < x))) - 1


def left_closed_bin(x: Column, inner: Column) -> Column:
    """Bins by inner edges; values beyond the ends fall in the end bins."""
    return F.size(F.filter(inner, lambda e: e <= x))


def require_boundary(dates: DataFrame, test_start: str) -> None:
    """A given boundary is a session, and not the first: otherwise one side of the split would be empty or another."""
    row = dates.agg(F.min("date").alias("first"), F.max(F.col("date") == test_start).alias("there")).first()
    if not row["there"]:
        raise ValueError(f"{test_start} is not a session")
    if row["first"] == test_start:
        raise ValueError(f"no session before {test_start} to train on")


def curve_cells(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """A row per value of x with what curves and deviations take from its rows, written once."""
    return settled(df.groupBy(*keys, F.col(x).alias("x")).agg(F.count("*").alias("c"), F.count(y).alias("k"), F.sum(F.col(y).cast("double")).alias("sy"), F.var_pop(y).alias("vy")))


def _variance(n: Column, total: Column, squares: Column) -> Column:
    return F.when(n > 1, F.greatest(F.lit(0.0), squares - total * total / n) / (n - 1))


def _y_variance() -> Column:
    """The sample variance of y over cells: within them and between their means."""
    return _variance(F.sum("k"), F.sum("sy"), F.sum(F.when(F.col("k") > 0, F.col("k") * F.col("vy") + F.col("sy") * F.col("sy") / F.col("k"))))


def cell_curve(cells: DataFrame, keys: list[str], bins: int) -> DataFrame:
    points = [i / bins for i in range(bins + 1)]
    edges = cells.groupBy(*keys).agg(F.array_distinct(F.percentile("x", points, F.col("c"))).alias("edges"))
    own = F.when(F.col("x").isNotNull(), F.col("c"))
    return (
        cells.join(F.broadcast(edges), keys).withColumn("bin", right_closed_bin(F.col("x").cast("double"), F.col("edges")))
        .groupBy(*keys, "bin").agg((F.sum(F.col("x") * F.col("c")) / F.sum(own)).alias("x_mean"), (F.sum("sy") / F.sum("k")).alias("y_mean"), (F.sqrt(_y_variance()) / F.sqrt(F.sum("k"))).alias("standard_error"), F.sum("c").alias("n"))
    )


def cell_scales(cells: DataFrame, keys: list[str], x_name: str, y_name: str) -> DataFrame:
    """Sample deviations of x and y by keys."""
    x, n = F.col("x").cast("double"), F.col("c")
    return cells.groupBy(*keys).agg(F.sqrt(_variance(F.sum(n), F.sum(n * x), F.sum(n * x * x))).alias(x_name), F.sqrt(_y_variance()).alias(y_name))


def quantile_curve(df: DataFrame, keys: list[str], x: str, y: str, bins: int) -> DataFrame:
    """Mean x and y, the standard error of y and counts per quantile bin of x; one row has no standard error. The rows are
    read once and collapsed to the values of x."""
    return cell_curve(curve_cells(df, keys, x, y), keys, bins)


def scaling_windows(trades: DataFrame, horizons: list[int]) -> DataFrame:
    """Non-overlapping windows of h trades by session: volume (scaled by mean over own session's volume), sign
    imbalance, log return and shares of price-changing and up-less-down steps; only full windows with a next trade.

    All of them are differences of running sums between the trades where a window starts and the next one does, so no
    trade is repeated for its horizons."""
    days = trades.groupBy("date").agg(F.sum("size").alias("day_size"))
    mean = days.agg(F.avg("day_size")).first()[0] or 0.0
    upto = in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.col("mid_raw") - F.lag("mid_raw").over(in_order())
    signed = F.col("sign") * F.col("size")
    before = trades.withColumn("step", step).select(
        "date", "row0", "mid_raw",
        (F.sum(signed).over(upto) - signed).alias("v"), (F.sum("sign").over(upto) - F.col("sign")).alias("e"),
        F.coalesce(F.sum((F.col("step") != 0).cast("int")).over(upto), F.lit(0)).alias("changes"), F.coalesce(F.sum(F.signum("step").cast("int")).over(upto), F.lit(0)).alias("rises"),
    )
    rows = _at_multiples(before, {h: h for h in horizons}).withColumns({f"end_{c}": F.lead(c).over(_by_horizon()) for c in ("row0", "mid_raw", "v", "e", "changes", "rises")})
    rows = rows.where(F.col("end_row0") == F.col("row0") + F.col("horizon")).join(F.broadcast(days.select("date", (F.lit(float(mean)) / F.col("day_size")).alias("scale"))), "date")
    more = lambda c: F.col(f"end_{c}") - F.col(c)
    return rows.select(
        "date", "horizon", F.floor(F.col("row0") / F.col("horizon")).alias("w"), F.col("horizon").cast("long").alias("n"), (more("v") * F.col("scale")).alias("q"),
        (more("e") / F.col("horizon")).alias("mean_sign"), more("e").alias("e"), F.col("mid_raw").alias("opened"), F.col("end_mid_raw").alias("closed"),
        (more("changes") / F.col("horizon")).alias("price_change_probability"), (more("rises") / F.col("horizon")).alias("return_sign_imbalance"),
        F.log(F.col("end_mid_raw").cast("double") / F.col("mid_raw")).alias("impact_log"),
    )


def dfa_fluctuations(trades: DataFrame, scales: list[int]) -> DataFrame:
    """Detrended fluctuation of the summed centred signs by session and scale: mean residual square over segments from
    both ends, each with its own line, from sums alone."""
    day = Window.partitionBy("date")
    t = trades.withColumns({"c": F.col("sign") - F.avg("sign").over(day), "n": F.count("*").over(day)})
    t = t.withColumn("y", F.sum("c").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    rows = t.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).where(F.col("n") >= F.col("scale"))
    s, whole = F.col("scale"), F.floor(F.col("n") / F.col("scale"))
    off = F.col("n") - whole * s
    ahead = F.struct(F.lit("f").alias("way"), F.floor(F.col("row0") / s).alias("seg"), (F.col("row0") % s).alias("i"))
    back = F.struct(F.lit("b").alias("way"), F.floor((F.col("row0") - off) / s).alias("seg"), F.pmod(F.col("row0") - off, s).alias("i"))
    rows = rows.withColumn("p", F.explode(F.array(ahead, back))).where((F.col("p.seg") >= 0) & (F.col("p.seg") < whole))
    i, y = F.col("p.i").cast("double"), F.col("y")
    sums = rows.groupBy("date", "scale", F.col("p.way").alias("way"), F.col("p.seg").alias("seg")).agg(
        F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(i * y).alias("siy")
    )
    n = s.cast("double")
    si, sii = n * (n - 1) / 2, n * (n * n - 1) / 12
    siy = F.col("siy") - si * F.col("sy") / n
    rss = F.col("syy") - F.col("sy") * F.col("sy") / n - siy * siy / sii
    return sums.withColumn("rss", F.greatest(rss, F.lit(0.0))).groupBy("date", "scale").agg(
        F.sqrt(F.avg(F.col("rss") / n)).alias("fluctuation"), F.count("*").alias("segments")
    )

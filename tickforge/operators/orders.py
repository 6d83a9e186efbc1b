"""Market orders put together from executions: pre-trade state by lag, then one aggregate per time and sign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.functions import book as B

ORDER = ["date", "ts_us", "trade_sign"]


def _grouped(rows: DataFrame, count: str) -> DataFrame:
    first = lambda c: F.min_by(c, "event_row")
    price = F.col("price") / F.lit(float(B.PRICE_SCALE))
    return rows.groupBy(*ORDER).agg(
        F.min("event_row").alias("first_event_row"),
        F.max("event_row").alias("last_event_row"),
        F.count("*").alias(count),
        F.sum("size").alias("size"),
        (first(F.col("prev.m2")) / F.lit(2.0 * B.PRICE_SCALE)).alias("mid_price_before"),
        first(F.col("prev.m2")).alias("midpoint_twice_before_raw"),
        F.max_by("m2", "event_row").alias("midpoint_twice_after_raw"),
        (first(F.col("prev.ask_price_1") - F.col("prev.bid_price_1")) / F.lit(float(B.PRICE_SCALE))).alias("spread_before"),
        first(F.when(F.col("trade_sign") == 1, F.col("prev.ask_size_1")).otherwise(F.col("prev.bid_size_1"))).alias("opposite_best_size_before"),
        first(F.when(F.col("trade_sign") == 1, F.col("prev.bid_size_1")).otherwise(F.col("prev.ask_size_1"))).alias("same_side_best_size_before"),
        (F.sum(price * F.col("size")) / F.sum("size")).alias("execution_price_vwap"),
    )


def visible_orders(flow: DataFrame) -> DataFrame:
    """Visible executions (type 4) by session, time and sign of the taker. The first row of a session has no state
    before it and is left out."""
    rows = flow.where("event_type = 4 AND prev IS NOT NULL").withColumn("trade_sign", -F.col("direction"))
    return _grouped(rows, "execution_count")


def scaling_transactions(flow: DataFrame, integer_exact: bool = False) -> DataFrame:
    """Visible and hidden executions (types 4 and 5), signed against the mid before; fills at the mid are left out.

    The default compares doubles, price/10000 with the mean of the scaled quotes; ``integer_exact`` compares whole
    numbers, which tells fills at the mid without rounding.
    """
    scale = F.lit(float(B.PRICE_SCALE))
    if integer_exact:
        sign = F.signum((2 * F.col("price") - F.col("prev.m2")).cast("double"))
    else:
        mid = (F.col("prev.ask_price_1") / scale + F.col("prev.bid_price_1") / scale) / F.lit(2.0)
        sign = F.signum(F.col("price") / scale - mid)
    rows = flow.where("event_type IN (4, 5) AND prev IS NOT NULL").withColumn("trade_sign", sign.cast("int")).where("trade_sign <> 0")
    return _grouped(rows, "transaction_count").select(*ORDER, "first_event_row", "last_event_row", "transaction_count", "size", "mid_price_before", "execution_price_vwap")


def regular_hours(orders: DataFrame, open_us: int = 34_200_000_000, close_us: int = 57_600_000_000) -> DataFrame:
    """The orders of regular trading hours, both ends included."""
    return orders.where(F.col("ts_us").between(open_us, close_us))

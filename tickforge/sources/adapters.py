"""Order-book sessions and trade sessions derived from the general event and line-item tables, in whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNNING = (Window.unboundedPreceding, Window.currentRow)


def lob_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per book event: date, event_row, ts_us (since midnight), message columns and the book after it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    w = Window.partitionBy("date").orderBy("ts", "event_id")
    e = e.withColumn("date", F.date_format("ts", "yyyy-MM-dd")).withColumn("event_row", (F.row_number().over(w) - 1).cast("long"))
    step = F.when(F.col("event_row") % 2 != 0, 0).when(F.col("k") % 5 == 0, -1).when(F.col("k") % 5 == 4, 1).otherwise(0)
    e = e.withColumns({"g": F.floor(F.col("event_row") / 2), "dd": F.dayofmonth("ts").cast("long"), "step": step})
    e = e.withColumn("cum", F.sum("step").over(w.rowsBetween(*RUNNING)))
    g, dd, ticks = F.col("g"), F.col("dd"), 1 + (F.col("g") * 29 + F.col("dd")) % 12
    ask, bid = 1_000_000 + 100 * F.col("cum") + 50 * ticks, 1_000_000 + 100 * F.col("cum") - 50 * ticks
    size = lambda a, b, m: (1 + (g * a + dd * b) % m).cast("int")
    code = F.create_map(*[F.lit(x) for pair in (("click", 1), ("view", 2), ("signup", 3), ("purchase", 4), ("error", 5)) for x in pair])
    at = F.col("ts").cast("timestamp")
    return e.select(
        "date",
        "event_row",
        (F.unix_micros(at) % 86_400_000_000).alias("ts_us"),
        code[F.col("event_type")].cast("int").alias("event_type"),
        F.col("event_id").alias("order_id"),
        (1 + (F.col("event_id") * 7 + F.col("user_id")) % 60).cast("int").alias("size"),
        F.when(F.col("k") % 2 == 0, bid).otherwise(ask).cast("int").alias("price"),
        F.when(F.col("k") % 2 == 0, 1).otherwise(-1).cast("int").alias("direction"),
        ask.cast("int").alias("ask_price_1"),
        size(37, 11, 97).alias("ask_size_1"),
        bid.cast("int").alias("bid_price_1"),
        size(53, 7, 89).alias("bid_size_1"),
        (ask + 100 * (1 + g % 3)).cast("int").alias("ask_price_2"),
        size(41, 5, 120).alias("ask_size_2"),
        (bid - 100 * (1 + (g + 1) % 3)).cast("int").alias("bid_price_2"),
        size(43, 3, 110).alias("bid_size_2"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trade: date (a month), row0, size, sign, mid before the trade in raw units and in currency."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    t = t.withColumns(
        {
            "date": F.date_format("l_shipdate", "yyyy-MM"),
            "size": F.col("l_quantity").cast("long"),
            "sign": F.when((F.col("l_partkey") + F.col("l_suppkey")) % 2 == 0, 1).otherwise(-1),
        }
    )
    w = Window.partitionBy("date").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    move = F.sum(F.col("sign") * F.ceil(F.col("size") / 10)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t.select(
        "date",
        (F.row_number().over(w) - 1).cast("long").alias("row0"),
        "size",
        "sign",
        (1_000_000 + 100 * F.coalesce(move, F.lit(0))).cast("long").alias("mid_raw"),
    )


#: The same tables in DuckDB SQL, as common table expressions.
LOB_SQL = """
e0 AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS date FROM events),
e1 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ts, event_id) - 1 AS event_row FROM e0),
e2 AS (SELECT *, event_row // 2 AS g, CAST(day(ts) AS BIGINT) AS dd,
         CASE WHEN event_row % 2 <> 0 THEN 0 WHEN k % 5 = 0 THEN -1 WHEN k % 5 = 4 THEN 1 ELSE 0 END AS step FROM e1),
e3 AS (SELECT *, CAST(sum(step) OVER (PARTITION BY date ORDER BY event_row ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, 1 + (g * 29 + dd) % 12 AS ticks FROM e2),
e4 AS (SELECT *, 1000000 + 100 * cum + 50 * ticks AS ask, 1000000 + 100 * cum - 50 * ticks AS bid FROM e3),
lob AS (SELECT date, event_row, epoch_us(ts) % 86400000000 AS ts_us,
    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END AS event_type,
    event_id AS order_id, 1 + (event_id * 7 + user_id) % 60 AS size, CASE WHEN k % 2 = 0 THEN bid ELSE ask END AS price,
    CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS direction,
    ask AS ap1, 1 + (g * 37 + dd * 11) % 97 AS as1, bid AS bp1, 1 + (g * 53 + dd * 7) % 89 AS bs1,
    ask + 100 * (1 + g % 3) AS ap2, 1 + (g * 41 + dd * 5) % 120 AS as2, bid - 100 * (1 + (g + 1) % 3) AS bp2, 1 + (g * 43 + dd * 3) % 110 AS bs2
  FROM e4)"""

TRADES_SQL = """
t0 AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS date, CAST(l_quantity AS BIGINT) AS size,
    CASE WHEN (l_partkey + l_suppkey) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM lineitem),
trades AS (SELECT date, row_number() OVER w - 1 AS row0, size, sign,
    CAST(1000000 + 100 * coalesce(sum(sign * ceil(size / 10)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS mid_raw
  FROM t0 WINDOW w AS (PARTITION BY date ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))"""

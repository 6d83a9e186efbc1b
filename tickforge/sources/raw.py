"""Raw sessions: a message CSV and an order-book CSV per day, without headers, whose rows correspond by position."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.book import BOOK
from tickforge.operators.contracts import ContractError

NAME = r"([A-Z.]+)_(\d{4}-\d{2}-\d{2})_(\d+)_(\d+)_(message|orderbook)_(\d+)\.csv$"
PARTS = ("symbol", "date", "start_ms", "end_ms", "kind", "levels")


def discover(spark: SparkSession, folder: str, symbol: str | None = None, year: int | None = None) -> DataFrame:
    """symbol, date, start_ms, end_ms, levels, message, orderbook: the paths of each session's pair, in any store that
    Spark reads. Files without their other half are an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    named = files.where(F.col("path").rlike(NAME)).select("path", *[F.regexp_extract("path", NAME, i + 1).alias(p) for i, p in enumerate(PARTS)])
    if symbol:
        named = named.where(F.col("symbol") == symbol)
    if year:
        named = named.where(F.col("date").startswith(str(year)))
    keys = [p for p in PARTS if p != "kind"]
    path = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("path"))).alias(kind)
    pairs = named.groupBy(*keys).agg(path("message"), path("orderbook")).withColumns({c: F.col(c).cast("long") for c in ("start_ms", "end_ms", "levels")})
    single = [f"{r['symbol']} {r['date']}" for r in pairs.where("message IS NULL OR orderbook IS NULL").limit(5).collect()]
    if single:
        raise ContractError(f"sessions without both files: {', '.join(single)}")
    if pairs.isEmpty():
        raise ContractError(f"no sessions in {folder}")
    return pairs


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """symbol, date, event_row, byte, fields: the lines of each file in order, and the byte at which each starts. A file's
    splits are ordered by where they start; lines end at line feeds, and a carriage return before one is dropped."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    w = Window.partitionBy("path").orderBy("block", "id")
    before = F.sum(F.octet_length("value") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return lines.select(
        F.regexp_extract("path", NAME, 1).alias("symbol"), F.regexp_extract("path", NAME, 2).alias("date"), "path", (F.row_number().over(w) - 1).cast("long").alias("event_row"),
        F.coalesce(before, F.lit(0)).alias("byte"), F.split(F.regexp_replace("value", "\r$", ""), ",").alias("fields"),
    )


def _checked(lines: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    ok = F.when(F.size("fields").isin(list(widths)), F.col("fields")).otherwise(_refused("unexpected number of fields"))
    return lines.withColumn("fields", ok)


def _refused(reason: str, text: Column | None = None) -> Column:
    """An error that names the file, the line and the byte at which the line starts."""
    parts = [F.col("path"), F.lit(":"), (F.col("event_row") + 1).cast("string"), F.lit(" (byte "), F.col("byte").cast("string"), F.lit(f"): {reason}")]
    return F.raise_error(F.concat(*parts, *([F.lit(" "), F.coalesce(text, F.lit(""))] if text is not None else [])))


def nanoseconds(text: Column) -> Column:
    """Seconds with up to nine decimals as whole nanoseconds."""
    valid = text.rlike(r"^\d+(\.\d{1,9})?$")
    return F.when(valid, (text.cast("decimal(18,9)") * F.lit(1_000_000_000)).cast("long")).otherwise(_refused("bad time", text))


def integer(text: Column, kind: str = "int") -> Column:
    """A whole number of a type; others, and those out of its range, are errors whatever the session's ANSI setting."""
    value = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(kind))
    return F.when(value.isNotNull(), value).otherwise(_refused("bad number", text))


def messages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Messages of six fields; a seventh is ignored. Numbers out of range and unknown types are errors."""
    f = lambda i: F.trim(F.col("fields")[i])
    rows = _checked(_lines(spark, paths), (6, 7))
    kind = integer(f(1))
    return rows.select(
        "symbol",
        "date",
        "event_row",
        nanoseconds(f(0)).alias("ts_ns"),
        F.when(kind.between(1, 7), kind).otherwise(_refused("unknown event type", f(1))).alias("event_type"),
        integer(f(2), "long").alias("order_id"),
        integer(f(3)).alias("size"),
        integer(f(4)).alias("price"),
        integer(f(5)).alias("direction"),
    )


def books(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The two-level book after each message."""
    rows = _checked(_lines(spark, paths), (8,))
    return rows.select("symbol", "date", "event_row", *[integer(F.trim(F.col("fields")[i])).alias(c) for i, c in enumerate(BOOK)])


def read_sessions(spark: SparkSession, folder: str, symbol: str | None = None, year: int | None = None, excluded: list[str] = (), close_ns: dict[str, int] | None = None, after_close: bool = False) -> DataFrame:
    """Events of all sessions that aren't excluded, up to their scheduled close (or all, with ``close_us``): the message
    and the book after it.
    What follows orders events within a date, so a folder with several symbols, or with a session at several level
    counts or extents, needs the symbol named; two pairs of one symbol and date are an error."""
    pairs = [r for r in discover(spark, folder, symbol, year).collect() if r["date"] not in set(excluded)]  # a row per session
    if len(symbols := sorted({r["symbol"] for r in pairs})) > 1:
        raise ContractError(f"several symbols, of which one must be named: {', '.join(symbols)}")
    twice = [d for d, n in Counter(r["date"] for r in pairs).items() if n > 1]
    if twice:
        raise ContractError(f"several pairs of files for a session: {', '.join(sorted(twice))}")
    m, b = messages(spark, [r["message"] for r in pairs]), books(spark, [r["orderbook"] for r in pairs])
    session = ["symbol", "date"]
    # lines are counted by file before anything is split or ordered
    path = F.col("_metadata.file_path")
    lines = spark.read.option("lineSep", "\n").text([r[k] for r in pairs for k in ("message", "orderbook")]).select(
        F.regexp_extract(path, NAME, 1).alias("symbol"), F.regexp_extract(path, NAME, 2).alias("date"), F.regexp_extract(path, NAME, 5).alias("kind")
    )
    counts = lines.groupBy(*session).agg(F.count_if(F.col("kind") == "message").alias("m"), F.count_if(F.col("kind") == "orderbook").alias("b"))
    bad = [r["date"] for r in counts.where("m <> b").limit(5).collect()]
    if bad:
        raise ContractError(f"message and book rows differ in number: {', '.join(bad)}")
    closes = {r["date"]: min(r["end_ms"] * 1_000_000, (close_ns or {}).get(r["date"], r["end_ms"] * 1_000_000)) for r in pairs}
    close = F.create_map(*[F.lit(x) for pair in closes.items() for x in pair])[F.col("date")]
    rows = m.join(b, [*session, "event_row"]).withColumn("ts_us", F.floor(F.col("ts_ns") / 1000))
    return rows.withColumn("close_us", F.floor(close / 1000)) if after_close else rows.where(F.col("ts_ns") <= close)


def write_events(events: DataFrame, path: str) -> None:
    """Parquet by session, zstd; the committer publishes whole files only. Sessions that are there already are replaced
    and others left alone, so adding a day twice leaves one copy of it."""
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)

"""A market recording derived from the event table, in the recorded envelope format.

Ten users make one market window; the thirty days of events are laid over its
fifteen minutes, and windows follow one another.  Errors become index prints,
clicks and views book changes, purchases trades, sign-ups venue prints.  The
number of windows grows with the table, so queries on the recording do too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.catalog.base import EVENTS_SQL, events
from tickloom.operators.slices import running
from tickloom.plans.state import Windows
from tickloom.schemas import INDEX_EVENT, INDEX_ID
from tickloom.session import cut

BASE_MS = 1_704_067_200_000
WINDOW_MS = 900_000
SQUEEZE = 2_880_000
USERS_PER_WINDOW = 10
EXCHANGE = "exchange"
SLICE_MS = 300_000

# The same derivation for the SQL side: w = window number, t = receive time in ms.
DERIVED_SQL = f"""{EVENTS_SQL}, r AS (SELECT event_id, user_id // {USERS_PER_WINDOW} AS w, event_type, value, k,
      {BASE_MS} + user_id // {USERS_PER_WINDOW} * {WINDOW_MS} + (t - {BASE_MS} * 1000) // {SQUEEZE} AS t FROM e),
    ticks AS (SELECT *, t AS tick_ms, round(100 * (1 + (value - 50) / 50000), 4) AS price FROM r WHERE event_type = 'error'),
    trade AS (SELECT *, 0.44 + (k % 14) / 100.0::DOUBLE AS price, 1 + floor(value / 5) AS count, CASE WHEN k % 2 = 0 THEN 'bid' ELSE 'ask' END AS taker FROM r WHERE event_type = 'purchase'),
    msgs AS (SELECT *, event_type = 'click' AND event_id % 23 = 0 AS snap,
      1 + sum(CASE WHEN event_id % 97 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY w ORDER BY t, event_id) AS number FROM r WHERE event_type IN ('click', 'view'))"""


def laid_out(spark, sf_dir) -> DataFrame:
    w = F.floor(F.col("user_id") / USERS_PER_WINDOW).cast("long")
    return events(spark, sf_dir).withColumn("w", w).withColumn(
        "ms", F.lit(BASE_MS) + F.col("w") * WINDOW_MS + F.floor((F.col("t") - F.lit(BASE_MS * 1000)) / SQUEEZE).cast("long")
    )


def _ticker(w: Column) -> Column:
    return F.concat(F.lit("M"), F.lpad(w.cast("string"), 6, "0"))


def _price(hundredths: Column) -> Column:
    return F.format_string("%.2f", hundredths / 100.0)


def _levels(first: int, step: int, salt: Column) -> Column:
    return F.array(*[F.array(F.lit(f"{(first + step * i) / 100:.2f}"), (F.lit(3 + i) + salt).cast("string")) for i in range(5)])


def market_json(w: Column) -> Column:
    def iso(s: Column) -> Column:
        return F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    open_s = F.lit(BASE_MS // 1000) + w * (WINDOW_MS // 1000)
    grid = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(0.01).alias("step")))
    return F.struct(
        _ticker(w).alias("ticker"), F.lit("FAMILY").alias("event_ticker"), F.lit("derived").alias("title"), F.lit("active").alias("status"),
        iso(open_s).alias("open_time"), iso(open_s + WINDOW_MS // 1000).alias("close_time"), F.lit(100.0).alias("floor_strike"), grid.alias("price_ranges"),
        F.when(w % 3 == 0, F.when(w % 2 == 0, "yes").otherwise("no")).otherwise("").alias("result"),
    )


def derived_events(spark, sf_dir) -> DataFrame:
    """Envelope rows with file columns (one file per window)."""
    rows = laid_out(spark, sf_dir)
    k, value, ticker = F.col("k"), F.col("value"), _ticker(F.col("w"))
    base = {"w": F.col("w"), "ms": F.col("ms"), "line": F.col("event_id") + 10}

    def envelope(df: DataFrame, source: Column, kind: Column, payload: Column, exchange_ms: Column | None = None) -> DataFrame:
        return df.select(
            F.concat(F.lit("derived/"), _ticker(F.col("w"))).alias("path"),
            F.timestamp_millis(F.lit(BASE_MS)).alias("modified"),
            F.lit(0).cast("long").alias("block"),
            F.col("line").cast("long").alias("line"),
            F.lit(1).alias("schema_version"),
            F.col("ms").alias("receive_ts_ms"),
            (exchange_ms if exchange_ms is not None else F.lit(None)).cast("long").alias("exchange_ts_ms"),
            source.alias("source"),
            kind.alias("event_type"),
            F.to_json(payload).alias("payload"),
        )

    placed = rows.select("*", base["line"].alias("line"))
    exchange = F.lit(EXCHANGE)

    books = placed.filter(F.col("event_type").isin("click", "view")).withColumn(
        "snap", (F.col("event_type") == "click") & (F.col("event_id") % 23 == 0)
    )
    books = running(
        books, ["w"], "ms", "event_id", SLICE_MS, {"n": ("sum", F.when(F.col("event_id") % 97 == 0, 2).otherwise(1).cast("long"))}
    ).withColumn("number", F.col("n") + 1)
    kind = F.when(F.col("snap"), "orderbook_snapshot").otherwise("orderbook_delta")
    is_yes = F.col("event_type") == "click"
    msg = F.struct(
        ticker.alias("market_ticker"),
        F.when(F.col("snap"), _levels(48, -1, k % 9)).alias("yes_dollars_fp"),
        F.when(F.col("snap"), _levels(51, 1, k % 7)).alias("no_dollars_fp"),
        F.when(~F.col("snap"), F.when(is_yes, "yes").otherwise("no")).alias("side"),
        F.when(~F.col("snap"), F.when(is_yes, _price(40 + k % 10)).otherwise(_price(51 + k % 10))).alias("price_dollars"),
        F.when(~F.col("snap"), (F.floor(value % 40) - 12).cast("string")).alias("delta_fp"),
    )
    book_rows = envelope(books, exchange, kind, F.struct(kind.alias("type"), F.col("number").alias("seq"), msg.alias("msg")))

    index_price = F.round(100 * (1 + (value - 50) / 50000), 4)
    data = F.to_json(F.struct(F.col("ms").alias("time"), index_price.cast("string").alias("value")))
    index_rows = envelope(
        placed.filter("event_type = 'error'"), exchange, F.lit(INDEX_EVENT),
        F.struct(F.lit(INDEX_EVENT).alias("type"), F.struct(F.lit(INDEX_ID).alias("index_id"), data.alias("data")).alias("msg")), F.col("ms"),
    )
    trade_msg = F.struct(
        ticker.alias("market_ticker"), _price(44 + k % 14).alias("yes_price_dollars"), (1 + F.floor(value / 5)).cast("string").alias("count_fp"),
        F.when(k % 2 == 0, "bid").otherwise("ask").alias("taker_book_side"),
    )
    trade_rows = envelope(placed.filter("event_type = 'purchase'"), exchange, F.lit("trade"), F.struct(F.lit("trade").alias("type"), trade_msg.alias("msg")), F.col("ms"))

    venue = F.when(k % 3 == 0, "binance").when(k % 3 == 1, "coinbase").otherwise("kraken")
    outside = 100 * (1 + (value - 45) / 40000)
    signups = placed.filter("event_type = 'signup'")
    spot_rows = envelope(signups.filter("k % 2 = 0"), venue, F.lit("spot"), F.struct(outside.alias("price")), F.col("ms") - k * 10)
    depth = F.struct(outside.alias("mid"), (outside + (k - 50) / 1000).alias("microprice"), ((k - 50) / 60).alias("depth_imbalance"))
    depth_rows = envelope(signups.filter("k % 2 = 1"), venue, F.lit("external_orderbook"), depth)

    per_window = rows.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    start = per_window.withColumn("ms", F.lit(BASE_MS) + F.col("w") * WINDOW_MS)
    first_book = F.struct(
        F.lit("orderbook_snapshot").alias("type"), F.lit(1).alias("seq"),
        F.struct(ticker.alias("market_ticker"), _levels(48, -1, F.col("n") % 5).alias("yes_dollars_fp"), _levels(51, 1, F.col("n") % 4).alias("no_dollars_fp")).alias("msg"),
    )
    edges = [
        envelope(start.withColumn("line", F.lit(0)), F.lit("system"), F.lit("market_metadata"), market_json(F.col("w"))),
        envelope(start.withColumn("line", F.lit(1)), exchange, F.lit("feed_status"), F.struct(F.lit("connected").alias("status"))),
        envelope(start.withColumn("line", F.lit(2)), exchange, F.lit("orderbook_snapshot"), first_book),
        envelope(start.withColumn("ms", F.col("ms") + WINDOW_MS).withColumn("line", F.lit(1 << 40)), F.lit("system"), F.lit("market_status_at_close"), market_json(F.col("w"))),
    ]
    out = book_rows
    for part in (index_rows, trade_rows, spot_rows, depth_rows, *edges):
        out = out.unionByName(part)
    return out


def derived_windows(spark, sf_dir) -> Windows:
    return Windows.from_recordings(cut(derived_events(spark, sf_dir)), slice_ms=SLICE_MS)

"""Recorded events: scans, the envelope writer, the market dimension and typed views."""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.parsing import first_filled, iso_seconds, number
from tickloom.functions.quoting import GRID_TYPE, default_grid, signed_by_aggressor
from tickloom.operators.slices import keyed_join
from tickloom.schemas import ENVELOPE, INDEX_EVENT, INDEX_ID, MARKET, ORDER, PAYLOAD, VENUES
from tickloom.session import cut
from tickloom.sources import recording_source

FILE_PATTERN = "{events_,runner_}*.jsonl*"
FAMILIES = "events_*.jsonl*|runner_*.jsonl*"


def _source(spark: SparkSession, paths: str | Sequence[str], pattern: str | None, options: dict[str, int | str]) -> DataFrame:
    recording_source.register(spark)
    reader = spark.read.format(recording_source.NAME).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths)))
    for name, value in {"pattern": pattern, "cores": spark.sparkContext.defaultParallelism, **options}.items():
        if value is not None:
            reader = reader.option(name, value)
    return reader.load()


def scan_lines(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None, **options: int) -> DataFrame:
    """Tolerant scan: every line, with ``readable`` false where it is not JSON and null where it is blank.

    Files are read in tasks of their own, plain ones in parts; a packed file cut short counts as far as it
    reaches, and ``complete`` is false in the row without text that closes it.  Filters on ticker, day, name and
    path keep other files from being opened.
    """
    lines = _source(spark, paths, pattern, options)
    # from_json turns broken text into a struct of nulls; only valid JSON parses as a variant.
    readable = F.try_parse_json("value").isNotNull()
    return lines.withColumn("readable", F.when(F.trim("value") != "", readable))


def scan_recordings(
    spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None, tickers: Sequence[str] | None = None, days: Sequence[datetime.date] | None = None, **options: int
) -> DataFrame:
    """JSON-lines recordings (``.gz`` by suffix) as envelopes, unreadable and blank lines left out.

    ``block``/``line`` give the order of events inside a file, whatever tasks read it.  ``tickers`` and ``days``
    choose files by folder and date.  Store the result (``write_bronze``) rather than rescanning JSON in every job.
    """
    lines = _source(spark, paths, pattern, options).filter("line >= 0")
    for column, wanted in (("ticker", tickers), ("day", days)):
        if wanted is not None:
            lines = lines.filter(F.col(column).isin(list(wanted)))
    events = lines.filter(F.trim("value") != "").select("path", "modified", "block", "line", F.from_json("value", ENVELOPE).alias("e"))
    return events.filter("e.event_type IS NOT NULL OR e.payload IS NOT NULL OR e.receive_ts_ms IS NOT NULL").select("path", "modified", "block", "line", "e.*")


def numbered(lines: DataFrame) -> DataFrame:
    """Scanned lines with ``number``, their exact place in their file from 0, found in two passes.

    The first pass counts the lines of every block; the sums of the blocks before are what a line's number in
    its block lacks.  No task needs a whole file.
    """
    counts = lines.filter("line >= 0").groupBy("path", "block").agg((F.max("line") + 1).alias("_n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    offsets = cut(counts.select("path", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_first")))
    # A block's lines are few, so the blocks themselves spread the rows.  The table of blocks grows with the input and
    # packs well, so Spark would take it for smaller than it is and broadcast it.
    placed = lines.join(offsets.hint("merge"), ["path", "block"], "left")
    return placed.withColumn("number", F.when(F.col("line") >= 0, F.col("_first") + F.col("line"))).drop("_first")


def envelope_rows(
    df: DataFrame, source: Column, event_type: Column, payload: Column, receive_ts_ms: Column, exchange_ts_ms: Column | None = None
) -> DataFrame:
    """Any table as envelope rows; the payload struct becomes JSON text."""
    return df.select(
        F.lit(1).alias("schema_version"),
        receive_ts_ms.cast("long").alias("receive_ts_ms"),
        (exchange_ts_ms if exchange_ts_ms is not None else F.lit(None)).cast("long").alias("exchange_ts_ms"),
        source.alias("source"),
        event_type.alias("event_type"),
        F.to_json(payload).alias("payload"),
    )


def envelope_json(rows: DataFrame) -> Column:
    """The JSON line of an envelope row, its payload nested as an object again."""

    def text(name: str) -> Column:
        held = F.to_json(F.struct(F.col(name).alias("v")))
        return held.substr(F.lit(6), F.length(held) - 6)

    return F.concat(
        F.lit('{"schema_version":'), F.col("schema_version"),
        F.lit(',"receive_ts_ms":'), F.col("receive_ts_ms"),
        F.lit(',"exchange_ts_ms":'), F.coalesce(F.col("exchange_ts_ms").cast("string"), F.lit("null")),
        F.lit(',"source":'), text("source"), F.lit(',"event_type":'), text("event_type"),
        F.lit(',"payload":'), F.coalesce(F.col("payload"), F.lit("{}")), F.lit("}"),
    )


def append_envelopes(rows: DataFrame, path: str, ticker: Column, fragment: Column, order: Sequence[str] = ("receive_ts_ms",), suffix: Column | str = ".jsonl.gz") -> None:
    """Append rows as recordings, one file per ticker and fragment, in the given order; all or none become visible."""
    recording_source.register(rows.sparkSession)
    ending = F.lit(suffix) if isinstance(suffix, str) else suffix
    named = rows.withColumns({"_ticker": ticker, "_fragment": fragment, "_suffix": ending, "_value": envelope_json(rows)})
    placed = named.repartition("_ticker", "_fragment").sortWithinPartitions("_ticker", "_fragment", *order)
    out = placed.select(*(F.col(f"_{c}").alias(c) for c in ("ticker", "fragment", "suffix", "value")))
    out.write.format(recording_source.NAME).mode("append").option("path", path).save()


def write_bronze(events: DataFrame, path: str) -> None:
    """Persist scanned events once, partitioned by day, for every later job to read."""
    events.withColumn("day", F.to_date(F.timestamp_millis("receive_ts_ms"))).write.mode("append").partitionBy("day").parquet(path)


def newest_file(events: DataFrame) -> DataFrame:
    """Path and time of the most recently modified recording."""
    return events.agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))


def market_columns(payload: Column) -> list[Column]:
    m = F.from_json(payload, MARKET)
    ranges = F.transform(
        m["price_ranges"],
        lambda r: F.struct(r["start"].cast("double").alias("start"), r["end"].cast("double").alias("end"), r["step"].cast("double").alias("step")),
    )
    close_ts = iso_seconds(m["close_time"])
    return [
        m["ticker"].alias("ticker"),
        m["event_ticker"].alias("event_ticker"),
        F.coalesce(m["title"], F.lit("")).alias("title"),
        F.coalesce(m["status"], F.lit("")).alias("market_status"),
        iso_seconds(m["open_time"]).alias("open_ts"),
        close_ts.alias("close_ts"),
        F.coalesce(iso_seconds(F.nullif(m["expected_expiration_time"], F.lit(""))), close_ts).alias("expiry_ts"),
        m["floor_strike"].cast("double").alias("strike"),
        F.when(F.size(ranges) > 0, ranges).otherwise(default_grid()).cast(GRID_TYPE).alias("price_ranges"),
        F.coalesce(m["rules_primary"], F.lit("")).alias("rules_primary"),
        F.coalesce(m["rules_secondary"], F.lit("")).alias("rules_secondary"),
        F.coalesce(m["result"], F.lit("")).alias("listed_result"),
    ]


def file_dimension(events: DataFrame) -> DataFrame:
    """One row per file with market metadata: its market, first time, and rank among the market's fragments.

    Files without metadata have no market and drop out, as in window stitching.
    """
    position = F.struct("block", "line")
    is_market = F.col("event_type") == "market_metadata"
    per_file = (
        events.groupBy("path")
        .agg(
            F.min_by(F.when(is_market, F.col("payload")), F.when(is_market, position)).alias("payload"),
            F.min("receive_ts_ms").alias("first_ts"),
            F.max("receive_ts_ms").alias("last_ts"),
            F.max("modified").alias("modified"),
            F.bool_or(F.col("event_type").isin("market_status_at_close", "market_result")).alias("close_seen"),
        )
        .filter(F.col("payload").isNotNull())
        .select("path", "first_ts", "last_ts", "modified", "close_seen", *market_columns(F.col("payload")))
    )
    fragments = Window.partitionBy("ticker").orderBy("first_ts", "path")
    return per_file.withColumn("frag", F.row_number().over(fragments).cast("long"))


def market_dimension(files: DataFrame) -> DataFrame:
    """One row per ticker, from its first file by path; ``fragments`` counts its files."""
    columns = ["event_ticker", "title", "market_status", "open_ts", "close_ts", "expiry_ts", "strike", "price_ranges",
               "rules_primary", "rules_secondary", "listed_result"]
    return (
        files.groupBy("ticker")
        .agg(
            F.min_by(F.struct(*columns), "path").alias("m"),
            F.count(F.lit(1)).alias("fragments"),
            F.min("first_ts").alias("first_ts"),
            F.bool_or("close_seen").alias("close_seen"),
            F.max("modified").alias("modified"),
        )
        .select("ticker", "m.*", "fragments", "first_ts", "close_seen", "modified")
    )


def final_windows(markets: DataFrame, now_s: Column | float, unreadable: DataFrame | None = None) -> DataFrame:
    """Markets that may be compacted.

    Closed over an hour ago and untouched for a minute, or a close marker was
    seen and every fragment is readable.
    """
    now = now_s if isinstance(now_s, Column) else F.lit(float(now_s))
    old = now > F.col("close_ts") + 3600
    if unreadable is not None:
        broken = unreadable.select("ticker").distinct().withColumn("_broken", F.lit(True))
        markets = markets.join(broken, "ticker", "left")
        readable = F.col("_broken").isNull()
    else:
        readable = F.lit(True)
    untouched = now - F.unix_timestamp("modified") > 60
    return markets.filter(F.when(old, untouched).otherwise(F.col("close_seen") & readable)).drop("_broken")


def current_market(markets: DataFrame, now_s: Column | float) -> DataFrame:
    """The open market that closes next, per event family."""
    now = now_s if isinstance(now_s, Column) else F.lit(float(now_s))
    return (
        markets.filter((F.col("close_ts") > now) & F.col("market_status").isin("open", "active"))
        .groupBy("event_ticker")
        .agg(F.min_by(F.struct("ticker", "open_ts", "close_ts", "strike"), F.struct("close_ts", "ticker")).alias("m"))
        .select("event_ticker", "m.*")
    )


def stitch(events: DataFrame, files: DataFrame) -> DataFrame:
    """Events of all fragments under their ticker, ordered by (receive_ts_ms, frag, block, line)."""
    dim = files.select("path", "ticker", "frag")
    return keyed_join(events, dim, ["path"], ["receive_ts_ms", "line"], how="inner").drop("modified")


def parse(events: DataFrame) -> DataFrame:
    """Add the typed payload as struct ``p``; Catalyst prunes the fields a view does not use."""
    return events.withColumn("p", F.from_json("payload", PAYLOAD))


BASE = ["ticker", "receive_ts_ms", *ORDER]


def own_message(kind: str) -> Column:
    return (F.col("p.type") == kind) & (F.col("p.msg.market_ticker") == F.col("ticker"))


def book_messages(parsed: DataFrame) -> DataFrame:
    kind = F.when(own_message("orderbook_snapshot"), "snapshot").when(own_message("orderbook_delta"), "delta")
    return parsed.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        *BASE,
        "kind",
        F.coalesce(F.col("p.seq").cast("long"), F.lit(0).cast("long")).alias("number"),
        F.col("p.msg.yes_dollars_fp").alias("yes_levels"),
        F.col("p.msg.no_dollars_fp").alias("no_levels"),
        F.col("p.msg.side").alias("side"),
        F.col("p.msg.price_dollars").alias("price"),
        F.col("p.msg.delta_fp").alias("delta"),
    )


def index_ticks(parsed: DataFrame) -> DataFrame:
    """Index prints: value, its own clock (receive time where missing), partial settlement average."""
    data = F.from_json("p.msg.data", "time string, value string")
    final = F.col("p.msg.last_60s_windowed_average_15min")
    return (
        parsed.filter((F.col("p.type") == INDEX_EVENT) & (F.col("p.msg.index_id") == INDEX_ID))
        .withColumn("d", data)
        .withColumn("value", number(F.col("d.value")))
        .filter(F.col("value").isNotNull())
        .select(
            *BASE,
            "value",
            F.col("d.time").try_cast("bigint").alias("source_ts_ms"),
            F.coalesce(F.col("d.time").try_cast("bigint"), F.col("receive_ts_ms")).alias("tick_ms"),
            number(F.col("p.msg.avg_60s_data.value")).alias("trailing_60s_average"),
            F.when(final.isNotNull(), number(final["value"])).alias("final_average"),
            F.when(final.isNotNull(), F.coalesce(final["window_size"].try_cast("int"), F.lit(0))).alias("final_count"),
            final["window_end_ts_exclusive"].try_cast("bigint").alias("final_end_ms"),
        )
    )


def trades(parsed: DataFrame) -> DataFrame:
    """Trades of the market: price, count, aggressor side and signed count (null when unreadable)."""
    msg = F.col("p.msg")
    count = number(first_filled(msg["count_fp"], msg["count"]))
    taker = first_filled(msg["taker_book_side"], msg["book_side"])
    return (
        parsed.filter(own_message("trade"))
        .select(
            *BASE,
            number(first_filled(msg["yes_price_dollars"], msg["price_dollars"])).alias("price"),
            count.alias("count"),
            taker.alias("taker_side"),
        )
        .filter((F.col("count") > 0) & F.col("taker_side").isin("bid", "ask"))
        .withColumn("signed", signed_by_aggressor(F.col("count"), F.col("taker_side")))
    )


def venue_spots(parsed: DataFrame) -> DataFrame:
    return (
        parsed.filter(F.col("source").isin(*VENUES) & (F.col("event_type") == "spot"))
        .select(
            *BASE,
            F.col("source").alias("venue"),
            F.coalesce(F.nullif(F.col("exchange_ts_ms"), F.lit(0)), F.col("receive_ts_ms")).alias("venue_ts_ms"),
            number(F.col("p.price")).alias("price"),
        )
        .filter(F.col("price").isNotNull())
    )


def venue_books(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("source").isin(*VENUES) & (F.col("event_type") == "external_orderbook")).select(
        *BASE,
        F.col("source").alias("venue"),
        F.col("receive_ts_ms").alias("venue_ts_ms"),
        number(F.col("p.mid")).alias("mid"),
        number(F.col("p.microprice")).alias("microprice"),
        number(F.col("p.depth_imbalance")).alias("imbalance"),
    )


def incentives_of(payload: Column, ticker: Column) -> Column:
    """Items of an incentive programme list that belong to one market."""
    items = F.from_json(payload, "incentive_programs array<struct<market_ticker:string,incentive_type:string,start_date:string,end_date:string>>")
    return F.filter(items["incentive_programs"], lambda x: x["market_ticker"] == ticker)

"""Raw messages of outside venues as one normalised table of depth updates and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.parsing import field, iso_millis, number

PRICE, QTY = "decimal(18,8)", "decimal(28,10)"
LEVELS = "array<struct<price:string,qty:string>>"

COINBASE = (
    "channel string, timestamp string, sequence_num string, events array<struct<type:string, "
    "updates:array<struct<side:string,event_time:string,price_level:string,new_quantity:string>>, tickers:array<struct<price:string>>>>"
)
KRAKEN = (
    "channel string, type string, data array<struct<symbol:string,bids:array<struct<price:string,qty:string>>,"
    "asks:array<struct<price:string,qty:string>>,checksum:string,timestamp:string,last:string>>"
)


def _side_levels(updates: Column, names: tuple[str, ...]) -> Column:
    chosen = F.filter(updates, lambda u: F.lower(u["side"]).isin(*names))
    return F.transform(chosen, lambda u: F.struct(u["price_level"].alias("price"), u["new_quantity"].alias("qty")))


def _pairs(levels: Column) -> Column:
    return F.transform(levels, lambda p: F.struct(F.get(p, F.lit(0)).alias("price"), F.get(p, F.lit(1)).alias("qty")))


def depth_updates(messages: DataFrame, all_channels: bool = False) -> DataFrame:
    """Depth updates from (venue, receive_ts_ms, line, message, and symbol if known): one row per update.

    With ``all_channels`` messages of other channels that carry a sequence number
    come as kind ``other``, since the number counts over all of them.
    Columns: venue, symbol, receive_ts_ms, line, part, kind (snapshot/update), ts_ms, bids, asks,
    sequence, checksum.  Levels keep the venue's number text (checksums depend on it).
    """
    if "symbol" not in messages.columns:
        messages = messages.withColumn("symbol", F.lit(None).cast("string"))
    base = ["venue", "symbol", "receive_ts_ms", "line"]
    parsed = messages.filter(F.col("venue") == "coinbase").withColumn("m", F.from_json("message", COINBASE))
    others = parsed.filter("m.channel <> 'l2_data' and m.sequence_num is not null").select(
        *base, F.lit(0).alias("part"), F.lit("other").alias("kind"), iso_millis(F.col("m.timestamp")).alias("ts_ms"), F.array().cast(LEVELS).alias("bids"),
        F.array().cast(LEVELS).alias("asks"), F.col("m.sequence_num").cast("long").alias("sequence"), F.lit(None).cast("long").alias("checksum"),
    )
    cb = parsed.filter("m.channel = 'l2_data'").select(*base, F.col("m.timestamp").alias("stamp"), F.col("m.sequence_num").cast("long").alias("sequence"), F.posexplode("m.events").alias("part", "ev"))
    clock = F.array_max(
        F.transform(
            F.filter(F.col("ev.updates"), lambda u: (u["event_time"] != "") & ~u["event_time"].startswith("1970-")), lambda u: iso_millis(u["event_time"])
        )
    )
    coinbase = cb.filter(F.col("ev.type").isin("snapshot", "update")).select(
        *base, "part", F.col("ev.type").alias("kind"), F.greatest(iso_millis(F.col("stamp")), clock).alias("ts_ms"),
        _side_levels(F.col("ev.updates"), ("bid", "buy")).alias("bids"), _side_levels(F.col("ev.updates"), ("ask", "offer", "sell")).alias("asks"),
        "sequence", F.lit(None).cast("long").alias("checksum"),
    )
    kr = messages.filter(F.col("venue") == "kraken").withColumn("m", F.from_json("message", KRAKEN)).filter("m.channel = 'book' and m.type in ('snapshot', 'update')")
    kraken = kr.select(*base, F.col("m.type").alias("kind"), F.posexplode("m.data").alias("part", "d")).select(
        "venue", F.coalesce("symbol", "d.symbol").alias("symbol"), "receive_ts_ms", "line", "part", "kind", iso_millis(F.col("d.timestamp")).alias("ts_ms"),
        F.coalesce("d.bids", F.array().cast(LEVELS)).alias("bids"), F.coalesce("d.asks", F.array().cast(LEVELS)).alias("asks"),
        F.lit(None).cast("long").alias("sequence"), F.col("d.checksum").cast("long").alias("checksum"),
    )
    # Field names that differ in case only (e, E) need the case-sensitive JSON path.
    message = F.col("message")
    bn = messages.filter(F.col("venue") == "binance")

    def side(long: str, short: str) -> Column:
        return F.from_json(F.coalesce(field(message, long), field(message, short)), "array<array<string>>")

    binance = bn.withColumn("_b", side("bids", "b")).withColumn("_a", side("asks", "a")).filter("_b is not null and _a is not null").select(
        *base, F.lit(0).alias("part"), F.lit("snapshot").alias("kind"),
        F.coalesce(F.nullif(field(message, "E").try_cast("bigint"), F.lit(0).cast("long")), F.col("receive_ts_ms")).alias("ts_ms"),
        _pairs(F.col("_b")).alias("bids"), _pairs(F.col("_a")).alias("asks"),
        F.coalesce(field(message, "lastUpdateId"), field(message, "u")).cast("long").alias("sequence"), F.lit(None).cast("long").alias("checksum"),
    )
    found = coinbase.unionByName(kraken).unionByName(binance)
    return found.unionByName(others) if all_channels else found


def venue_trades(messages: DataFrame) -> DataFrame:
    """(venue, receive_ts_ms, line, ts_ms, price) of every price print; crossed or non-positive quotes drop out."""
    base = ["venue", "receive_ts_ms", "line"]
    message = F.col("message")
    bn = messages.filter(F.col("venue") == "binance")
    traded = field(message, "e").isin("trade", "aggTrade") & field(message, "p").isNotNull()
    traded = F.coalesce(traded, F.lit(False))
    bid, ask = number(field(message, "b")), number(field(message, "a"))
    quoted = (bid > 0) & (bid <= ask)

    def clock(name: str) -> Column:
        return F.nullif(field(message, name).try_cast("bigint"), F.lit(0).cast("long"))

    binance = bn.select(
        *base,
        F.when(traded, F.coalesce(clock("T"), clock("E"), F.col("receive_ts_ms"))).otherwise(F.col("receive_ts_ms")).alias("ts_ms"),
        F.when(traded, number(field(message, "p"))).when(quoted, (bid + ask) / 2.0).alias("price"),
    )
    cb = messages.filter(F.col("venue") == "coinbase").withColumn("m", F.from_json("message", COINBASE)).filter("m.channel = 'ticker'")
    coinbase = cb.select(*base, iso_millis(F.col("m.timestamp")).alias("ts_ms"), number(F.get(F.get("m.events", F.lit(0))["tickers"], F.lit(0))["price"]).alias("price"))
    kr = messages.filter(F.col("venue") == "kraken").withColumn("m", F.from_json("message", KRAKEN)).filter("m.channel = 'ticker'")
    kraken = kr.select(*base, F.col("receive_ts_ms").alias("ts_ms"), number(F.get("m.data", F.lit(0))["last"]).alias("price"))
    return coinbase.unionByName(kraken).unionByName(binance).filter("price is not null")


def typed_levels(levels: Column) -> Column:
    return F.transform(levels, lambda x: F.struct(x["price"].cast(PRICE).alias("price"), x["qty"].cast(QTY).alias("qty")))


def best_first(levels: Column, side: str, depth: int) -> Column:
    """Positive levels sorted best first, at most ``depth``."""
    kept = F.filter(levels, lambda x: (x["price"] > 0) & (x["qty"] > 0))
    ordered = F.array_sort(kept)
    return F.slice(F.reverse(ordered) if side == "bid" else ordered, 1, depth)


def book_summary(bids: Column, asks: Column) -> Column:
    """Best prices, mid, microprice and imbalance over all kept levels, in decimals; null when crossed or one-sided."""
    bid, ask = F.get(bids, F.lit(0)), F.get(asks, F.lit(0))

    def total(levels: Column) -> Column:
        return F.aggregate(levels, F.lit(0).cast(QTY), lambda acc, x: (acc + x["qty"]).cast(QTY))

    top = bid["qty"] + ask["qty"]
    mid = (bid["price"] + ask["price"]) / 2
    micro = F.when(top > 0, (ask["price"].cast("double") * bid["qty"].cast("double") + bid["price"].cast("double") * ask["qty"].cast("double")) / top.cast("double")).otherwise(mid.cast("double"))
    depth_bid, depth_ask = total(bids), total(asks)
    both = depth_bid + depth_ask
    return F.when(
        bid.isNotNull() & ask.isNotNull() & (bid["price"] < ask["price"]),
        F.struct(
            bid["price"].cast("double").alias("best_bid"),
            ask["price"].cast("double").alias("best_ask"),
            mid.cast("double").alias("mid"),
            micro.alias("microprice"),
            F.when(both > 0, ((depth_bid - depth_ask) / both).cast("double")).otherwise(0.0).alias("depth_imbalance"),
        ),
    )


def book_checksum(bids: Column, asks: Column) -> Column:
    """CRC-32 over the ten best asks then bids (price and quantity text without dot and leading zeros)."""
    def part(text: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(text, r"\.", ""), "^0+", "")
        return F.when(digits == "", "0").otherwise(digits)

    def side(levels: Column) -> Column:
        return F.array_join(F.transform(F.slice(levels, 1, 10), lambda x: F.concat(part(x["price"]), part(x["qty"]))), "")

    return F.crc32(F.concat(side(asks), side(bids)))


def composite_price(prices: Column, now: Column, max_age_ms: int = 2_000) -> Column:
    """Median of the venues fresh at ``now`` with their spread, from an array of (venue, ts_ms, price)."""
    from tickloom.functions.quoting import true_median

    recent = F.filter(prices, lambda v: now - v["ts_ms"] <= max_age_ms)
    values = F.transform(recent, lambda v: v["price"])
    median = true_median(values)
    return F.when(
        F.size(recent) > 0,
        F.struct(
            now.alias("ts_ms"),
            median.alias("price"),
            F.array_sort(F.transform(recent, lambda v: v["venue"])).alias("venues"),
            F.when(F.size(recent) > 1, (F.array_max(values) - F.array_min(values)) / median * 10_000).otherwise(0.0).alias("dispersion_bps"),
        ),
    )

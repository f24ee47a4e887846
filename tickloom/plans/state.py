"""State of a market at every recorded event, and throttled samples of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.book import best_levels
from tickloom.operators.sampling import greedy_sample
from tickloom.operators.slices import keyed_join, running
from tickloom.operators.volatility import multi_horizon_forecast
from tickloom.schemas import ORDER, VENUES
from tickloom.session import cut
from tickloom.sources import recordings as rec

# Sampling cadence and freshness bound of venue data.
SAMPLE_MS = 250
VENUE_MAX_AGE_MS = 2_000
SLICE_MS = 60_000
HOUR_MS = 3_600_000

T = "receive_ts_ms"
NOT_EXCHANGE = (*VENUES, "system", "strategy", "execution")


@dataclass(frozen=True)
class Windows:
    """Stitched events with their typed views; payloads are parsed once, into a written table."""

    events: DataFrame
    markets: DataFrame
    parsed: DataFrame
    ticks: DataFrame
    trades: DataFrame
    slice_ms: int = SLICE_MS

    @classmethod
    def of(cls, events: DataFrame, markets: DataFrame, slice_ms: int = SLICE_MS) -> Windows:
        parsed = cut(rec.parse(events).drop("payload"))
        return cls(events, markets, parsed, rec.index_ticks(parsed), rec.trades(parsed), slice_ms)

    @classmethod
    def from_recordings(cls, scanned: DataFrame, slice_ms: int = SLICE_MS) -> Windows:
        files = rec.file_dimension(scanned)
        return cls.of(rec.stitch(scanned, files), rec.market_dimension(files), slice_ms)


def from_exchange() -> Column:
    return ~F.col("source").isin(*NOT_EXCHANGE) & ~F.col("source").endswith("_rest")


def warmup_ticks(ticks: DataFrame, markets: DataFrame, lookback_ms: int = HOUR_MS) -> DataFrame:
    """Index ticks of earlier windows of the family within ``lookback_ms`` before a window's first event.

    An interval join made an equi join: both sides carry the time bin of length
    ``lookback_ms``, a tick also the following bin.
    """
    bins = markets.select("ticker", "event_ticker", "first_ts", F.floor(F.col("first_ts") / lookback_ms).alias("_bin"))
    family = markets.select("ticker", "event_ticker", F.col("first_ts").alias("own_first_ts"))
    located = keyed_join(ticks, family, ["ticker"], [T, "line"], how="inner")
    spread = located.withColumn("_b", F.floor(F.col("tick_ms") / lookback_ms)).withColumn(
        "_bin", F.explode(F.array(F.col("_b"), F.col("_b") + 1))
    )
    return (
        spread.drop("ticker", "_b")
        .join(bins, ["event_ticker", "_bin"])
        .filter(
            (F.col("own_first_ts") < F.col("first_ts"))
            & (F.col("tick_ms") >= F.col("first_ts") - lookback_ms)
            & (F.col("tick_ms") < F.col("first_ts"))
        )
        .select("ticker", "tick_ms", "value", F.col("own_first_ts").alias("_prior"), *ORDER)
    )


def index_state(windows: Windows, warm: bool = False) -> DataFrame:
    """Index ticks of each window with the volatility forecast standing after them."""
    ticks = windows.ticks.withColumn("_prior", F.lit(None).cast("long"))
    if warm:
        earlier = warmup_ticks(windows.ticks, windows.markets).withColumn(T, F.col("tick_ms"))
        ticks = ticks.unionByName(earlier, allowMissingColumns=True)
    # Warm-up ticks lie before the window's first event; among equal times the older window comes first.
    order = ["_old", *ORDER]
    ticks = ticks.withColumn("_old", F.coalesce(F.col("_prior"), F.lit(1 << 62)))
    forecast = multi_horizon_forecast(ticks, ["ticker"], T, order, "tick_ms", "value", width=windows.slice_ms)
    return cut(forecast.filter(F.col("_prior").isNull()).drop("_prior", "_old"))


def book_of(windows: Windows) -> tuple[DataFrame, DataFrame]:
    """(best levels after every book message, level changes), both written."""
    book, changes = best_levels(rec.book_messages(windows.parsed), "ticker", T, ORDER, width=windows.slice_ms)
    return cut(book), changes


def market_state(windows: Windows, warm: bool = False, book: DataFrame | None = None) -> DataFrame:
    """One row per event with the latest state of every stream at that point, flat columns.

    Every stream contributes its own rows to one time line; a single carried scan
    over (ticker, slice) fills all of them forward.
    """
    parsed = windows.parsed
    if book is None:
        book, _ = book_of(windows)
    sized = ["bid", "ask", "bid_size", "ask_size", "bid_depth", "ask_depth", "valid", "epoch"]

    def typed(df: DataFrame, tie: int, **columns: Column) -> DataFrame:
        return df.select("ticker", T, *ORDER, F.lit(tie).alias("_tie"), *[c.alias(n) for n, c in columns.items()])

    is_book = rec.own_message("orderbook_snapshot") | rec.own_message("orderbook_delta")
    rows = [
        typed(book, 1, emit=F.lit(True), exchange=F.lit(True), bbo=F.struct(*sized)),
        typed(parsed.filter(~F.coalesce(is_book, F.lit(False))), 1, emit=F.lit(True), exchange=from_exchange()),
        typed(
            windows.ticks, 0,
            idx=F.struct("value", "source_ts_ms", "tick_ms"),
            fin=F.when(F.col("final_average").isNotNull(), F.struct("final_average", "final_count")),
        ),
        typed(index_state(windows, warm), 0, volatility=F.struct(F.col("vol").alias("v"))),
        typed(windows.trades, 0, trade_ms=F.col(T)),
    ]
    spots, depth = rec.venue_spots(parsed), rec.venue_books(parsed)
    rows.append(typed(spots, 0, **{f"spot_{v}": F.when(F.col("venue") == v, F.struct("venue_ts_ms", "price")) for v in VENUES}))
    rows.append(typed(depth, 0, **{f"l2_{v}": F.when(F.col("venue") == v, F.struct("venue_ts_ms", "microprice", "imbalance")) for v in VENUES}))
    line = rows[0]
    for part in rows[1:]:
        line = line.unionByName(part, allowMissingColumns=True)

    carried = ["bbo", "idx", "fin", "volatility", "trade_ms", *[f"spot_{v}" for v in VENUES], *[f"l2_{v}" for v in VENUES]]
    state = running(
        line, ["ticker"], T, [*ORDER, "_tie"], windows.slice_ms, {f"s_{c}": ("last", F.col(c)) for c in carried}
    ).filter("emit")
    flat = [
        *[F.col(f"s_bbo.{c}").alias(c) for c in sized],
        F.col("s_idx.value").alias("brti"),
        F.col("s_idx.source_ts_ms").alias("brti_ts_ms"),
        F.col("s_fin.final_average").alias("final_average"),
        F.coalesce(F.col("s_fin.final_count"), F.lit(0)).alias("final_count"),
        F.col("s_volatility.v.sigma_per_s").alias("sigma_per_s"),
        F.col("s_volatility.v.jump_ratio").alias("jump_ratio"),
        F.col("s_trade_ms").alias("trade_ms"),
    ]
    for v in VENUES:
        flat += [
            F.col(f"s_spot_{v}.venue_ts_ms").alias(f"spot_ts_{v}"),
            F.col(f"s_spot_{v}.price").alias(f"spot_{v}"),
            F.col(f"s_l2_{v}.venue_ts_ms").alias(f"l2_ts_{v}"),
            F.col(f"s_l2_{v}.microprice").alias(f"l2_micro_{v}"),
            F.col(f"s_l2_{v}.imbalance").alias(f"l2_imb_{v}"),
        ]
    return state.select("ticker", T, *ORDER, "exchange", *flat)


def priced(state: DataFrame, markets: DataFrame) -> DataFrame:
    """State rows not after close on which everything needed for a price is known."""
    known = F.col("valid") & F.col("bid").isNotNull() & F.col("ask").isNotNull() & F.col("brti").isNotNull() & F.col("sigma_per_s").isNotNull()
    dim = markets.select("ticker", "close_ts", "strike")
    return keyed_join(state.filter(known), dim, ["ticker"], [T, "line"], how="inner").filter(
        F.col(T) / 1000.0 <= F.col("close_ts")
    )


def sample(rows: DataFrame, interval_ms: int = SAMPLE_MS, slice_ms: int = SLICE_MS) -> DataFrame:
    """First row, then the first row at least ``interval_ms`` after the last kept one, per ticker."""
    return greedy_sample(rows, ["ticker"], T, ORDER, interval_ms, slice_ms)


def fresh(names: Sequence[str], clock: str, now: Column, max_age_ms: int = VENUE_MAX_AGE_MS) -> Column:
    """Array of the venues' values whose own clock is recent enough (a clock ahead counts as fresh)."""
    return F.array_compact(
        F.array(*[F.when(now - F.col(f"{clock}_{v}") <= max_age_ms, F.col(n)) for v, n in zip(VENUES, names)])
    )

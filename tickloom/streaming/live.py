"""Streams of recorded events: ingest, sampled books, flow, composite price, monitors, finalisation, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.plans.variants import ToxicityTax
from tickloom.schemas import ENVELOPE
from tickloom.sources import recording_source
from tickloom.streaming.many import FeaturesOfMany, FlowOfMany, SamplerOfMany, by_buckets
from tickloom.streaming.stateful import Composite, SequencedBook, stateful
from tickloom.streaming.timed import LiveFeatures, Silence, VenueBooks, with_state


def envelope_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed recordings as a stream of envelopes with an event-time column ``received``."""
    return (
        spark.readStream.schema(ENVELOPE)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
        .withColumn("received", F.timestamp_millis("receive_ts_ms"))
    )


def recording_stream(spark: SparkSession, path: str, pattern: str = "*", **options: int) -> DataFrame:
    """Recordings that land in ``path`` as a stream of envelopes, with file, place, ticker and ``received``."""
    recording_source.register(spark)
    reader = spark.readStream.format(recording_source.NAME).option("path", path).option("pattern", pattern).option("cores", spark.sparkContext.defaultParallelism)
    for name, value in options.items():
        reader = reader.option(name, value)
    lines = reader.load().filter("line >= 0")
    events = lines.select("path", "ticker", "modified", "block", "line", F.from_json("value", ENVELOPE).alias("e")).filter("e.event_type IS NOT NULL")
    return events.select("path", "ticker", "modified", "block", "line", "e.*").withColumn("received", F.timestamp_millis("receive_ts_ms"))


def ingest(stream: DataFrame, out: str, checkpoint: str, once: bool = False):
    """Append envelopes to the day-partitioned event table; exactly once by the sink's log."""
    writer = (
        stream.withColumn("day", F.to_date("received")).writeStream.format("parquet").partitionBy("day")
        .option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def deduplicated(stream: DataFrame, keys: Sequence[str], t: str = "received", lateness: str = "2 minutes") -> DataFrame:
    """Drop repeats of a sequence number; state is bounded by the watermark."""
    return stream.withWatermark(t, lateness).dropDuplicatesWithinWatermark(list(keys))


def book_stream(messages: DataFrame, t: str = "receive_ts_ms", order: Sequence[str] = ("receive_ts_ms", "line")) -> DataFrame:
    """Best levels and gap events per book message, keyed by ticker."""
    out = (
        f"ticker string, {t} bigint, bid double, ask double, bid_size double, ask_size double, bid_depth double, ask_depth double, "
        "valid boolean, gap boolean, previous_number bigint, number bigint"
    )
    return stateful(messages, ["ticker"], order, lambda: SequencedBook(t), SequencedBook.STATE, out)


def sampled_stream(rows: DataFrame, interval_ms: int, keys: Sequence[str] = ("ticker",), t: str = "receive_ts_ms", order: Sequence[str] = ("receive_ts_ms", "line"), force: str | None = None) -> DataFrame:
    """Throttled rows of a stream (same rule as the batch sampler), optionally with rows that always pass."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return by_buckets(rows, keys, order, lambda: SamplerOfMany(keys, t, interval_ms, force), schema)


def flow_stream(trades: DataFrame, spans_ms: Sequence[int] = (1_000, 5_000, 30_000), t: str = "receive_ts_ms", order: Sequence[str] = ("receive_ts_ms", "line")) -> DataFrame:
    out = f"ticker string, {t} bigint, last_trade_age_ms bigint, " + ", ".join(f"flow_{s} double" for s in spans_ms)
    return by_buckets(trades, ["ticker"], order, lambda: FlowOfMany(["ticker"], t, "signed", spans_ms), out)


def flow_grid(trades: DataFrame, span: str = "5 seconds", step: str = "250 milliseconds", t: str = "received", lateness: str = "30 seconds") -> DataFrame:
    """Flow on a fixed grid with watermarked sliding windows (cheaper, not aligned to samples)."""
    return trades.withWatermark(t, lateness).groupBy("ticker", F.window(t, span, step)).agg(
        F.sum("signed").alias("flow"), F.count(F.lit(1)).alias("trades")
    )


def venue_book_stream(
    updates: DataFrame, depth: int = 10, truncate: bool = False, enforce_sequence: bool = False, verify_checksum: bool = False, idle_ms: int | None = None
) -> DataFrame:
    """Books per venue and symbol from ``depth_updates``, of which the state store holds one entry a level.

    Sequences are checked within a key, so ``enforce_sequence`` is for connections
    that carry one symbol; take ``depth_updates(..., all_channels=True)`` with it.  With ``idle_ms`` (and a watermark) a
    book is forgotten when event time has passed its last message by so much.
    """
    books = VenueBooks(depth, truncate, enforce_sequence, verify_checksum, idle_ms)
    return with_state(updates, ["venue", "symbol"], books, VenueBooks.OUT, timed=idle_ms is not None)


def composite_stream(prints: DataFrame, max_age_ms: int = 2_000) -> DataFrame:
    """Median price over the fresh venues at every print, keyed by symbol."""
    out = "symbol string, ts_ms bigint, price double, venues int, dispersion_bps double"
    return stateful(prints, ["symbol"], ["ts_ms", "line"], lambda: Composite("ts_ms", max_age_ms), Composite.STATE, out)


def silence_alerts(stream: DataFrame, limits_ms: dict[str, int], default_ms: int = 300_000) -> DataFrame:
    """One alert per source for each time that nothing has come from it for its limit, in event time.

    Needs source, ``receive_ts_ms`` and a watermark on a column of the same time.
    """
    return with_state(stream, ["source"], Silence(limits_ms, default_ms), Silence.OUT)


def finalised_windows(stream: DataFrame, grace_ms: int = 3_600_000) -> DataFrame:
    """(ticker, reason): a window is final at its close marker, or ``grace_ms`` past close in event time.

    Needs ticker, event_type, close_ts (s) and ``received`` with a watermark.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, close_ms = state.get if state.exists else (False, None)
        reason = "grace" if state.hasTimedOut else None
        for batch in batches if not state.hasTimedOut else ():
            if batch["event_type"].isin(["market_status_at_close", "market_result"]).any():
                reason = "close_marker"
            known = batch["close_ts"].dropna()
            close_ms = int(known.iloc[-1] * 1000) if len(known) else close_ms
        emit = reason is not None and not done
        state.update((done or emit, close_ms))
        # A timeout holds for one call only, so every call sets it anew.
        if not (done or emit) and close_ms is not None:
            state.setTimeoutTimestamp(max(close_ms + grace_ms, state.getCurrentWatermarkMs() + 1))
        if emit:
            yield pd.DataFrame({"ticker": [key[0]], "reason": [reason]})

    return stream.groupBy("ticker").applyInPandasWithState(
        watch, "ticker string, reason string", "done boolean, close_ms long", "append", GroupStateTimeout.EventTimeTimeout
    )


def compact_on_final(finals: DataFrame, compact: Callable[[DataFrame], None], checkpoint: str):
    """Run ``compact(tickers)`` for each micro-batch of final windows; a repeated batch finds them stored."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            compact(batch.select("ticker").distinct())

    return finals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def live_features(rows: DataFrame, sample_ms: int = 250, span_ms: int = 5_000, short_ms: int = 1_000) -> DataFrame:
    """Flow and size changes at every decision of a stream of trades and decisions (see ``LiveFeatures``)."""
    added = {"flow_5s": "double", "flow_1s": "double", "trades_5s": "bigint", "bid_size_delta": "double", "ask_size_delta": "double"}
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "signed"]
    schema = ", ".join([*kept, *(f"{n} {t}" for n, t in added.items())])
    return by_buckets(rows, ["ticker"], LiveFeatures.ORDER, lambda: FeaturesOfMany(["ticker"], sample_ms, span_ms, short_ms), schema)


def toxicity_stream(samples: DataFrame, gate: ToxicityTax) -> DataFrame:
    """Per-side toxicity tax on a stream of decisions; venue features are unknown live and impute to the mean."""
    blind = samples.withColumn("ext_micro_lead_bps", F.lit(None).cast("double")).withColumn("ext_imbalance", F.lit(None).cast("double"))
    _, bid_tax, ask_tax = gate.columns(F.col("gbm_fair"))
    return blind.withColumn("bid_tax", bid_tax).withColumn("ask_tax", ask_tax)

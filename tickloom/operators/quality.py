"""Quality of a recorded window, and gaps in sequence numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.parsing import field
from tickloom.operators.slices import keyed_join, running
from tickloom.schemas import ORDER

# Thresholds of the quality flags.
MAX_INDEX_GAP_S = 5.0
LATE_START_S = 120.0


def max_gap(df: DataFrame, keys: Sequence[str], t: str, seq: str | Sequence[str], width: int, out: str) -> DataFrame:
    """Largest difference between consecutive times per key (order by ``seq`` decides who is consecutive)."""
    stepped = running(df, keys, t, seq, width, {"_before": ("lag", F.col(t))})
    return stepped.groupBy(*keys).agg(F.max(F.col(t) - F.col("_before")).alias(out))


def window_quality(events: DataFrame, ticks: DataFrame, markets: DataFrame) -> DataFrame:
    """One row per ticker: fragments, start offset, largest index gap, reconnects, flags."""
    bounds = markets.select("ticker", "open_ts", "close_ts")
    inside = keyed_join(ticks, bounds, ["ticker"], ["receive_ts_ms", "line"], how="inner").filter(
        F.col("tick_ms").between(F.col("open_ts") * 1000, F.col("close_ts") * 1000)
    )
    # Consecutive in arrival order, measured on the index's own clock.
    stepped = running(inside, ["ticker"], "receive_ts_ms", ORDER, 60_000, {"_before": ("lag", F.col("tick_ms"))})
    gaps = stepped.groupBy("ticker").agg(F.max((F.col("tick_ms") - F.col("_before")) / 1000.0).alias("gap"))
    connected = (F.col("event_type") == "feed_status") & (field(F.col("payload"), "status") == "connected")
    starts = events.groupBy("ticker").agg(
        F.min("receive_ts_ms").alias("start_ms"), F.count_if(connected).alias("connects")
    )
    joined = markets.join(starts, "ticker", "left").join(gaps, "ticker", "left")
    measured = joined.select(
        "ticker",
        F.col("fragments").cast("int").alias("fragments"),
        ((F.col("start_ms") - F.col("open_ts") * 1000) / 1000.0).alias("start_offset_s"),
        F.coalesce("gap", F.lit(0.0)).alias("index_max_gap_s"),
        F.greatest(F.lit(0).cast("long"), F.col("connects") - F.col("fragments")).alias("reconnects"),
    )
    return measured.withColumn("flags", quality_flags())


def quality_flags() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("fragments") > 1, F.lit("fragmented")),
            F.when(F.col("index_max_gap_s") > MAX_INDEX_GAP_S, F.lit("brti_gap")),
            F.when(F.col("reconnects") > 0, F.lit("reconnect")),
            F.when(F.col("start_offset_s") > LATE_START_S, F.lit("late_start")),
        )
    )


def sequence_gaps(df: DataFrame, keys: Sequence[str], t: str, seq: str | Sequence[str], number: str, width: int) -> DataFrame:
    """Per key: how often a sequence number skipped, and how many numbers were skipped."""
    stepped = running(df, keys, t, seq, width, {"_before": ("lag", F.col(number))})
    skip = F.col(number) - F.col("_before") - 1
    return stepped.groupBy(*keys).agg(
        F.count_if(skip > 0).alias("gaps"),
        F.coalesce(F.sum(F.when(skip > 0, skip)), F.lit(0).cast("long")).alias("missing"),
        F.count_if(F.col(number) <= F.col("_before")).alias("repeats"),
    )


def sustained(df: DataFrame, keys: Sequence[str], t: str, seq: str | Sequence[str], condition: Column, hold: int, width: int, out: str = "sustained") -> DataFrame:
    """True where ``condition`` has held without a break for at least ``hold`` time units.

    The start of the present stretch is the first true row after the last false
    one; both travel as running values.
    """
    flagged = df.withColumn("_on", F.coalesce(condition, F.lit(False)))
    edged = running(flagged, keys, t, seq, width, {"_was": ("lag", F.col("_on"))})
    starts = F.col("_on") & ~F.coalesce(F.col("_was"), F.lit(False))
    since = running(edged.withColumn("_starts", starts), keys, t, seq, width, {"_since": ("last", F.when(F.col("_starts"), F.col(t)))})
    held = F.col("_on") & ~F.col("_starts") & (F.col(t) - F.col("_since") >= hold)
    return since.withColumn(out, F.coalesce(held, F.lit(False))).drop("_on", "_was", "_starts", "_since")


def consecutive(df: DataFrame, keys: Sequence[str], t: str, seq: str | Sequence[str], condition: Column, width: int, out: str = "streak") -> DataFrame:
    """Length of the present run of rows on which ``condition`` holds."""
    flagged = df.withColumn("_on", F.coalesce(condition, F.lit(False)))
    counted = running(flagged, keys, t, seq, width, {"_n": ("sum", F.lit(1).cast("long"))})
    reset = running(counted, keys, t, seq, width, {"_off": ("last", F.when(~F.col("_on"), F.col("_n")))})
    return reset.withColumn(out, F.col("_n") - F.coalesce(F.col("_off"), F.lit(0))).drop("_on", "_n", "_off")


def changes_only(df: DataFrame, keys: Sequence[str], t: str, seq: str | Sequence[str], value: Column, width: int) -> DataFrame:
    """Rows whose ``value`` differs from the row before (the first row of a key stays)."""
    stepped = running(
        df.withColumn("_value", value).withColumn("_one", F.lit(1)),
        keys, t, seq, width,
        {"_before": ("lag", F.col("_value")), "_any": ("lag", F.col("_one"))},
    )
    return stepped.filter(F.col("_any").isNull() | ~F.col("_value").eqNullSafe(F.col("_before"))).drop("_value", "_one", "_before", "_any")

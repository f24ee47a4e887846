"""Cross checks between independent records of the same thing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.quality import consecutive, sustained
from tickloom.operators.slices import running

POSITION_TOLERANCE = 0.01
FEED_MAX_AGE_MS = 5_000


def position_divergence(fills: DataFrame, polls: DataFrame, keys: Sequence[str], t: str, seq: str, width: int, tolerance: float = POSITION_TOLERANCE) -> DataFrame:
    """At every poll: estimate from the previous poll plus fills since, divergence, and its streak.

    ``fills`` has ``delta`` (null when unreadable), ``polls`` has ``polled``.  The
    fills since a poll are a difference of running sums, so no group is collected.
    """
    line = fills.select(*keys, t, seq, "delta", F.lit(0).alias("_tie")).unionByName(
        polls.select(*keys, t, seq, "polled", F.lit(1).alias("_tie")), allowMissingColumns=True
    )
    summed = running(line, keys, t, ["_tie", seq], width, {"_sum": ("sum", F.coalesce(F.col("delta"), F.lit(0.0)))})
    at_polls = summed.filter(F.col("polled").isNotNull())
    stepped = running(at_polls, keys, t, ["_tie", seq], width, {"_sum0": ("lag", F.col("_sum")), "_polled0": ("lag", F.col("polled"))})
    estimate = F.coalesce(F.col("_polled0"), F.lit(0.0)) + F.col("_sum") - F.coalesce(F.col("_sum0"), F.lit(0.0))
    judged = stepped.withColumn("estimate", estimate).withColumn("divergence", F.col("polled") - F.col("estimate"))
    diverged = F.abs(F.col("divergence")) > tolerance
    return consecutive(judged, keys, t, seq, diverged, width).drop("_tie", "_sum", "_sum0", "_polled0", "delta")


def feed_divergence(book: DataFrame, quotes: DataFrame, keys: Sequence[str], t: str, seq: str | Sequence[str], width: int, tick: float = 0.01, tolerance_ticks: float = 2.0, sustain_ms: int = 5_000) -> DataFrame:
    """Book rows with the latest independent quote and whether they have disagreed long enough to act on.

    A quote older than five seconds, or one side missing, disarms the check.
    """
    seqs = [seq] if isinstance(seq, str) else list(seq)
    line = book.select(*keys, t, *seqs, "bid", "ask", F.lit(1).alias("_tie")).unionByName(
        quotes.select(*keys, t, *seqs, F.struct(F.col("quote_bid").alias("bid"), F.col("quote_ask").alias("ask"), F.col("quote_ts_ms").alias("ts")).alias("_q"), F.lit(0).alias("_tie")),
        allowMissingColumns=True,
    )
    joined = running(line, keys, t, [*seqs, "_tie"], width, {"_quote": ("last", F.col("_q"))}).filter(F.col("_tie") == 1)
    q = F.col("_quote")
    armed = q["bid"].isNotNull() & q["ask"].isNotNull() & (F.col(t) - q["ts"] <= FEED_MAX_AGE_MS)
    limit = tolerance_ticks * max(tick, 1e-9)
    apart = (F.abs(F.col("bid") - q["bid"]) > limit) | (F.abs(F.col("ask") - q["ask"]) > limit)
    return sustained(joined, keys, t, seqs, armed & apart, sustain_ms, width, "diverged").select(
        *keys, t, *seqs, "bid", "ask", q["bid"].alias("quote_bid"), q["ask"].alias("quote_ask"), "diverged"
    )

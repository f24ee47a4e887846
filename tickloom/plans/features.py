"""The 38-column feature table: one row per sample of a market window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.pricing import average_settlement_fair, let, moneyness_z
from tickloom.functions.quoting import basis_points, dispersion_bps, imbalance, microprice, mid_price, upper_median
from tickloom.operators.asof import first_after
from tickloom.operators.flow import rolling
from tickloom.operators.quality import window_quality
from tickloom.operators.settlement import infer_settlement
from tickloom.operators.slices import keyed_join, running
from tickloom.plans.state import T, Windows, fresh, market_state, priced, sample
from tickloom.schemas import FEATURE_COLUMNS, FEATURE_SCHEMA_VERSION, ORDER, VENUES
from tickloom.session import cut

# Flow windows, target horizons and their slack.
FLOW_MS = {"flow_1s": 1_000, "flow_5s": 5_000, "flow_30s": 30_000}
TARGETS_MS = {"fwd_mid_delta_1s": 1_000, "fwd_mid_delta_5s": 5_000, "fwd_mid_delta_30s": 30_000}
TARGET_SLACK_MS = 1_500


def seconds_to_close() -> Column:
    return F.greatest(F.lit(0.0), F.col("close_ts") - F.col(T) / 1000.0)


def observed_fixings() -> tuple[Column, Column]:
    """(count, sum) of the published final-minute average, used only inside the last minute."""
    usable = (F.col("seconds_to_close") <= 60) & (F.col("final_average") > 0)
    count = F.when(usable, F.least(F.col("final_count"), F.lit(60))).otherwise(0)
    return count, F.when(usable, F.col("final_average") * count).otherwise(0.0)


def attach_flow(samples: DataFrame, trades: DataFrame, slice_ms: int) -> DataFrame:
    """Signed aggressor flow over 1/5/30 s and trade count over 5 s, as of each sample."""
    columns = samples.columns
    line = samples.withColumn("_tie", F.lit(1)).withColumn("_sample", F.lit(True)).unionByName(
        trades.select("ticker", T, *ORDER, "signed", F.lit(0).alias("_tie")), allowMissingColumns=True
    )
    frames = {name: (F.col("signed"), span) for name, span in FLOW_MS.items()}
    frames["trades_5s"] = (F.col("signed").isNotNull().cast("int"), FLOW_MS["flow_5s"])
    flowed = rolling(line, ["ticker"], T, [*ORDER, "_tie"], slice_ms, frames)
    return flowed.filter("_sample").select(*columns, *frames)


def shape_columns(df: DataFrame) -> DataFrame:
    """Book shape, venue and model columns of sampled state; the one definition every consumer uses."""
    now = F.col(T)
    shaped = (
        df.withColumn("seconds_to_close", seconds_to_close())
        .withColumn("mid", mid_price(F.col("bid"), F.col("ask")))
        .withColumn("spread", F.col("ask") - F.col("bid"))
        .withColumn("microprice_minus_mid", microprice(F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("ask_size")) - F.col("mid"))
        .withColumn("imb_top1", imbalance(F.col("bid_size"), F.col("ask_size")))
        .withColumn("imb_top3", imbalance(F.col("bid_depth"), F.col("ask_depth")))
        .withColumn("depth_top3", F.col("bid_depth") + F.col("ask_depth"))
        .withColumn("last_trade_age_ms", now - F.col("trade_ms"))
        .withColumn("_spots", fresh([f"spot_{v}" for v in VENUES], "spot_ts", now))
        .withColumn("_micros", fresh([f"l2_micro_{v}" for v in VENUES], "l2_ts", now))
        .withColumn("_imbs", fresh([f"l2_imb_{v}" for v in VENUES], "l2_ts", now))
    )
    count, total = observed_fixings()
    fair = average_settlement_fair(F.col("strike"), F.col("brti"), F.col("sigma_per_s"), F.col("seconds_to_close"), count, total)
    return (
        shaped.withColumn("ext_basis_bps", basis_points(upper_median(F.col("_spots")), F.col("brti")))
        .withColumn("ext_dispersion_bps", dispersion_bps(F.col("_spots"), F.col("brti")))
        .withColumn("ext_micro_lead_bps", let(upper_median(F.col("_micros")), lambda m: basis_points(m, F.col("brti"))))
        .withColumn("ext_imbalance", upper_median(F.col("_imbs")))
        .withColumn("ext_venues_fresh", F.size("_spots"))
        .withColumn("_fair", fair)
        .withColumn("gbm_fair", F.col("_fair.yes"))
        .withColumn("gbm_fair_minus_mid", F.col("gbm_fair") - F.col("mid"))
        .withColumn("final_minute_count", F.col("_fair.observed_count"))
        .withColumn("z_moneyness", moneyness_z(F.col("brti"), F.col("strike"), F.col("sigma_per_s"), F.col("seconds_to_close")))
        .drop("_spots", "_micros", "_imbs", "_fair")
    )


def size_deltas(samples: DataFrame, slice_ms: int) -> DataFrame:
    """Change of top sizes since the previous emitted sample, zero on the first."""
    stepped = running(
        samples, ["ticker"], T, ORDER, slice_ms,
        {"_bid": ("lag", F.col("bid_size")), "_ask": ("lag", F.col("ask_size"))},
    )
    return (
        stepped.withColumn("bid_size_delta", F.coalesce(F.col("bid_size") - F.col("_bid"), F.lit(0.0)))
        .withColumn("ask_size_delta", F.coalesce(F.col("ask_size") - F.col("_ask"), F.lit(0.0)))
        .drop("_bid", "_ask")
    )


def forward_targets(samples: DataFrame, t: str, slice_ms: int) -> DataFrame:
    """Mid move to the first sample in [t+h, t+h+slack] of the same window, null without one."""
    moved = first_after(samples, ["ticker"], t, slice_ms, "mid", TARGETS_MS, TARGET_SLACK_MS)
    for name in TARGETS_MS:
        moved = moved.withColumn(name, F.col(name) - F.col("mid"))
    return moved


def sampled_state(windows: Windows, warm: bool = False, state: DataFrame | None = None) -> DataFrame:
    """Samples with flow, shape, venue and model columns, without targets and window labels.

    ``state`` is the written market state, if there is one; sampling reads it twice.
    """
    state = cut(market_state(windows, warm)) if state is None else state
    samples = cut(sample(priced(state, windows.markets), slice_ms=windows.slice_ms))
    flowed = attach_flow(samples, windows.trades, windows.slice_ms)
    return cut(shape_columns(size_deltas(flowed, windows.slice_ms)))


def window_labels(windows: Windows) -> DataFrame:
    """(ticker, outcome_yes, quality_flags, flags): one row per window."""
    settled = infer_settlement(windows.events, windows.ticks, windows.markets)
    quality = window_quality(windows.events, windows.ticks, windows.markets)
    return quality.join(settled, "ticker", "left").select(
        "ticker",
        F.when(F.col("result").isNotNull(), (F.col("result") == "yes").cast("double")).alias("outcome_yes"),
        F.array_join("flags", ",").alias("quality_flags"),
        "flags",
    )


def feature_table(windows: Windows, state: DataFrame | None = None) -> DataFrame:
    """The feature rows of every window; from their written ``market_state``, if there is one."""
    samples = sampled_state(windows, state=state).withColumn("ts_ms", F.col(T))
    targeted = forward_targets(samples, "ts_ms", windows.slice_ms)
    labelled = keyed_join(targeted, window_labels(windows).drop("flags"), ["ticker"], ["ts_ms", "line"])
    return labelled.withColumn("schema_version", F.lit(FEATURE_SCHEMA_VERSION)).select(*FEATURE_COLUMNS)

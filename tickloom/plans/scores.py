"""Scores of many fair-value formulas over all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.pricing import average_settlement_fair, clamp
from tickloom.functions.quoting import upper_median
from tickloom.operators.asof import asof_join
from tickloom.operators.metrics import brier_term, hit_rate, log_loss_term, pearson
from tickloom.operators.slices import keyed_join
from tickloom.plans.features import observed_fixings, seconds_to_close, window_labels
from tickloom.plans.state import T, Windows, fresh, market_state, priced, sample
from tickloom.schemas import ORDER, VENUES
from tickloom.session import cut

# Parameter grid of the compared formulas and the horizons they are judged at.
SIGMA_MULTIPLES = (0.75, 1.0, 1.25)
BASIS_WEIGHTS = (0.25, 0.5, 1.0)
MICRO_WEIGHTS = (0.25, 0.5)
HORIZONS_MS = (100, 500, 1_000, 5_000, 30_000)


def model_fairs() -> Column:
    """Array of (model, fair): the mid, three volatilities, three basis tilts, two microprice leans."""
    count, total = observed_fixings()

    def fair(spot: Column, sigma: Column) -> Column:
        return average_settlement_fair(F.col("strike"), spot, sigma, F.col("seconds_to_close"), count, total)["yes"]

    def named(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("model"), value.alias("fair"))

    out = [named("market_mid", F.col("mid"))]
    out += [
        named(f"sigma_{m:.2f}", F.col("_base") if m == 1.0 else fair(F.col("brti"), F.col("sigma_per_s") * m)) for m in SIGMA_MULTIPLES
    ]
    out += [
        named(f"basis_{b:.2f}", fair(F.col("brti") + b * (F.col("_proxy") - F.col("brti")), F.col("sigma_per_s"))) for b in BASIS_WEIGHTS
    ]
    lean = F.when(
        (F.col("bid_size") > 0) & (F.col("ask_size") > 0),
        (F.col("ask") * F.col("bid_size") + F.col("bid") * F.col("ask_size")) / (F.col("bid_size") + F.col("ask_size")),
    ).otherwise(F.col("mid"))
    out += [
        named(f"microprice_{w:.2f}", clamp(F.col("_base") + w * (lean - F.col("mid")), 0.001, 0.999)) for w in MICRO_WEIGHTS
    ]
    return F.array(*out)


def predictions(windows: Windows) -> DataFrame:
    """Samples with the array ``fairs``; volatility is warmed by the hour of index ticks before the window."""
    samples = cut(sample(priced(cut(market_state(windows, warm=True)), windows.markets), slice_ms=windows.slice_ms))
    count, total = observed_fixings()
    staged = (
        samples.withColumn("seconds_to_close", seconds_to_close())
        .withColumn("mid", (F.col("bid") + F.col("ask")) / 2.0)
        .withColumn("_proxy", F.coalesce(upper_median(fresh([f"spot_{v}" for v in VENUES], "spot_ts", F.col(T))), F.col("brti")))
        .withColumn("_base", average_settlement_fair(F.col("strike"), F.col("brti"), F.col("sigma_per_s"), F.col("seconds_to_close"), count, total)["yes"])
    )
    return staged.withColumn("fairs", model_fairs()).select("ticker", T, *ORDER, "mid", "fairs")


def score_models(windows: Windows, strict: bool = False) -> DataFrame:
    """One row per (model, horizon): samples, windows, Brier, log loss, mean |fair - mid|, IC, hit rate.

    ``strict`` leaves out windows with a quality flag; their ticks still warm later ones.
    """
    rows = cut(predictions(windows))
    labels = window_labels(windows)
    if strict:
        labels = labels.filter(F.size("flags") == 0)
    labels = cut(labels)
    kept = keyed_join(rows, labels.select("ticker", "outcome_yes"), ["ticker"], [T, "line"], how="inner")
    long = kept.select("ticker", T, "mid", "outcome_yes", F.inline("fairs"))
    resolved = F.col("outcome_yes").isNotNull()
    level = long.groupBy("model").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.when(resolved, brier_term(F.col("fair"), F.col("outcome_yes")))).alias("brier"),
        F.avg(F.when(resolved, log_loss_term(F.col("fair"), F.col("outcome_yes")))).alias("log_loss"),
        F.avg(F.abs(F.col("fair") - F.col("mid"))).alias("mean_abs_fair_mid"),
    )
    counted = labels.agg(F.count(F.lit(1)).alias("windows"))

    probes = kept.withColumn("horizon_ms", F.explode(F.array(*[F.lit(h) for h in HORIZONS_MS]))).withColumn("_probe", F.col(T) + F.col("horizon_ms"))
    met = asof_join(
        probes.select("ticker", "horizon_ms", "mid", "fairs", "_probe"), kept.select("ticker", T, "mid"), ["ticker"], "_probe", T,
        width=windows.slice_ms, direction="forward", right_columns=[T, "mid"], out="_m",
    ).filter(F.col("_m").isNotNull())
    moves = met.select("ticker", "horizon_ms", (F.col("_m.mid") - F.col("mid")).alias("move"), "mid", F.inline("fairs")).withColumn(
        "signal", F.col("fair") - F.col("mid")
    )
    per_window = moves.groupBy("model", "horizon_ms", "ticker").agg(
        pearson(F.col("signal"), F.col("move")).alias("ic"),
        hit_rate(F.col("signal"), F.col("move")).alias("hit"),
    )
    ahead = per_window.groupBy("model", "horizon_ms").agg(F.avg("ic").alias("signal_ic"), F.avg("hit").alias("hit_rate"))
    return level.crossJoin(counted).join(ahead, "model", "left").select(
        "model", "horizon_ms", "samples", "windows", "brier", "log_loss", "mean_abs_fair_mid", "signal_ic", "hit_rate"
    )


def excluded_windows(windows: Windows) -> DataFrame:
    """Windows a strict run leaves out, with their flags."""
    return window_labels(windows).filter(F.size("flags") > 0).select("ticker", "quality_flags")

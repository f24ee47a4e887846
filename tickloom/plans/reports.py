"""Report tables over features, outcomes and logged events."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.parsing import field, number
from tickloom.operators.metrics import brier_term, log_loss_term
from tickloom.operators.slices import running


def decile_calibration(df: DataFrame, p: str, outcome: str, keys: Sequence[str] = ()) -> DataFrame:
    """Predicted against realised frequency by probability decile."""
    decile = F.least(F.lit(9), F.floor(F.col(p) * 10).cast("int"))
    return df.filter(F.col(p).isNotNull() & F.col(outcome).isNotNull()).groupBy(*keys, decile.alias("decile")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("predicted"),
        F.avg(F.col(outcome).cast("double")).alias("realised"),
        F.avg(brier_term(F.col(p), F.col(outcome))).alias("brier"),
        F.avg(log_loss_term(F.col(p), F.col(outcome))).alias("log_loss"),
    )


def banded(value: Column, edges: Sequence[float]) -> Column:
    """Index of the band between ``edges`` a value falls in (0 below the first); null stays null."""
    band = F.lit(0)
    for edge in edges:
        band = band + F.when(value >= edge, 1).otherwise(0)
    return F.when(value.isNotNull(), band)


def by_regime(df: DataFrame, dimensions: dict[str, Column], metrics: Sequence[Column]) -> DataFrame:
    """Metrics overall and by each regime dimension on its own (grouping sets of one)."""
    tagged = df.withColumn(
        "_d",
        F.explode(
            F.array(
                F.struct(F.lit("all").alias("dimension"), F.lit(0).alias("band")),
                *[F.struct(F.lit(n).alias("dimension"), c.cast("int").alias("band")) for n, c in dimensions.items()],
            )
        ),
    ).select("*", "_d.*")
    return tagged.filter("band is not null").groupBy("dimension", "band").agg(F.count(F.lit(1)).alias("n"), *metrics)


def by_regime_sets(df: DataFrame, dimensions: dict[str, Column], metrics: Sequence[Column], most: int = 2) -> DataFrame:
    """Metrics overall and by every combination of up to ``most`` regime dimensions, in one aggregation.

    ``by`` names the dimensions of a row's combination, set apart by plus signs; the others' columns are null.  A
    row without a band in a dimension counts where that dimension isn't asked for, and under null where it is.
    """
    banded_rows = df.withColumns({name: band.cast("int") for name, band in dimensions.items()})
    sets = [list(c) for n in range(most + 1) for c in combinations(dimensions, n)]
    by = F.concat_ws("+", *[F.when(F.grouping(name) == 0, F.lit(name)) for name in dimensions])
    return banded_rows.groupingSets(sets, *dimensions).agg(by.alias("by"), F.count(F.lit(1)).alias("n"), *metrics)


def daily_stability(outcomes: DataFrame, day: Column, value: str, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Mean and total per day and variant; flags a variant whose gain comes from one day only."""
    daily = outcomes.groupBy(*keys, day.alias("day")).agg(F.count(F.lit(1)).alias("windows"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    overall = daily.groupBy(*keys).agg(
        F.sum("total").alias("_all"), F.max("total").alias("_best"), F.count_if(F.col("total") > 0).alias("days_up"), F.count(F.lit(1)).alias("days")
    )
    return daily.join(overall, list(keys)).withColumn(
        "single_day_winner", (F.col("_all") > 0) & (F.col("_all") - F.col("_best") <= 0)
    ).drop("_all", "_best")


def stress_flips(outcomes: DataFrame, base: str, value: str = "settlement_pnl") -> DataFrame:
    """Mean result per stressed variant (``name@latency/fee``) and whether its sign differs from ``base``'s."""
    parts = F.split("variant", "@")
    means = outcomes.withColumn("name", parts[0]).groupBy("name", "variant").agg(F.avg(value).alias("mean"))
    base_rows = means.filter(F.split("variant", "@")[1] == base).select("name", F.col("mean").alias("_base"))
    return means.join(base_rows, "name", "left").withColumn("flips", F.signum("mean") != F.signum("_base")).drop("_base")


def pnl_decomposition(money: DataFrame, keys: Sequence[str], mid_at_fill: str, outcome: DataFrame | None = None) -> DataFrame:
    """Spread captured at the fill, five-second markout of the mid, fees, inventory carried and settlement, per key."""
    sign = F.when(F.col("fill_side") == "bid", 1.0).otherwise(-1.0)
    spread = sign * (F.col(mid_at_fill) - F.col("fill_price")) * F.col("fill_count")
    rows = money if outcome is None else money.join(outcome.select("ticker", "outcome_yes"), "ticker", "left")
    parts = [
        F.sum(spread).alias("spread_capture"),
        F.sum(F.col("markout_5s") * F.col("fill_count") - spread).alias("post_fill_move"),
        F.sum("fee").alias("fees"),
        F.sum("signed_count").alias("inventory"),
    ]
    if outcome is not None:
        carried = sign * (F.col("outcome_yes") - F.col(mid_at_fill)) * F.col("fill_count")
        parts += [F.sum(carried).alias("inventory_pnl"), F.sum(spread + carried - F.col("fee")).alias("settlement_pnl")]
    return rows.groupBy(*keys).agg(*parts)


def regime_filter(outcomes: DataFrame, keys: Sequence[str], t: str, value: str, lookback: int, threshold: float, width: int) -> DataFrame:
    """Trailing mean of ``value`` over the ``lookback`` time units before each window, and whether to stand down.

    Only earlier windows count, so the flag is known when the window opens.  Slices are ``lookback`` wide, so a frame
    is the end of one slice and the beginning of the next: two running sums, and no frame is summed row by row.  Where
    ``width`` is larger, a slice is still one ``lookback``.
    """
    from tickloom.operators.slices import OWN, SLICE, with_halo

    haloed = with_halo(outcomes, t, lookback, back=lookback).withColumns({
        # Rows of the slice before stand where they leave the frame.
        "_at": F.when(F.col(OWN), F.col(t)).otherwise(F.col(t) + F.lit(lookback)),
        "_begun": F.when(F.col(OWN), F.col(value)), "_ending": F.when(~F.col(OWN), F.col(value)),
    })
    by = Window.partitionBy(*keys, SLICE)
    earlier = by.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    still = by.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    sums = haloed.select(
        "*", F.sum("_begun").over(earlier).alias("_sum_begun"), F.count("_begun").over(earlier).alias("_n_begun"),
        F.sum("_ending").over(still).alias("_sum_ending"), F.count("_ending").over(still).alias("_n_ending"),
    ).filter(F.col(OWN))
    total = F.coalesce(F.col("_sum_begun") + F.col("_sum_ending"), F.col("_sum_begun"), F.col("_sum_ending"))
    seen = F.col("_n_begun") + F.col("_n_ending")
    trailing = sums.withColumn("trailing", F.when(seen > 0, total / seen)).withColumn("windows_seen", seen)
    return trailing.select(*outcomes.columns, "trailing", "windows_seen").withColumn(
        "stand_down", F.coalesce(F.col("trailing") < threshold, F.lit(False))
    )


def paper_fills(events: DataFrame) -> DataFrame:
    """Logged paper fills as typed rows."""
    p = F.col("payload")
    return events.filter(F.col("event_type") == "paper_fill").select(
        "path", "receive_ts_ms", "line", field(p, "side").alias("fill_side"), number(field(p, "price")).alias("fill_price"),
        number(field(p, "count")).alias("fill_count"), number(field(p, "fair_yes")).alias("fill_fair_yes"), number(field(p, "fee")).alias("fee"),
    )


def paper_summary(events: DataFrame) -> DataFrame:
    """Per run: fills, position, cash and fees from its logged fills."""
    sign = F.when(F.col("fill_side") == "bid", 1.0).otherwise(-1.0)
    return paper_fills(events).groupBy("path").agg(
        F.count(F.lit(1)).alias("fills"),
        F.sum(sign * F.col("fill_count")).alias("position"),
        F.sum(-sign * F.col("fill_price") * F.col("fill_count") - F.col("fee")).alias("cash_flow"),
        F.sum("fee").alias("fees_paid"),
    )


LATENCY_FIELDS = ("round_trip_ms", "brti_to_decision_ms", "book_to_decision_ms")


def latency_rows(events: DataFrame) -> DataFrame:
    """(event_type, measure, ms) of every logged latency."""
    p = F.col("payload")
    items = F.array(*[F.struct(F.lit(f).alias("measure"), number(field(p, f)).alias("ms")) for f in LATENCY_FIELDS])
    logged = events.filter(F.col("event_type").isin("decision", "post_ack", "cancel_ack"))
    return logged.select("event_type", F.inline(items)).filter("ms is not null")


def latency_percentiles(rows: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Exact discrete percentiles per key.

    Values collapse to counts first; the cumulative count runs over slices of the
    value axis, each a hundredth of a value wide, so no group is sorted in one
    task and an outlier adds slices only.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    scaled = counts.withColumn("_axis", F.signum(value) * F.log1p(F.abs(F.col(value))))
    cumulated = running(scaled, keys, "_axis", value, 0.01, {"_cum": ("sum", F.col("_n"))})
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    joined = cumulated.join(totals, list(keys))
    picks = [
        F.min(F.when(F.col("_cum") >= F.ceil(F.lit(q) * F.col("n")), F.col(value))).alias(f"p{int(q * 100)}") for q in quantiles
    ]
    return joined.groupBy(*keys, "n").agg(*picks)

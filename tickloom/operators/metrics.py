"""Scoring metrics as distributed aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.pricing import clamp
from tickloom.operators.slices import running

PROBABILITY_FLOOR = 1e-9
MOVE_FLOOR = 1e-12


def brier_term(p: Column, outcome: Column) -> Column:
    return (p - outcome) * (p - outcome)


def log_loss_term(p: Column, outcome: Column) -> Column:
    clipped = clamp(p, PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)
    return -(outcome * F.log(clipped) + (1.0 - outcome) * F.log(1.0 - clipped))


def pearson(x: Column, y: Column, min_rows: int = 3) -> Column:
    """Aggregate: correlation, null below ``min_rows`` pairs or when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= min_rows) & (spread > 0), F.covar_pop(a, b) / spread)


def window_ic(df: DataFrame, keys: Sequence[str], x: str, y: str, min_rows: int = 3, out: str = "ic") -> DataFrame:
    """Pearson correlation per key; null below ``min_rows`` or when a side is constant."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    return both.groupBy(*keys).agg(
        pearson(F.col(x), F.col(y), min_rows).alias(out), F.count(F.lit(1)).alias("rows")
    )


def hit_rate(signal: Column, move: Column) -> Column:
    """Aggregate: share of equal signs among rows where both are non-zero."""
    counted = (F.abs(signal) > MOVE_FLOOR) & (F.abs(move) > MOVE_FLOOR)
    return F.avg(F.when(counted, (signal * move > 0).cast("double")))


def auc(df: DataFrame, keys: Sequence[str], score: str, target: str, bins: int = 1024) -> DataFrame:
    """Rank-sum AUC with ties counting half; null when a class is missing.

    Rows collapse to counts per distinct score before ranking, and the running
    count of negatives is taken over slices of the score axis, so one large group
    is ranked by many tasks.
    """
    counts = (
        df.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
        .groupBy(*keys, score)
        .agg(F.count_if(F.col(target) == 1.0).alias("_pos"), F.count_if(F.col(target) == 0.0).alias("_neg"))
    )
    if not keys:
        counts = counts.withColumn("_all", F.lit(0))
    group = list(keys) or ["_all"]
    ranked = running(counts, group, score, None, 1.0 / bins, {"_below": ("sum", F.col("_neg"))})
    wins = F.sum(F.col("_pos") * ((F.col("_below") - F.col("_neg")) + 0.5 * F.col("_neg")))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    out = ranked.groupBy(*group).agg(
        F.when(pairs > 0, wins / pairs).alias("auc"),
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
    )
    return out if keys else out.drop("_all")

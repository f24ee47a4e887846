"""As-of joins: the latest (or next) row of one stream at each row of another.

Spark SQL has no as-of join, and a range join would pair every row with every
earlier one.  Both sides are put on one time line and read with an ordered scan,
so each row is shuffled once and no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.slices import OWN, SLICE, running, slice_window, with_halo


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    lt: str,
    rt: str,
    *,
    width: float,
    direction: str = "backward",
    strict: bool = False,
    tolerance: float | None = None,
    left_seq: str | Sequence[str] | None = None,
    right_seq: str | Sequence[str] | None = None,
    right_columns: Sequence[str] | None = None,
    out: str = "matched",
) -> DataFrame:
    """Left rows with struct column ``out`` holding the matched right row (null if none).

    backward: latest right row with time <= left time (< when ``strict``);
    forward: earliest right row with time >= left time (> when ``strict``).
    ``tolerance`` bounds the distance.  Equal right times are ordered by the
    columns ``right_seq``, one after the other: backward takes the last, forward the first.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    keys = list(keys)
    backward = direction == "backward"
    columns = list(right_columns or [c for c in right.columns if c not in keys])
    if rt not in columns:
        columns.append(rt)
    # At equal times the right row must come first to be seen by a backward scan, last by a forward one.
    right_tie = 0 if backward != strict else 1
    left_seq, right_seq = ([s] if isinstance(s, str) else list(s or ()) for s in (left_seq, right_seq))
    ranks = [f"_rank{i}" for i in range(max(len(left_seq), len(right_seq)))]

    def ranked(seq: list[str]) -> list[Column]:
        return [(F.col(seq[i]).cast("long") if i < len(seq) else F.lit(0).cast("long")).alias(name) for i, name in enumerate(ranks)]


    left_rows = left.select(
        *keys,
        F.col(lt).alias("_t"),
        F.lit(1 - right_tie).alias("_tie"),
        *ranked(left_seq),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    right_rows = right.select(
        *keys,
        F.col(rt).alias("_t"),
        F.lit(right_tie).alias("_tie"),
        *ranked(right_seq),
        F.struct(*[F.col(c) for c in columns]).alias("_right"),
    )
    order = ["_tie", *ranks]

    if tolerance is None:
        line = left_rows.unionByName(right_rows, allowMissingColumns=True)
        kind = "last" if backward else "next"
        scanned = running(line, keys, "_t", order, width, {"_hit": (kind, F.col("_right"))})
    else:
        back, ahead = (tolerance, 0) if backward else (0, tolerance)
        line = with_halo(right_rows, "_t", width, back=back, ahead=ahead).unionByName(
            with_halo(left_rows, "_t", width), allowMissingColumns=True
        )
        if backward:
            window = slice_window(keys, "_t", order).rowsBetween(Window.unboundedPreceding, 0)
        else:
            window = (
                Window.partitionBy(*keys, SLICE)
                .orderBy(F.col("_t").desc(), *[F.col(c).desc() for c in order])
                .rowsBetween(Window.unboundedPreceding, 0)
            )
        scanned = line.withColumn("_hit", F.last("_right", ignorenulls=True).over(window)).filter(F.col(OWN))

    matched = scanned.filter(F.col("_left").isNotNull())
    hit = F.col("_hit")
    if tolerance is not None:
        distance = F.col("_t") - hit[rt] if backward else hit[rt] - F.col("_t")
        hit = F.when(distance <= F.lit(tolerance), hit)
    return matched.select(*[F.col("_left")[c].alias(c) for c in left.columns], hit.alias(out))


def first_after(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    width: float,
    value: str,
    horizons: dict[str, float],
    slack: float,
    seq: Sequence[str] = (),
) -> DataFrame:
    """For each row and horizon h: ``value`` of the first row with time in [t+h, t+h+slack].

    Rows of one time are ordered by the columns ``seq``, then by value.  All
    horizons share one halo and one sort.
    """
    reach = max(horizons.values()) + slack
    window = slice_window(keys, t)
    haloed = with_halo(df, t, width, ahead=reach)
    earliest = F.struct(F.col(t).alias("t"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(seq)], F.col(value).alias("v"))
    for name, h in horizons.items():
        haloed = haloed.withColumn(name, F.min(earliest).over(window.rangeBetween(int(h), int(h + slack)))["v"])
    return haloed.filter(F.col(OWN)).drop(SLICE, OWN)

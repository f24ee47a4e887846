"""Ordered scans that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task, so a
key holding a third of the table becomes the job.  Here the ordering axis is cut
into slices of fixed width; rows are shuffled by (key, slice) and what must cross
a slice border travels in one summary row per (key, slice):

* ``running`` carries sums, extremes, last/first values, lags and leads,
* ``with_halo`` copies the few border rows that a bounded frame looks back or
  ahead at.

Both are exact: the result does not depend on the width.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

SLICE = "_slice"
OWN = "_own"

KINDS = ("sum", "max", "min", "last", "before", "lag", "lead", "next", "after")


def slice_of(t: str | Column, width: float) -> Column:
    column = F.col(t) if isinstance(t, str) else t
    return F.floor(column / F.lit(width)).cast("long")


def order_columns(t: str, seq: str | Sequence[str] | None) -> list[Column]:
    names = [t] + ([] if seq is None else [seq] if isinstance(seq, str) else list(seq))
    return [F.col(name) for name in names]


def renewed(df: DataFrame) -> DataFrame:
    """Same columns under new attribute ids, for a cogroup with a relative of ``df``."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def slice_window(keys: Sequence[str], t: str, seq: str | Sequence[str] | None = None) -> WindowSpec:
    return Window.partitionBy(*keys, SLICE).orderBy(*order_columns(t, seq))


def with_halo(df: DataFrame, t: str, width: float, back: float = 0, ahead: float = 0) -> DataFrame:
    """Place each row in its own slice and in those whose frames may reach it.

    ``back``/``ahead`` are the reach of the frames that follow.  Filter on
    ``_own`` once the frames are evaluated.
    """
    first = F.floor((F.col(t) - F.lit(ahead)) / F.lit(width)).cast("long")
    last = F.floor((F.col(t) + F.lit(back)) / F.lit(width)).cast("long")
    return df.withColumn(SLICE, F.explode(F.sequence(first, last))).withColumn(
        OWN, F.col(SLICE) == slice_of(t, width)
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    seq: str | Sequence[str] | None,
    width: float,
    values: Mapping[str, tuple[str, Column]],
    keep_slice: bool = False,
) -> DataFrame:
    """Add running values per key in (t, seq) order.

    ``values`` maps an output name to ``(kind, expression)``:

    ``sum max min``  over all rows up to and including this one
    ``last``         latest non-null value up to and including this row
    ``next``         earliest non-null value from this row on
    ``before after`` as ``last``/``next`` but without this row
    ``lag lead``     the neighbouring row's value (null allowed)

    Key columns must not be null.
    """
    for name, (kind, _) in values.items():
        if kind not in KINDS:
            raise ValueError(f"{name}: unknown kind {kind}")
    keys = list(keys)
    order = order_columns(t, seq)
    position = F.struct(*order)
    tmp = {name: f"_v_{name}" for name in values}
    carry = {name: f"_c_{name}" for name in values}

    sliced = df.withColumn(SLICE, slice_of(t, width))
    for name, (kind, expr) in values.items():
        # A neighbour's value may itself be null: a struct keeps "null value" and "no neighbour" apart.
        sliced = sliced.withColumn(tmp[name], F.struct(expr.alias("v")) if kind in ("lag", "lead") else expr)

    def total(name: str, kind: str) -> Column:
        value = F.col(tmp[name])
        known = F.when(value.isNotNull(), position)
        column = {
            "sum": lambda: F.sum(value),
            "max": lambda: F.max(value),
            "min": lambda: F.min(value),
            "last": lambda: F.max_by(value, known),
            "before": lambda: F.max_by(value, known),
            "lag": lambda: F.max_by(value, known),
            "next": lambda: F.min_by(value, known),
            "after": lambda: F.min_by(value, known),
            "lead": lambda: F.min_by(value, known),
        }[kind]()
        return column.alias(tmp[name])

    totals = sliced.groupBy(*keys, SLICE).agg(*[total(name, kind) for name, (kind, _) in values.items()])
    along = Window.partitionBy(*keys).orderBy(SLICE)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after_desc = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)

    def prefix(name: str, kind: str) -> Column:
        value = F.col(tmp[name])
        column = {
            "sum": lambda: F.sum(value).over(before),
            "max": lambda: F.max(value).over(before),
            "min": lambda: F.min(value).over(before),
            "last": lambda: F.last(value, ignorenulls=True).over(before),
            "before": lambda: F.last(value, ignorenulls=True).over(before),
            "lag": lambda: F.last(value, ignorenulls=True).over(before),
            "next": lambda: F.last(value, ignorenulls=True).over(after_desc),
            "after": lambda: F.last(value, ignorenulls=True).over(after_desc),
            "lead": lambda: F.last(value, ignorenulls=True).over(after_desc),
        }[kind]()
        return column.alias(carry[name])

    carries = totals.select(*keys, SLICE, *[prefix(name, kind) for name, (kind, _) in values.items()])
    joined = sliced.join(carries, [*keys, SLICE], "left")

    inside = slice_window(keys, t, seq)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    backwards = Window.partitionBy(*keys, SLICE).orderBy(*[c.desc() for c in order])
    onward = backwards.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    later = backwards.rowsBetween(Window.unboundedPreceding, -1)

    def final(name: str, kind: str) -> Column:
        value, carried = F.col(tmp[name]), F.col(carry[name])
        column = {
            "sum": lambda: F.coalesce(F.sum(value).over(upto) + carried, F.sum(value).over(upto), carried),
            "max": lambda: F.greatest(F.max(value).over(upto), carried),
            "min": lambda: F.least(F.min(value).over(upto), carried),
            "last": lambda: F.coalesce(F.last(value, ignorenulls=True).over(upto), carried),
            "before": lambda: F.coalesce(F.last(value, ignorenulls=True).over(earlier), carried),
            "lag": lambda: F.coalesce(F.lag(value).over(inside), carried)["v"],
            "next": lambda: F.coalesce(F.last(value, ignorenulls=True).over(onward), carried),
            "after": lambda: F.coalesce(F.last(value, ignorenulls=True).over(later), carried),
            "lead": lambda: F.coalesce(F.lead(value).over(inside), carried)["v"],
        }[kind]()
        return column.alias(name)

    kept = [c for c in df.columns if c not in values]
    extra = [SLICE] if keep_slice else []
    return joined.select(*kept, *extra, *[final(name, kind) for name, (kind, _) in values.items()])


def reflected_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    seq: str | Sequence[str] | None,
    width: float,
    delta: str,
    out: str,
) -> DataFrame:
    """Running sum that is held at zero from below (a level whose size cannot go negative).

    A step is x -> max(0, x + d).  Any run of steps is x -> max(x + A, B), with
    A the plain sum and B the result of starting at zero, so a slice is
    summarised by (A, B) and the value entering a slice is
    P + max(0, max_j(B_j - P_j)) over the earlier slices, P the prefix sum of A.
    """
    keys = list(keys)
    inside = slice_window(keys, t, seq).rowsBetween(Window.unboundedPreceding, 0)
    sliced = (
        df.withColumn(SLICE, slice_of(t, width))
        .withColumn("_s", F.sum(delta).over(inside))
        .withColumn("_m", F.min("_s").over(inside))
    )
    last_row = F.struct(*order_columns(t, seq))
    totals = sliced.groupBy(*keys, SLICE).agg(
        F.max_by("_s", last_row).alias("_a"), F.min("_s").alias("_low")
    ).withColumn("_b", F.col("_a") - F.least(F.col("_low"), F.col("_low") * 0))
    along = Window.partitionBy(*keys).orderBy(SLICE)
    carries = (
        totals.withColumn("_p", F.sum("_a").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_top", F.max(F.col("_b") - F.col("_p")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_end", F.col("_p") + F.greatest(F.col("_top"), F.col("_top") * 0))
        .select(*keys, SLICE, F.lag("_end").over(along).alias("_in"))
    )
    entering = F.coalesce(F.col("_in"), F.col("_s") * 0)
    return (
        sliced.join(carries, [*keys, SLICE], "left")
        .withColumn(out, F.col("_s") + F.greatest(entering, -F.col("_m")))
        .drop(SLICE, "_s", "_m", "_in")
    )


def keyed_join(
    facts: DataFrame, dim: DataFrame, keys: Sequence[str], salt_on: Sequence[str], spread: int = 16, how: str = "left"
) -> DataFrame:
    """Join a table of one or few rows per key to facts in which one key may dominate.

    Spark broadcasts the small side when its measured size allows; when it does
    not, the salt spreads a hot key over ``spread`` tasks instead of one.  The
    salt comes from row values, so a recomputed task routes rows the same way.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(spread)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")

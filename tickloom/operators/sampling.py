"""Throttled sampling: keep a row when at least ``interval`` has passed since the last kept row.

The rule is a recurrence (each kept row decides the next), yet it is run in
parallel over time slices.  The last kept time before a slice fully determines
what the slice keeps, and only values within one interval of the slice start make
a difference, so each slice is summarised by a short step table
"first candidate taken -> last candidate taken".  Chaining those tables over the
slices of a key gives every slice its entering state; then all slices are walked
independently.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.slices import SLICE, running, slice_of


def _next_index(times: np.ndarray, interval: float) -> np.ndarray:
    return np.searchsorted(times, times + interval, side="left")


def step_table(times: np.ndarray, slice_start: float, interval: float) -> tuple[list[float], list[float]]:
    """Bounds and last-kept times: entering probe p <= bounds[j] (first such j) ends at lasts[j]."""
    n = len(times)
    following = _next_index(times, interval)
    ends = np.where(following >= n, np.arange(n), following)
    while True:
        doubled = ends[ends]
        if np.array_equal(doubled, ends):
            break
        ends = doubled
    reach = min(n, int(np.searchsorted(times, slice_start + interval, side="left")) + 1)
    lasts = times[ends[:reach]]
    # Keep one bound per run of equal outcomes.
    cut = np.append(np.flatnonzero(np.diff(lasts) != 0), reach - 1)
    return times[:reach][cut].tolist(), lasts[cut].tolist()


def walk(times: np.ndarray, entering: int | None, interval: float) -> np.ndarray:
    """Positions kept, given the last kept time before the slice."""
    n = len(times)
    following = _next_index(times, interval)
    at = 0 if entering is None else int(np.searchsorted(times, entering + interval, side="left"))
    kept = []
    while at < n:
        kept.append(at)
        at = int(following[at])
    return np.asarray(kept, dtype=np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], mark: str = "_g") -> Iterator[pa.Table]:
    """Re-cut sorted batches so that every table holds complete groups only.

    Thousands of small groups then share one table; only a group that runs past
    its batch is held back.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(mark).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        if held and held[-1].column(mark)[-1].as_py() != ids[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(changes):
            last = int(changes[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, mark: str = "_g") -> list[tuple[int, int]]:
    """(start, end) of every group in a table of whole groups."""
    ids = table.column(mark).to_numpy()
    starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
    return list(zip(starts[:-1].tolist(), starts[1:].tolist()))


def clustered(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a group together in one task and in order, with the group mark ``_g``."""
    marked = df.withColumn("_g", F.xxhash64(*group))
    return marked.repartition(*group).sortWithinPartitions(*group, *order)


def greedy_sample(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    seq: str | Sequence[str],
    interval: int,
    width: int,
) -> DataFrame:
    """Rows of ``df`` kept by the throttle; the first row of a key is always kept.

    Filter to qualifying rows first: only kept rows move the throttle.  ``t`` is
    an integer time and ``width`` (at least ``interval``) the slice length.
    """
    if width < interval:
        raise ValueError("slice width must be at least the sampling interval")
    keys = list(keys)
    seqs = [seq] if isinstance(seq, str) else list(seq)
    group = [*keys, SLICE]
    sliced = df.withColumn(SLICE, slice_of(t, width))
    fields = [*[df.schema[k] for k in keys], T.StructField(SLICE, T.LongType())]
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("_bounds", "_lasts")]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            times, slices = table.column(t).to_numpy(), table.column(SLICE).to_numpy()
            cuts = bounds(table)
            steps = [step_table(times[a:b], slices[a] * width, interval) for a, b in cuts]
            out = table.select(group).take([a for a, _ in cuts])
            for i, name in enumerate(("_bounds", "_lasts")):
                out = out.append_column(name, pa.array([s[i] for s in steps], pa.list_(pa.int64())))
            yield from out.to_batches()

    times_only = clustered(sliced.select(*group, t).distinct(), group, [t])
    tables = times_only.mapInArrow(summarise, T.StructType([*fields, *lists]))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            tables_of, lasts_of = table.column("_bounds").to_pylist(), table.column("_lasts").to_pylist()
            entering: list[int | None] = []
            for a, b in bounds(table):
                last: int | None = None
                for i in range(a, b):
                    entering.append(last)
                    j = 0 if last is None else bisect_left(tables_of[i], last + interval)
                    if j < len(tables_of[i]):
                        last = lasts_of[i][j]
            yield from table.select(group).append_column("_enter", pa.array(entering, pa.int64())).to_batches()

    entries = clustered(tables, keys, [SLICE]).mapInArrow(chain, T.StructType([*fields, T.StructField("_enter", T.LongType())]))

    # The entering state travels as one extra row at the head of its slice, so no join is needed.
    line = sliced.withColumn("_head", F.lit(1)).unionByName(entries.withColumn("_head", F.lit(0)), allowMissingColumns=True)
    columns = df.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            heads = table.column("_head").to_numpy() == 0
            times = table.column(t).fill_null(0).to_numpy()
            enters = table.column("_enter")
            kept = []
            for a, b in bounds(table):
                first = a + 1 if heads[a] else a
                entering = enters[a].as_py() if heads[a] else None
                kept.append(first + walk(times[first:b], entering, interval))
            yield from table.select(columns).take(np.concatenate(kept)).to_batches()

    return clustered(line, group, ["_head", t, *seqs]).mapInArrow(keep, df.schema)


def forced_sample(df: DataFrame, keys: Sequence[str], t: str, seq: str | Sequence[str], interval: int, width: int, force: Column) -> DataFrame:
    """``greedy_sample`` in which rows with ``force`` always pass, and start the throttle anew.

    A forced row decides all that follows, so the rows from one to the next are a key of their own: their count
    so far names it, and its first row, the forced one, is kept by the rule.
    """
    counted = running(df, list(keys), t, seq, width, {"_epoch": ("sum", F.when(force, 1).otherwise(0).cast("long"))})
    return greedy_sample(counted, [*keys, "_epoch"], t, seq, interval, width).drop("_epoch")


def greedy_reference(times: Iterable[float], interval: float) -> list[float]:
    """Plain statement of the rule, for tests."""
    kept: list[float] = []
    for value in sorted(times):
        if not kept or value - kept[-1] >= interval:
            kept.append(value)
    return kept

"""Stateful stream operators over many small keys: a call of Python takes a bucket of keys.

A call per key and micro-batch costs far more than the few rows that it is for, and both keys and micro-batches grow
with the data.  Here keys are dealt to ``BUCKETS`` by a hash; a bucket's rows are sorted by key, and every step is done
for all of its keys at once.  Its state is a few tables with a row per key or trade, as Arrow bytes.  The rows are those
of the processor of one key, which also takes the keys of which a row has no time.
Rows of one key must arrive in order from batch to batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.streaming.stateful import FlowWindow, Sampler

BUCKETS = 512
BUCKET = "_bucket"


def packed(table: pd.DataFrame) -> bytes:
    sink, rows = pa.BufferOutputStream(), pa.Table.from_pandas(table, preserve_index=False)
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(held)).read_all().to_pandas()


def by_buckets(stream: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], ManyKeys], output_schema: str) -> DataFrame:
    """Feed each bucket's rows, sorted by ``order`` within the micro-batch, to its processor."""

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        processor = make()
        if state.exists:
            processor.load([unpacked(held) for held in state.get])
        rows = pd.concat(list(batches)).drop(columns=BUCKET).sort_values(list(order), kind="stable").reset_index(drop=True)
        out = processor.feed(rows)
        state.update(tuple(packed(table) for table in processor.dump()))
        if len(out):
            yield out

    # Whole numbers beside nulls would be floats in Python, so rows with a null key keep to themselves.
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    bucket = F.when(some_null, F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    schema = ", ".join(f"{name} binary" for name in make().TABLES)
    return stream.withColumn(BUCKET, bucket).groupBy(BUCKET).applyInPandasWithState(step, output_schema, schema, "append", GroupStateTimeout.NoTimeout)


class Segments:
    """Rows sorted by key and, within a key, by time; a search within many keys is one search."""

    def __init__(self, code: np.ndarray, t: np.ndarray) -> None:
        self.start = np.flatnonzero(np.diff(code, prepend=-1))
        self.end = np.append(self.start[1:], len(code))[: len(self.start)].astype(np.int64)
        self.key = code[self.start]
        self.of = np.repeat(np.arange(len(self.start)), self.end - self.start)
        self.times = np.unique(t)  # ranks of times can't overflow, whatever their unit
        self.line = self.of * (len(self.times) + 1) + np.searchsorted(self.times, t)

    def search(self, segment: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First row of the segment whose time is ``at`` or later, or the segment's end."""
        return np.searchsorted(self.line, segment * (len(self.times) + 1) + np.searchsorted(self.times, at))

    def walk(self, t: np.ndarray, interval: int, due: np.ndarray, forced: np.ndarray | None = None) -> np.ndarray:
        """Rows that pass a throttle of which ``due`` is the first due row per segment: every key takes a step a round."""
        here = np.arange(len(t))
        after = np.maximum(self.search(self.of, t + interval), here + 1)
        if forced is not None:
            ahead = np.append(np.minimum.accumulate(np.where(forced, here, len(t))[::-1])[::-1], len(t))
            after, due = np.minimum(after, ahead[here + 1]), np.minimum(due, ahead[self.start])
        at, end, out = due, self.end, [np.zeros(0, np.int64)]
        while len(at := at[live := at < end]):
            end = end[live]
            out.append(at)
            at = after[at]
        return np.sort(np.concatenate(out))

    def lasts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, row): the last of ``rows``, which are in order, in each segment that has one."""
        last = rows[np.flatnonzero(np.diff(self.of[rows], append=-1))]
        return self.key[self.of[last]], last


class ManyKeys:
    """State tables by name, the first columns of each being the keys."""

    TABLES: dict[str, tuple[str, ...]] = {}

    def __init__(self, keys: Sequence[str], t: str) -> None:
        self.keys, self.t = list(keys), t
        self.held = {name: pd.DataFrame(columns=[*self.keys, *columns]) for name, columns in self.TABLES.items()}

    def load(self, tables: Sequence[pd.DataFrame]) -> None:
        self.held = dict(zip(self.TABLES, tables))

    def dump(self) -> list[pd.DataFrame]:
        return list(self.held.values())

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows with a number per key, sorted by it; keys with a row without time go one by one."""
        tables = [*self.held.values(), rows]
        names = pd.concat([x[self.keys] for x in tables if len(x)], ignore_index=True)
        code = names.groupby(self.keys, dropna=False, sort=False).ngroup().to_numpy()
        self.names = names.iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)
        *held, mine = np.split(code, np.cumsum([len(x) for x in tables])[:-1])
        self.code = dict(zip(self.held, held))
        order = np.argsort(mine, kind="stable")
        rows, mine = rows.iloc[order].reset_index(drop=True), mine[order]
        timeless = np.isin(mine, mine[rows[self.t].isna().to_numpy()])
        if not timeless.any():
            return self.together(rows, mine)
        out = [self.together(rows[~timeless].reset_index(drop=True), mine[~timeless])] if not timeless.all() else []
        for k in np.unique(mine[timeless]):
            out.append(self.alone(rows[mine == k].reset_index(drop=True), k))
            # The held tables have changed; numbers of keys stay.
        return pd.concat([x for x in out if len(x)] or out[:1], ignore_index=True)

    def together(self, rows: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
        raise NotImplementedError

    def alone(self, rows: pd.DataFrame, k: int) -> pd.DataFrame:
        raise NotImplementedError

    def of_key(self, name: str, k: int) -> pd.DataFrame:
        return self.held[name][self.code[name] == k]

    def put(self, name: str, gone: np.ndarray, code: np.ndarray, **columns: np.ndarray) -> None:
        """Rows of the keys ``gone`` make way for the given ones."""
        stay = ~np.isin(self.code[name], gone)
        new = self.names.iloc[code].reset_index(drop=True).assign(**columns)
        parts = [x for x in (self.held[name][stay], new) if len(x)]
        self.held[name] = pd.concat(parts, ignore_index=True) if parts else new
        self.code[name] = np.concatenate([self.code[name][stay], code])

    def spread(self, name: str, column: str, none: float | int) -> tuple[np.ndarray, np.ndarray]:
        """(value per number of a key, whether there is one) of a table with a row per key."""
        value, known = np.full(len(self.names), none), np.zeros(len(self.names), bool)
        value[self.code[name]] = self.held[name][column].to_numpy(dtype=value.dtype)
        known[self.code[name]] = True
        return value, known


class SamplerOfMany(ManyKeys):
    """``Sampler`` of many keys."""

    TABLES = {"last": ("_last",)}

    def __init__(self, keys: Sequence[str], t: str, interval_ms: int, force: str | None = None) -> None:
        super().__init__(keys, t)
        self.interval, self.force = interval_ms, force

    def together(self, rows: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
        t = rows[self.t].to_numpy(dtype=np.int64)
        forced = rows[self.force].fillna(False).astype(bool).to_numpy() if self.force else None
        last, known = self.spread("last", "_last", 0)
        lines = Segments(code, t)
        due = np.where(known[lines.key], lines.search(np.arange(len(lines.key)), last[lines.key] + self.interval), lines.start)
        passed = lines.walk(t, self.interval, due, forced)
        key, at = lines.lasts(passed)
        self.put("last", key, key, _last=t[at])
        return rows.iloc[passed]

    def alone(self, rows: pd.DataFrame, k: int) -> pd.DataFrame:
        one = Sampler(self.t, self.interval, self.force)
        if len(held := self.of_key("last", k)):
            one.load((int(held["_last"].iloc[0]),))
        out = one.feed(rows)
        if one.last is not None:
            self.put("last", np.array([k]), np.array([k]), _last=np.array([one.last], np.int64))
        return out


class Trades(ManyKeys):
    """Trades of the longest span, from which sums over spans are taken."""

    TABLES = {"trades": ("_ts", "_signed")}
    longest: int

    def sums(self, code: np.ndarray, now: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[int], tuple[np.ndarray, np.ndarray]]]:
        """(times of the trades, how many of its own trades and the held ones a row has behind it, sums over a span).

        Rows are sorted by key and time, and ``value`` is NaN where they aren't trades.
        """
        traded = ~np.isnan(value)
        held = self.held["trades"]
        whose = np.concatenate([self.code["trades"], code[traded]])
        order = np.argsort(whose, kind="stable")  # a key's held trades come before its new ones
        whose = whose[order]
        ts = np.concatenate([held["_ts"].to_numpy(dtype=np.int64), now[traded]])[order]
        signed = np.concatenate([held["_signed"].to_numpy(dtype=float), value[traded]])[order]
        lines = Segments(whose, ts)
        # Sums run within a key, so that no other key's size costs precision.
        total = np.concatenate([[0.0], pd.Series(signed).groupby(whose).cumsum().to_numpy()])
        n_held = np.bincount(self.code["trades"], minlength=len(self.names))
        segment = np.full(len(self.names), -1)
        segment[lines.key] = np.arange(len(lines.key))
        mine, none = segment[code], segment[code] < 0
        start = lines.start[mine] if len(lines.start) else np.zeros(len(code), np.int64)
        seen = np.cumsum(traded)
        seen = seen - (seen - traded)[np.searchsorted(code, code)]  # of the key's rows so far
        upto = start + n_held[code] + seen

        def sum_to(i: np.ndarray) -> np.ndarray:
            return np.where(none | (i <= start), 0.0, total[i])

        def over(span: int) -> tuple[np.ndarray, np.ndarray]:
            first = np.minimum(lines.search(mine, now - span), upto)
            return np.where(none, 0.0, sum_to(upto) - sum_to(first)), np.where(none, 0, upto - first)

        ends = np.flatnonzero(np.diff(code, append=-1))
        bar = np.full(len(self.names), np.iinfo(np.int64).min)
        bar[code[ends]] = now[ends] - self.longest
        keep = ts >= bar[whose]
        self.put("trades", np.arange(len(self.names)), whose[keep], _ts=ts[keep], _signed=signed[keep])
        newest = np.where(seen > 0, ts[np.maximum(upto - 1, 0)] if len(ts) else 0, 0)
        return newest, seen, over


class FlowOfMany(Trades):
    """``FlowWindow`` of many keys."""

    TABLES = Trades.TABLES | {"last": ("_last",)}

    def __init__(self, keys: Sequence[str], t: str, value: str, spans_ms: Sequence[int]) -> None:
        super().__init__(keys, t)
        self.value, self.spans, self.longest = value, tuple(spans_ms), max(spans_ms)

    def together(self, rows: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
        now, value = rows[self.t].to_numpy(dtype=np.int64), pd.to_numeric(rows[self.value]).to_numpy(dtype=float)
        before, known = self.spread("last", "_last", 0)
        newest, seen, over = self.sums(code, now, value)
        out = {self.t: now, "last_trade_age_ms": pd.array(now - np.where(seen > 0, newest, before[code]), dtype="Int64")}
        out |= {f"flow_{span}": over(span)[0] for span in self.spans}
        ends = np.flatnonzero(np.diff(code, append=-1))
        ends = ends[seen[ends] > 0]
        self.put("last", code[ends], code[ends], _last=newest[ends])
        known = (seen > 0) | known[code]
        return pd.DataFrame(out).assign(last_trade_age_ms=lambda d: d["last_trade_age_ms"].mask(~known), **{k: rows[k] for k in self.keys})

    def alone(self, rows: pd.DataFrame, k: int) -> pd.DataFrame:
        one, trades, last = FlowWindow(self.t, self.value, self.spans), self.of_key("trades", k), self.of_key("last", k)
        one.load((trades["_ts"].tolist(), trades["_signed"].tolist(), int(last["_last"].iloc[0]) if len(last) else None))
        out = one.feed(rows).assign(**{c: rows[c] for c in self.keys})
        self.put("trades", np.array([k]), np.full(len(one.ts), k), _ts=one.ts, _signed=one.signed)
        if one.last is not None:
            self.put("last", np.array([k]), np.array([k]), _last=np.array([one.last], np.int64))
        return out


class FeaturesOfMany(Trades):
    """``LiveFeatures`` of many markets."""

    TABLES = Trades.TABLES | {"sampled": ("_ts", "_bid", "_ask")}
    SIZES = ("bid_size", "ask_size")

    def __init__(self, keys: Sequence[str], sample_ms: int = 250, span_ms: int = 5_000, short_ms: int = 1_000) -> None:
        super().__init__(keys, "ts_ms")
        self.sample, self.span, self.short, self.longest = sample_ms, span_ms, short_ms, span_ms

    def together(self, rows: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
        now, value = rows[self.t].to_numpy(dtype=np.int64), pd.to_numeric(rows["signed"]).to_numpy(dtype=float)
        _, _, over = self.sums(code, now, value)
        (flow, trades), (short, _) = over(self.span), over(self.short)
        decisions = np.flatnonzero(np.isnan(value))
        out = rows.iloc[decisions].reset_index(drop=True)
        sizes = [out[c].to_numpy(dtype=float) for c in self.SIZES]
        bases = self._bases(code[decisions], now[decisions], sizes)
        delta = {f"{c}_delta": np.where(np.isnan(was), 0.0, size - was) for c, size, was in zip(self.SIZES, sizes, bases)}
        return out.drop(columns=["signed"]).assign(flow_5s=flow[decisions], flow_1s=short[decisions], trades_5s=trades[decisions].astype(np.int64), **delta)

    def _bases(self, code: np.ndarray, at: np.ndarray, sizes: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Sizes at the key's last sampled decision before each one (NaN: none)."""
        last, known = self.spread("sampled", "_ts", 0)
        lines = Segments(code, at)
        due = np.where(known[lines.key], lines.search(np.arange(len(lines.key)), last[lines.key] + self.sample), lines.start)
        picked = lines.walk(at, self.sample, due)
        # A decision is compared with the last sample before it, not with itself.
        which = np.searchsorted(picked, np.arange(len(at)), side="left") - 1
        chosen = picked[np.maximum(which, 0)] if len(picked) else np.zeros(len(at), np.int64)
        here = (which >= 0) & (chosen >= lines.start[lines.of]) if len(at) else np.zeros(0, bool)
        old = [self.spread("sampled", c, np.nan)[0] for c in ("_bid", "_ask")]
        bases = [np.where(here, size[chosen], was[code]) if len(at) else size for size, was in zip(sizes, old)]
        key, end = lines.lasts(picked)
        self.put("sampled", key, key, _ts=at[end], _bid=sizes[0][end], _ask=sizes[1][end])
        return bases

    def alone(self, rows: pd.DataFrame, k: int) -> pd.DataFrame:
        from tickloom.streaming.timed import LiveFeatures

        one, trades, sampled = LiveFeatures(self.sample, self.span, self.short), self.of_key("trades", k), self.of_key("sampled", k)
        one.load((trades["_ts"].tolist(), trades["_signed"].tolist(), tuple(sampled[["_ts", "_bid", "_ask"]].iloc[0]) if len(sampled) else None))
        out = one.feed(rows)
        ts, signed, last = one.dump()
        self.put("trades", np.array([k]), np.full(len(ts), k), _ts=np.array(ts, np.int64), _signed=np.array(signed, float))
        if last is not None:
            self.put("sampled", np.array([k]), np.array([k]), **{c: np.array([x], kind) for c, x, kind in zip(("_ts", "_bid", "_ask"), last, (np.int64, float, float))})
        return out

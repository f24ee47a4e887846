"""Stream operators with keyed state and event-time timers (transformWithState).

State lives in the state store as values and maps, so a micro-batch writes what it changed and no more: a venue's
book is a map from price to level, of which only touched levels are written.  Timers run on event time; the
stream carries a watermark.  Rows of a key must arrive in order from batch to batch, within a batch in any order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.streaming.ladder import Ladder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS = 7_200_000


def with_state(stream: DataFrame, keys: Sequence[str], processor: StatefulProcessor, output: str, timed: bool = True) -> DataFrame:
    """Run ``processor`` per key; map states need the session's RocksDB store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, output, "Append", "EventTime" if timed else "None")


def _ordered(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(order), kind="stable").reset_index(drop=True)


class Silence(StatefulProcessor):
    """An alert for every stretch of more than a key's limit without a row: (source, last_ts_ms, limit_ms).

    A gap inside a micro-batch is told at once; one that lasts is told by a timer when the watermark passes
    its end, whether or not the source is heard from again.
    """

    OUT = "source string, last_ts_ms bigint, limit_ms bigint"

    def __init__(self, limits_ms: dict[str, int], default_ms: int, t: str = "receive_ts_ms") -> None:
        self.limits, self.default, self.t = limits_ms, default_ms, t

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, told boolean")

    def _alerts(self, key: tuple, last: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"source": key[0], "last_ts_ms": last.astype(np.int64), "limit_ms": self.limits.get(key[0], self.default)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        limit = self.limits.get(key[0], self.default)
        times = np.sort(np.concatenate([b[self.t].to_numpy(dtype=np.int64) for b in rows]))
        told = False
        if self.last.exists():
            before, told = self.last.get()
            times = np.maximum.accumulate(np.concatenate([[before], times]))
            if not told:
                self.handle.deleteTimer(before + limit)
        quiet = np.flatnonzero(np.diff(times) > limit)
        if told:
            quiet = quiet[quiet > 0]  # the first gap was told by its timer
        self.last.update((int(times[-1]), False))
        self.handle.registerTimer(int(times[-1]) + limit)
        if len(quiet):
            yield self._alerts(key, times[quiet])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, told = self.last.get()
        if not told and expiredTimerInfo.getExpiryTimeInMs() == before + self.limits.get(key[0], self.default):
            self.last.update((before, True))
            yield self._alerts(key, np.array([before]))

    def close(self) -> None:
        pass


class VenueBooks(StatefulProcessor):
    """The book of a venue and symbol after every update that leaves it whole, and a report where it is lost."""

    OUT = (
        "venue string, symbol string, receive_ts_ms bigint, line bigint, part int, status string, bids array<struct<price:string,qty:string>>, "
        "asks array<struct<price:string,qty:string>>, expected bigint, received bigint"
    )
    ORDER = ("receive_ts_ms", "line", "part")

    def __init__(self, depth: int = 10, truncate: bool = False, enforce_sequence: bool = False, verify_checksum: bool = False, idle_ms: int | None = None) -> None:
        self.options, self.idle_ms = (depth, truncate, enforce_sequence, verify_checksum), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "sequence bigint, part bigint, ready boolean, until bigint")
        self.levels = {side: handle.getMapState(side, "price string", "text string, qty string") for side in ("bids", "asks")}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        book, until = Ladder(*self.options), None
        if self.place.exists():
            sequence, part, ready, until = self.place.get()
            held = {side: [(price, *level) for (price,), level in levels.iterator()] for side, levels in self.levels.items()}
            book.load(None if sequence is None else (sequence, part), ready, held)
        batch = _ordered(rows, self.ORDER)
        out = pd.concat([self._fed(book, batch.iloc[a:z], a in breaks) for a, z, breaks in self._pieces(batch, until)], ignore_index=True)
        for side, levels in self.levels.items():
            gone, put = book.changes(side)
            for price in gone:
                levels.removeKey((price,))
            for price, text, qty in put:
                levels.updateValue((price,), (text, qty))
        if self.idle_ms is not None:
            if until is not None:
                self.handle.deleteTimer(until)
            until = int(batch["receive_ts_ms"].iloc[-1]) + self.idle_ms
            self.handle.registerTimer(until)
        self.place.update((*(book.at or (None, None)), book.ready, until))
        if len(out):
            yield out.assign(venue=key[0], symbol=key[1])[[c.split(" ")[0] for c in _columns(self.OUT)]]

    def _pieces(self, batch: pd.DataFrame, until: int | None) -> list[tuple[int, int, set[int]]]:
        """Stretches of the batch that no idle time parts, and where such a time ended."""
        times = batch["receive_ts_ms"].to_numpy(dtype=np.int64)
        if self.idle_ms is None:
            return [(0, len(times), set())]
        before = times[0] if until is None else until - self.idle_ms
        breaks = np.flatnonzero(np.diff(times, prepend=before) > self.idle_ms).tolist()
        edges = sorted({0, *breaks})
        return [(a, z, set(breaks)) for a, z in zip(edges, [*edges[1:], len(times)])]

    @staticmethod
    def _fed(book: Ladder, rows: pd.DataFrame, forgotten: bool) -> pd.DataFrame:
        if forgotten:
            book.empty()
            book.at = None
        return book.feed(rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A book that nothing has come for is forgotten, as it would be at the next message."""
        if self.place.exists() and self.place.get()[3] == expiredTimerInfo.getExpiryTimeInMs():
            self.place.clear()
            for levels in self.levels.values():
                levels.clear()
        return iter(())

    def close(self) -> None:
        pass


def _columns(schema: str) -> list[str]:
    """Column definitions of a schema whose types may hold commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


class LiveFeatures:
    """What a toxicity model needs at each decision of a market, from its trades and the decisions before.

    Input rows are trades (``signed`` is set) or decisions (``bid_size`` and ``ask_size`` are set).  A decision gets the
    signed flow of the last second and of five, the number of trades in five, and the change of both sizes since
    the last sampled decision; one is sampled when ``sample_ms`` have gone by since the one before.
    ``many.FeaturesOfMany`` does the same for many markets at once.
    """

    ORDER = ("ts_ms", "line")

    def __init__(self, sample_ms: int = 250, span_ms: int = 5_000, short_ms: int = 1_000) -> None:
        self.sample, self.span, self.short = sample_ms, span_ms, short_ms
        self.ts, self.signed = np.zeros(0, np.int64), np.zeros(0)
        self.sampled: tuple[int, float, float] | None = None

    def load(self, state: tuple) -> None:
        self.ts, self.signed, self.sampled = np.array(state[0], np.int64), np.array(state[1], float), state[2]

    def dump(self) -> tuple:
        return (self.ts.tolist(), self.signed.tolist(), self.sampled)

    def feed(self, batch: pd.DataFrame) -> pd.DataFrame:
        now, signed = batch["ts_ms"].to_numpy(dtype=np.int64), pd.to_numeric(batch["signed"]).to_numpy(dtype=float)
        traded = ~np.isnan(signed)
        held = len(self.ts)
        ts, kept = np.concatenate([self.ts, now[traded]]), np.concatenate([self.signed, signed[traded]])
        sums = np.concatenate([[0.0], np.cumsum(kept)])
        upto = held + np.cumsum(traded)
        decisions = np.flatnonzero(~traded)
        keep = ts >= now[-1] - self.span
        self.ts, self.signed = ts[keep], kept[keep]
        at, upto = now[decisions], upto[decisions]
        first, short = (np.minimum(np.searchsorted(ts, at - span, side="left"), upto) for span in (self.span, self.short))
        bid, ask = (batch[c].to_numpy(dtype=float)[decisions] for c in ("bid_size", "ask_size"))
        base = self._bases(at, bid, ask)
        out = batch.iloc[decisions].reset_index(drop=True)
        delta = {f"{side}_size_delta": np.where(np.isnan(was), 0.0, size - was) for side, size, was in (("bid", bid, base[0]), ("ask", ask, base[1]))}
        return out.drop(columns=["signed"]).assign(flow_5s=sums[upto] - sums[first], flow_1s=sums[upto] - sums[short], trades_5s=(upto - first).astype(np.int64), **delta)

    def _bases(self, at: np.ndarray, bid: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes at the last sampled decision before each one (NaN: none)."""
        last = self.sampled
        picked, i = [], 0 if last is None else int(np.searchsorted(at, last[0] + self.sample, side="left"))
        while i < len(at):
            picked.append(i)
            i = int(np.searchsorted(at, at[i] + self.sample, side="left"))
        # A decision is compared with the last sample before it, not with itself.
        which = np.searchsorted(np.array(picked, np.int64), np.arange(len(at)), side="left") - 1
        old = (np.nan, np.nan) if last is None else last[1:]
        if picked:
            self.sampled = (int(at[picked[-1]]), float(bid[picked[-1]]), float(ask[picked[-1]]))
        chosen = np.array(picked, np.int64)[np.maximum(which, 0)] if picked else np.zeros(len(at), np.int64)
        return tuple(np.where(which >= 0, size[chosen], was) for size, was in ((bid, old[0]), (ask, old[1])))

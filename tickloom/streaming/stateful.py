"""Stateful stream operators, one small state per key (market, or venue and symbol).

Each processor is a plain class with ``load``/``dump`` for its state and ``feed``
for a frame of ordered rows; ``stateful`` runs it under Structured Streaming.
Nothing depends on the wall clock: state is kept as long as the key lives, or,
with a watermark, until event time has passed its last row by ``idle_ms``.
Rows of one key must arrive in order from batch to batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EMPTY = 1e-9  # sizes up to here count as none


def stateful(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], object], state_schema: str, output_schema: str,
    event_ms: str | None = None, idle_ms: int = 7_200_000,
) -> DataFrame:
    """Feed each key's rows, sorted by ``order`` within the micro-batch, to its processor.

    ``event_ms`` names a column of event time in milliseconds; the stream must
    then carry a watermark, which ends a key's state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        processor = make()
        if state.exists:
            processor.load(state.get)
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable").reset_index(drop=True)
        out = processor.feed(rows)
        state.update(processor.dump())
        if event_ms:
            state.setTimeoutTimestamp(max(int(rows[event_ms].max()) + idle_ms, state.getCurrentWatermarkMs() + 1))
        if len(out):
            yield out.assign(**dict(zip(keys, key)))

    timeout = GroupStateTimeout.EventTimeTimeout if event_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(step, output_schema, state_schema, "append", timeout)


class Sampler:
    """Pass a row when ``interval_ms`` has gone by since the last one passed; ``force`` rows always pass."""

    STATE = "last_ms long"

    def __init__(self, t: str, interval_ms: int, force: str | None = None) -> None:
        self.t, self.interval, self.force, self.last = t, interval_ms, force, None

    def load(self, state: tuple) -> None:
        self.last = state[0]

    def dump(self) -> tuple:
        return (self.last,)

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        # From one passed row to the next: the earlier of the next forced row and the first row that is due.
        t = rows[self.t].to_numpy(dtype=np.int64)
        forced = np.flatnonzero(rows[self.force].fillna(False).astype(bool)) if self.force else np.zeros(0, np.int64)
        passed, at = [], 0
        while at < len(t):
            due = at if self.last is None else at + int(np.searchsorted(t[at:], self.last + self.interval, side="left"))
            later = forced[np.searchsorted(forced, at) :]
            at = min(due, int(later[0])) if len(later) else due
            if at < len(t):
                passed.append(at)
                self.last = int(t[at])
                at += 1
        return rows.iloc[passed]


class SequencedBook:
    """Order book of one market: deltas must follow by one, a gap waits for the next snapshot.

    A micro-batch is cut at its snapshots; within a piece the sizes of all levels
    at all messages are one matrix of running sums held at zero.
    """

    STATE = "number long, valid boolean, bids array<struct<k:int,s:double>>, asks array<struct<k:int,s:double>>"

    def __init__(self, t: str, depth: int = 3) -> None:
        self.t, self.depth = t, depth
        self.number: int | None = None
        self.valid = False
        self.sides: dict[str, dict[int, float]] = {"bid": {}, "ask": {}}

    def load(self, state: tuple) -> None:
        self.number, self.valid = state[0], bool(state[1])
        self.sides = {"bid": {int(k): s for k, s in state[2]}, "ask": {int(k): s for k, s in state[3]}}

    def dump(self) -> tuple:
        return (self.number, self.valid, list(self.sides["bid"].items()), list(self.sides["ask"].items()))

    @staticmethod
    def _levels(levels) -> dict[int, float]:
        sized = {round(float(p) * 10_000): float(s) for p, s in (levels if levels is not None else [])}
        return {k: s for k, s in sized.items() if s > 0}

    def _side(self, name: str, level: np.ndarray, delta: np.ndarray) -> dict[str, np.ndarray]:
        """Best price, its size and the depth at every message; ``delta`` is 0 where a message is not for this side."""
        start = self.sides[name]
        ladder = np.array(sorted(set(start) | set(level[delta != 0].tolist()), reverse=name == "bid"), np.int64)
        n = len(level)
        if not len(ladder):
            return {name: np.full(n, np.nan), f"{name}_size": np.zeros(n), f"{name}_depth": np.zeros(n)}
        moves = np.where(level[:, None] == ladder[None, :], delta[:, None], 0.0)
        total = np.cumsum(moves, axis=0) + np.array([start.get(int(k), 0.0) for k in ladder])
        size = total - np.minimum(np.minimum.accumulate(total, axis=0), 0.0)
        shown = np.where(size > EMPTY, size, 0.0)
        there = shown > 0
        best = there.argmax(axis=1)
        some = there.any(axis=1)
        rows = np.arange(n)
        self.sides[name] = {int(k): float(s) for k, s in zip(ladder, shown[-1]) if s > 0}
        return {
            name: np.where(some, ladder[best] / 10_000, np.nan),
            f"{name}_size": np.where(some, shown[rows, best], 0.0),
            f"{name}_depth": np.where(np.cumsum(there, axis=1) <= self.depth, shown, 0.0).sum(axis=1),
        }

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        number = rows["number"].to_numpy(dtype=np.int64)
        snapshot = (rows["kind"] == "snapshot").to_numpy()
        before = np.concatenate([[np.nan if self.number is None else self.number], number[:-1].astype(float)])
        gap = ~snapshot & ~(number == before + 1)
        applied = ~snapshot & ~gap
        level = np.where(applied, np.round(pd.to_numeric(rows["price"]).fillna(0.0) * 10_000), 0).astype(np.int64)
        delta = np.where(applied, pd.to_numeric(rows["delta"]).fillna(0.0), 0.0)
        yes = (rows["side"] == "yes").to_numpy()
        # Valid from a snapshot on, until the next gap.
        order = np.arange(len(rows))
        opened = np.maximum.accumulate(np.where(snapshot, order, -1 if self.valid else -2))
        broken = np.maximum.accumulate(np.where(gap, order, -2 if self.valid else -1))
        parts = []
        for a, z in zip(edges := [0, *(np.flatnonzero(snapshot[1:]) + 1)], [*edges[1:], len(rows)]):
            if snapshot[a]:
                self.sides = {"bid": self._levels(rows["yes_levels"].iloc[a]), "ask": self._levels(rows["no_levels"].iloc[a])}
            one = slice(a, z)
            parts.append(pd.DataFrame(self._side("bid", level[one], np.where(yes[one], delta[one], 0.0)) | self._side("ask", level[one], np.where(yes[one], 0.0, delta[one]))))
        self.number, self.valid = int(number[-1]), bool(opened[-1] > broken[-1])
        out = pd.concat(parts, ignore_index=True)
        return out.assign(**{self.t: rows[self.t], "valid": opened > broken, "gap": gap, "previous_number": pd.array(np.where(np.isnan(before), 0, before).astype(np.int64), dtype="Int64").copy(), "number": number}).assign(
            previous_number=lambda d: d["previous_number"].mask(np.isnan(before))
        )


class FlowWindow:
    """Signed flow over rolling spans at every event, by differences of running sums over the trades kept."""

    STATE = "ts array<long>, signed array<double>, last_ms long"

    def __init__(self, t: str, value: str, spans_ms: Sequence[int]) -> None:
        self.t, self.value, self.spans = t, value, tuple(spans_ms)
        self.ts, self.signed = np.zeros(0, np.int64), np.zeros(0)
        self.last: int | None = None

    def load(self, state: tuple) -> None:
        self.ts, self.signed, self.last = np.array(state[0], np.int64), np.array(state[1], float), state[2]

    def dump(self) -> tuple:
        return (self.ts.tolist(), self.signed.tolist(), self.last)

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        now, value = rows[self.t].to_numpy(dtype=np.int64), pd.to_numeric(rows[self.value]).to_numpy(dtype=float)
        traded = ~np.isnan(value)
        held = len(self.ts)
        ts, signed = np.concatenate([self.ts, now[traded]]), np.concatenate([self.signed, value[traded]])
        sums = np.concatenate([[0.0], np.cumsum(signed)])
        upto = held + np.cumsum(traded)  # trades up to and with each row
        last = np.where(np.cumsum(traded) > 0, ts[np.maximum(upto - 1, 0)] if len(ts) else 0, -1 if self.last is None else self.last)
        known = (np.cumsum(traded) > 0) | (self.last is not None)
        out = {self.t: now, "last_trade_age_ms": pd.array(now - last, dtype="Int64")}
        for span in self.spans:
            first = np.minimum(np.searchsorted(ts, now - span, side="left"), upto)
            out[f"flow_{span}"] = sums[upto] - sums[first]
        if traded.any():
            self.last = int(now[traded][-1])
        keep = ts >= now[-1] - max(self.spans)
        self.ts, self.signed = ts[keep], signed[keep]
        return pd.DataFrame(out).assign(last_trade_age_ms=lambda d: d["last_trade_age_ms"].mask(~known))


class Composite:
    """Median price of the venues heard from in the last ``max_age_ms``."""

    STATE = "venues array<string>, ts array<long>, prices array<double>"

    def __init__(self, t: str, max_age_ms: int = 2_000) -> None:
        self.t, self.max_age = t, max_age_ms
        self.latest: dict[str, tuple[int, float]] = {}

    def load(self, state: tuple) -> None:
        self.latest = {v: (t, p) for v, t, p in zip(*state)}

    def dump(self) -> tuple:
        return (list(self.latest), [t for t, _ in self.latest.values()], [p for _, p in self.latest.values()])

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        # One column a venue: its newest print's time and price at every row, then one median a row.
        names = sorted(set(self.latest) | set(rows["venue"]))
        now = rows["ts_ms"].to_numpy(dtype=np.int64)
        prices, times = np.empty((len(rows), len(names))), np.empty((len(rows), len(names)))
        for j, name in enumerate(names):
            mine = (rows["venue"] == name).to_numpy()
            at = np.maximum.accumulate(np.where(mine, np.arange(len(rows)), -1))
            t0, p0 = self.latest.get(name, (np.nan, np.nan))
            times[:, j] = np.where(at >= 0, now[at], t0)
            prices[:, j] = np.where(at >= 0, rows["price"].to_numpy(dtype=float)[at], p0)
            if at[-1] >= 0:
                self.latest[name] = (int(now[at[-1]]), float(rows["price"].iloc[at[-1]]))
        fresh = np.where(now[:, None] - times <= self.max_age, prices, np.nan)
        median, n = np.nanmedian(fresh, axis=1), (~np.isnan(fresh)).sum(axis=1)
        spread = np.where(n > 1, (np.nanmax(fresh, axis=1) - np.nanmin(fresh, axis=1)) / median * 10_000, 0.0)
        return pd.DataFrame({"ts_ms": now, "price": median, "venues": n.astype(np.int32), "dispersion_bps": spread})

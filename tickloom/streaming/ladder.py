"""A venue's ladder of absolute quantities: levels by price value, bounded where the venue forgets deeper ones."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable
from decimal import Decimal

import pandas as pd

SIDES = ("bids", "asks")


class Ladder:
    """Book of one venue and symbol, fed messages in order.

    Levels are keyed by the price's value; the venue's own text is kept for the checksum.  Levels beyond ``depth``
    are forgotten where the venue truncates.  Messages of any channel carry the sequence (kind ``other`` has no
    levels); a message may come in several parts with one number.  A jump or a wrong checksum empties the book until
    the next snapshot and is reported.
    """

    COLUMNS = ("receive_ts_ms", "line", "part", "sequence", "kind", "checksum", "bids", "asks")

    def __init__(self, depth: int = 10, truncate: bool = False, enforce_sequence: bool = False, verify_checksum: bool = False) -> None:
        self.depth, self.truncate, self.enforce, self.verify = depth, truncate, enforce_sequence, verify_checksum
        self.at: tuple[int, int] | None = None  # sequence and part of the last message taken
        self.ready = False
        # Prices rise from the best: bids are held under their negative.
        self.prices: dict[str, list[Decimal]] = {s: [] for s in SIDES}
        self.levels: dict[str, dict[Decimal, tuple[str, str]]] = {s: {} for s in SIDES}
        self.stored: dict[str, dict[str, tuple[str, str]]] = {s: {} for s in SIDES}

    def load(self, at: tuple[int, int] | None, ready: bool, held: dict[str, list[tuple[str, str, str]]]) -> None:
        """Go on from stored levels (price, text, quantity)."""
        self.at, self.ready = at, bool(ready)
        for side, levels in held.items():
            self.stored[side] = {price: (text, qty) for price, text, qty in levels}
            self.levels[side] = {self._key(side, Decimal(price)): (text, qty) for price, text, qty in levels}
            self.prices[side] = sorted(self.levels[side])

    def changes(self, side: str) -> tuple[list[str], list[tuple[str, str, str]]]:
        """Stored prices that are gone, and levels that are new or different; they count as stored from here on."""
        now = {format(abs(k).normalize(), "f"): level for k, level in self.levels[side].items()}
        gone = [p for p in self.stored[side] if p not in now]
        put = [(p, *level) for p, level in now.items() if self.stored[side].get(p) != level]
        self.stored[side] = now
        return gone, put

    @staticmethod
    def _key(side: str, price: Decimal) -> Decimal:
        return -price if side == "bids" else price

    def best(self, side: str) -> list[tuple[str, str]]:
        return [self.levels[side][k] for k in self.prices[side][: self.depth]]

    def checksum(self) -> int:
        digits = "".join(v.replace(".", "").lstrip("0") or "0" for side in ("asks", "bids") for level in self.best(side)[:10] for v in level)
        return zlib.crc32(digits.encode())

    def empty(self) -> None:
        self.ready = False
        for side in SIDES:
            self.prices[side], self.levels[side] = [], {}

    def _lost(self, status: str, expected: int, received: int) -> dict:
        self.empty()
        return {"status": status, "expected": expected, "received": received}

    def _in_turn(self, sequence, part) -> dict | bool:
        """True for a message that comes in turn, False for an old one, a report for one after a gap."""
        if not self.enforce or pd.isna(sequence):
            return True
        here, last = (int(sequence), int(part)), self.at
        if last and here <= last:
            return False
        self.at = here
        if last and here[0] > last[0] + 1:
            self.at = None
            return self._lost("sequence_gap", last[0] + 1, here[0])
        return True

    def put(self, side: str, levels: Iterable) -> None:
        prices, held = self.prices[side], self.levels[side]
        for level in levels if levels is not None else ():
            price = Decimal(str(level["price"]))
            if price <= 0:
                continue
            key = self._key(side, price)
            if Decimal(str(level["qty"])) > 0:
                if key not in held:
                    insort(prices, key)
                held[key] = (str(level["price"]), str(level["qty"]))
            elif key in held:
                del prices[bisect_left(prices, key)], held[key]
        if self.truncate:
            for key in prices[self.depth :]:
                del held[key]
            del prices[self.depth :]

    def answer(self, sequence, part, kind: str, checksum, bids, asks) -> dict | None:
        """What a message leaves: the book, a report, or nothing."""
        turn = self._in_turn(sequence, part)
        if turn is not True:
            return turn or None
        if kind == "snapshot":
            self.empty()
            self.ready = True
        if kind == "other" or not self.ready:
            return None
        self.put("bids", bids)
        self.put("asks", asks)
        if self.verify and not pd.isna(checksum) and (mine := self.checksum()) != int(checksum):
            return self._lost("checksum_mismatch", int(checksum), mine)
        best_bid, best_ask = self.prices["bids"], self.prices["asks"]
        if not best_bid or not best_ask or -best_bid[0] >= best_ask[0]:
            return None
        return {"status": "book", **{s: [{"price": p, "qty": q} for p, q in self.best(s)] for s in SIDES}}

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The answers to ordered rows."""
        out = []
        for t, line, part, sequence, kind, checksum, bids, asks in zip(*(rows[c].tolist() for c in self.COLUMNS)):
            if answer := self.answer(sequence, part, kind, checksum, bids, asks):
                out.append((t, line, part, answer["status"], answer.get("bids"), answer.get("asks"), answer.get("expected"), answer.get("received")))
        columns = ["receive_ts_ms", "line", "part", "status", "bids", "asks", "expected", "received"]
        return pd.DataFrame(out, columns=columns).astype({"expected": "Int64", "received": "Int64"})

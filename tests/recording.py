"""Generated recordings for tests: random book, index, trades and venue events."""

import gzip
import json
import random

START = 1_767_615_300  # any time will do


def metadata(ticker, result="yes", strike=100.0, start=START):
    from datetime import datetime, timezone

    def iso(s):
        return datetime.fromtimestamp(s, timezone.utc).isoformat()

    return {
        "ticker": ticker, "event_ticker": "EV-" + ticker.rsplit("-", 1)[0], "title": f"Above {strike:g}?", "status": "open", "open_time": iso(start), "close_time": iso(start + 900),
        "expected_expiration_time": iso(start + 1200), "floor_strike": strike, "price_ranges": [{"start": 0, "end": 1, "step": 0.01}],
        "rules_primary": f"pays if above {strike:g}", "rules_secondary": "", "result": result,
    }


def dump(rows, path):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt") as f:
        for row in rows:
            f.write(json.dumps(row, separators=(",", ":"), sort_keys=True) + "\n")


def write_recording(path, ticker, n=1000, seed=0, result="yes", start=START, exchange="exchange"):
    r = random.Random(seed)
    rows = []

    def add(ts, source, kind, payload, exchange_ts=None):
        rows.append({"schema_version": 1, "receive_ts_ms": ts, "exchange_ts_ms": exchange_ts, "source": source, "event_type": kind, "payload": payload})

    t = start * 1000
    add(t, "system", "market_metadata", metadata(ticker, result, start=start))
    add(t, exchange, "feed_status", {"status": "connected"})
    seq, price, second = 1, 100.0, start

    def levels(base, step):
        return [[f"{(base + step * i) / 100:.2f}", str(r.randrange(1, 40))] for i in range(5)]

    def snapshot(ts):
        base = r.randrange(42, 50)
        msg = {"market_ticker": ticker, "yes_dollars_fp": levels(base, -1), "no_dollars_fp": levels(base + 2, 1)}
        add(ts, exchange, "orderbook_snapshot", {"type": "orderbook_snapshot", "seq": seq, "msg": msg})

    snapshot(t)
    for _ in range(n):
        t += r.choice([0, 1, 5, 20, 40, 90])
        while second * 1000 + 1000 <= t:
            second += 1
            price *= 1 + r.gauss(0, 1e-4) * (6 if r.random() < 0.05 else 1)
            msg = {"index_id": "BRTI", "data": json.dumps({"time": second * 1000, "value": f"{price:.4f}"})}
            add(second * 1000, exchange, "cfbenchmarks_value", {"type": "cfbenchmarks_value", "msg": msg}, second * 1000)
        u = r.random()
        if u < 0.6:
            seq += 1 if r.random() > 0.01 else 2
            side = r.choice(["yes", "no"])
            level = r.randrange(38, 50) if side == "yes" else r.randrange(47, 58)
            msg = {"market_ticker": ticker, "side": side, "price_dollars": f"{level / 100:.2f}", "delta_fp": str(r.choice([-20, -5, -3, 4, 6, 9]))}
            add(t, exchange, "orderbook_delta", {"type": "orderbook_delta", "seq": seq, "msg": msg})
        elif u < 0.63:
            seq += 1
            snapshot(t)
        elif u < 0.75:
            msg = {"market_ticker": ticker, "yes_price_dollars": f"{r.randrange(40, 56) / 100:.2f}", "count_fp": str(r.randrange(1, 30)),
                   "taker_book_side": r.choice(["bid", "ask"]), "ts_ms": t}
            add(t, exchange, "trade", {"type": "trade", "msg": msg}, t)
        elif u < 0.87:
            add(t, r.choice(["binance", "coinbase", "kraken"]), "spot", {"price": price * (1 + r.gauss(0, 2e-4)), "raw": {}}, t - r.randrange(0, 1500))
        else:
            book = {"mid": price, "microprice": price * (1 + r.gauss(0, 1e-4)), "depth_imbalance": r.uniform(-1, 1)}
            add(t, r.choice(["binance", "coinbase", "kraken"]), "external_orderbook", book)
    add((start + 900) * 1000, "system", "market_status_at_close", metadata(ticker, result, start=start))
    if path is not None:
        dump(rows, path)
    return rows

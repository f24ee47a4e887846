"""Processors give the same rows however the stream is cut into micro-batches, and agree with row loops."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.catalog.streams import drain, landed
from tickloom.sources.venues import depth_updates
from tickloom.streaming import live
from tickloom.operators.venue_book import venue_books
from tickloom.streaming.ladder import SIDES, Ladder
from tickloom.streaming.many import FeaturesOfMany, FlowOfMany, SamplerOfMany, packed, unpacked
from tickloom.streaming.stateful import Composite, FlowWindow, Sampler, SequencedBook
from tickloom.streaming.timed import LiveFeatures


def in_pieces(make, rows, cuts):
    """Feed piece by piece, through dump and load each time."""
    out, state = [], None
    for a, z in zip([0, *cuts], [*cuts, len(rows)]):
        if a == z:
            continue
        p = make()
        if state is not None:
            p.load(state)
        out.append(p.feed(rows.iloc[a:z].reset_index(drop=True)))
        state = p.dump()
    return pd.concat([o for o in out if len(o)], ignore_index=True)


def book_rows(seed, n=300):
    r = random.Random(seed)
    rows, number = [], 0
    for i in range(n):
        number += 1 if r.random() > 0.05 else 2
        if r.random() < 0.06 or i == 3:
            levels = [[[f"{p / 100:.2f}", str(r.randrange(0, 9))] for p in r.sample(range(lo, lo + 9), 4)] for lo in (40, 50)]
            rows.append((i, number, "snapshot", None, None, None, *levels))
        else:
            side = r.choice(["yes", "no"])
            rows.append((i, number, "delta", side, f"{r.randrange(40, 49) / 100 if side == 'yes' else r.randrange(50, 59) / 100:.2f}", str(r.choice([-7, -2, 3, 5])), None, None))
    return pd.DataFrame(rows, columns=["t", "number", "kind", "side", "price", "delta", "yes_levels", "no_levels"])


def looped_book(rows, depth=3):
    number, valid, sides, out = None, False, {"yes": {}, "no": {}}, []
    for r in rows.itertuples():
        if r.kind == "snapshot":
            sides = {s: {float(p): float(q) for p, q in levels if float(q) > 0} for s, levels in (("yes", r.yes_levels), ("no", r.no_levels))}
            valid = True
        elif number is None or r.number != number + 1:
            valid = False
        else:
            book = sides[r.side]
            size = book.get(float(r.price), 0.0) + float(r.delta)
            book[float(r.price)] = size
            if size <= 1e-9:
                del book[float(r.price)]
        number = r.number
        bids, asks = sorted(sides["yes"].items(), reverse=True)[:depth], sorted(sides["no"].items())[:depth]
        out.append((bids[0][0] if bids else None, asks[0][0] if asks else None, sum(q for _, q in bids), sum(q for _, q in asks), valid))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sequenced_book(seed):
    rows = book_rows(seed)
    want = looped_book(rows)
    for cuts in ([], [1, 2, 50, 51, 200]):
        got = in_pieces(lambda: SequencedBook("t"), rows, cuts)
        for g, w in zip(got.itertuples(), want):
            assert (None if np.isnan(g.bid) else g.bid, None if np.isnan(g.ask) else g.ask, g.bid_depth, g.ask_depth, g.valid) == pytest.approx(w)
        assert len(got) == len(want)


def test_sampler_and_force():
    r = random.Random(4)
    t = np.cumsum([r.choice([0, 1, 40, 90]) for _ in range(200)])
    rows = pd.DataFrame({"t": t, "must": [r.random() < 0.05 for _ in t]})
    last, want = None, []
    for i, (now, must) in enumerate(zip(rows.t, rows.must)):
        if must or last is None or now - last >= 250:
            last = now
            want.append(i)
    for cuts in ([], [3, 4, 90]):
        got = in_pieces(lambda: Sampler("t", 250, "must"), rows.assign(i=range(len(rows))), cuts)
        assert got.i.tolist() == want


def test_flow_window():
    r = random.Random(5)
    t = np.cumsum([r.choice([0, 3, 500, 2000]) for _ in range(150)])
    rows = pd.DataFrame({"t": t, "signed": [r.choice([None, 1.5, -2.0]) for _ in t]})
    for cuts in ([], [1, 70, 71]):
        got = in_pieces(lambda: FlowWindow("t", "signed", (1000, 5000)), rows, cuts)
        for i, g in enumerate(got.itertuples()):
            seen = [(a, b) for a, b in zip(rows.t[: i + 1], rows.signed[: i + 1]) if b is not None and not np.isnan(b)]
            assert g.flow_1000 == pytest.approx(sum(b for a, b in seen if a >= g.t - 1000)) and g.flow_5000 == pytest.approx(sum(b for a, b in seen if a >= g.t - 5000))
            assert (g.last_trade_age_ms is pd.NA) if not seen else g.last_trade_age_ms == g.t - seen[-1][0]


def test_composite():
    r = random.Random(6)
    t = np.cumsum([r.choice([0, 300, 900, 2500]) for _ in range(80)])
    rows = pd.DataFrame({"ts_ms": t, "venue": [r.choice("abc") for _ in t], "price": [100 + r.random() for _ in t]})
    for cuts in ([], [1, 40]):
        got, latest = in_pieces(lambda: Composite("ts_ms"), rows, cuts), {}
        for g, row in zip(got.itertuples(), rows.itertuples()):
            latest[row.venue] = (row.ts_ms, row.price)
            fresh = [p for at, p in latest.values() if row.ts_ms - at <= 2000]
            assert (g.price, g.venues) == (pytest.approx(np.median(fresh)), len(fresh))


def level(p, q):
    return {"price": p, "qty": q}


def venue_rows(rows):
    return pd.DataFrame(rows, columns=["receive_ts_ms", "sequence", "part", "kind", "bids", "asks"]).assign(checksum=None, line=0)


def ladder_in_pieces(make, rows, cuts):
    """Feed piece by piece; between pieces only what changed is stored, level by level."""
    out, stored, at, ready = [], {s: {} for s in SIDES}, None, False
    for a, z in zip([0, *cuts], [*cuts, len(rows)]):
        if a == z:
            continue
        book = make()
        book.load(at, ready, {s: [(p, *level) for p, level in levels.items()] for s, levels in stored.items()})
        out.append(book.feed(rows.iloc[a:z].reset_index(drop=True)))
        at, ready = book.at, book.ready
        for side in SIDES:
            gone, put = book.changes(side)
            for price in gone:
                del stored[side][price]
            stored[side] |= {p: (text, qty) for p, text, qty in put}
    return pd.concat([o for o in out if len(o)], ignore_index=True)


def test_venue_book_prices_are_values():
    rows = venue_rows([(1, None, 0, "snapshot", [level("100.5", "1"), level("99", "1")], [level("101", "2")]), (2, None, 0, "update", [level("100.50", "0")], [])])
    got = ladder_in_pieces(Ladder, rows, [1])
    assert [[b["price"] for b in g] for g in got.bids] == [["100.5", "99"], ["99"]]


def test_venue_book_sequence_over_parts_and_channels():
    rows = venue_rows([
        (1, 7, 0, "snapshot", [level("9", "1")], [level("11", "1")]), (2, 8, 0, "other", [], []), (3, 9, 0, "update", [level("10", "1")], []), (3, 9, 1, "update", [], [level("10.5", "2")]),
        (3, 9, 1, "update", [level("10.2", "7")], []), (4, 12, 0, "update", [level("1", "1")], []), (5, 13, 0, "update", [level("2", "1")], []),
    ])
    for cuts in ([], [1, 3, 4, 6]):
        got = ladder_in_pieces(lambda: Ladder(enforce_sequence=True), rows, cuts)
        assert got.status.tolist() == ["book", "book", "book", "sequence_gap"]
        assert got.asks.iloc[2][0]["price"] == "10.5" and got.bids.iloc[2][0]["price"] == "10"
        assert (got.expected.iloc[3], got.received.iloc[3]) == (10, 12)


def test_other_channels_count(spark):
    rows = [("coinbase", 1, 1, json.dumps({"channel": "heartbeats", "sequence_num": 5, "timestamp": "2026-01-01T00:00:00Z"}))]
    messages = spark.createDataFrame(rows, "venue string, receive_ts_ms long, line long, message string")
    assert depth_updates(messages).count() == 0
    assert [(r.kind, r.sequence) for r in depth_updates(messages, all_channels=True).collect()] == [("other", 5)]


def test_grace_survives_later_batches(spark):
    rows = [("W1", "market_metadata", 1_000, 10.0), ("W1", "trade", 2_000, None), ("W2", "market_metadata", 1_000, 10.0), ("W2", "market_result", 3_000, None), ("Z", "trade", 400_000, None), ("Z", "trade", 500_000, None)]
    df = spark.createDataFrame(rows, "ticker string, event_type string, receive_ts_ms long, close_ts double")
    stream = landed(df, "receive_ts_ms").withColumn("received", F.timestamp_millis("receive_ts_ms")).withWatermark("received", "1 second")
    got = {(r.ticker, r.reason) for r in drain(live.finalised_windows(stream, 60_000)).collect()}
    assert got == {("W1", "grace"), ("W2", "close_marker")}


def looped_ladders(rows, depth):
    """Plain statement of the bounded book: sort everything after every message."""
    books, out = {}, []
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        venue, symbol, t, line, kind, bids, asks = r
        if kind == "snapshot":
            books[venue, symbol] = ({}, {})
        if (venue, symbol) not in books:
            continue
        sides = books[venue, symbol]
        for side, levels in zip(sides, (bids, asks)):
            for l in levels:
                side.pop(float(l["price"]), None)
                if float(l["qty"]) > 0:
                    side[float(l["price"])] = float(l["qty"])
        bid, ask = dict(sorted(sides[0].items(), reverse=True)[:depth]), dict(sorted(sides[1].items())[:depth])
        books[venue, symbol] = (bid, ask)
        if bid and ask and max(bid) < min(ask):
            out.append((symbol, line, tuple(bid.items()), tuple(ask.items())))
    return sorted(out)


def test_bounded_books_in_batch_and_stream(spark):
    r = random.Random(8)
    rows = []
    for i in range(500):
        deep = r.random() < 0.05
        lv = lambda lo: [level(f"{lo + r.randrange(30)}.{r.choice(['5', '50'])}", str(r.choice([0, 1, 2.5, 7]))) for _ in range(12 if deep else r.randrange(3))]
        rows.append(("v", r.choice("xyz"), i // 2, i, "snapshot" if deep else "update", lv(60), lv(92)))
    schema = "venue string, symbol string, receive_ts_ms long, line long, kind string, bids array<struct<price:string,qty:string>>, asks array<struct<price:string,qty:string>>"
    updates = spark.createDataFrame(rows, schema).withColumns({"part": F.lit(0), "sequence": F.lit(None).cast("long"), "checksum": F.lit(None).cast("long")})
    want = looped_ladders(rows, 4)
    for found in (venue_books(updates, 4, truncate=True, width_ms=20), venue_books(updates, 4, truncate=True, width_ms=10_000), drain(live.venue_book_stream(landed(updates, "receive_ts_ms"), 4, truncate=True))):
        got = sorted((b.symbol, b.line, *(tuple((float(l.price), float(l.qty)) for l in side) for side in (b.bids, b.asks))) for b in found.collect())
        assert got == want and len(want) > 100


def test_idle_books_are_forgotten(spark):
    one = [level("1", "1")], [level("2", "1")]
    rows = [("v", "x", 1_000, 1, "snapshot", *one), ("v", "y", 900_000, 2, "snapshot", *one), ("v", "y", 1_800_000, 3, "update", *one), ("v", "x", 2_000_000, 4, "update", *one), ("v", "y", 2_000_000, 5, "update", *one)]
    schema = "venue string, symbol string, receive_ts_ms long, line long, kind string, bids array<struct<price:string,qty:string>>, asks array<struct<price:string,qty:string>>"
    updates = spark.createDataFrame(rows, schema).withColumns({"part": F.lit(0), "sequence": F.lit(None).cast("long"), "checksum": F.lit(None).cast("long"), "received": F.timestamp_millis("receive_ts_ms")})
    stream = landed(updates, "receive_ts_ms").withWatermark("received", "1 second")
    assert sorted(b.line for b in drain(live.venue_book_stream(stream, idle_ms=1_000_000)).collect()) == [1, 2, 3, 5]


def test_a_landing_reads_its_own_files_only(spark):
    from tickloom.catalog.streams import PART, split_by

    rows = spark.range(0, 1000, 1, 4).withColumn("x", F.col("id") * 2)
    parted = split_by(rows, F.when(F.col("id") >= 700, 2).otherwise(0))
    plan = parted.filter(F.col(PART) == 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan
    assert [parted.filter(F.col(PART) == i).drop(PART).count() for i in range(3)] == [700, 0, 300]
    assert parted.filter(F.col(PART) == 2).drop(PART).agg(F.sum("x")).first()[0] == sum(2 * i for i in range(700, 1000))


def many_rows(seed, timeless=0):
    r = random.Random(seed)
    rows, t = [], 1_000
    for i in range(600):
        t += r.choice([0, 3, 60, 700])
        signed = r.choice([None, None, 1.5, -2.25, 1e15 if i % 97 == 0 else 0.5])
        rows.append((r.choice("aaabcdefgh") if i < 500 else r.choice("ahxyz"), t, i, r.random() < 0.05, signed, None if signed is not None else r.randrange(90) / 4, None if signed is not None else 7.0))
    rows = pd.DataFrame(rows, columns=["ticker", "ts_ms", "line", "must", "signed", "bid_size", "ask_size"])
    return rows.assign(ts_ms=rows.ts_ms.mask(rows.line.isin(r.sample(range(600), timeless)))) if timeless else rows


def many_in_pieces(make, rows, cuts):
    out, state = [], None
    for a, z in zip([0, *cuts], [*cuts, len(rows)]):
        p = make()
        if state is not None:
            p.load([unpacked(x) for x in state])
        out.append(p.feed(rows.iloc[a:z].sort_values(["ts_ms", "line"]).reset_index(drop=True)))
        state = [packed(x) for x in p.dump()]
    return pd.concat([o for o in out if len(o)], ignore_index=True)


@pytest.mark.parametrize("seed, timeless", [(1, 0), (2, 0), (3, 4)])
def test_many_keys_at_once(seed, timeless):
    """A bucket of keys gives each key's rows, though one key has far larger numbers than the others."""
    rows = many_rows(seed, timeless)
    kinds = [
        (lambda: SamplerOfMany(["ticker"], "ts_ms", 900), lambda: Sampler("ts_ms", 900)),
        (lambda: SamplerOfMany(["ticker"], "ts_ms", 900, "must"), lambda: Sampler("ts_ms", 900, "must")),
        (lambda: FlowOfMany(["ticker"], "ts_ms", "signed", (500, 4_000)), lambda: FlowWindow("ts_ms", "signed", (500, 4_000))),
    ] + [(lambda: FeaturesOfMany(["ticker"], 900, 4_000, 500), lambda: LiveFeatures(900, 4_000, 500))] * (not timeless)
    for cuts in ([], [1, 40, 41, 300, 520]):
        for many, one in kinds:
            got = many_in_pieces(many, rows, cuts)
            for ticker, mine in rows.groupby("ticker"):
                edges = [0, *cuts, len(rows)]
                own = [int((mine.index < e).sum()) for e in edges[1:-1]]
                pieces = mine.reset_index(drop=True)
                for a, z in zip([0, *own], [*own, len(mine)]):
                    pieces.iloc[a:z] = pieces.iloc[a:z].sort_values(["ts_ms", "line"]).to_numpy()
                pieces = pieces.astype({"line": "int64", "must": "bool", "signed": "float64", "bid_size": "float64", "ask_size": "float64"} | ({"ts_ms": "int64"} if mine.ts_ms.notna().all() else {"ts_ms": "float64"}))
                want = in_pieces(one, pieces, own)
                have = got[got.ticker == ticker].reset_index(drop=True)
                assert len(have) == len(want)
                for c in want.columns.drop("ticker", errors="ignore"):
                    pd.testing.assert_series_equal(have[c].astype("float64"), want[c].astype("float64"), check_names=False, rtol=1e-12, atol=1e-9)


def test_streams_call_python_by_buckets(spark):
    """Keys of one type or two, null ones too, over several micro-batches."""
    rows = [(i % 301 if i % 50 else None, "uv"[i % 2], i, 100 * (i // 400) + i % 3) for i in range(1600)]
    df = spark.createDataFrame(rows, "user long, side string, line long, t long")
    seen = df.withColumn("k", F.coalesce("user", F.lit(-1))).groupBy("k", "side").count().count()
    got = drain(live.sampled_stream(landed(df, "t"), 100, ["user", "side"], "t", ["t", "line"])).toPandas()
    want, last = [], {}
    for user, side, line, t in sorted(rows, key=lambda r: (r[3], r[2])):
        if (user, side) not in last or t - last[user, side] >= 100:
            last[user, side] = t
            want.append(line)
    assert len(last) == seen and sorted(got.line) == sorted(want)
    assert [(None if pd.isna(u) else int(u), s) for u, s in zip(got.user, got.side)] == [rows[i][:2] for i in got.line]

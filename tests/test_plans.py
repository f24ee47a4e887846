import math

import brute
import pytest
from pyspark.sql import functions as F

from tickloom.functions import pricing as P
from tickloom.functions import quoting as Q
from tickloom.operators.audit import audit
from tickloom.plans.features import feature_table
from tickloom.plans.fills import label_rows, queue_fills
from tickloom.plans.quotes import quote_lifetimes
from tickloom.plans.state import market_state
from tickloom.plans.variants import mirrored, parse_variant
from tickloom.schemas import ORDER
from tickloom.session import cut


def test_fair_value_matches_double_sum(spark):
    cases = [(100.0, 100.1, 1e-4, 300.0, 0, 0.0, 0.0), (100.0, 99.99, 5e-5, 45.0, 20, 100.01, 0.0), (100.0, 100.0, 1e-4, 30.0, 0, 0.0, 0.0),
             (100.0, 100.1, 1e-4, 0.0, 10, 99.0, 0.0), (100.0, 101.0, 1e-4, 10.0, 60, 100.2, 0.0), (100.0, 100.0, 1e-4, 300.0, 0, 0.0, 1e-6)]
    df = spark.createDataFrame(cases, "k double, s double, g double, t double, c int, a double, d double")
    f = P.average_settlement_fair(F.col("k"), F.col("s"), F.col("g"), F.col("t"), F.col("c"), F.col("c") * F.col("a"), F.col("d"))
    for case, row in zip(cases, df.select(f["yes"].alias("yes")).collect()):
        assert row.yes == pytest.approx(brute.fair_yes(*case), abs=1e-9)


def test_normal_cdf_is_exact_and_null_safe(spark):
    xs = [-30.0, -5.7, -1.0, -0.1, 0.0, 0.66, 2.2, 8.0, None]
    for x, row in zip(xs, spark.createDataFrame([(x,) for x in xs], "x double").select(P.normal_cdf(F.col("x")).alias("p")).collect()):
        assert row.p is None if x is None else abs(row.p - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 3e-16
    assert spark.range(1).select(P.clamp(F.lit(None).cast("double"), 0.0, 1.0)).first()[0] is None


def test_tapered_grid_steps_one_tick(spark):
    grid = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(s).alias("step")) for a, b, s in ((0.0, 0.1, 0.001), (0.1, 0.9, 0.01), (0.9, 1.0, 0.001))])
    row = spark.range(1).select(*[f(grid, F.lit(p)) for f, p in ((Q.tick_below, 0.1), (Q.tick_above, 0.1), (Q.tick_below, 0.9), (Q.tick_above, 0.9), (Q.grid_floor, 0.0956), (Q.grid_ceil, 0.506))]).first()
    assert list(row) == [0.099, 0.11, 0.89, 0.901, 0.095, 0.51]


def test_queue_must_clear_before_a_fill(spark):
    quotes = spark.createDataFrame([("m", "bid", "q", 0.49, 5.0, 10.0, 0, None, 0.5)], "k string, side string, quote_id string, price double, count double, queue_ahead double, activate_ts_ms long, cancel_ts_ms long, fair_yes double")
    trades = spark.createDataFrame([("m", 1, 1, 0.49, 9.0, "ask"), ("m", 2, 2, 0.49, 4.0, "ask"), ("m", 3, 3, 0.50, 9.0, "ask"), ("m", 4, 4, 0.48, 9.0, "ask")], "k string, t long, s long, price double, count double, taker_side string")
    got = queue_fills(quotes, trades, ["k"], "t", ["s"], 2).orderBy("fill_ts_ms").collect()
    assert [(r.fill_ts_ms, r.fill_count) for r in got] == [(2, 3.0), (4, 2.0)]


def test_labels_join_strictly_before_and_respect_gaps(spark):
    features = spark.createDataFrame([("m", t, float(t)) for t in (1_000, 5_000, 9_000)], "ticker string, ts_ms long, x double")
    # Ten mids of one millisecond: the first in the recording's order counts.
    tied = [("m", 6_001, 0, 1 << 33, i, 0.40 + i / 100) for i in reversed(range(10))]
    mids = spark.createDataFrame([*tied, ("m", 20_000, 1, 0, 0, 0.60)], "ticker string, receive_ts_ms long, frag long, block long, line long, mid double")
    fills = spark.createDataFrame([("m", "a", 5_000, "bid", 0.5, 1.0), ("m", "b", 5_001, "bid", 0.5, 1.0), ("m", "c", 9_500, "ask", 0.5, 1.0)],
                                  "ticker string, quote_id string, fill_ts_ms long, fill_side string, fill_price double, fill_count double")
    got = {r.quote_id: r for r in label_rows(fills, features, mids, 2_000).collect()}
    # The row at the fill's own time does not count, and the one before is four seconds old.
    assert set(got) == {"b", "c"}
    assert got["b"].ts_ms == 5_000 and got["b"].feature_age_ms == 1
    assert got["b"].markout_1s == pytest.approx(-0.10)
    assert got["c"].markout_5s is None and got["c"].toxic_5s is None


def test_mirror_rejects_bad_side_and_variants_parse():
    with pytest.raises(ValueError):
        mirrored("up")
    v = parse_variant("micro25+wide2")
    assert v.min_edge == 0.02 and v.adjuster.weight == 0.25
    assert len(parse_variant("micro25+extlead50").adjuster.parts) == 2
    # Later settings win, also where they equal the default.
    assert parse_variant("wide2+wide1").min_edge == 0.01 and parse_variant("close300+close90").close_cutoff_s == 90.0
    with pytest.raises(ValueError):
        parse_variant("nothing")


def test_audit_reports_missing_parts_and_sequence_skips(spark):
    def line(i, kind, source="exchange", payload="{}"):
        return ("f", 0, i, f'{{"receive_ts_ms": {100_000 + i}, "source": "{source}", "event_type": "{kind}", "payload": {payload}}}', True, True)

    meta = '{"open_time": "1970-01-01T00:01:40Z", "close_time": "1970-01-01T00:03:20Z"}'
    rows = [line(0, "market_metadata", "system", meta), line(1, "orderbook_snapshot"), line(2, "orderbook_delta")]
    rows += [line(3, "trade", payload='{"type": "trade", "seq": 1, "sid": 4}'), line(4, "trade", payload='{"type": "trade", "seq": 3, "sid": 4}')]
    rows += [line(5, "cfbenchmarks_value"), line(101_000, "market_status_at_close", "system"), ("f", 0, 7, "{broken", True, False)]
    lines = spark.createDataFrame(rows, "path string, block long, line long, value string, complete boolean, readable boolean")
    r = audit(lines, 201_000, "exchange").first()
    assert r.status == "complete" and not r.healthy and r.rows == 7 and r.invalid_rows == 1
    assert r.channel_seq_gaps == {"trade": 1} and "channel_gaps=trade|1" in r.warnings
    assert "no_reference_price=binance|coinbase|kraken" in r.errors and "unreadable_rows=1" in r.errors


def test_lifetimes_work_quotes_out_once(spark):
    """A side's quote ends where its price changes or goes; the rows it is made from are worked out once."""
    prices = {"a": [(0.4, 0.6), (0.4, 0.6), (0.4, None), (0.3, None), (None, 0.7), (0.3, 0.7)], "b": [(None, None), (None, 0.5)]}
    rows = [
        (m, "v", i, 0, 0, i, 0.5, 10, [("bid", b, 1.0, 0.1)] * (b is not None) + [("ask", a, 1.0, 0.1)] * (a is not None))
        for m, steps in prices.items() for i, (b, a) in enumerate(steps)
    ]
    order = ", ".join(f"{c} long" for c in ORDER)
    made = spark.sparkContext.accumulator(0)

    def seen(latency):
        made.add(1)
        return latency

    flat = [(m, v, t, *range(len(ORDER) - 1), line, fair, latency, q) for m, v, t, _, _, line, fair, latency, q in rows]
    quoted = spark.createDataFrame(flat, f"ticker string, variant string, receive_ts_ms long, {order}, fair_yes double, latency_ms long, quotes array<struct<side string, price double, count double, edge double>>")
    counted = quoted.withColumn("latency_ms", F.udf(seen, "long")("latency_ms"))
    got = sorted((r.ticker, r.side, r.price, r.decide_ts_ms, r.cancel_ts_ms) for r in quote_lifetimes(counted, 2).collect())
    assert got == [
        ("a", "ask", 0.6, 0, 12), ("a", "ask", 0.7, 4, None), ("a", "bid", 0.3, 3, 14), ("a", "bid", 0.3, 5, None), ("a", "bid", 0.4, 0, 13), ("b", "ask", 0.5, 1, None),
    ]
    assert made.value == len(rows)


def test_features_from_a_written_state(windows):
    state = cut(market_state(windows))
    assert sorted(map(str, feature_table(windows, state).collect())) == sorted(map(str, feature_table(windows).collect()))

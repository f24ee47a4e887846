"""Queries on the derived market recording: book, index, settlement, quality, features, fills, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.base import query, rounded
from tickloom.catalog.scalar import cdf_cte
from tickloom.catalog.recording import DERIVED_SQL, EXCHANGE, SLICE_MS, WINDOW_MS, BASE_MS, derived_events, derived_windows, laid_out
from tickloom.operators.audit import audit as audit_files
from tickloom.operators.metrics import window_ic
from tickloom.operators.quality import window_quality
from tickloom.operators.settlement import WINDOW_END_TOLERANCE_MS as END_TOLERANCE_MS
from tickloom.operators.settlement import infer_settlement
from tickloom.operators.volatility import rolling_sigma
from tickloom.operators.book import top_levels
from tickloom.plans import ab, fills, fit, quotes, scores
from tickloom.plans.features import attach_flow, feature_table
from tickloom.plans.state import T, Windows, book_of, index_state, market_state, warmup_ticks
from tickloom.plans.variants import parse_variants, stress_grid
from tickloom.schemas import INDEX_EVENT, ORDER
from tickloom.session import cut
from tickloom.sources import recordings as rec

TICKER_SQL = "'M' || lpad(CAST(w AS VARCHAR), 6, '0')"
START_SQL = f"({BASE_MS} + w * {WINDOW_MS})"


@query(
    "flow_ic",
    f"""WITH {DERIVED_SQL}, x AS (SELECT t.*, b.price - t.price AS move FROM (SELECT *, tick_ms + 5000 AS p FROM ticks) t ASOF JOIN ticks b ON t.w = b.w AND t.p <= b.tick_ms),
    f AS (SELECT x.w, x.event_id, any_value(move) AS move, coalesce(sum(CASE WHEN taker = 'bid' THEN count ELSE -count END), 0) AS flow
      FROM x LEFT JOIN trade ON trade.w = x.w AND trade.t >= x.t - 5000 AND (trade.t < x.t OR (trade.t = x.t AND trade.event_id < x.event_id)) GROUP BY x.w, x.event_id),
    c AS (SELECT w, count(*) AS n, CASE WHEN count(*) >= 30 AND stddev_pop(flow) > 0 AND stddev_pop(move) > 0 THEN corr(flow, move) END AS ic FROM f GROUP BY w)
    SELECT count(ic) AS windows, round(avg(ic), 8) AS ic, CAST(sum(n) AS BIGINT) AS samples FROM c""",
)
def flow_ic(spark, sf_dir):
    from tickloom.operators.asof import asof_join

    w = derived_windows(spark, sf_dir)
    probes = w.ticks.withColumn("probe", F.col(T) + 5_000)
    ahead = asof_join(probes, w.ticks, ["ticker"], "probe", T, width=SLICE_MS, direction="forward", right_seq="line", right_columns=[T, "value"])
    moved = ahead.filter("matched is not null").withColumn("move", F.col("matched.value") - F.col("value")).drop("matched")
    flowed = attach_flow(moved, w.trades, SLICE_MS)
    ics = window_ic(flowed, ["ticker"], "flow_5s", "move", 30)
    return rounded(ics.agg(F.count("ic").alias("windows"), F.avg("ic").alias("ic"), F.sum("rows").alias("samples")), 8)


@query(
    "market_dimension",
    f"""WITH {DERIVED_SQL} SELECT {TICKER_SQL} AS ticker, {START_SQL} // 1000 AS open_ts, {START_SQL} // 1000 + 900 AS close_ts, {START_SQL} // 1000 + 900 AS expiry_ts,
      100.0::DOUBLE AS strike, CASE WHEN w % 3 = 0 THEN CASE WHEN w % 2 = 0 THEN 'yes' ELSE 'no' END ELSE '' END AS listed_result, 1::BIGINT AS fragments, true AS close_seen
    FROM (SELECT DISTINCT w FROM r)""",
)
def market_dimension(spark, sf_dir):
    files = rec.file_dimension(cut(derived_events(spark, sf_dir)))
    return rec.market_dimension(files).select("ticker", "open_ts", "close_ts", "expiry_ts", "strike", "listed_result", "fragments", "close_seen")


@query(
    "current_market",
    f"WITH {DERIVED_SQL} SELECT 'FAMILY' AS event_ticker, min({TICKER_SQL}) AS ticker, min({START_SQL} // 1000 + 900) AS close_ts FROM r WHERE {START_SQL} // 1000 + 900 > {BASE_MS // 1000 + 4000}",
)
def current_market(spark, sf_dir):
    markets = rec.market_dimension(rec.file_dimension(cut(derived_events(spark, sf_dir))))
    return rec.current_market(markets, BASE_MS / 1000 + 4000).select("event_ticker", "ticker", "close_ts")


@query(
    "final_windows",
    f"WITH {DERIVED_SQL} SELECT DISTINCT {TICKER_SQL} AS ticker FROM r WHERE {START_SQL} // 1000 + 900 + 3600 >= {BASE_MS // 1000 + 9000} OR {BASE_MS // 1000 + 9000} > {BASE_MS // 1000} + 60",
)
def final_windows(spark, sf_dir):
    markets = rec.market_dimension(rec.file_dimension(cut(derived_events(spark, sf_dir))))
    return rec.final_windows(markets, BASE_MS / 1000 + 9000).select("ticker")


@query(
    "event_routing",
    f"""WITH {DERIVED_SQL} SELECT {TICKER_SQL} AS ticker, count(*) FILTER (event_type IN ('click', 'view')) + 1 AS book, count(*) FILTER (event_type = 'error') AS ticks,
      count(*) FILTER (event_type = 'purchase') AS trades, count(*) FILTER (event_type = 'signup' AND k % 2 = 0) AS spots, count(*) FILTER (event_type = 'signup' AND k % 2 = 1) AS depths FROM r GROUP BY w""",
)
def event_routing(spark, sf_dir):
    w = derived_windows(spark, sf_dir)
    views = {"book": rec.book_messages(w.parsed), "ticks": w.ticks, "trades": w.trades, "spots": rec.venue_spots(w.parsed), "depths": rec.venue_books(w.parsed)}
    rows = None
    for name, view in views.items():
        part = view.select("ticker", F.lit(name).alias("view"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("ticker").agg(*[F.count_if(F.col("view") == n).alias(n) for n in views])


@query(
    "settlement_inference",
    f"""WITH {DERIVED_SQL}, l AS (SELECT w, arg_max(price, (tick_ms, -event_id)) AS last_tick FROM ticks GROUP BY w), a AS (SELECT DISTINCT w FROM r)
    SELECT {TICKER_SQL} AS ticker, CASE WHEN w % 3 = 0 THEN CASE WHEN w % 2 = 0 THEN 'yes' ELSE 'no' END WHEN last_tick IS NOT NULL THEN CASE WHEN CAST(last_tick AS DECIMAL(18, 2)) >= 100 THEN 'yes' ELSE 'no' END END AS result,
      CASE WHEN w % 3 = 0 THEN 'official' WHEN last_tick IS NOT NULL THEN 'last_preclose_tick' END AS settlement_source, CASE WHEN w % 3 <> 0 THEN last_tick END AS reference_value
    FROM a LEFT JOIN l USING (w)""",
)
def settlement_inference(spark, sf_dir):
    w = derived_windows(spark, sf_dir)
    return infer_settlement(w.events, w.ticks, w.markets)


@query(
    "window_quality",
    f"""WITH {DERIVED_SQL}, g AS (SELECT w, max(gap) AS gap FROM (SELECT w, (tick_ms - lag(tick_ms) OVER (PARTITION BY w ORDER BY t, event_id)) / 1000.0::DOUBLE AS gap FROM ticks) GROUP BY w)
    SELECT {TICKER_SQL} AS ticker, 1 AS fragments, 0.0::DOUBLE AS start_offset_s, round(coalesce(gap, 0), 6) AS index_max_gap_s, 0::BIGINT AS reconnects,
      CASE WHEN gap > 5 THEN 'brti_gap' ELSE '' END AS flags FROM (SELECT DISTINCT w FROM r) LEFT JOIN g USING (w)""",
)
def quality_per_window(spark, sf_dir):
    w = derived_windows(spark, sf_dir)
    return rounded(window_quality(w.events, w.ticks, w.markets).withColumn("flags", F.array_join("flags", ",")))


@query(
    "recording_audit",
    f"""WITH {DERIVED_SQL}, n AS (SELECT w, sum(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS gaps FROM msgs GROUP BY w)
    SELECT 'derived/' || {TICKER_SQL} AS path, 'complete' AS status, count(*) + 4 AS rows, min({START_SQL}) AS first_ts_ms, min({START_SQL}) + {WINDOW_MS} AS last_ts_ms,
      CAST(coalesce(any_value(gaps), 0) AS BIGINT) AS orderbook_gaps, list_aggregate(list_sort(list_distinct(list(CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN CASE k % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'coinbase' ELSE 'kraken' END END))), 'string_agg', ',') AS venues
    FROM r LEFT JOIN n USING (w) GROUP BY w""",
)
def recording_audit(spark, sf_dir):
    e = derived_events(spark, sf_dir)
    # One JSON line per envelope, as a recording file holds it.
    value = F.concat(
        F.lit('{"event_type":"'), F.col("event_type"), F.lit('","receive_ts_ms":'), F.col("receive_ts_ms"), F.lit(',"source":"'), F.col("source"), F.lit('","payload":'), F.col("payload"), F.lit("}")
    )
    lines = cut(e.select("path", "block", "line", value.alias("value"), F.lit(True).alias("complete"), F.lit(True).alias("readable")))
    a = audit_files(lines, BASE_MS + 10**9, EXCHANGE)
    gaps = F.coalesce(F.element_at(F.col("channel_seq_gaps"), F.lit("orderbook")), F.lit(0).cast("long"))
    return a.select("path", "status", "rows", "first_ts_ms", "last_ts_ms", gaps.alias("orderbook_gaps"), F.array_join(F.array_sort("venues"), ",").alias("venues"))


_LEVELS_SQL = f"""{DERIVED_SQL}, n0 AS (SELECT w, count(*) AS n FROM r GROUP BY w),
    m AS (SELECT w, t, event_id, snap, number, k, value, event_type, n FROM msgs JOIN n0 USING (w)
      UNION ALL SELECT w, {START_SQL}, -1, true, 1, NULL, NULL, 'click', n FROM n0),
    q AS (SELECT *, number <> lag(number) OVER (PARTITION BY w ORDER BY t, event_id) + 1 AND NOT snap AS gap, count(*) FILTER (snap) OVER (PARTITION BY w ORDER BY t, event_id) AS epoch FROM m),
    v AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY w, epoch ORDER BY t, event_id) = 0 AS valid FROM q),
    d AS (SELECT w, t, event_id, epoch, s.side, CASE WHEN s.side = 'bid' THEN 48 - i ELSE 51 + i END AS p,
        3 + i + CASE WHEN event_id = -1 THEN CASE WHEN s.side = 'bid' THEN n % 5 ELSE n % 4 END ELSE CASE WHEN s.side = 'bid' THEN k % 9 ELSE k % 7 END END AS d
      FROM v, (VALUES ('bid'), ('ask')) AS s(side), range(5) AS g(i) WHERE snap
      UNION ALL SELECT w, t, event_id, epoch, CASE WHEN event_type = 'click' THEN 'bid' ELSE 'ask' END, CASE WHEN event_type = 'click' THEN 40 + k % 10 ELSE 51 + k % 10 END, floor(value % 40) - 12
      FROM v WHERE NOT snap AND valid),
    z AS (SELECT *, sum(d) OVER (PARTITION BY w, epoch, side, p ORDER BY t, event_id) AS s FROM d),
    lv AS (SELECT w, t, event_id, epoch, side, p, s - least(0, min(s) OVER (PARTITION BY w, epoch, side, p ORDER BY t, event_id)) AS size FROM z)"""


@query(
    "book_level_sizes",
    f"WITH {_LEVELS_SQL} SELECT {TICKER_SQL} AS ticker, t AS receive_ts_ms, CASE WHEN event_id = -1 THEN 2 ELSE event_id + 10 END AS line, side, CAST(p * 100 AS INTEGER) AS price_key, CAST(size AS DOUBLE) AS size FROM lv",
)
def book_level_sizes(spark, sf_dir):
    _, changes = book_of(derived_windows(spark, sf_dir))
    return changes.select("ticker", T, "line", "side", "price_key", "size")


_BEST_CTES = f"""{_LEVELS_SQL}, grid AS (SELECT DISTINCT w, epoch, side, p FROM lv),
    pt AS (SELECT v.w, v.t, v.event_id, v.valid, grid.side, grid.p, v.epoch FROM v LEFT JOIN grid ON grid.w = v.w AND grid.epoch = v.epoch),
    sz AS (SELECT pt.w, pt.t, pt.event_id, pt.valid, pt.side, pt.p, coalesce(l.size, 0) AS size FROM pt ASOF LEFT JOIN (SELECT *, (t, event_id) AS pos FROM lv) l
      ON l.w = pt.w AND l.epoch = pt.epoch AND l.side = pt.side AND l.p = pt.p AND (pt.t, pt.event_id) >= l.pos),
    rk AS (SELECT *, row_number() OVER (PARTITION BY w, t, event_id, side ORDER BY CASE WHEN side = 'bid' THEN -p ELSE p END) AS rn FROM sz WHERE size > 0),
    b AS (SELECT w, t, event_id, max(p) FILTER (side = 'bid' AND rn = 1) / 100.0::DOUBLE AS bid, max(p) FILTER (side = 'ask' AND rn = 1) / 100.0::DOUBLE AS ask,
      sum(size) FILTER (side = 'bid' AND rn = 1) AS bid_size, sum(size) FILTER (side = 'ask' AND rn = 1) AS ask_size,
      sum(size) FILTER (side = 'bid' AND rn <= 3) AS bid_depth, sum(size) FILTER (side = 'ask' AND rn <= 3) AS ask_depth FROM rk GROUP BY w, t, event_id)"""
_BEST_SQL = f"""WITH {_BEST_CTES}
    SELECT {TICKER_SQL} AS ticker, v.t AS receive_ts_ms, CASE WHEN v.event_id = -1 THEN 2 ELSE v.event_id + 10 END AS line, v.valid, bid, ask, CAST(coalesce(bid_size, 0) AS DOUBLE) AS bid_size, CAST(coalesce(ask_size, 0) AS DOUBLE) AS ask_size,
      CAST(coalesce(bid_depth, 0) AS DOUBLE) AS bid_depth, CAST(coalesce(ask_depth, 0) AS DOUBLE) AS ask_depth FROM v LEFT JOIN b USING (w, t, event_id) WHERE v.valid"""


@query("book_best_levels", _BEST_SQL)
def book_best_levels(spark, sf_dir):
    book, _ = book_of(derived_windows(spark, sf_dir))
    return book.filter("valid").select("ticker", T, "line", "valid", "bid", "ask", "bid_size", "ask_size", "bid_depth", "ask_depth")


_VOL_CTES = f"""s AS (SELECT w, event_id, t, tick_ms // 1000 AS sec, price FROM ticks), cl AS (SELECT w, sec, arg_max(price, event_id) AS price FROM s GROUP BY w, sec),
    cr AS (SELECT w, sec, ln(price / lag(price) OVER o) / sqrt(sec - lag(sec) OVER o) AS r FROM cl WINDOW o AS (PARTITION BY w ORDER BY sec)),
    tk AS (SELECT s.w, s.event_id, s.sec, ln(s.price / p.price) / sqrt(s.sec - p.sec) AS r FROM s ASOF LEFT JOIN cl p ON p.w = s.w AND s.sec > p.sec),
    h AS (SELECT tk.w, tk.event_id, tk.sec, list_concat((SELECT coalesce(list({{'sec': cr.sec, 'r': cr.r}} ORDER BY cr.sec), []) FROM cr WHERE cr.w = tk.w AND cr.sec < tk.sec AND cr.r IS NOT NULL),
      CASE WHEN tk.r IS NULL THEN [] ELSE [{{'sec': tk.sec, 'r': tk.r}}] END) AS x FROM tk),
    g AS (SELECT w, event_id, sec, x, list_transform(x, lambda p: p.r * p.r) AS sq, list_sort(list_transform(x, lambda p: abs(p.r))) AS ab,
      list_transform([10, 60, 300, 1800], lambda z: list_filter(x, lambda p: p.sec > sec - z)) AS hz FROM h WHERE len(x) >= 3),
    e2 AS (SELECT *, list_reduce(sq, lambda a, b: a * {0.5 ** (1 / 60)!r} + (1 - {0.5 ** (1 / 60)!r}) * b) AS ev,
      list_transform(hz, lambda q: CASE WHEN len(q) >= 3 THEN sqrt(list_sum(list_transform(q, lambda p: p.r * p.r)) / len(q)) END) AS sg FROM g),
    f AS (SELECT *, (coalesce(sg[1] * 0.15, 0) + coalesce(sg[2] * 0.35, 0) + coalesce(sg[3] * 0.3, 0) + coalesce(sg[4] * 0.2, 0)) /
      (CASE WHEN sg[1] IS NULL THEN 0 ELSE 0.15 END + CASE WHEN sg[2] IS NULL THEN 0 ELSE 0.35 END + CASE WHEN sg[3] IS NULL THEN 0 ELSE 0.3 END + CASE WHEN sg[4] IS NULL THEN 0 ELSE 0.2 END) AS bl FROM e2)"""
_JUMP_SQL = "coalesce(list_sum(list_transform(list_filter(ab, lambda a: a > greatest(5 * ab[len(ab) // 2 + 1], 1e-12)), lambda a: a * a)), 0) / list_sum(sq)"


@query(
    "multi_horizon_volatility",
    f"""WITH {DERIVED_SQL}, {_VOL_CTES}
    SELECT {TICKER_SQL} AS ticker, event_id + 10 AS line, round(greatest(1e-6, 0.5 * sqrt(ev) + 0.5 * bl) * 1e6, 4) AS sigma_e6, round(sqrt(ev) * 1e6, 4) AS ewma_e6,
      round(sg[1] * 1e6, 4) AS s10_e6, round(sg[2] * 1e6, 4) AS s60_e6, round(sg[3] * 1e6, 4) AS s300_e6, round(sg[4] * 1e6, 4) AS s1800_e6,
      round({_JUMP_SQL}, 8) AS jump FROM f""",
)
def multi_horizon_volatility(spark, sf_dir):
    state = index_state(derived_windows(spark, sf_dir)).filter("vol is not null")
    return rounded(
        state.select(
            "ticker", "line", F.round(F.col("vol.sigma_per_s") * 1e6, 4).alias("sigma_e6"), F.round(F.col("vol.ewma_sigma_per_s") * 1e6, 4).alias("ewma_e6"),
            *(F.round(F.col(f"vol.sigma_{h}s") * 1e6, 4).alias(f"s{h}_e6") for h in (10, 60, 300, 1800)), F.col("vol.jump_ratio").alias("jump"),
        ), 8,
    )


@query(
    "rolling_realised_sigma",
    f"""WITH {DERIVED_SQL}, s AS (SELECT w, event_id, t, price, (t - lag(t) OVER o) / 1000.0 AS dt, ln(price / lag(price) OVER o) AS r, lag(t) OVER o AS t0 FROM ticks WINDOW o AS (PARTITION BY w ORDER BY t, event_id)),
    j AS (SELECT a.w, a.event_id, count(*) AS pts, avg(CASE WHEN b.t0 >= a.t - 120000 AND b.dt > 0 THEN b.r * b.r / b.dt END) AS m FROM s a JOIN s b ON a.w = b.w AND b.t BETWEEN a.t - 120000 AND a.t GROUP BY a.w, a.event_id)
    SELECT {TICKER_SQL} AS ticker, event_id + 10 AS line, round(CASE WHEN pts >= 3 THEN sqrt(m) END * 1e6, 4) AS sigma_e6 FROM j""",
)
def rolling_realised_sigma(spark, sf_dir):
    w = derived_windows(spark, sf_dir)
    s = rolling_sigma(w.ticks, ["ticker"], T, ORDER, "value")
    return rounded(s.select("ticker", "line", (F.col("sigma_per_s") * 1e6).alias("sigma_e6")), 4)


@query(
    "warmup_interval_join",
    f"""WITH {DERIVED_SQL}, b AS (SELECT w, min(t) AS f FROM (SELECT w, {START_SQL} AS t FROM r) GROUP BY w)
    SELECT {TICKER_SQL.replace('w AS', 'b.w AS')} AS ticker, count(*) AS ticks, round(avg(ticks.price), 6) AS mean, min(tick_ms) AS first_ms, max(tick_ms) AS last_ms
    FROM b JOIN ticks ON ticks.w < b.w AND ticks.tick_ms >= b.f - 3600000 AND ticks.tick_ms < b.f GROUP BY b.w""",
)
def warmup_interval_join(spark, sf_dir):
    w = derived_windows(spark, sf_dir)
    out = warmup_ticks(w.ticks, w.markets).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("ticks"), F.avg("value").alias("mean"), F.min("tick_ms").alias("first_ms"), F.max("tick_ms").alias("last_ms")
    )
    return rounded(out)


@query(
    "trade_flow_at_ticks",
    f"""WITH {DERIVED_SQL} SELECT {TICKER_SQL.replace('w AS', 'x.w AS')} AS ticker, x.event_id + 10 AS line, coalesce(sum(CASE WHEN taker = 'bid' THEN count ELSE -count END) FILTER (trade.t >= x.t - 1000), 0) AS flow_1s,
      coalesce(sum(CASE WHEN taker = 'bid' THEN count ELSE -count END) FILTER (trade.t >= x.t - 5000), 0) AS flow_5s, coalesce(sum(CASE WHEN taker = 'bid' THEN count ELSE -count END), 0) AS flow_30s,
      count(trade.t) FILTER (trade.t >= x.t - 5000) AS trades_5s
    FROM ticks x LEFT JOIN trade ON trade.w = x.w AND trade.t >= x.t - 30000 AND (trade.t < x.t OR (trade.t = x.t AND trade.event_id < x.event_id)) GROUP BY x.w, x.event_id""",
)
def trade_flow_at_ticks(spark, sf_dir):
    w = derived_windows(spark, sf_dir)
    return attach_flow(w.ticks.select("ticker", T, *ORDER), w.trades, SLICE_MS).select("ticker", "line", "flow_1s", "flow_5s", "flow_30s", "trades_5s")


@query(
    "top_n_levels",
    """WITH l AS (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN 'ask' ELSE 'bid' END AS side, floor(l_extendedprice / l_quantity) AS price, l_quantity AS size FROM lineitem),
    g AS (SELECT l_partkey, side, price, sum(size) AS size FROM l GROUP BY ALL)
    SELECT l_partkey, side, price, size, row_number() OVER (PARTITION BY l_partkey, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS level FROM g QUALIFY level <= 3""",
)
def top_n_levels(spark, sf_dir):
    from tickloom.catalog.base import table

    side = F.when(F.col("l_returnflag") == "R", "ask").otherwise("bid")
    levels = table(spark, sf_dir, "lineitem").groupBy("l_partkey", side.alias("side"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price")).agg(F.sum("l_quantity").alias("size"))
    return top_levels(levels, ["l_partkey"], "side", "price", "size", 3)


_QUEUE_SQL = f"""WITH {DERIVED_SQL}, q AS (SELECT w, t, event_id, CASE WHEN event_type = 'click' THEN 'bid' ELSE 'ask' END AS side, CASE WHEN event_type = 'click' THEN 0.47 + (k % 6) / 100.0::DOUBLE ELSE 0.48 + (k % 6) / 100.0::DOUBLE END AS price,
      CAST(3 + k % 20 AS DOUBLE) AS count, CAST(k % 12 AS DOUBLE) AS ahead, lead(t) OVER (PARTITION BY w, event_type ORDER BY t, event_id) AS ends FROM r WHERE event_type IN ('click', 'view')),
    h AS (SELECT x.w, x.t, x.event_id AS trade_id, q.event_id AS quote_id, q.side, q.price, q.count, q.ahead, x.count AS n FROM trade x JOIN q ON q.w = x.w AND q.side = CASE WHEN x.taker = 'ask' THEN 'bid' ELSE 'ask' END
      AND x.t >= q.t AND (q.ends IS NULL OR x.t < q.ends) AND CASE WHEN q.side = 'bid' THEN round(x.price * 100) <= round(q.price * 100) ELSE round(x.price * 100) >= round(q.price * 100) END),
    c AS (SELECT *, sum(n) OVER (PARTITION BY quote_id ORDER BY t, trade_id) AS cum FROM h)
    SELECT {TICKER_SQL} AS ticker, CAST(quote_id AS VARCHAR) AS quote_id, t AS fill_ts_ms, side AS fill_side, round(price, 4) AS fill_price,
      CAST(greatest(0, least(count, cum - ahead)) - greatest(0, least(count, cum - n - ahead)) AS DOUBLE) AS fill_count FROM c WHERE greatest(0, least(count, cum - ahead)) > greatest(0, least(count, cum - n - ahead))"""


@query("queue_fills", _QUEUE_SQL)
def queue_fills(spark, sf_dir):
    from tickloom.operators.slices import running

    w = derived_windows(spark, sf_dir)
    k = F.col("k")
    is_bid = F.col("event_type") == "click"
    rows = laid_out(spark, sf_dir).filter(F.col("event_type").isin("click", "view"))
    ends = running(rows, ["w", "event_type"], "ms", "event_id", SLICE_MS, {"_end": ("lead", F.col("ms"))})
    table = ends.select(
        F.concat(F.lit("M"), F.lpad(F.col("w").cast("string"), 6, "0")).alias("ticker"), F.when(is_bid, "bid").otherwise("ask").alias("side"),
        F.col("event_id").cast("string").alias("quote_id"), F.round(F.when(is_bid, 47 + k % 6).otherwise(48 + k % 6) / 100.0, 4).alias("price"),
        (3 + k % 20).cast("double").alias("count"), (k % 12).cast("double").alias("queue_ahead"), F.col("ms").alias("activate_ts_ms"), F.col("_end").alias("cancel_ts_ms"), F.lit(0.5).alias("fair_yes"),
    )
    out = fills.queue_fills(table, w.trades, ["ticker"], T, ORDER, SLICE_MS)
    return out.select("ticker", "quote_id", "fill_ts_ms", "fill_side", "fill_price", "fill_count")


def _fresh_sql(clock: str, value: str) -> str:
    """Values of the venues heard from in the last two seconds, sorted."""
    return f"list_sort(list_filter([{', '.join(f'CASE WHEN t - {clock}{v} <= 2000 THEN {value}{v} END' for v in range(3))}], lambda x: x IS NOT NULL))"


_OUTSIDE_SQL = "100 * (1 + (value - 45) / 40000)"
_CARRIED = {"bbo": "bbo", "idx": "idx", "trade_ms": "trade_ms", **{f"{n}{v}": f"{n}{v}" for n in ("sp_ts", "sp", "l2_ts", "l2_mi", "l2_im") for v in range(3)}}
# What a sample of the derived recording holds, step by step: one time line, its state, the throttle, flows, targets.
SAMPLES_SQL = f"""{_BEST_CTES}, {_VOL_CTES},
    x0 AS (SELECT w, t, event_id + 10 AS line, event_type, value, k, event_id FROM r UNION ALL SELECT w, {START_SQL}, 2, 'first', NULL, NULL, -1 FROM n0
      UNION ALL SELECT w, {START_SQL} + {WINDOW_MS}, {1 << 40}, 'close', NULL, NULL, NULL FROM n0),
    x1 AS (SELECT x0.*, CASE WHEN v.w IS NOT NULL THEN {{'valid': v.valid, 'bid': b.bid, 'ask': b.ask, 'bs': b.bid_size, 'az': b.ask_size, 'bd': b.bid_depth, 'ad': b.ask_depth}} END AS bbo,
      CASE WHEN x0.event_type = 'error' THEN {{'p': round(100 * (1 + (x0.value - 50) / 50000), 4), 'sigma': CASE WHEN f.ev IS NOT NULL AND f.bl IS NOT NULL THEN greatest(1e-6, 0.5 * sqrt(f.ev) + 0.5 * f.bl) END, 'jump': {_JUMP_SQL}}} END AS idx, CASE WHEN x0.event_type = 'purchase' THEN x0.t END AS trade_ms
      FROM x0 LEFT JOIN v ON v.w = x0.w AND v.event_id = x0.event_id AND x0.event_type IN ('click', 'view', 'first') LEFT JOIN b ON b.w = v.w AND b.event_id = v.event_id LEFT JOIN f ON f.w = x0.w AND f.event_id = x0.event_id),
    x2 AS (SELECT *, {", ".join(f"CASE WHEN event_type = 'signup' AND k % 2 = {kind} AND k % 3 = {venue} THEN {value} END AS {name}{venue}"
      for kind, name, value in ((0, "sp_ts", "coalesce(nullif(t - k * 10, 0), t)"), (0, "sp", _OUTSIDE_SQL), (1, "l2_ts", "t"), (1, "l2_mi", f"{_OUTSIDE_SQL} + (k - 50) / 1000"), (1, "l2_im", "(k - 50) / 60")) for venue in range(3))} FROM x1),
    x3 AS (SELECT w, t, line, {", ".join(f"last_value({c} IGNORE NULLS) OVER o AS {c}" for c in _CARRIED)} FROM x2 WINDOW o AS (PARTITION BY w ORDER BY t, line ROWS UNBOUNDED PRECEDING)),
    x4 AS (SELECT * FROM x3 WHERE bbo.valid AND bbo.bid IS NOT NULL AND bbo.ask IS NOT NULL AND idx.p IS NOT NULL AND idx.sigma IS NOT NULL),
    u0 AS (SELECT w, t, min(line) AS line FROM x4 GROUP BY w, t), u1 AS (SELECT a.w, a.t, a.line, c.t AS nt FROM (SELECT *, t + 250 AS probe FROM u0) a ASOF LEFT JOIN u0 c ON a.w = c.w AND a.probe <= c.t),
    walk AS (SELECT w, t, line, nt FROM u1 QUALIFY row_number() OVER (PARTITION BY w ORDER BY t) = 1 UNION ALL SELECT u1.w, u1.t, u1.line, u1.nt FROM walk JOIN u1 ON u1.w = walk.w AND u1.t = walk.nt),
    y0 AS (SELECT x4.*, (bbo.bid + bbo.ask) / 2 AS mid, greatest(0, {START_SQL} // 1000 + {WINDOW_MS // 1000} - t / 1000.0::DOUBLE) AS secs, {_fresh_sql("sp_ts", "sp")} AS sps, {_fresh_sql("l2_ts", "l2_mi")} AS mis, {_fresh_sql("l2_ts", "l2_im")} AS ims FROM x4 JOIN walk USING (w, t, line)),
    y1 AS (SELECT y0.w, y0.t, y0.line, {", ".join(f"coalesce(sum(CASE WHEN taker = 'bid' THEN count ELSE -count END) FILTER (trade.t >= y0.t - {ms}), 0) AS {n}" for n, ms in (("flow_1s", 1000), ("flow_5s", 5000), ("flow_30s", 30000)))}, count(*) FILTER (trade.t >= y0.t - 5000) AS trades_5s
      FROM y0 LEFT JOIN trade ON trade.w = y0.w AND trade.t >= y0.t - 30000 AND (trade.t < y0.t OR (trade.t = y0.t AND trade.event_id + 10 <= y0.line)) GROUP BY ALL),
    y2 AS (SELECT y0.*, flow_1s, flow_5s, flow_30s, trades_5s, bbo.bs - lag(bbo.bs) OVER o AS d_bid, bbo.az - lag(bbo.az) OVER o AS d_ask,
      list_sum(list_transform(range(1, 61), lambda i: (2 * (60 - i) + 1) * (CASE WHEN secs >= 60 THEN secs - 60 + i ELSE secs / 60 * i END))) AS s1, idx.sigma * idx.sigma AS vv,
      list_sum(list_transform(range(1, 61), lambda i: (2 * (60 - i) + 1) * pow(CASE WHEN secs >= 60 THEN secs - 60 + i ELSE secs / 60 * i END, 2))) AS s2,
      list_sum(list_transform(range(1, 61), lambda i: (2 * (60 - i) + 1) * pow(CASE WHEN secs >= 60 THEN secs - 60 + i ELSE secs / 60 * i END, 3))) AS s3
      FROM y0 JOIN y1 USING (w, t, line) WINDOW o AS (PARTITION BY w ORDER BY t)),
    y3 AS (SELECT *, (vv * s1 + vv * vv * s2 / 2 + vv * vv * vv * s3 / 6) / 3600 AS rv FROM y2), y4 AS (SELECT *, rv - rv * rv / 2 + rv * rv * rv / 3 AS lgv FROM y3),
    y5 AS (SELECT *, CASE WHEN secs > 0 THEN (ln(100.0::DOUBLE) - (ln(idx.p) - 0.5 * lgv)) / sqrt(lgv) ELSE 0 END AS zz FROM y4), {cdf_cte("y6", "y5", "zz", "below")},
    fair AS (SELECT * EXCLUDE (s1, s2, s3, vv, rv, lgv, zz), CASE WHEN secs > 0 THEN greatest(0.001, least(0.999, 1 - below)) WHEN idx.p >= 100 THEN 1 ELSE 0 END AS gbm FROM y6),
    lt AS (SELECT w, arg_max(price, (tick_ms, -event_id)) AS last_tick FROM ticks GROUP BY w),
    won AS (SELECT w, CASE WHEN w % 3 = 0 THEN CASE WHEN w % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END WHEN last_tick IS NOT NULL THEN CASE WHEN CAST(last_tick AS DECIMAL(18, 2)) >= 100 THEN 1.0 ELSE 0.0 END END AS outcome FROM n0 LEFT JOIN lt USING (w)),
    gaps AS (SELECT w, max(gap) AS gap FROM (SELECT w, (tick_ms - lag(tick_ms) OVER (PARTITION BY w ORDER BY t, event_id)) / 1000.0::DOUBLE AS gap FROM ticks) GROUP BY w)"""


def _target_sql(ms: int) -> str:
    return f"t{ms} AS (SELECT a.w, a.t, CASE WHEN c.t <= a.t + {ms} + 1500 THEN c.mid - a.mid END AS move FROM (SELECT *, t + {ms} AS probe FROM fair) a ASOF LEFT JOIN fair c ON a.w = c.w AND a.probe <= c.t)"


# Digits that are compared; sigma is per second and small.
DIGITS = {"sigma_per_s": 12, "gbm_fair": 7, "gbm_fair_minus_mid": 7, "z_moneyness": 7}
_FEATURES = {
    "schema_version": "1", "ticker": TICKER_SQL, "ts_ms": "t", "seconds_to_close": "secs", "mid": "mid", "spread": "bbo.ask - bbo.bid", "bid": "bbo.bid", "ask": "bbo.ask", "bid_size": "CAST(bbo.bs AS DOUBLE)", "ask_size": "CAST(bbo.az AS DOUBLE)",
    "microprice_minus_mid": "(bbo.ask * bbo.bs + bbo.bid * bbo.az) / (bbo.bs + bbo.az) - mid", "imb_top1": "(bbo.bs - bbo.az) / (bbo.bs + bbo.az)", "imb_top3": "(bbo.bd - bbo.ad) / (bbo.bd + bbo.ad)", "depth_top3": "CAST(bbo.bd + bbo.ad AS DOUBLE)",
    "bid_size_delta": "CAST(coalesce(d_bid, 0) AS DOUBLE)", "ask_size_delta": "CAST(coalesce(d_ask, 0) AS DOUBLE)", "flow_1s": "CAST(flow_1s AS DOUBLE)", "flow_5s": "CAST(flow_5s AS DOUBLE)", "flow_30s": "CAST(flow_30s AS DOUBLE)", "trades_5s": "trades_5s",
    "last_trade_age_ms": "t - trade_ms", "brti": "idx.p", "ext_basis_bps": "(sps[len(sps) // 2 + 1] - idx.p) / idx.p * 10000", "ext_dispersion_bps": "CASE WHEN len(sps) > 1 THEN (sps[-1] - sps[1]) / idx.p * 10000 END",
    "ext_micro_lead_bps": "(mis[len(mis) // 2 + 1] - idx.p) / idx.p * 10000", "ext_imbalance": "ims[len(ims) // 2 + 1]", "ext_venues_fresh": "CAST(len(sps) AS INTEGER)", "sigma_per_s": "idx.sigma", "jump_ratio": "idx.jump",
    "z_moneyness": "ln(idx.p / 100) / (idx.sigma * sqrt(greatest(1e-9, secs)))", "gbm_fair": "gbm", "gbm_fair_minus_mid": "gbm - mid", "final_minute_count": "0", "outcome_yes": "outcome", "quality_flags": "CASE WHEN gap > 5 THEN 'brti_gap' ELSE '' END",
    "fwd_mid_delta_1s": "t1000.move", "fwd_mid_delta_5s": "t5000.move", "fwd_mid_delta_30s": "t30000.move",
}
_EXACT = {"schema_version", "ticker", "ts_ms", "trades_5s", "last_trade_age_ms", "ext_venues_fresh", "final_minute_count", "quality_flags"}
FEATURES_SQL = f"""{SAMPLES_SQL}, {_target_sql(1000)}, {_target_sql(5000)}, {_target_sql(30000)},
    features AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _FEATURES.items())} FROM fair JOIN won USING (w) LEFT JOIN gaps USING (w) JOIN t1000 USING (w, t) JOIN t5000 USING (w, t) JOIN t30000 USING (w, t))"""


def features_rounded(df):
    """Doubles at the digits that both engines agree on."""
    return df.select(*[F.col(n) if n in _EXACT else (F.round(n, DIGITS.get(n, 6)) + F.lit(0.0)).alias(n) for n in df.columns])


@query("feature_table", f"WITH RECURSIVE {FEATURES_SQL} SELECT {', '.join(n if n in _EXACT else f'round({n}, {DIGITS.get(n, 6)}) + 0.0 AS {n}' for n in _FEATURES)} FROM features")
def features(spark, sf_dir):
    return features_rounded(feature_table(derived_windows(spark, sf_dir)))


def _simulated(spark, sf_dir, spec="baseline"):
    """(windows, state, fills) of open-loop quotes on the derived recording."""
    w = derived_windows(spark, sf_dir)
    book, changes = book_of(w)
    state = cut(market_state(w, book=book))
    context = cut(quotes.decision_context(w, state))
    table = cut(quotes.quote_lifetimes(quotes.variant_quotes(context, w.markets, parse_variants(spec)), SLICE_MS))
    done, _ = fills.recorded_fills(table, state, changes, w.trades, w.markets, SLICE_MS)
    return w, state, cut(done)


@query("quote_lifetimes")
def quote_lifetimes(spark, sf_dir):
    w = derived_windows(spark, sf_dir)
    context = cut(quotes.decision_context(w, cut(market_state(w))))
    return quotes.quote_lifetimes(quotes.variant_quotes(context, w.markets, parse_variants("baseline,micro25")), SLICE_MS)


@query("label_rows")
def labels(spark, sf_dir):
    w, state, done = _simulated(spark, sf_dir)
    mids = fills.mid_series(state, w.markets)
    return fills.label_rows(done.drop("variant"), cut(feature_table(w, state)), mids, SLICE_MS)


@query("model_scores")
def model_scores(spark, sf_dir):
    return scores.score_models(derived_windows(spark, sf_dir))


def _clipped_sql(p: str) -> str:
    return f"greatest(1e-9, least(1 - 1e-9, {p}))"


@query(
    "calibration_by_bucket",
    f"""WITH RECURSIVE {FEATURES_SQL}, s AS (SELECT CASE WHEN seconds_to_close >= 90 AND seconds_to_close < 300 THEN '90-300' WHEN seconds_to_close >= 300 AND seconds_to_close < 600 THEN '300-600' WHEN seconds_to_close >= 600 AND seconds_to_close < 900 THEN '600-900' END AS bucket,
      outcome_yes AS o, {_clipped_sql("gbm_fair")} AS g, {_clipped_sql("mid")} AS m FROM features WHERE outcome_yes IS NOT NULL)
    SELECT bucket, count(*) AS n, {", ".join(f"round(avg(({p} - o) * ({p} - o)), 6) AS brier_{x}, round(avg(-(o * ln({p}) + (1 - o) * ln(1 - {p}))), 5) AS log_loss_{x}" for p, x in (("g", "gbm"), ("m", "mid")))}
    FROM s WHERE bucket IS NOT NULL GROUP BY bucket HAVING count(*) >= 100""".replace(", s AS (SELECT CASE", ", cal AS (SELECT CASE").replace("FROM s WHERE bucket", "FROM cal WHERE bucket"),
)
def calibration_by_bucket(spark, sf_dir):
    found = fit.calibration(cut(feature_table(derived_windows(spark, sf_dir))))
    scores = ("brier_gbm", "brier_mid", "log_loss_gbm", "log_loss_mid")
    return found.select("bucket", "n", *[(F.round(c, 5 if "log" in c else 6) + F.lit(0.0)).alias(c) for c in scores])


FINAL_MS = 200_000


def _final_averages(spark, sf_dir):
    """The derived recording with a partial settlement average in the index prints of the last 200 s of two windows in three."""
    e = derived_events(spark, sf_dir)
    w = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    close = F.lit(BASE_MS) + (w + 1) * WINDOW_MS
    price = F.get_json_object(F.get_json_object("payload", "$.msg.data"), "$.value")
    n = F.col("line") % 41 + 30
    final = F.struct(price.alias("value"), n.cast("string").alias("window_size"), (close + F.col("line") % 3 * 1000).cast("string").alias("window_end_ts_exclusive"))
    msg = F.from_json(F.get_json_object("payload", "$.msg"), "index_id string, data string")
    richer = F.to_json(F.struct(F.lit(INDEX_EVENT).alias("type"), F.struct(msg["index_id"].alias("index_id"), msg["data"].alias("data"), final.alias("last_60s_windowed_average_15min")).alias("msg")))
    late = (F.col("event_type") == INDEX_EVENT) & (F.col("receive_ts_ms") >= close - FINAL_MS) & (w % 3 != 0)
    return Windows.from_recordings(cut(e.withColumn("payload", F.when(late, richer).otherwise(F.col("payload")))), slice_ms=SLICE_MS)


_FINAL_SQL = f"""{DERIVED_SQL}, fa AS (SELECT *, {START_SQL} + {WINDOW_MS} AS close_ms, t >= {START_SQL} + {WINDOW_MS} - {FINAL_MS} AND w % 3 <> 0 AS late, (event_id + 10) % 41 + 30 AS n, {START_SQL} + {WINDOW_MS} + (event_id + 10) % 3 * 1000 AS end_ms FROM ticks)"""


@query(
    "settlement_by_final_average",
    f"""WITH {_FINAL_SQL}, a0 AS (SELECT DISTINCT w FROM r), av AS (SELECT w, arg_max(price, (end_ms, -t, -event_id)) AS v FROM fa WHERE late AND n >= 60 AND abs(end_ms - close_ms) <= {END_TOLERANCE_MS} GROUP BY w),
    lt AS (SELECT w, arg_max(price, (tick_ms, -event_id)) AS v FROM ticks GROUP BY w), j AS (SELECT a0.w, CASE WHEN a0.w % 3 <> 0 THEN coalesce(av.v, lt.v) END AS v, av.v IS NOT NULL AS averaged FROM a0 LEFT JOIN av USING (w) LEFT JOIN lt USING (w))
    SELECT {TICKER_SQL} AS ticker, CASE WHEN w % 3 = 0 THEN CASE WHEN w % 2 = 0 THEN 'yes' ELSE 'no' END WHEN v IS NOT NULL THEN CASE WHEN CAST(v AS DECIMAL(18, 2)) >= 100 THEN 'yes' ELSE 'no' END END AS result,
      CASE WHEN w % 3 = 0 THEN 'official' WHEN averaged THEN 'final_60s_average' WHEN v IS NOT NULL THEN 'last_preclose_tick' END AS settlement_source, v AS reference_value FROM j""",
)
def settlement_by_final_average(spark, sf_dir):
    w = _final_averages(spark, sf_dir)
    return infer_settlement(w.events, w.ticks, w.markets)


@query(
    "partial_average_carried",
    f"""WITH {_FINAL_SQL}, y AS (SELECT r.w, r.event_id, r.t, last_value(CASE WHEN late THEN {{'a': fa.price, 'n': fa.n}} END IGNORE NULLS) OVER (PARTITION BY r.w ORDER BY r.t, r.event_id) AS f FROM r LEFT JOIN fa ON fa.w = r.w AND fa.event_id = r.event_id)
    SELECT {TICKER_SQL} AS ticker, event_id + 10 AS line, f.a AS final_average, CAST(f.n AS INTEGER) AS final_count FROM y WHERE f IS NOT NULL""",
)
def partial_average_carried(spark, sf_dir):
    """The newest partial average at every event after it."""
    state = market_state(_final_averages(spark, sf_dir)).filter("final_average IS NOT NULL AND line < 1099511627776")
    return state.select("ticker", "line", "final_average", F.col("final_count").cast("int").alias("final_count"))


VARIANTS = "baseline,micro25,extlead50,wide2,close300,micro25+extlead50,micro25+wide2+close300"


@query("variant_comparison")
def variant_comparison(spark, sf_dir):
    """All windows quoted by plain and by fitted variants; the models come from the train windows."""
    from tickloom.catalog.modelling import fitted_models

    models = fitted_models(spark, sf_dir)
    names = [VARIANTS, *(["toxgate6", "combo25x6"] if models.gate else []), *(["modelv", "modelv50"] if models.value else [])]
    variants = parse_variants(",".join(names), models.gate, models.value)
    return ab.ab_summary(cut(ab.window_outcomes(models.windows, variants)))


@query("variant_stress_grid")
def variant_stress_grid(spark, sf_dir):
    from tickloom.plans.reports import stress_flips

    grid = stress_grid(parse_variants("baseline"), (75, 150, 300), (0.0, 1.0))
    return stress_flips(ab.window_outcomes(derived_windows(spark, sf_dir), grid), "75/0")

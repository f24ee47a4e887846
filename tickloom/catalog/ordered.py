"""Queries on ordered events: rolling frames, as-of joins, sampling, running state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.base import DAY, EVENTS_SQL, HOUR, events, query, rounded, table
from tickloom.functions.quoting import dispersion_bps, signed_by_aggressor, signed_markout, toxic_label, true_median, upper_median
from tickloom.operators import pnl
from tickloom.operators.asof import asof_join, first_after
from tickloom.operators.flow import rolling
from tickloom.operators.metrics import hit_rate, window_ic
from tickloom.operators.quality import changes_only, consecutive, max_gap, sequence_gaps, sustained
from tickloom.operators.reconcile import feed_divergence, position_divergence
from tickloom.operators.sampling import forced_sample, greedy_sample
from tickloom.operators.slices import reflected_running_sum, running
from tickloom.plans.fills import markouts
from tickloom.sources.venues import composite_price

USER = ["user_id"]
WIDTH = 2 * DAY

SIGNED_SQL = "CASE WHEN event_type IN ('purchase', 'signup') THEN value WHEN event_type IN ('error', 'view') THEN -value END"


def signed():
    side = F.when(F.col("event_type").isin("purchase", "signup"), "bid").when(F.col("event_type").isin("error", "view"), "ask")
    return signed_by_aggressor(F.col("value"), side)


@query(
    "rolling_signed_flow",
    f"""WITH {EVENTS_SQL}, s AS (SELECT *, {SIGNED_SQL} AS v FROM e)
    SELECT event_id, user_id,
      round(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW), 0), 4) AS flow_6h,
      round(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW), 0), 4) AS flow_24h,
      round(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW), 0), 4) AS flow_72h,
      count(v) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS trades_24h
    FROM s""",
)
def rolling_signed_flow(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("v", signed())
    flow = rolling(
        rows, USER, "t", "event_id", 5 * DAY,
        {"flow_6h": (F.col("v"), 6 * HOUR), "flow_24h": (F.col("v"), DAY), "flow_72h": (F.col("v"), 3 * DAY),
         "trades_24h": (F.col("v").isNotNull().cast("long"), DAY)},
    )
    return rounded(flow.select("event_id", "user_id", "flow_6h", "flow_24h", "flow_72h", "trades_24h"), 4)


@query(
    "last_event_age",
    f"""WITH {EVENTS_SQL}
    SELECT event_id, t - max(CASE WHEN event_type = 'purchase' THEN t END) OVER (PARTITION BY user_id ORDER BY t) AS age_us,
      t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS since_previous_us FROM e""",
)
def last_event_age(spark, sf_dir):
    bought = F.when(F.col("event_type") == "purchase", F.col("t"))
    state = running(events(spark, sf_dir), USER, "t", "event_id", WIDTH, {"last": ("last", bought), "before": ("lag", F.col("t"))})
    return state.select("event_id", (F.col("t") - F.col("last")).alias("age_us"), (F.col("t") - F.col("before")).alias("since_previous_us"))


@query(
    "asof_backward_strict",
    f"""WITH {EVENTS_SQL}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view')
    SELECT p.event_id, v.event_id AS view_id, v.value AS view_value, p.t - v.t AS age_us
    FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.t > v.t WHERE p.t - v.t <= {2 * DAY}""",
)
def asof_backward_strict(spark, sf_dir):
    e = events(spark, sf_dir)
    joined = asof_join(
        e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), USER, "t", "t", width=4 * DAY, strict=True,
        tolerance=2 * DAY, right_seq="event_id", right_columns=["event_id", "value", "t"],
    ).filter("matched is not null")
    return joined.select(
        "event_id", F.col("matched.event_id").alias("view_id"), F.col("matched.value").alias("view_value"), (F.col("t") - F.col("matched.t")).alias("age_us")
    )


@query(
    "asof_latest_state",
    f"""WITH {EVENTS_SQL}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view')
    SELECT p.event_id, v.event_id AS view_id, v.value AS view_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t""",
)
def asof_latest_state(spark, sf_dir):
    e = events(spark, sf_dir)
    joined = asof_join(
        e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), USER, "t", "t", width=WIDTH, right_seq="event_id",
        right_columns=["event_id", "value", "t"],
    )
    return joined.select("event_id", F.col("matched.event_id").alias("view_id"), F.col("matched.value").alias("view_value"))


@query(
    "asof_forward_tolerance",
    f"""WITH {EVENTS_SQL}, c AS (SELECT *, t + {HOUR} AS probe FROM e WHERE event_type = 'click'), p AS (SELECT * FROM e WHERE event_type = 'purchase')
    SELECT c.event_id, CASE WHEN p.t - c.probe <= {DAY} THEN p.event_id END AS purchase_id,
      CASE WHEN p.t - c.probe <= {DAY} THEN p.t - c.t END AS wait_us
    FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.probe <= p.t""",
)
def asof_forward_tolerance(spark, sf_dir):
    e = events(spark, sf_dir)
    clicks = e.filter("event_type = 'click'").withColumn("probe", F.col("t") + HOUR)
    joined = asof_join(
        clicks, e.filter("event_type = 'purchase'"), USER, "probe", "t", width=4 * DAY, direction="forward", tolerance=DAY,
        right_seq="event_id", right_columns=["event_id", "t"],
    )
    return joined.select("event_id", F.col("matched.event_id").alias("purchase_id"), (F.col("matched.t") - F.col("t")).alias("wait_us"))


def _target_sql(name: str, horizon: int, slack: int) -> str:
    return (
        f"round(first(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {horizon} FOLLOWING AND {horizon + slack} FOLLOWING) - value, 6) AS {name}"
    )


TARGETS = {"move_6h": 6 * HOUR, "move_24h": DAY, "move_72h": 3 * DAY}


@query(
    "forward_targets",
    f"WITH {EVENTS_SQL} SELECT event_id, " + ", ".join(_target_sql(n, h, 12 * HOUR) for n, h in TARGETS.items()) + " FROM e",
)
def forward_targets(spark, sf_dir):
    ahead = first_after(events(spark, sf_dir), USER, "t", 5 * DAY, "value", TARGETS, 12 * HOUR)
    return rounded(ahead.select("event_id", *[(F.col(n) - F.col("value")).alias(n) for n in TARGETS]))


HORIZONS = (HOUR, 6 * HOUR, DAY)


def _forward_pairs(spark, sf_dir):
    e = events(spark, sf_dir)
    probes = e.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS]))).withColumn("probe", F.col("t") + F.col("horizon"))
    met = asof_join(probes, e, USER, "probe", "t", width=WIDTH, direction="forward", right_seq="event_id", right_columns=["t", "value"])
    return met.filter("matched is not null").select(
        "user_id", "horizon", (F.col("k") - 50).cast("double").alias("signal"), (F.col("matched.value") - F.col("value")).alias("move")
    )


_PAIRS_SQL = f"""{EVENTS_SQL}, p AS (SELECT e.*, h.horizon, t + h.horizon AS probe FROM e, (VALUES ({HORIZONS[0]}), ({HORIZONS[1]}), ({HORIZONS[2]})) AS h(horizon)),
    m AS (SELECT p.user_id, p.horizon, CAST(p.k - 50 AS DOUBLE) AS signal, r.value - p.value AS move FROM p ASOF JOIN e r ON p.user_id = r.user_id AND p.probe <= r.t)"""


@query(
    "forward_ic",
    f"""WITH {_PAIRS_SQL}, w AS (SELECT user_id, horizon,
      CASE WHEN count(*) >= 30 AND stddev_pop(signal) > 0 AND stddev_pop(move) > 0 THEN corr(signal, move) END AS ic FROM m GROUP BY ALL)
    SELECT horizon, count(ic) AS windows, round(avg(ic), 8) AS ic FROM w GROUP BY horizon""",
)
def forward_ic(spark, sf_dir):
    ics = window_ic(_forward_pairs(spark, sf_dir), ["user_id", "horizon"], "signal", "move", 30)
    return rounded(ics.groupBy("horizon").agg(F.count("ic").alias("windows"), F.avg("ic").alias("ic")), 8)


@query(
    "forward_hit_rate",
    f"""WITH {_PAIRS_SQL}, w AS (SELECT user_id, horizon,
      avg(CASE WHEN abs(signal) > 1e-12 AND abs(move) > 1e-12 THEN CASE WHEN signal * move > 0 THEN 1.0 ELSE 0.0 END END) AS hit FROM m GROUP BY ALL)
    SELECT horizon, round(avg(hit), 8) AS hit_rate FROM w GROUP BY horizon""",
)
def forward_hit_rate(spark, sf_dir):
    per_user = _forward_pairs(spark, sf_dir).groupBy("user_id", "horizon").agg(hit_rate(F.col("signal"), F.col("move")).alias("hit"))
    return rounded(per_user.groupBy("horizon").agg(F.avg("hit").alias("hit_rate")), 8)


SAMPLE_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, n AS (SELECT a.user_id, a.t, a.event_id, b.t AS nt FROM
      (SELECT user_id, t, event_id, t + {DAY} AS probe FROM e) a ASOF LEFT JOIN e b ON a.user_id = b.user_id AND a.probe <= b.t),
    walk AS (SELECT user_id, t, event_id, nt FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t) = 1
      UNION ALL SELECT n.user_id, n.t, n.event_id, n.nt FROM walk JOIN n ON n.user_id = walk.user_id AND n.t = walk.nt)
    SELECT user_id, event_id, t FROM walk"""


@query("greedy_sample", SAMPLE_SQL)
def greedy_sample_daily(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "t", "event_id")
    return greedy_sample(e, USER, "t", "event_id", DAY, 5 * DAY).select("user_id", "event_id", "t")


FORCED_SQL = SAMPLE_SQL.replace("b.t AS nt FROM", "least(b.t, a.f) AS nt FROM").replace(
    "(SELECT user_id, t, event_id, t + ", "(SELECT user_id, t, event_id, min(CASE WHEN event_id % 17 = 0 THEN t END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f, t + "
)


@query("greedy_sample_forced", FORCED_SQL)
def greedy_sample_forced(spark, sf_dir):
    """A day between kept rows, but every 17th event passes."""
    e = events(spark, sf_dir).select("user_id", "t", "event_id")
    return forced_sample(e, USER, "t", "event_id", DAY, 5 * DAY, F.col("event_id") % 17 == 0).select("user_id", "event_id", "t")


@query("stream_greedy_sample_forced", FORCED_SQL)
def stream_greedy_sample_forced(spark, sf_dir):
    """The same rule over several micro-batches."""
    from tickloom.catalog.streams import drain, event_stream
    from tickloom.streaming import live

    rows = event_stream(spark, sf_dir).select("user_id", "event_id", "t", (F.col("event_id") % 17 == 0).alias("must"))
    return drain(live.sampled_stream(rows, DAY, ["user_id"], "t", ["t", "event_id"], force="must")).drop("must")


@query(
    "reflected_running_size",
    f"""WITH {EVENTS_SQL}, s AS (SELECT event_id, user_id, event_type, t, CAST(k - 55 AS BIGINT) AS d FROM e),
    r AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY t) AS s FROM s)
    SELECT event_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY t)) AS BIGINT) AS size FROM r""",
)
def reflected_running_size(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("d", (F.col("k") - 55).cast("long"))
    return reflected_running_sum(rows, USER, "t", "event_id", WIDTH, "d", "size").select("event_id", "size")


@query(
    "sequence_gaps",
    f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, event_type, k, k - lag(k) OVER (PARTITION BY user_id, event_type ORDER BY t) - 1 AS skip FROM e)
    SELECT user_id, event_type, count(*) FILTER (skip > 0) AS gaps, CAST(coalesce(sum(skip) FILTER (skip > 0), 0) AS BIGINT) AS missing,
      count(*) FILTER (skip < 0) AS repeats FROM s GROUP BY ALL""",
)
def sequence_gap_counts(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("k", F.col("k").cast("long"))
    return sequence_gaps(rows, ["user_id", "event_type"], "t", "event_id", "k", WIDTH)


@query(
    "max_gap",
    f"""WITH {EVENTS_SQL}, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM e)
    SELECT user_id, max(gap) AS max_gap_us FROM g GROUP BY user_id""",
)
def max_gap_per_user(spark, sf_dir):
    return max_gap(events(spark, sf_dir), USER, "t", "event_id", WIDTH, "max_gap_us")


@query(
    "size_delta_since_sample",
    SAMPLE_SQL.replace("SELECT user_id, event_id, t FROM walk", """
    SELECT w.user_id, w.event_id, round(coalesce(e.value - lag(e.value) OVER (PARTITION BY w.user_id ORDER BY w.t), 0), 6) AS size_delta
    FROM walk w JOIN e ON e.event_id = w.event_id"""),
)
def size_delta_since_sample(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "t", "event_id", "value")
    kept = greedy_sample(e, USER, "t", "event_id", DAY, 5 * DAY)
    stepped = running(kept, USER, "t", "event_id", WIDTH, {"before": ("lag", F.col("value"))})
    return rounded(stepped.select("user_id", "event_id", F.coalesce(F.col("value") - F.col("before"), F.lit(0.0)).alias("size_delta")))


@query(
    "change_only",
    f"""WITH {EVENTS_SQL}, s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t) AS before FROM e)
    SELECT event_id, event_type FROM s WHERE before IS NULL OR before <> event_type""",
)
def change_only(spark, sf_dir):
    return changes_only(events(spark, sf_dir), USER, "t", "event_id", F.col("event_type"), WIDTH).select("event_id", "event_type")


@query(
    "sustained_condition",
    f"""WITH {EVENTS_SQL}, f AS (SELECT *, value > 20 AS on_ FROM e),
    g AS (SELECT *, count(*) FILTER (NOT on_) OVER (PARTITION BY user_id ORDER BY t) AS island FROM f),
    h AS (SELECT *, min(CASE WHEN on_ THEN t END) OVER (PARTITION BY user_id, island) AS since,
      count(*) FILTER (on_) OVER (PARTITION BY user_id, island ORDER BY t) AS n FROM g)
    SELECT event_id, on_ AND n > 1 AND t - since >= {12 * HOUR} AS sustained FROM h""",
)
def sustained_condition(spark, sf_dir):
    held = sustained(events(spark, sf_dir), USER, "t", "event_id", F.col("value") > 20, 12 * HOUR, WIDTH)
    return held.select("event_id", "sustained")


@query(
    "consecutive_condition",
    f"""WITH {EVENTS_SQL}, f AS (SELECT *, value > 40 AS on_ FROM e),
    g AS (SELECT *, count(*) FILTER (NOT on_) OVER (PARTITION BY user_id ORDER BY t) AS island FROM f)
    SELECT event_id, count(*) FILTER (on_) OVER (PARTITION BY user_id, island ORDER BY t) AS streak FROM g""",
)
def consecutive_condition(spark, sf_dir):
    return consecutive(events(spark, sf_dir), USER, "t", "event_id", F.col("value") > 40, WIDTH).select("event_id", "streak")


TYPES = ("click", "error", "purchase", "signup", "view")


def _latest_by_type(spark, sf_dir):
    latest = {
        f"l_{ty}": ("last", F.when(F.col("event_type") == ty, F.struct(F.lit(ty).alias("venue"), F.col("t").alias("ts_ms"), F.col("value").alias("price"))))
        for ty in TYPES
    }
    return running(events(spark, sf_dir), USER, "t", "event_id", WIDTH, latest)


_LATEST_SQL = f"""WITH {EVENTS_SQL}, l AS (SELECT event_id, t, """ + ", ".join(
    f"max(CASE WHEN event_type = '{ty}' THEN t END) OVER w AS t_{ty}, "
    f"arg_max(CASE WHEN event_type = '{ty}' THEN value END, CASE WHEN event_type = '{ty}' THEN t END) OVER w AS v_{ty}"
    for ty in TYPES
) + """ FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)), f AS (SELECT event_id, t, list_sort(list_filter([""" + ", ".join(
    f"CASE WHEN t - t_{ty} <= {DAY} THEN v_{ty} END" for ty in TYPES
) + """], lambda x: x IS NOT NULL)) AS v FROM l)"""


@query(
    "venue_freshness_median",
    _LATEST_SQL + """ SELECT event_id, len(v) AS venues_fresh, round(v[len(v) // 2 + 1], 6) AS upper_median,
      round((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 6) AS true_median,
      round(CASE WHEN len(v) > 1 THEN (v[len(v)] - v[1]) / 100.0 * 10000 END, 4) AS dispersion_bps FROM f""",
)
def venue_freshness_median(spark, sf_dir):
    state = _latest_by_type(spark, sf_dir)
    fresh = F.array_compact(F.array(*[F.when(F.col("t") - F.col(f"l_{ty}.ts_ms") <= DAY, F.col(f"l_{ty}.price")) for ty in TYPES]))
    return state.withColumn("v", fresh).select(
        "event_id", F.size("v").cast("long").alias("venues_fresh"), F.round(upper_median(F.col("v")), 6).alias("upper_median"),
        F.round(true_median(F.col("v")), 6).alias("true_median"), F.round(dispersion_bps(F.col("v"), F.lit(100.0)), 4).alias("dispersion_bps"),
    )


@query(
    "composite_price",
    _LATEST_SQL + """, m AS (SELECT event_id, v, (v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2 AS med FROM f)
    SELECT event_id, round(med, 6) AS price, len(v) AS venues,
      round(CASE WHEN len(v) > 1 THEN (v[len(v)] - v[1]) / med * 10000 ELSE 0 END, 4) AS dispersion_bps FROM m""",
)
def composite(spark, sf_dir):
    state = _latest_by_type(spark, sf_dir)
    prices = F.array_compact(F.array(*[F.col(f"l_{ty}") for ty in TYPES]))
    c = composite_price(prices, F.col("t"), DAY)
    return state.withColumn("c", c).select(
        "event_id", F.round("c.price", 6).alias("price"), F.size("c.venues").cast("long").alias("venues"), F.round("c.dispersion_bps", 4).alias("dispersion_bps")
    )


@query(
    "fill_markouts",
    f"""WITH {EVENTS_SQL}, f AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'bid' ELSE 'ask' END AS side FROM e WHERE event_type = 'purchase'),
    m AS (SELECT user_id, t, value AS mid FROM e WHERE event_type = 'view'),
    a AS (SELECT f.event_id, f.side, f.value, CASE WHEN m.t - (f.t + {6 * HOUR}) <= {12 * HOUR} THEN m.mid END AS mid FROM (SELECT *, t + {6 * HOUR} AS p FROM f) f ASOF LEFT JOIN m ON f.user_id = m.user_id AND f.p <= m.t),
    b AS (SELECT f.event_id, CASE WHEN m.t - (f.t + {DAY}) <= {12 * HOUR} THEN m.mid END AS mid FROM (SELECT *, t + {DAY} AS p FROM f) f ASOF LEFT JOIN m ON f.user_id = m.user_id AND f.p <= m.t)
    SELECT a.event_id, round(CASE WHEN side = 'bid' THEN a.mid - value ELSE value - a.mid END, 6) AS markout_6h,
      round(CASE WHEN side = 'bid' THEN b.mid - value ELSE value - b.mid END, 6) AS markout_24h,
      CASE WHEN b.mid IS NOT NULL THEN CASE WHEN (CASE WHEN side = 'bid' THEN b.mid - value ELSE value - b.mid END) <= -0.01 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS toxic
    FROM a JOIN b USING (event_id)""",
)
def fill_markouts(spark, sf_dir):
    e = events(spark, sf_dir)
    fills = e.filter("event_type = 'purchase'").select(
        "user_id", "event_id", "t", F.when(F.col("k") % 2 == 0, "bid").otherwise("ask").alias("fill_side"), F.col("value").alias("fill_price")
    )
    mids = e.filter("event_type = 'view'").select("user_id", F.col("t").alias("mid_t"), F.col("event_id").alias("seq"), F.col("value").alias("mid"))
    marked = markouts(fills, mids, USER, "t", 4 * DAY, {"markout_6h": 6 * HOUR, "markout_24h": DAY}, 12 * HOUR, "mid_t", ["seq"])
    return rounded(marked.select("event_id", "markout_6h", "markout_24h", toxic_label(F.col("markout_24h")).alias("toxic")))


@query(
    "fill_markouts_tied",
    f"""WITH {EVENTS_SQL}, f AS (SELECT * FROM e WHERE event_type = 'purchase'),
    m AS (SELECT user_id, t - t % {30 * DAY} AS mid_t, event_id AS seq, event_id % 7 AS part, value AS mid FROM e WHERE event_type = 'view'),
    j AS (SELECT f.event_id, f.k, f.value, m.mid, row_number() OVER (PARTITION BY f.event_id ORDER BY m.mid_t, m.part, m.seq) AS r
      FROM f JOIN m ON m.user_id = f.user_id AND m.mid_t BETWEEN f.t + {DAY} AND f.t + {61 * DAY})
    SELECT event_id, round(CASE WHEN k % 2 = 0 THEN mid - value ELSE value - mid END, 6) AS markout FROM j WHERE r = 1""",
)
def fill_markouts_tied(spark, sf_dir):
    """Very many mids share a time; two more columns order them."""
    e = events(spark, sf_dir)
    fills = e.filter("event_type = 'purchase'").select(
        "user_id", "event_id", "t", F.when(F.col("k") % 2 == 0, "bid").otherwise("ask").alias("fill_side"), F.col("value").alias("fill_price")
    )
    mids = e.filter("event_type = 'view'").select(
        "user_id", (F.col("t") - F.col("t") % (30 * DAY)).alias("mid_t"), (F.col("event_id") % 7).alias("part"), F.col("event_id").alias("seq"), F.col("value").alias("mid")
    )
    marked = markouts(fills, mids, USER, "t", 62 * DAY, {"markout": DAY}, 60 * DAY, "mid_t", ["part", "seq"])
    return rounded(marked.filter("markout is not null").select("event_id", "markout"))


@query(
    "position_reconciliation",
    f"""WITH {EVENTS_SQL}, s AS (SELECT *, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN CASE WHEN k % 7 = 0 THEN 0 ELSE k - 50 END ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY t) AS s FROM e),
    p AS (SELECT *, CAST(s AS DOUBLE) + CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END AS polled FROM s WHERE event_type = 'view'),
    d AS (SELECT *, coalesce(lag(polled) OVER (PARTITION BY user_id ORDER BY t), 0) + s - coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY t), 0) AS estimate FROM p),
    f AS (SELECT *, abs(polled - estimate) > 0.01 AS on_ FROM d),
    g AS (SELECT *, count(*) FILTER (NOT on_) OVER (PARTITION BY user_id ORDER BY t) AS island FROM f)
    SELECT event_id, round(estimate, 6) AS estimate, round(polled - estimate, 6) AS divergence,
      count(*) FILTER (on_) OVER (PARTITION BY user_id, island ORDER BY t) AS streak FROM g""",
)
def position_reconciliation(spark, sf_dir):
    e = events(spark, sf_dir)
    delta = F.when(F.col("event_type").isin("purchase", "signup"), F.when(F.col("k") % 7 != 0, (F.col("k") - 50).cast("double")))
    fills = e.filter(F.col("event_type").isin("purchase", "signup")).withColumn("delta", delta)
    # What an exchange would report: the true running position, off by five at every third poll.
    state = running(e, USER, "t", "event_id", WIDTH, {"s": ("sum", F.coalesce(delta, F.lit(0.0)))})
    polls = state.filter("event_type = 'view'").withColumn("polled", F.col("s") + F.when(F.col("k") % 3 == 0, 5.0).otherwise(0.0))
    judged = position_divergence(fills, polls, USER, "t", "event_id", WIDTH)
    return rounded(judged.select("event_id", "estimate", "divergence", "streak"))


@query(
    "feed_cross_check",
    f"""WITH {EVENTS_SQL}, q AS (SELECT user_id, t, value FROM e WHERE event_type IN ('view', 'signup')), b AS (SELECT * FROM e WHERE event_type IN ('click', 'purchase', 'error')),
    j AS (SELECT b.event_id, b.user_id, b.t, b.value, q.value AS qv, coalesce(b.t - q.t <= 5000 AND (abs(b.value - q.value) > 0.02), false) AS on_
      FROM (SELECT event_id, user_id, t // {4 * HOUR // 1000} AS t, t AS o, value FROM b) b ASOF LEFT JOIN (SELECT user_id, t AS o, t // {4 * HOUR // 1000} AS t, value FROM q) q ON b.user_id = q.user_id AND b.o >= q.o),
    g AS (SELECT *, count(*) FILTER (NOT on_) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM j),
    h AS (SELECT *, min(CASE WHEN on_ THEN t END) OVER (PARTITION BY user_id, island) AS since, count(*) FILTER (on_) OVER (PARTITION BY user_id, island ORDER BY t, event_id) AS n FROM g)
    SELECT event_id, round(qv, 6) AS quote_bid, on_ AND n > 1 AND t - since >= 5000 AS diverged FROM h""",
)
def feed_cross_check(spark, sf_dir):
    # Four hours of event time stand for one second, so that the five-second rules bite.
    e = events(spark, sf_dir).withColumn("t", F.floor(F.col("t") / (4 * HOUR // 1000)).cast("long"))
    book = e.filter(F.col("event_type").isin("click", "purchase", "error")).withColumn("bid", F.col("value")).withColumn("ask", F.col("value"))
    quotes = e.filter(F.col("event_type").isin("view", "signup")).select(
        "user_id", "t", "event_id", F.col("value").alias("quote_bid"), F.col("value").alias("quote_ask"), F.col("t").alias("quote_ts_ms")
    )
    return rounded(feed_divergence(book, quotes, USER, "t", "event_id", 30_000).select("event_id", "quote_bid", "diverged"))


@query(
    "running_position",
    """WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS n, round(l_extendedprice / l_quantity) / 100 AS p,
      datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_suppkey, round(sum(n) OVER w, 4) AS position, round(sum(-n * p) OVER w, 4) AS cash
    FROM f WINDOW w AS (PARTITION BY l_suppkey ORDER BY d, l_orderkey, l_linenumber, p, n ROWS UNBOUNDED PRECEDING)""",
)
def running_position(spark, sf_dir):
    n = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    p = F.round(F.col("l_extendedprice") / F.col("l_quantity")) / 100
    fills = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", n.alias("n"), p.alias("p"), F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01")).cast("long").alias("d")
    )
    money = fills.withColumn("signed_count", F.col("n")).withColumn("cash_delta", -F.col("n") * F.col("p"))
    state = pnl.running_position(money, ["l_suppkey"], "d", ["l_orderkey", "l_linenumber", "p", "n"], 60)
    return rounded(state.select("l_orderkey", "l_linenumber", "l_suppkey", "position", "cash"), 4)

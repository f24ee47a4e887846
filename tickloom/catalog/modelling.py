"""Queries for splits, moments, fits, evaluation, comparison and reports."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.catalog.base import DAY, EVENTS_SQL, HOUR, events, query, rounded, table
from tickloom.catalog.market import _simulated
from tickloom.catalog.recording import SLICE_MS, derived_windows
from tickloom.catalog.scalar import scored_documents
from tickloom.operators import linear
from tickloom.operators.bootstrap import bootstrap_ci, bootstrap_draws
from tickloom.operators.linear import LinearModel
from tickloom.operators.metrics import auc
from tickloom.operators.pnl import fill_money, pnl_rollup
from tickloom.operators.split import chronological_split, readable_windows, window_order
from tickloom.plans import fit, reports
from tickloom.plans.ab import ab_summary, promotion_candidate
from tickloom.plans.features import feature_table, window_labels
from tickloom.plans.fills import label_rows, label_summary, mid_series
from tickloom.plans.state import Windows
from tickloom.session import cut
from tickloom.sources.manifest import archive_backlog, file_manifest, oldest_first
from tickloom.sources.recordings import incentives_of
from tickloom.sources.stores import not_stored

_ORDER_SQL = f"""{EVENTS_SQL}, o AS (SELECT user_id, min(t) AS first FROM e GROUP BY user_id), p AS (SELECT *, row_number() OVER (ORDER BY first, user_id) AS position, count(*) OVER () AS n FROM o),
    s AS (SELECT user_id, first, position, CASE WHEN position <= greatest(1, floor(n * 0.6)) THEN 'train' WHEN position <= greatest(greatest(1, floor(n * 0.6)) + 1, floor(n * (0.6 + 0.2))) THEN 'val' ELSE 'holdout' END AS part FROM p)"""


def _split(spark, sf_dir):
    return chronological_split(window_order(events(spark, sf_dir), "user_id", "t", HOUR))


@query("chronological_split", f"WITH {_ORDER_SQL} SELECT user_id, position, part FROM s")
def split(spark, sf_dir):
    return _split(spark, sf_dir).select("user_id", "position", "part")


@query("holdout_lock", f"WITH {_ORDER_SQL} SELECT s.part, count(*) AS rows, round(avg(e.value), 6) AS mean FROM e JOIN s USING (user_id) WHERE s.part <> 'holdout' GROUP BY s.part")
def holdout_lock(spark, sf_dir):
    allowed = readable_windows(_split(spark, sf_dir)).select("user_id", "part")
    return rounded(events(spark, sf_dir).join(allowed, "user_id").groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean")))


MOMENT_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "standardisation_moments",
    "SELECT l_returnflag, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(stddev_pop({c}), 6) AS std_{c}" for c in MOMENT_COLUMNS) + " FROM lineitem GROUP BY l_returnflag",
)
def standardisation_moments(spark, sf_dir):
    m = linear.moments(table(spark, sf_dir, "lineitem"), ["l_returnflag"], MOMENT_COLUMNS)
    named = [F.get(part, F.lit(i)).alias(f"{name}_{c}") for i, c in enumerate(MOMENT_COLUMNS) for name, part in (("mean", "means"), ("std", "stds"))]
    return rounded(m.select("l_returnflag", "n", *named))


@query(
    "ridge_fit",
    """WITH m AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_discount) AS mb, stddev_pop(l_discount) AS sb, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1),
    z AS (SELECT g, n, my, (l_quantity - ma) / sa AS a, (l_discount - mb) / sb AS b, l_extendedprice - my AS y FROM lineitem JOIN m ON g = l_returnflag),
    s AS (SELECT g, n, my, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS ay, sum(b * y) AS b_y FROM z GROUP BY g, n, my)
    SELECT g AS grp, n, round(my, 4) AS intercept, round((ay * bb - b_y * ab) / (aa * bb - ab * ab), 4) AS coef_quantity, round((b_y * aa - ay * ab) / (aa * bb - ab * ab), 4) AS coef_discount FROM s""",
)
def ridge_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "grp")
    fits = linear.fit_ridge(rows, "grp", ["l_quantity", "l_discount"], "l_extendedprice", l2=1.0, min_rows=500)
    out = [(g, f["n"], f["intercept"], *f["coefs"]) for g, f in fits.items()]
    return rounded(spark.createDataFrame(out, "grp string, n bigint, intercept double, coef_quantity double, coef_discount double"), 4)


@query("ridge_fit_embeddings", "SELECT 'x' || i AS feature, 0.0::DOUBLE AS gradient FROM range(64) AS r(i)")
def ridge_fit_embeddings(spark, sf_dir):
    features = [f"x{i}" for i in range(64)]
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.lit("all").alias("grp"), F.col("label").cast("double").alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(f) for i, f in enumerate(features)])
    f = linear.fit_ridge(rows, "grp", features, "y", l2=1.0)["all"]
    # The penalised gradient at the fitted weights, over all rows: it has to vanish.
    z = {n: (F.col(n) - m) / s for n, m, s in zip(features, f["means"], f["stds"])}
    rest = F.col("y") - f["intercept"] - F.aggregate(F.array(*[z[n] * c for n, c in zip(features, f["coefs"])]), F.lit(0.0), lambda a, x: a + x)
    sums = rows.withColumn("_rest", rest).agg(*[(F.sum(z[n] * F.col("_rest")) - c).alias(n) for n, c in zip(features, f["coefs"])])
    return rounded(sums.unpivot([], features, "feature", "gradient"), 6)


@query("logistic_fit", "SELECT unnest(['intercept', 'size', 'words']) AS term, 0.0::DOUBLE AS gradient")
def logistic_fit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.log1p("n_chars").alias("size"), F.size(F.split("text", r"\s+")).cast("double").alias("words"))
    rows = table(spark, sf_dir, "labels").join(d, "doc_id").select(F.lit("all").alias("grp"), "size", F.log1p("words").alias("words"), F.col("quality").cast("double").alias("y"))
    names = ["size", "words"]
    f = linear.fit_logistic(rows, "grp", names, "y")["all"]
    # The penalised gradient at the fitted weights, over all rows: it has to vanish.
    z = {n: (F.col(n) - m) / s for n, m, s in zip(names, f["means"], f["stds"])}
    score = F.lit(f["intercept"]) + z["size"] * f["coefs"][0] + z["words"] * f["coefs"][1]
    off = rows.select(*[z[n].alias(n) for n in names], (1 / (1 + F.exp(-score)) - F.col("y")).alias("off"))
    sums = off.agg(F.sum("off").alias("intercept"), *[(F.sum(F.col(n) * F.col("off")) + c).alias(n) for n, c in zip(names, f["coefs"])])
    return rounded(sums.unpivot([], ["intercept", *names], "term", "gradient"), 4)


@query(
    "auc_rank_sum",
    """WITH s AS (SELECT d.lang, least(0.999, greatest(0.001, d.n_chars % 1000 / 1000.0::DOUBLE)) AS p, l.quality AS o FROM labels l JOIN documents d USING (doc_id)),
    w AS (SELECT a.lang, sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS wins FROM s a JOIN s b ON a.lang = b.lang AND a.o = 1 AND b.o = 0 GROUP BY a.lang),
    c AS (SELECT lang, count(*) FILTER (o = 1) AS positives, count(*) FILTER (o = 0) AS negatives FROM s GROUP BY lang)
    SELECT lang, round(CASE WHEN positives > 0 AND negatives > 0 THEN wins / (positives * negatives) END, 8) AS auc, positives, negatives FROM c LEFT JOIN w USING (lang)""",
)
def auc_rank_sum(spark, sf_dir):
    out = auc(scored_documents(spark, sf_dir), ["lang"], "p", "o")
    return rounded(out.select("lang", "auc", "positives", "negatives"), 8)


@query(
    "calibration_deciles",
    """WITH s AS (SELECT least(0.999, greatest(0.001, d.n_chars % 1000 / 1000.0::DOUBLE)) AS p, CAST(l.quality AS DOUBLE) AS o FROM labels l JOIN documents d USING (doc_id))
    SELECT CAST(least(9, floor(p * 10)) AS INTEGER) AS decile, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(o), 6) AS realised, round(avg((p - o) * (p - o)), 6) AS brier,
      round(avg(-(o * ln(p) + (1 - o) * ln(1 - p))), 6) AS log_loss FROM s GROUP BY 1""",
)
def calibration_deciles(spark, sf_dir):
    return rounded(reports.decile_calibration(scored_documents(spark, sf_dir), "p", "o"))


from tickloom.operators.bootstrap import DRAWS, SEED, STEPS  # noqa: E402


def draws_sql(keys: str = "") -> str:
    """CTEs from p(keys, x, i, n) to the draws' means m(keys, draw, mean)."""
    k = f"{keys}, " if keys else ""
    join = " AND ".join(["a.pick = p.i", *(f"a.{c.strip()} = p.{c.strip()}" for c in keys.split(",") if c.strip())])
    steps = "b", "(a * a + 12345) % 2147483647"

    def hashed(i: str, seed: int) -> str:
        return f"(((draw * 1000003 + {i} * 7919 + {seed} * 104729 + 1) % 2147483647) * 48271) % 2147483647"

    limits = ", ".join(f"CAST(least(2147483647, floor(2147483647 * ({' + '.join(f'exp(-lam) * pow(lam, {j}) / factorial({j})' for j in range(s + 1))}))) AS BIGINT) AS z{s}" for s in range(STEPS))
    count = " + ".join(f"CAST(u >= z{s} AS INTEGER)" for s in range(STEPS))
    return f"""lam AS (SELECT DISTINCT {k}n, greatest(0.0::DOUBLE, 1 - 8 / sqrt(n)) AS lam FROM p), th AS (SELECT {k}n, {limits} FROM lam),
    h1 AS (SELECT p.*, draw, {hashed("i", SEED)} AS a FROM p, range({DRAWS}) AS r(draw)), h2 AS (SELECT * EXCLUDE (a), {steps[1]} AS b FROM h1), h3 AS (SELECT * EXCLUDE (b), (b * b + draw + 1) % 2147483647 AS u FROM h2),
    c AS (SELECT {k}draw, n, sum(({count}) * x) AS t, CAST(sum({count}) AS BIGINT) AS d FROM h3 JOIN th USING ({k}n) GROUP BY {k}draw, n),
    g0 AS (SELECT {k}draw, n, unnest(range(0, greatest(0, n - d))) AS j FROM c), g1 AS (SELECT *, {hashed("j", SEED + 1)} AS a FROM g0), g2 AS (SELECT * EXCLUDE (a), {steps[1]} AS b FROM g1),
    a AS (SELECT * EXCLUDE (b), (b * b + draw + 1) % 2147483647 % n AS pick FROM g2), e0 AS (SELECT {", ".join(f"a.{c.strip()}" for c in keys.split(",") if c.strip())}{", " if keys else ""}a.draw, sum(x) AS more FROM a JOIN p ON {join} GROUP BY ALL),
    m AS (SELECT {k}draw, (t + coalesce(more, 0)) / greatest(d, n) AS mean FROM c LEFT JOIN e0 USING ({k}draw))"""


_DRAWS_SQL = f"""v AS (SELECT user_id, avg(value) AS x FROM events GROUP BY user_id), p AS (SELECT x, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM v),
    {draws_sql()}"""


def _user_means(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("x"))


@query("bootstrap_draws", f"WITH {_DRAWS_SQL} SELECT draw, round(mean, 6) AS mean FROM m")
def draws(spark, sf_dir):
    return rounded(bootstrap_draws(_user_means(spark, sf_dir), [], "x", "user_id", DRAWS, SEED).select("draw", "mean"))


@query(
    "bootstrap_interval",
    f"""WITH {_DRAWS_SQL}, r AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS k FROM m)
    SELECT (SELECT round(avg(x), 6) FROM p) AS mean, (SELECT count(*) FROM p) AS windows, round(max(mean) FILTER (k = {int(0.025 * DRAWS)}), 6) AS low, round(max(mean) FILTER (k = {int(0.975 * DRAWS)}), 6) AS high FROM r""",
)
def bootstrap_interval(spark, sf_dir):
    return rounded(bootstrap_ci(_user_means(spark, sf_dir), [], "x", "user_id", DRAWS, SEED, chunk=16).select("mean", "windows", "low", "high"))


# Orders by priority stand for variants, customers for windows.
_OUTCOME_SQL = """o AS (SELECT o_custkey AS ticker, substr(o_orderpriority, 1, 1) AS variant, count(*) AS fills, CAST(count(*) * 5 AS DOUBLE) AS contracts,
      CASE WHEN o_custkey % 5 <> 0 THEN avg(o_totalprice) / 100000 - 2.5 END AS markout_5s, CASE WHEN o_custkey % 7 <> 0 THEN sum(o_totalprice) / 100000 - 3 END AS settlement_pnl FROM orders GROUP BY 1, 2),
    b AS (SELECT ticker, coalesce(markout_5s * contracts, 0) AS m0, settlement_pnl AS s0 FROM o WHERE variant = '1'),
    j AS (SELECT o.*, coalesce(markout_5s * contracts, 0) - m0 AS d_markout, settlement_pnl - s0 AS d_settle FROM o JOIN b USING (ticker))"""


def _outcomes(spark, sf_dir):
    key = F.col("o_custkey")
    return table(spark, sf_dir, "orders").groupBy(key.alias("ticker"), F.substring("o_orderpriority", 1, 1).alias("variant")).agg(
        F.count(F.lit(1)).alias("fills"), F.avg("o_totalprice").alias("_a"), F.sum("o_totalprice").alias("_s")
    ).select(
        "ticker", "variant", "fills", (F.col("fills") * 5).cast("double").alias("contracts"),
        F.when(F.col("ticker") % 5 != 0, F.col("_a") / 100000 - 2.5).alias("markout_5s"), F.when(F.col("ticker") % 7 != 0, F.col("_s") / 100000 - 3).alias("settlement_pnl"),
    )


_PAIR_DRAWS_SQL = f"""p AS (SELECT variant, k, v AS x, row_number() OVER (PARTITION BY variant, k ORDER BY ticker) - 1 AS i, count(*) OVER (PARTITION BY variant, k) AS n
      FROM (SELECT variant, 'm' AS k, d_markout AS v, ticker FROM j UNION ALL SELECT variant, 's', d_settle, ticker FROM j) WHERE v IS NOT NULL AND variant <> '1'),
    {draws_sql("variant, k")},
    q AS (SELECT variant, k, mean, row_number() OVER (PARTITION BY variant, k ORDER BY mean) - 1 AS rk FROM m),
    ci AS (SELECT variant, {", ".join(f"round(max(mean) FILTER (k = '{k}' AND rk = {int(p * DRAWS)}), 6) AS {name}" for k, c in (("m", "d_markout"), ("s", "d_settle")) for p, name in ((0.025, f"{c}_low"), (0.975, f"{c}_high")))} FROM q GROUP BY variant)"""


@query(
    "paired_comparison",
    f"""WITH {_OUTCOME_SQL}, {_PAIR_DRAWS_SQL},
    l AS (SELECT variant, count(*) AS windows, round(avg(fills), 6) AS fills_per_window, round(avg(markout_5s), 6) AS markout_5s, round(avg(settlement_pnl), 6) AS settlement_pnl,
      CASE WHEN variant <> '1' THEN round(avg(d_markout), 6) END AS d_markout, CASE WHEN variant <> '1' THEN round(avg(d_settle), 6) END AS d_settle FROM j GROUP BY variant)
    SELECT l.*, ci.d_markout_low, ci.d_markout_high, ci.d_settle_low, ci.d_settle_high FROM l LEFT JOIN ci USING (variant)""",
)
def paired_comparison(spark, sf_dir):
    return rounded(ab_summary(_outcomes(spark, sf_dir), baseline="1"))


@query(
    "daily_stability",
    """WITH d AS (SELECT o_orderpriority AS variant, CAST(year(o_orderdate) AS INTEGER) AS day, count(*) AS windows, avg(o_totalprice - 250000) AS mean, sum(o_totalprice - 250000) AS total FROM orders GROUP BY ALL),
    a AS (SELECT variant, sum(total) AS s, max(total) AS m, count(*) FILTER (total > 0) AS days_up, count(*) AS days FROM d GROUP BY variant)
    SELECT variant, day, windows, round(mean, 2) AS mean, round(total, 2) AS total, days_up, days, s > 0 AND s - m <= 0 AS single_day_winner FROM d JOIN a USING (variant)""",
)
def daily_stability(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice") - 250000).alias("v"))
    return rounded(reports.daily_stability(rows, F.col("year"), "v"), 2)


_REGIMES = {"quantity": ("l_quantity", (10, 25, 40)), "discount": ("l_discount", (0.025, 0.055)), "tax": ("l_tax", (0.035,))}


def _band_sql(c, edges):
    return " + ".join(f"CASE WHEN {c} >= {e} THEN 1 ELSE 0 END" for e in edges)


@query(
    "results_by_regime",
    "SELECT 'all' AS dimension, 0 AS band, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem "
    + " ".join(f"UNION ALL SELECT '{n}', {_band_sql(c, e)} AS band, count(*), round(avg(l_extendedprice), 4) FROM lineitem GROUP BY band" for n, (c, e) in _REGIMES.items()),
)
def results_by_regime(spark, sf_dir):
    dims = {n: reports.banded(F.col(c), e) for n, (c, e) in _REGIMES.items()}
    return rounded(reports.by_regime(table(spark, sf_dir, "lineitem"), dims, [F.avg("l_extendedprice").alias("mean")]), 4)


_REGIME_SETS = _REGIMES | {"size": ("l_extendedprice", (10_000, 30_000, 60_000)), "line": ("l_linenumber", (2, 5))}


@query(
    "results_by_regime_sets",
    f"""WITH b AS (SELECT *, {", ".join(f"CAST({_band_sql(c, e)} AS INTEGER) AS {n}" for n, (c, e) in _REGIME_SETS.items())} FROM lineitem)
    SELECT {", ".join(_REGIME_SETS)}, concat_ws('+', {", ".join(f"CASE WHEN grouping({n}) = 0 THEN '{n}' END" for n in _REGIME_SETS)}) AS by, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(avg(l_discount), 8) AS discounted
    FROM b GROUP BY GROUPING SETS ({", ".join(f"({', '.join(c)})" for k in range(3) for c in combinations(_REGIME_SETS, k))})""",
)
def results_by_regime_sets(spark, sf_dir):
    """Five regimes, alone and in pairs, from one pass."""
    dims = {n: reports.banded(F.col(c), e) for n, (c, e) in _REGIME_SETS.items()}
    out = reports.by_regime_sets(table(spark, sf_dir, "lineitem"), dims, [F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.avg("l_discount"), 8).alias("discounted")])
    return rounded(out, 8)


@query(
    "regime_filter",
    f"""WITH {EVENTS_SQL}, f AS (SELECT event_id, avg(value) OVER w AS m, count(value) OVER w AS c FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND 1 PRECEDING))
    SELECT event_id, round(m, 9) AS trailing, c AS windows_seen, coalesce(m < 45, false) AS stand_down FROM f""",
)
def regime_filter(spark, sf_dir):
    out = reports.regime_filter(events(spark, sf_dir), ["event_type"], "t", "value", DAY, 45.0, 3 * DAY)
    return rounded(out.select("event_id", "trailing", "windows_seen", "stand_down"), 9)


_FILLS_SQL = """f AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'ask' ELSE 'bid' END AS side, l_quantity AS n, round(0.05 + l_discount * 8, 4) AS p, round(0.05 + l_discount * 8, 4) + (l_tax - 0.04) / 2 AS mid,
      CASE WHEN l_linenumber % 3 <> 0 THEN (l_tax - 0.035) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END END AS mk FROM lineitem),
    g AS (SELECT *, CASE WHEN side = 'bid' THEN 1 ELSE -1 END AS s, CAST(ceil(CAST(CAST(n AS DECIMAL(12, 4)) * (CAST(p AS DECIMAL(5, 4)) * (1 - CAST(p AS DECIMAL(5, 4)))) AS DECIMAL(30, 12)) * 175) / 10000 AS DOUBLE) AS fee FROM f)"""


def _fills(spark, sf_dir):
    price = F.round(0.05 + F.col("l_discount") * 8, 4)
    ask = F.col("l_returnflag") == "R"
    fills = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.when(ask, "ask").otherwise("bid").alias("fill_side"), F.col("l_quantity").alias("fill_count"), price.alias("fill_price"),
        (price + (F.col("l_tax") - 0.04) / 2).alias("fill_fair_yes"),
        F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_tax") - 0.035) * F.when(ask, -1).otherwise(1)).alias("markout_5s"),
    )
    return fill_money(fills, 1.0)


@query(
    "pnl_rollup",
    f"""WITH {_FILLS_SQL} SELECT l_suppkey, round(sum(s * n), 4) AS final_position, round(sum(-s * n * p - fee), 4) AS cash_flow, round(sum(fee), 4) AS fees, round(sum(s * (mid - p) * n), 4) AS gross_edge,
      sum(n) AS contracts, count(*) AS fills, round(sum(mk * n) / sum(n) FILTER (mk IS NOT NULL), 8) AS markout_5s FROM g GROUP BY l_suppkey""",
)
def pnl_by_supplier(spark, sf_dir):
    out = rounded(pnl_rollup(_fills(spark, sf_dir), ["l_suppkey"]), 8)
    return out.select("l_suppkey", *[F.round(c, 4).alias(c) for c in ("final_position", "cash_flow", "fees", "gross_edge")], "contracts", "fills", "markout_5s")


@query(
    "pnl_decomposition",
    f"""WITH {_FILLS_SQL} SELECT l_suppkey, round(sum(s * (mid - p) * n), 4) AS spread_capture, round(sum(mk * n - s * (mid - p) * n), 4) AS post_fill_move, round(sum(fee), 4) AS fees, round(sum(s * n), 4) AS inventory FROM g GROUP BY l_suppkey""",
)
def pnl_decomposition(spark, sf_dir):
    return rounded(reports.pnl_decomposition(_fills(spark, sf_dir), ["l_suppkey"], "fill_fair_yes"), 4)


_LOG_SQL = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, CAST(1 + o_orderkey % 9 AS DOUBLE) AS n, (10 + o_orderkey % 80) / 100.0::DOUBLE AS p, (o_orderkey % 13) / 1000.0::DOUBLE AS fee FROM orders"""


def _logged(spark, sf_dir):
    """Strategy log lines made from orders: a paper fill and a decision each."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    fill = F.struct(
        F.when(key % 2 == 0, "bid").otherwise("ask").alias("side"), ((10 + key % 80) / 100.0).alias("price"), (1 + key % 9).cast("double").alias("count"),
        F.lit(0.5).alias("fair_yes"), ((key % 13) / 1000.0).alias("fee"),
    )
    decision = F.struct((key % 997).alias("brti_to_decision_ms"), (key % 331).alias("book_to_decision_ms"))
    run = F.concat(F.lit("run/"), F.col("o_custkey"))
    rows = [
        o.select(run.alias("path"), key.alias("receive_ts_ms"), key.alias("line"), F.lit(kind).alias("event_type"), F.to_json(payload).alias("payload"))
        for kind, payload in (("paper_fill", fill), ("decision", decision))
    ]
    return rows[0].unionByName(rows[1])


@query(
    "paper_summary",
    f"""WITH l AS ({_LOG_SQL}) SELECT 'run/' || o_custkey AS path, count(*) AS fills, round(sum(CASE WHEN side = 'bid' THEN n ELSE -n END), 6) AS position,
      round(sum(CASE WHEN side = 'bid' THEN -p * n ELSE p * n END - fee), 6) AS cash_flow, round(sum(fee), 6) AS fees_paid FROM l GROUP BY o_custkey""",
)
def paper_summary(spark, sf_dir):
    return rounded(reports.paper_summary(_logged(spark, sf_dir)))


@query(
    "latency_percentiles",
    """WITH l AS (SELECT 'decision' AS event_type, 'brti_to_decision_ms' AS measure, o_orderkey % 997 AS ms FROM orders UNION ALL SELECT 'decision', 'book_to_decision_ms', o_orderkey % 331 FROM orders)
    SELECT event_type, measure, count(*) AS n, CAST(quantile_disc(ms, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(ms, 0.9) AS DOUBLE) AS p90, CAST(quantile_disc(ms, 0.99) AS DOUBLE) AS p99 FROM l GROUP BY ALL""",
)
def latencies(spark, sf_dir):
    return reports.latency_percentiles(reports.latency_rows(_logged(spark, sf_dir)), ["event_type", "measure"], "ms")


@query("incremental_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def incremental_anti(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return not_stored(table(spark, sf_dir, "customer"), stored, "c_custkey").select("c_custkey", "c_name")


@query(
    "retention_pick",
    """WITH s AS (SELECT o_orderkey, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d, CAST(o_totalprice AS BIGINT) AS size FROM orders),
    r AS (SELECT *, sum(size) OVER (ORDER BY d, o_orderkey) AS freed FROM s) SELECT o_orderkey, size, CAST(freed AS BIGINT) AS freed FROM r WHERE freed - size < 500000000""",
)
def retention_pick(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).cast("long").alias("d"), F.bround("o_totalprice", 0).cast("long").alias("size")
    )
    return oldest_first(rows, "d", "o_orderkey", "size", 500_000_000, 30).select("o_orderkey", "size", "freed")


@query(
    "required_minus_seen",
    f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, t // {DAY} AS day, list(DISTINCT event_type) AS seen FROM e GROUP BY ALL)
    SELECT user_id, day, list_aggregate(list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(seen, x))), 'string_agg', ',') AS missing FROM s WHERE len(seen) < 5""",
)
def required_minus_seen(spark, sf_dir):
    seen = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.collect_set("event_type").alias("seen"))
    required = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    missing = F.array_sort(F.array_except(required, F.col("seen")))
    return seen.filter(F.size(missing) > 0).select("user_id", "day", F.array_join(missing, ",").alias("missing"))


@query(
    "two_side_samples",
    f"""WITH {EVENTS_SQL}, m AS (SELECT *, first(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY} FOLLOWING AND {2 * DAY} FOLLOWING) - value AS mv FROM e)
    SELECT event_id, side, CASE WHEN coalesce(CASE WHEN side = 'bid' THEN mv <= -0.01 ELSE mv >= 0.01 END, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target, CASE WHEN side = 'bid' THEN -k ELSE k END + 0.0::DOUBLE AS adv_flow_5s
    FROM m, (VALUES ('bid'), ('ask')) AS s(side)""",
)
def two_side_samples(spark, sf_dir):
    from tickloom.operators.asof import first_after

    ahead = first_after(events(spark, sf_dir), ["user_id"], "t", 5 * DAY, "value", {"later": DAY}, DAY)
    none = F.lit(None).cast("double")
    rows = ahead.select(
        F.col("event_id").alias("ticker"), F.lit(100.0).alias("seconds_to_close"), (F.col("later") - F.col("value")).alias("fwd_mid_delta_5s"), F.col("k").alias("flow_5s"),
        *[none.alias(c) for c in ("imb_top1", "imb_top3", "microprice_minus_mid", "flow_1s", "bid_size_delta", "ask_size_delta", "ext_micro_lead_bps", "ext_imbalance", "gbm_fair_minus_mid", "trades_5s")],
        none.alias("spread"),
    )
    out = fit.state_samples(rows)
    return out.select(F.col("ticker").alias("event_id"), F.col("fill_side").alias("side"), "target", (F.col("adv_flow_5s") + 0.0).alias("adv_flow_5s"))


@dataclass(frozen=True)
class FittedModels:
    """Both kinds of models from the train windows, and fills that they can be judged by."""

    windows: Windows
    gate: list[LinearModel]
    value: list[LinearModel]
    val_fills: DataFrame


def fitted_models(spark, sf_dir) -> FittedModels:
    """Features of all windows, the labelled fills of open-loop quotes, and the models of the train windows."""
    windows, state, done = _simulated(spark, sf_dir)
    features = cut(feature_table(windows, state))
    labels = cut(label_rows(done.drop("variant"), features, mid_series(state, windows.markets), SLICE_MS))
    parts = cut(readable_windows(chronological_split(window_order(features, "ticker", "ts_ms"))))

    def of(rows: DataFrame, part: str) -> DataFrame:
        return rows.join(parts.filter(F.col("part") == part).select("ticker"), "ticker", "left_semi")

    gate = fit.fit_toxicity_models(of(labels, "train"), of(features, "train"))
    return FittedModels(windows, gate, fit.fit_value_models(of(features, "train")), of(labels, "val"))


@query("value_model_fit")
def value_model_fit(spark, sf_dir):
    features = cut(feature_table(derived_windows(spark, sf_dir)))
    parts = cut(readable_windows(chronological_split(window_order(features, "ticker", "ts_ms"))))
    train, val = (features.join(parts.filter(F.col("part") == p).select("ticker"), "ticker", "left_semi") for p in ("train", "val"))
    return rounded(fit.evaluate_value_models(fit.fit_value_models(train), val), 6)


@query("toxicity_model_evaluation")
def toxicity_model_evaluation(spark, sf_dir):
    """AUC and Brier score of every toxicity model on the fills of windows it has not seen."""
    models = fitted_models(spark, sf_dir)
    return rounded(fit.evaluate_toxicity_models(models.gate, models.val_fills), 6)


@query("toxicity_model_fit")
def toxicity_model_fit(spark, sf_dir):
    models = fitted_models(spark, sf_dir).gate
    out = [(m.meta["training"], f"{int(m.bucket[0])}-{int(m.bucket[1])}", n, c) for m in models for n, c in zip(("intercept", *m.features), (m.intercept, *m.coefs))]
    return rounded(spark.createDataFrame(out, "training string, bucket string, term string, weight double"), 6)


@query("settlement_pnl_by_window")
def settlement_pnl_by_window(spark, sf_dir):
    w, _, done = _simulated(spark, sf_dir)
    return rounded(pnl_rollup(fill_money(done), ["ticker", "variant"], outcome=window_labels(w)), 6)


@query("table_file_manifest")
def table_file_manifest(spark, sf_dir):
    manifest = file_manifest(spark, sf_dir, "tables", "archive", "*.parquet")
    return manifest.select("key", "size", "sha256")


@query(
    "label_summary",
    "SELECT CAST(l_suppkey AS VARCHAR) AS ticker, count(*) AS fills, count(*) FILTER (l_linenumber % 4 <> 0 AND l_discount > 0.05) AS toxic_5s FROM lineitem GROUP BY l_suppkey",
)
def label_summary_by_supplier(spark, sf_dir):
    toxic = F.when(F.col("l_linenumber") % 4 != 0, (F.col("l_discount") > 0.05).cast("double"))
    labels = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("ticker"), toxic.alias("toxic_5s"))
    return label_summary(labels)


@query(
    "promotion_candidate",
    """WITH s AS (SELECT l_returnflag || l_linenumber AS variant, avg(l_discount) - 0.0499 AS m, avg(l_tax) - 0.0399 AS low, avg(l_tax) AS d FROM lineitem GROUP BY 1)
    SELECT arg_max(variant, d) AS variant, round(max(d), 8) AS d_settle, count(*) AS qualified FROM s WHERE m > 0 AND low > 0""",
)
def best_variant(spark, sf_dir):
    variant = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    summary = table(spark, sf_dir, "lineitem").groupBy(variant.alias("variant")).agg(
        (F.avg("l_discount") - 0.0499).alias("d_markout_low"), (F.avg("l_tax") - 0.0399).alias("d_settle_low"), F.avg("l_tax").alias("d_settle")
    )
    return rounded(promotion_candidate(summary), 8)


ARCHIVE_NOW_S = 900_000_000


@query(
    "archive_backlog",
    """WITH b AS (SELECT o_orderkey, o_orderkey % 20000 AS age, o_orderkey % 2 = 0 AS ev, o_orderstatus = 'F' AS closed, substr(o_orderpriority, 1, 1) = '1' AS finalized, o_orderkey % 11 <> 0 AS readable,
      o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AS done FROM orders),
    c AS (SELECT *, NOT done AND age >= 60 AND readable AND CASE WHEN ev AND NOT closed THEN age >= 7200 ELSE finalized OR age >= 900 END AS pending FROM b)
    SELECT count(*) FILTER (pending OR done) AS ready, count(*) FILTER (pending) AS pending, CAST(max(age) FILTER (pending) AS DOUBLE) AS oldest_pending_s, coalesce(max(age) FILTER (pending) > 1800, false) AS alarm,
      'k/' || max(o_orderkey) FILTER (done) AS newest_key FROM c""",
)
def archive_backlog_of_orders(spark, sf_dir):
    """Orders as recordings: every third one uploaded, some of these changed since."""
    n = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    path = F.concat(F.when(n % 2 == 0, "d/events_").otherwise("d/runner_"), n.cast("string"))
    mtime = ((F.lit(ARCHIVE_NOW_S) - n % 20000) * 1_000_000).cast("long")
    size = F.floor("o_totalprice").cast("long")
    manifest = orders.select(path.alias("path"), F.lit("b").alias("bucket"), F.concat(F.lit("k/"), n.cast("string")).alias("key"), size.alias("size"), mtime.alias("mtime_us"), F.lit("").alias("sha256"))
    flags = orders.select(path.alias("path"), (F.col("o_orderstatus") == "F").alias("closed"), F.col("o_orderpriority").startswith("1").alias("finalized"), (n % 11 != 0).alias("readable"))
    markers = orders.filter(n % 3 == 0).select(
        F.lit("b").alias("bucket"), F.concat(F.lit("k/"), n.cast("string")).alias("key"), F.when(n % 5 == 0, size + 1).otherwise(size).alias("size"), mtime.alias("mtime_us"), F.lit("").alias("sha256"), n.cast("double").alias("uploaded_at")
    )
    return archive_backlog(manifest, flags, markers, float(ARCHIVE_NOW_S))


@query(
    "incentive_filter",
    "SELECT l_orderkey, count(*) FILTER (l_linenumber % 3 = 1) AS n, coalesce(string_agg(l_returnflag, ',' ORDER BY l_returnflag) FILTER (l_linenumber % 3 = 1), '') AS kinds FROM lineitem GROUP BY l_orderkey",
)
def incentive_filter(spark, sf_dir):
    """Items of a programme list in JSON that name one market; an order's lines are its list."""
    item = F.struct(F.concat(F.lit("T"), F.col("l_linenumber") % 3).alias("market_ticker"), F.col("l_returnflag").alias("incentive_type"), F.col("l_shipdate").cast("string").alias("start_date"))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(item).alias("incentive_programs"))).alias("payload"))
    mine = lists.select("l_orderkey", incentives_of(F.col("payload"), F.lit("T1")).alias("items"))
    return mine.select("l_orderkey", F.size("items").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("items", lambda x: x["incentive_type"])), ",").alias("kinds"))

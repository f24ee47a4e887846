"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickloom.catalog.base import EVENTS_SQL, events, query, rounded, table
from tickloom.functions import pricing as P
from tickloom.functions import quoting as Q
from tickloom.functions.parsing import field, first_filled, iso_millis, iso_seconds, number
from tickloom.operators.linear import LinearModel
from tickloom.operators.metrics import brier_term, log_loss_term
from tickloom.plans.fit import bucket_name
from tickloom.plans.quotes import quote_columns
from tickloom.plans.variants import MIRRORED_FEATURES, VenueLead, BookLean, ToxicityTax, Variant, mirrored, parse_variant

# SQL text of the normal CDF and its inverse: the same published coefficients, written as macros per use.


def _horner(coefficients, x):
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


def cdf_cte(name: str, source: str, x: str, out: str) -> str:
    """CTE ``name``: ``source`` plus ``out`` = Phi(x), by erfc over three ranges."""
    a, b, c, d, p, q = P.ERF_A, P.ERF_B, P.ERF_C, P.ERF_D, P.ERF_P, P.ERF_Q
    small_n, small_d = _horner((a[4], *a[:4]), "s"), _horner((1.0, *b), "s")
    mid_n, mid_d = _horner((c[8], *c[:8]), "y"), _horner((1.0, *d), "y")
    far_n, far_d = _horner((p[5], *p[:5]), "v"), _horner((1.0, *q), "v")
    return f"""{name}_y AS (SELECT *, abs({x}) / {math.sqrt(2.0)!r} AS y FROM {source}),
    {name}_s AS (SELECT *, y * y AS s, CASE WHEN y > 0 THEN 1 / (y * y) END AS v FROM {name}_y),
    {name}_t AS (SELECT *, CASE WHEN y <= 0.46875 THEN 1 - y * {small_n} / {small_d} WHEN y <= 4 THEN exp(-s) * {mid_n} / {mid_d}
      WHEN y < 27 THEN exp(-s) * ({1 / math.sqrt(math.pi)!r} - v * {far_n} / {far_d}) / y ELSE 0.0 END / 2 AS tail FROM {name}_s),
    {name} AS (SELECT * EXCLUDE (y, s, v, tail), CASE WHEN {x} > 0 THEN 1 - tail ELSE tail END AS {out} FROM {name}_t)"""


def icdf_sql(p: str) -> str:
    q_low, q_high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    centre = f"({_horner(P.ICDF_A, f'(({p} - 0.5) * ({p} - 0.5))')} * ({p} - 0.5) / {_horner((*P.ICDF_B, 1.0), f'(({p} - 0.5) * ({p} - 0.5))')})"
    low = f"({_horner(P.ICDF_C, q_low)} / {_horner((*P.ICDF_D, 1.0), q_low)})"
    high = f"(-{_horner(P.ICDF_C, q_high)} / {_horner((*P.ICDF_D, 1.0), q_high)})"
    return f"CASE WHEN {p} < {P.ICDF_LOW} THEN {low} WHEN {p} > {1 - P.ICDF_LOW} THEN {high} ELSE {centre} END"


@query("normal_cdf", f"WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25.5) / 4 AS x FROM lineitem), {cdf_cte('c', 'z', 'x', 'p')} SELECT l_orderkey, l_linenumber, round(p, 12) AS p FROM c")
def normal_cdf(spark, sf_dir):
    x = (F.col("l_quantity") - 25.5) / 4
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.normal_cdf(x).alias("p")), 12)


@query("inverse_normal_cdf", f"WITH u AS (SELECT l_orderkey, l_linenumber, (l_quantity - 0.5) / 50 AS u FROM lineitem) SELECT l_orderkey, l_linenumber, round({icdf_sql('u')}, 10) AS z FROM u")
def inverse_normal_cdf(spark, sf_dir):
    u = (F.col("l_quantity") - 0.5) / 50
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.inverse_normal_cdf(u).alias("z")), 10)


# Spot, strike, volatility and time to close taken from order lines.
INPUTS_SQL = """i AS (SELECT l_orderkey, l_linenumber, 100.0::DOUBLE AS strike, 100 * (1 + (l_discount - 0.05) / 50) AS spot, 0.00005 * (1 + l_tax * 20) AS sigma,
      l_quantity * 18 AS secs, (l_linenumber - 4) * 0.000001 AS drift FROM lineitem)"""


def _inputs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit(100.0).alias("strike"), (100 * (1 + (F.col("l_discount") - 0.05) / 50)).alias("spot"),
        (0.00005 * (1 + F.col("l_tax") * 20)).alias("sigma"), (F.col("l_quantity") * 18).alias("secs"), ((F.col("l_linenumber") - 4) * 0.000001).alias("drift"),
    )


@query(
    "gbm_binary_price",
    f"""WITH {INPUTS_SQL}, z AS (SELECT *, ln(spot / strike) / (sigma * sqrt(secs)) AS zs, drift * sqrt(secs) / sigma AS zr FROM i),
    g AS (SELECT *, CASE WHEN abs(zr) < 0.08 THEN 0 ELSE greatest(-0.35, least(0.35, zr)) END AS zd FROM z), h AS (SELECT *, zs + zd AS x FROM g), {cdf_cte('c', 'h', 'x', 'p')}
    SELECT l_orderkey, l_linenumber, round(greatest(0.01, least(0.99, p)), 9) AS up, round(zs, 9) AS z_spot, round(zd, 9) AS z_drift FROM c""",
)
def gbm_binary_price(spark, sf_dir):
    g = P.gbm_binary_price(F.col("strike"), F.col("spot"), F.col("sigma"), F.col("secs"), F.col("drift"))
    return rounded(_inputs(spark, sf_dir).withColumn("g", g).select("l_orderkey", "l_linenumber", "g.up", "g.z_spot", "g.z_drift"), 9)


@query(
    "implied_and_blended_sigma",
    f"""WITH {INPUTS_SQL}, m AS (SELECT *, greatest(0.01, least(0.99, 0.5 + (spot - 100) * 2 + (l_linenumber - 4) * 0.05)) AS p FROM i),
    s AS (SELECT *, {icdf_sql('p')} AS z FROM m), r AS (SELECT *, CASE WHEN abs(z) >= 1e-9 THEN ln(spot / strike) / (z * sqrt(secs)) END AS raw FROM s),
    v AS (SELECT *, CASE WHEN raw > 0 THEN raw END AS implied FROM r)
    SELECT l_orderkey, l_linenumber, round(implied * 1e6, 6) AS implied_e6, round(greatest(0.00002, coalesce(0.7 * sigma + 0.3 * implied, sigma)) * 1e6, 6) AS blended_e6 FROM v""",
)
def implied_and_blended_sigma(spark, sf_dir):
    p = 0.5 + (F.col("spot") - 100) * 2 + (F.col("l_linenumber") - 4) * 0.05
    rows = _inputs(spark, sf_dir).withColumn("implied", P.implied_sigma(p, F.col("strike"), F.col("spot"), F.col("secs")))
    blended = P.blend_sigma(F.col("sigma"), F.col("implied"), 0.3, 0.00002)
    return rounded(rows.select("l_orderkey", "l_linenumber", (F.col("implied") * 1e6).alias("implied_e6"), (blended * 1e6).alias("blended_e6")))


@query(
    "average_settlement_fair",
    f"""WITH {INPUTS_SQL}, o AS (SELECT *, CASE WHEN secs <= 60 THEN l_linenumber * 5 ELSE 0 END AS seen FROM i),
    t AS (SELECT *, 60 - seen AS n, seen * spot AS seen_sum, list_transform(range(1, 61 - seen), lambda k: CASE WHEN seen = 0 AND secs >= 60 THEN secs - 60 + k ELSE secs / (60 - seen) * k END) AS ts FROM o),
    v AS (SELECT *, spot * spot * list_sum(list_transform(range(1, n + 1), lambda k: (2 * (n - k) + 1) * (exp(sigma * sigma * ts[k]) - 1))) / (n * n) AS var FROM t),
    w AS (SELECT *, ln(1 + var / (spot * spot)) AS lv, 60 * strike - seen_sum AS need FROM v),
    x AS (SELECT *, (ln(need / n) - (ln(spot) - 0.5 * lv)) / sqrt(lv) AS x FROM w), {cdf_cte('c', 'x', 'x', 'p')}
    SELECT l_orderkey, l_linenumber, round(greatest(0.001, least(0.999, 1 - p)), 5) AS yes, round((seen_sum + n * spot) / 60, 6) AS expected_average, round(sqrt(var) * n / 60, 5) AS average_std FROM c""",
)
def average_settlement_fair(spark, sf_dir):
    seen = F.when(F.col("secs") <= 60, F.col("l_linenumber") * 5).otherwise(0)
    f = P.average_settlement_fair(F.col("strike"), F.col("spot"), F.col("sigma"), F.col("secs"), seen, seen * F.col("spot"))
    out = _inputs(spark, sf_dir).withColumn("f", f).select(
        "l_orderkey", "l_linenumber", F.round("f.yes", 5).alias("yes"), F.round("f.expected_average", 6).alias("expected_average"), F.round("f.average_std", 5).alias("average_std")
    )
    return out


@query(
    "moneyness",
    f"WITH {INPUTS_SQL} SELECT l_orderkey, l_linenumber, round(ln(spot / strike) / (sigma * sqrt(secs)), 8) AS z FROM i",
)
def moneyness(spark, sf_dir):
    z = P.moneyness_z(F.col("spot"), F.col("strike"), F.col("sigma"), F.col("secs"))
    return rounded(_inputs(spark, sf_dir).select("l_orderkey", "l_linenumber", z.alias("z")), 8)


@query(
    "contract_fees",
    """WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(12, 4)) AS n, CAST(0.01 + l_discount * 9 AS DECIMAL(5, 4)) AS p FROM lineitem),
    f AS (SELECT *, CAST(n AS DECIMAL(12,4)) * (p * (1 - p)) AS base FROM p)
    SELECT l_orderkey, l_linenumber, CAST(ceil(CAST(base AS DECIMAL(30, 12)) * 175) / 10000 AS DOUBLE) AS maker_fee, CAST(ceil(CAST(base AS DECIMAL(30, 12)) * 700) / 10000 AS DOUBLE) AS taker_fee,
      round(CAST(p * (1 - p) * 0.0175 AS DOUBLE), 8) AS maker_rate FROM f""",
)
def contract_fees(spark, sf_dir):
    price = 0.01 + F.col("l_discount") * 9
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", Q.contract_fee(F.col("l_quantity"), price, True, 1.0).alias("maker_fee"),
        Q.contract_fee(F.col("l_quantity"), price, False).alias("taker_fee"), F.round(Q.maker_fee_per_contract(price, 1.0), 8).alias("maker_rate"),
    )


TAPERED = ((0.0, 0.1, 0.001), (0.1, 0.9, 0.01), (0.9, 1.0, 0.001))


def _tapered():
    return F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(s).alias("step")) for a, b, s in TAPERED])


def _grid_sql(price: str, up: bool) -> str:
    b = f"least(0.999, greatest(0.001, {price}))"
    whole = "ceil({u} - 1e-10)" if up else "floor({u} + 1e-10)"
    arms = " ".join(
        f"WHEN {b} < {end if end < 1 else 2} THEN round({start} + {whole.format(u=f'(({b} - {start}) / {step})')} * {step}, 4)" for start, end, step in TAPERED
    )
    return f"CASE {arms} END"


@query(
    "price_grid",
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, (l_extendedprice % 1000) / 1000 AS p FROM lineitem)
    SELECT l_orderkey, l_linenumber, {_grid_sql('p', False)} AS low, {_grid_sql('p', True)} AS high, {_grid_sql('(p - 1e-9)', False)} AS below, {_grid_sql('(p + 1e-9)', True)} AS above,
      CASE WHEN p < 0.1 OR p >= 0.9 THEN 0.001::DOUBLE ELSE 0.01::DOUBLE END AS step FROM p""",
)
def price_grid(spark, sf_dir):
    p = (F.col("l_extendedprice") % 1000) / 1000
    g = _tapered()
    return table(spark, sf_dir, "lineitem").withColumn("g", g).withColumn("p", p).select(
        "l_orderkey", "l_linenumber", Q.grid_floor(F.col("g"), F.col("p")).alias("low"), Q.grid_ceil(F.col("g"), F.col("p")).alias("high"),
        Q.tick_below(F.col("g"), F.col("p")).alias("below"), Q.tick_above(F.col("g"), F.col("p")).alias("above"), Q.grid_step(F.col("g"), F.col("p")).alias("step"),
    )


@query(
    "price_keys_and_cents",
    """SELECT l_orderkey, l_linenumber, CAST(round_even(l_discount * l_quantity / 50 * 10000, 0) AS INTEGER) AS price_key,
      CAST(round(CAST(l_extendedprice AS DECIMAL(38, 12)), 2) AS DOUBLE) AS cents FROM lineitem""",
)
def price_keys_and_cents(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", Q.price_key(F.col("l_discount") * F.col("l_quantity") / 50).alias("price_key"),
        Q.half_up_cents(F.col("l_extendedprice")).cast("double").alias("cents"),
    )


@query(
    "iso_times",
    "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, epoch_ms(o_orderdate) AS millis FROM orders",
)
def iso_times(spark, sf_dir):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise("+00:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", iso_seconds(text).alias("seconds"), iso_millis(text).alias("millis"))


@query(
    "json_fields",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(json_extract(props, '$.k') AS DOUBLE) AS nested,
      CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) <> 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) ELSE value END AS filled, CAST(NULL AS DOUBLE) AS bad FROM events""",
)
def json_fields(spark, sf_dir):
    # A JSON object inside a JSON string, as index messages carry it.
    nested = F.to_json(F.struct(F.col("props").alias("data")))
    return table(spark, sf_dir, "events").select(
        "event_id", number(field(F.col("props"), "k")).alias("k"), number(field(field(nested, "data"), "k")).alias("nested"),
        number(first_filled(field(F.col("props"), "k"), F.col("value").cast("string"))).alias("filled"), number(F.col("event_type")).alias("bad"),
    )


@query(
    "aggressor_and_fill_signs",
    f"""WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k % 3 = 0 THEN value WHEN k % 3 = 1 THEN -value END AS trade_signed,
      CASE WHEN k % 5 = 0 THEN value WHEN k % 5 = 1 THEN -value WHEN k % 5 = 2 THEN CASE WHEN k % 2 = 0 THEN value ELSE -value END
        WHEN k % 5 = 3 THEN CASE WHEN k % 2 = 0 THEN -value ELSE value END END AS fill_signed FROM e""",
)
def aggressor_and_fill_signs(spark, sf_dir):
    k, none = F.col("k"), F.lit(None).cast("string")
    trade_side = F.when(k % 3 == 0, "bid").when(k % 3 == 1, "ask").otherwise("other")
    book_side = F.when(k % 5 == 0, "bid").when(k % 5 == 1, "ask").otherwise(none)
    taker_side = F.when(k % 2 == 0, "bid").otherwise("ask")
    action = F.when(k % 5 == 3, F.when(k % 2 == 0, "sell").otherwise("BUY"))
    side = F.when(k % 5 == 3, F.lit("yes"))
    return events(spark, sf_dir).select(
        "event_id", Q.signed_by_aggressor(F.col("value"), trade_side).alias("trade_signed"),
        Q.private_fill_delta(F.col("value"), book_side, k % 5 == 2, taker_side, action, side).alias("fill_signed"),
    )


# Decision columns made from events, shared by the variant queries.
CONTEXT_SQL = f"""{EVENTS_SQL}, x AS (SELECT event_id, k, CAST(1 + k % 17 AS DOUBLE) AS bid_size, CAST(1 + k % 23 AS DOUBLE) AS ask_size, 0.30 + (k % 40) / 100.0::DOUBLE AS bid,
      0.30 + (k % 40) / 100.0::DOUBLE + 0.02 AS ask, CAST(60 + k * 9 AS DOUBLE) AS secs, least(0.95, greatest(0.05, 0.31 + (k % 40) / 100.0::DOUBLE + (value - 50) / 2000)) AS fair,
      CASE WHEN k % 11 <> 0 THEN (value - 50) / 25 END AS lead, 0.0001::DOUBLE AS sigma FROM e),
    y AS (SELECT *, (bid + ask) / 2 AS mid, (ask * bid_size + bid * ask_size) / (bid_size + ask_size) - (bid + ask) / 2 AS micro FROM x)"""


def decision_columns(spark, sf_dir):
    k = F.col("k")
    bid = 0.30 + (k % 40) / 100.0
    base = events(spark, sf_dir).select(
        "event_id", "k", "value", (1 + k % 17).cast("double").alias("bid_size"), (1 + k % 23).cast("double").alias("ask_size"), bid.alias("bid"), (bid + 0.02).alias("ask"),
        (60 + k * 9).cast("double").alias("seconds_to_close"),
        F.least(F.lit(0.95), F.greatest(F.lit(0.05), 0.31 + (k % 40) / 100.0 + (F.col("value") - 50) / 2000)).alias("gbm_fair"),
        F.when(k % 11 != 0, (F.col("value") - 50) / 25).alias("ext_micro_lead_bps"), F.lit(0.0001).alias("sigma_per_s"),
    )
    shaped = base.withColumn("mid", Q.mid_price(F.col("bid"), F.col("ask"))).withColumn("spread", F.col("ask") - F.col("bid"))
    zero = F.lit(0.0)
    return (
        shaped.withColumn("microprice_minus_mid", Q.microprice(F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("ask_size")) - F.col("mid"))
        .withColumn("imb_top1", Q.imbalance(F.col("bid_size"), F.col("ask_size")))
        .withColumn("imb_top3", F.col("imb_top1") / 2).withColumn("flow_1s", F.col("value") / 100).withColumn("flow_5s", F.col("value") / 50)
        .withColumn("bid_size_delta", F.col("bid_size") - 9).withColumn("ask_size_delta", F.col("ask_size") - 12).withColumn("ext_imbalance", zero)
        .withColumn("gbm_fair_minus_mid", F.col("gbm_fair") - F.col("mid")).withColumn("trades_5s", k % 6)
    )


@query(
    "book_shape",
    f"""WITH {CONTEXT_SQL} SELECT event_id, round(mid, 6) AS mid, round(ask - bid, 6) AS spread, round(micro, 8) AS microprice_minus_mid,
      round((bid_size - ask_size) / (bid_size + ask_size), 8) AS imb_top1, round((lead / 100 - 1) * 10000, 4) AS basis_bps FROM y""",
)
def book_shape(spark, sf_dir):
    return decision_columns(spark, sf_dir).select(
        "event_id", F.round("mid", 6).alias("mid"), F.round("spread", 6).alias("spread"), F.round("microprice_minus_mid", 8).alias("microprice_minus_mid"),
        F.round("imb_top1", 8).alias("imb_top1"), F.round(Q.basis_points(F.col("ext_micro_lead_bps"), F.lit(100.0)), 4).alias("basis_bps"),
    )


@query(
    "time_buckets",
    f"WITH {CONTEXT_SQL} SELECT event_id, CASE WHEN secs >= 90 AND secs < 300 THEN '90-300' WHEN secs >= 300 AND secs < 600 THEN '300-600' WHEN secs >= 600 AND secs < 900 THEN '600-900' END AS bucket FROM y",
)
def time_buckets(spark, sf_dir):
    return decision_columns(spark, sf_dir).select("event_id", bucket_name().alias("bucket"))


@query(
    "side_mirror",
    f"""WITH {CONTEXT_SQL}, s AS (SELECT y.*, side, CASE WHEN side = 'bid' THEN -1 ELSE 1 END AS g FROM y, (VALUES ('bid'), ('ask')) AS v(side))
    SELECT event_id, side, round(g * (bid_size - ask_size) / (bid_size + ask_size), 8) + 0.0 AS adv_imb_top1, round(g * micro, 8) + 0.0 AS adv_microprice,
      CASE WHEN side = 'bid' THEN 9 - bid_size ELSE 12 - ask_size END AS adv_own_depth_delta, CASE WHEN side = 'bid' THEN ask_size - 12 ELSE bid_size - 9 END AS adv_opp_depth_delta,
      round(g * lead, 8) + 0.0 AS adv_ext_micro_lead, round(g * (fair - mid), 8) + 0.0 AS adv_fair_minus_mid FROM s""",
)
def side_mirror(spark, sf_dir):
    two = decision_columns(spark, sf_dir).withColumn("side", F.explode(F.array(F.lit("bid"), F.lit("ask"))))
    m = mirrored(F.col("side"))
    names = ["adv_imb_top1", "adv_microprice", "adv_own_depth_delta", "adv_opp_depth_delta", "adv_ext_micro_lead", "adv_fair_minus_mid"]
    return rounded(two.select("event_id", "side", *[m[n].alias(n) for n in names]), 8)


@query(
    "variant_fairs",
    f"""WITH {CONTEXT_SQL}, f AS (SELECT *, fair + 0.25 * micro AS micro25, greatest(0.01, least(0.99, fair)) AS f0 FROM y),
    z AS (SELECT *, {icdf_sql('f0')} + 0.5 * lead / 10000 / (sigma * sqrt(secs)) AS x FROM f), {cdf_cte('c', 'z', 'x', 'p')}
    SELECT event_id, variant, round(CASE variant WHEN 'baseline' THEN fair WHEN 'micro25' THEN greatest(0.001, least(0.999, micro25))
      ELSE CASE WHEN lead IS NULL THEN fair ELSE greatest(0.001, least(0.999, p)) END END, 8) AS fair_yes FROM c, (VALUES ('baseline'), ('micro25'), ('extlead50')) AS v(variant)""",
)
def variant_fairs(spark, sf_dir):
    variants = [parse_variant(n) for n in ("baseline", "micro25", "extlead50")]
    long = decision_columns(spark, sf_dir).withColumn("v", F.explode(F.array(*[v.struct() for v in variants])))
    return rounded(long.select("event_id", "v.variant", "v.fair_yes"), 8)


# A small fixed model: weights on three mirrored features, neutral on the rest.
GATE = LinearModel(
    "logistic", MIRRORED_FEATURES, (0.0,) * 12, (1.0,) * 12, (1.5, 0.0, 20.0, 0.0, 0.0, 0.0, 0.0, 0.3, 0.0, 0.0, 0.0, 0.0), -0.5, (90.0, 600.0), 1000, {"base_rate": "0.3"}
)


@query(
    "toxicity_gate",
    f"""WITH {CONTEXT_SQL}, s AS (SELECT *, 1.5 * (bid_size - ask_size) / (bid_size + ask_size) + 20 * micro + 0.3 * coalesce(lead, 0) AS r, secs >= 90 AND secs < 600 AS on_ FROM y),
    p AS (SELECT *, 1 / (1 + exp(-greatest(-30, least(30, -0.5 - r)))) AS pb, 1 / (1 + exp(-greatest(-30, least(30, -0.5 + r)))) AS pa FROM s)
    SELECT event_id, round(CASE WHEN on_ THEN greatest(0, pb - 0.3) / 0.7 * 0.06 ELSE 0 END, 8) AS bid_tax, round(CASE WHEN on_ THEN greatest(0, pa - 0.3) / 0.7 * 0.06 ELSE 0 END, 8) AS ask_tax FROM p""",
)
def toxicity_gate(spark, sf_dir):
    _, bid_tax, ask_tax = ToxicityTax((GATE,), 0.06).columns(F.col("gbm_fair"))
    return rounded(decision_columns(spark, sf_dir).select("event_id", bid_tax.alias("bid_tax"), ask_tax.alias("ask_tax")), 8)


@query(
    "open_loop_quotes",
    f"""WITH {CONTEXT_SQL}, q AS (SELECT *, CAST((k % 21 - 10) * 4 AS DOUBLE) AS pos FROM y), u AS (SELECT *, greatest(-1, least(1, pos / 50)) AS use_ FROM q),
    r AS (SELECT *, greatest(0.001, least(0.999, fair - use_ * 0.02)) AS res FROM u),
    p AS (SELECT *, least(round(floor(least(0.999, greatest(0.001, res - 0.01)) / 0.01 + 1e-10) * 0.01, 4), round(floor(least(0.999, greatest(0.001, ask - 1e-9)) / 0.01 + 1e-10) * 0.01, 4)) AS b,
      greatest(round(ceil(least(0.999, greatest(0.001, res + 0.01)) / 0.01 - 1e-10) * 0.01, 4), round(ceil(least(0.999, greatest(0.001, bid + 1e-9)) / 0.01 - 1e-10) * 0.01, 4)) AS a FROM r),
    n AS (SELECT *, least(5 * greatest(0, 1 - use_), 50 - pos, 10 / greatest(0.001, b), 20) AS nb, least(5 * greatest(0, 1 + use_), 50 + pos, 10 / greatest(0.001, 1 - a), 20) AS na FROM p),
    k2 AS (SELECT *, secs > 90 AND least(5 * greatest(0, 1 - use_), 50 - pos) > 0 AND b > 0 AND b < ask AND res - b >= 0.01 - 1e-9 AND nb >= 1 AS bok,
      secs > 90 AND least(5 * greatest(0, 1 + use_), 50 + pos) > 0 AND a > bid AND a < 1 AND a - res >= 0.01 - 1e-9 AND na >= 1 AS aok FROM n)
    SELECT event_id, 'bid' AS side, b AS price, round(nb, 6) AS count FROM k2 WHERE bok
    UNION ALL SELECT event_id, 'ask' AS side, a AS price, round(na, 6) AS count FROM k2 WHERE aok AND NOT (bok AND a <= b)""",
)
def open_loop_quotes(spark, sf_dir):
    base = decision_columns(spark, sf_dir).withColumn("price_ranges", Q.default_grid()).withColumn("v", Variant("baseline").struct()).select("*", "v.*")
    quoted = quote_columns(base, position=((F.col("k") % 21 - 10) * 4).cast("double"))
    return rounded(quoted.select("event_id", F.inline("quotes")).select("event_id", "side", "price", "count"))


@query(
    "linear_score",
    f"""WITH {CONTEXT_SQL} SELECT event_id, round(1 / (1 + exp(-(0.2 + 0.8 * ((bid_size - ask_size) / (bid_size + ask_size) - 0.1) / 0.5 - 0.3 * (lead - 0.2) / 1.5))), 8) AS p,
      round(0.2 + 0.8 * ((bid_size - ask_size) / (bid_size + ask_size) - 0.1) / 0.5 - coalesce(0.3 * (lead - 0.2) / 1.5, 0), 8) AS imputed FROM y""",
)
def linear_score(spark, sf_dir):
    m = LinearModel("logistic", ("imb_top1", "ext_micro_lead_bps"), (0.1, 0.2), (0.5, 1.5), (0.8, -0.3), 0.2, (90.0, 300.0), 10)
    return rounded(decision_columns(spark, sf_dir).select("event_id", m.predict().alias("p"), m.score(impute_missing=True).alias("imputed")), 8)


@query(
    "brier_log_loss",
    """WITH s AS (SELECT d.lang, least(0.999, greatest(0.001, d.n_chars % 1000 / 1000.0::DOUBLE)) AS p, CAST(l.quality AS DOUBLE) AS o FROM labels l JOIN documents d USING (doc_id))
    SELECT lang, count(*) AS n, round(avg((p - o) * (p - o)), 8) AS brier, round(avg(-(o * ln(p) + (1 - o) * ln(1 - p))), 8) AS log_loss FROM s GROUP BY lang HAVING count(*) >= 20""",
)
def brier_log_loss(spark, sf_dir):
    s = scored_documents(spark, sf_dir)
    p, o = F.col("p"), F.col("o")
    out = s.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(brier_term(p, o)).alias("brier"), F.avg(log_loss_term(p, o)).alias("log_loss"))
    return rounded(out.filter("n >= 20"), 8)


def scored_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("n_chars") % 1000 / 1000.0))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("lang", p.alias("p"), F.col("quality").cast("double").alias("o"))

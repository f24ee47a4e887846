"""Price grids, fees and book-shape formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.pricing import clamp, let

# Fee rates of the published quadratic schedule; price grid bounds.
MAKER_FEE_RATE = "0.0175"
TAKER_FEE_RATE = "0.07"
PRICE_LOW, PRICE_HIGH = 0.001, 0.999
KEY_SCALE = 10_000
GRID_TYPE = "array<struct<start:double,end:double,step:double>>"


def price_key(price: Column) -> Column:
    """Integer book key of a price, half to even."""
    return F.bround(price.cast("double") * KEY_SCALE, 0).cast("int")


def default_grid() -> Column:
    return F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit(0.01).alias("step")))


def _range_of(ranges: Column, price: Column) -> Column:
    """The range holding ``price``: half-open, the last one closed; null if none."""
    last = F.size(ranges) - 1
    holding = F.filter(
        ranges,
        lambda r, i: (r["start"] <= price) & ((price < r["end"]) | ((i == last) & (price <= r["end"]))),
    )
    return F.get(holding, F.lit(0))


def grid_step(ranges: Column, price: Column) -> Column:
    return let(
        clamp(price, 0.0, 1.0), lambda b: F.coalesce(_range_of(ranges, b)["step"], F.element_at(ranges, -1)["step"])
    )


def _grid_round(ranges: Column, price: Column, up: bool) -> Column:
    low, high = F.element_at(ranges, 1)["start"], F.element_at(ranges, -1)["end"]

    def at(bounded: Column) -> Column:
        def inside(r: Column) -> Column:
            units = (bounded - r["start"]) / r["step"]
            whole = F.ceil(units - 1e-10) if up else F.floor(units + 1e-10)
            return F.round(r["start"] + whole * r["step"], 4)

        # Outside the configured ranges the nearest edge is the price.
        edge = F.when(bounded < low, low).when(bounded.isNotNull(), F.round(high, 4))
        return F.coalesce(let(_range_of(ranges, bounded), inside), edge)

    return let(clamp(price, PRICE_LOW, PRICE_HIGH), at)


def grid_floor(ranges: Column, price: Column) -> Column:
    return _grid_round(ranges, price, up=False)


def grid_ceil(ranges: Column, price: Column) -> Column:
    return _grid_round(ranges, price, up=True)


def tick_below(ranges: Column, price: Column) -> Column:
    """Largest grid price strictly below ``price`` (taper borders included)."""
    return grid_floor(ranges, price - 1e-9)


def tick_above(ranges: Column, price: Column) -> Column:
    return grid_ceil(ranges, price + 1e-9)


def _fee_product(price: Column, multiplier: Column | float, rate: str) -> Column:
    factor = (multiplier if isinstance(multiplier, Column) else F.lit(str(multiplier))).cast("decimal(6,4)")
    p = price.cast("decimal(5,4)")
    return factor * F.lit(rate).cast("decimal(5,4)"), p * (F.lit(1).cast("decimal(5,4)") - p)


def contract_fee(contracts: Column, price: Column, maker: Column | bool, maker_multiplier: Column | float = 0.0, taker_multiplier: Column | float = 1.0) -> Column:
    """Quadratic fee in exact decimals, rounded up to a hundredth of a cent."""

    def one(rate: str, multiplier: Column | float) -> Column:
        scale, spread = _fee_product(price, multiplier, rate)
        raw = scale * contracts.cast("decimal(12,4)") * spread
        return F.ceil(F.greatest(raw, raw * 0), F.lit(4)).cast("double")

    maker_side = maker if isinstance(maker, Column) else F.lit(maker)
    return F.when(maker_side, one(MAKER_FEE_RATE, maker_multiplier)).otherwise(one(TAKER_FEE_RATE, taker_multiplier))


def maker_fee_per_contract(price: Column, multiplier: Column | float = 0.0) -> Column:
    scale, spread = _fee_product(price, multiplier, MAKER_FEE_RATE)
    raw = scale * spread
    return F.greatest(raw, raw * 0).cast("double")


def half_up_cents(value: Column) -> Column:
    """Cents, half up, on the shortest decimal text of the double (as a trader reads it)."""
    return F.round(value.cast("string").cast("decimal(38,12)"), 2)


def mid_price(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2.0


def microprice(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    total = bid_size + ask_size
    return F.when(total > 0, (ask * bid_size + bid * ask_size) / total).otherwise(mid_price(bid, ask))


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    total = bid_size + ask_size
    return F.when(total > 0, (bid_size - ask_size) / total).otherwise(F.lit(0.0))


def basis_points(value: Column, base: Column) -> Column:
    return (value - base) / base * 10_000


def present(values: Column) -> Column:
    """Array without nulls."""
    return F.filter(values, lambda v: v.isNotNull())


def upper_median(values: Column) -> Column:
    """Element n//2 of the sorted values; null when empty."""
    ordered = F.array_sort(present(values))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def true_median(values: Column) -> Column:
    """Middle value, or the mean of the two middle values; null when empty."""
    ordered = F.array_sort(present(values))
    n = F.size(ordered)
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (upper + lower) / 2)


def dispersion_bps(values: Column, base: Column) -> Column:
    """Spread of two or more values in basis points of ``base``; null for fewer."""
    kept = present(values)
    return F.when(F.size(kept) > 1, (F.array_max(kept) - F.array_min(kept)) / base * 10_000)


def signed_markout(side: Column, price: Column, future_mid: Column) -> Column:
    return F.when(side == "bid", future_mid - price).otherwise(price - future_mid)


# Fixed value: a fill is toxic when its markout is at least one cent adverse.
TOXIC_MARKOUT = -0.01


def toxic_label(markout: Column) -> Column:
    return F.when(markout.isNotNull(), (markout <= TOXIC_MARKOUT).cast("double"))


def signed_by_aggressor(count: Column, taker_side: Column) -> Column:
    """Positive for a buying aggressor, negative for a selling one, null otherwise."""
    return F.when(taker_side == "bid", count).when(taker_side == "ask", -count)


def private_fill_delta(count: Column, book_side: Column, is_taker: Column, taker_side: Column, action: Column, side: Column) -> Column:
    """Change of the YES position by an own fill; null where the message cannot be read."""
    own_side = F.when(book_side.isin("bid", "ask"), book_side).when(is_taker, taker_side)
    sign_action = F.when(F.lower(action) == "buy", 1.0).when(F.lower(action) == "sell", -1.0)
    sign_side = F.when(F.lower(side) == "yes", 1.0).when(F.lower(side) == "no", -1.0)
    return F.when(
        count > 0,
        F.when(own_side == "bid", count).when(own_side == "ask", -count).otherwise(sign_action * sign_side * count),
    )


# Seconds-to-close buckets of the fitted models.
TIME_BUCKETS = ((90.0, 300.0), (300.0, 600.0), (600.0, 900.0))


def time_bucket(seconds_to_close: Column) -> Column:
    """Struct (lo, hi) of the model bucket; null outside all of them."""
    out = F.when(F.lit(False), F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")))
    for low, high in TIME_BUCKETS:
        inside = (seconds_to_close >= low) & (seconds_to_close < high)
        out = out.when(inside, F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")))
    return out

"""Binary and average-settlement pricing as Column expressions (no Python in the task)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody's rational Chebyshev approximation of erf/erfc (netlib calerf).
ERF_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
ERF_C = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
ERF_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
ERF_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
ERF_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)

# Acklam's inverse-normal coefficients.
ICDF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
ICDF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
ICDF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ICDF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
ICDF_LOW = 0.02425

FIXINGS = 60
SETTLEMENT_WINDOW_S = 60.0


def _c(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A Python variable holding a Column is pasted in at every use, so nested
    formulas would grow exponentially; a lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp(value: Column | float, low: Column | float, high: Column | float) -> Column:
    """Value held inside [low, high]; null stays null (greatest/least alone would skip it)."""
    return let(_c(value), lambda v: F.when(v.isNotNull(), F.greatest(_c(low), F.least(_c(high), v))))


def _upper_tail(y: Column, sq: Column) -> Column:
    """erfc(y)/2 for y >= 0, with sq = y*y."""
    numerator, denominator = F.lit(ERF_A[4]) * sq, sq
    for a, b in zip(ERF_A[:3], ERF_B[:3]):
        numerator, denominator = (numerator + a) * sq, (denominator + b) * sq
    small = F.lit(1.0) - y * (numerator + ERF_A[3]) / (denominator + ERF_B[3])

    numerator, denominator = F.lit(ERF_C[8]) * y, y
    for c, d in zip(ERF_C[:7], ERF_D[:7]):
        numerator, denominator = (numerator + c) * y, (denominator + d) * y
    middle = F.exp(-sq) * (numerator + ERF_C[7]) / (denominator + ERF_D[7])

    def far(inverse: Column) -> Column:
        numerator, denominator = F.lit(ERF_P[5]) * inverse, inverse
        for p, q in zip(ERF_P[:4], ERF_Q[:4]):
            numerator, denominator = (numerator + p) * inverse, (denominator + q) * inverse
        tail = inverse * (numerator + ERF_P[4]) / (denominator + ERF_Q[4])
        return F.exp(-sq) * (F.lit(1.0 / math.sqrt(math.pi)) - tail) / y

    return F.when(y <= 0.46875, small).when(y <= 4.0, middle).when(
        y < 27.0, let(F.lit(1.0) / sq, far)
    ).otherwise(F.lit(0.0)) / 2.0


def normal_cdf(x: Column | float) -> Column:
    """Standard normal CDF to double precision: erfc by three ranges of |x|/sqrt(2)."""

    def at(v: Column) -> Column:
        tail = let(F.abs(v) / math.sqrt(2.0), lambda y: let(y * y, lambda sq: _upper_tail(y, sq)))
        return let(tail, lambda mass: F.when(v > 0, F.lit(1.0) - mass).otherwise(mass))

    x = _c(x)
    return F.when(x.isNotNull(), let(x, at))


def inverse_normal_cdf(p: Column | float) -> Column:
    def tail(mass: Column) -> Column:
        return let(
            F.sqrt(F.lit(-2.0) * F.log(mass)), lambda q: _horner(ICDF_C, q) / _horner((*ICDF_D, 1.0), q)
        )

    def centre(q: Column) -> Column:
        return let(q * q, lambda r: _horner(ICDF_A, r) * q / _horner((*ICDF_B, 1.0), r))

    def at(v: Column) -> Column:
        return (
            F.when(v <= 0, F.lit(float("-inf")))
            .when(v >= 1, F.lit(float("inf")))
            .when(v < ICDF_LOW, tail(v))
            .when(v > 1.0 - ICDF_LOW, -tail(F.lit(1.0) - v))
            .otherwise(let(v - 0.5, centre))
        )

    p = _c(p)
    return F.when(p.isNotNull(), let(p, at))


def gbm_binary_price(
    s0: Column,
    spot: Column,
    sigma_per_s: Column,
    time_remaining_s: Column,
    drift_per_s: Column | float = 0.0,
    *,
    drift_gate_z: float = 0.08,
    drift_cap_z: float = 0.35,
    min_probability: float = 0.01,
    max_probability: float = 0.99,
) -> Column:
    """Struct (up, down, z, z_spot, z_drift): P(S_T > S0) for a geometric Brownian motion."""
    drift = _c(drift_per_s)
    expired = time_remaining_s <= 0
    usable = (s0 > 0) & (spot > 0) & (sigma_per_s > 0) & ~expired
    root = F.when(usable, F.sqrt(time_remaining_s))
    z_spot = F.when(usable, F.log(spot / s0) / (sigma_per_s * root))
    raw = F.when(usable, drift * root / sigma_per_s)
    z_drift = F.when(F.abs(raw) < drift_gate_z, F.lit(0.0)).otherwise(clamp(raw, -drift_cap_z, drift_cap_z))
    won = spot >= s0
    zero = F.lit(0.0)

    def price(parts: Column) -> Column:
        z = parts["spot"] + parts["drift"]
        up = (
            F.when(expired, won.cast("double"))
            .when(~usable, F.lit(0.5))
            .otherwise(clamp(normal_cdf(z), min_probability, max_probability))
        )
        z_out = (
            F.when(expired, F.when(won, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
            .when(~usable, zero)
            .otherwise(z)
        )
        return let(
            up,
            lambda u: F.struct(
                u.alias("up"),
                (F.lit(1.0) - u).alias("down"),
                z_out.alias("z"),
                F.coalesce(parts["spot"], zero).alias("z_spot"),
                F.coalesce(parts["drift"], zero).alias("z_drift"),
            ),
        )

    return let(F.struct(z_spot.alias("spot"), F.when(usable, z_drift).alias("drift")), price)


def implied_sigma(p_up: Column, s0: Column, spot: Column, time_remaining_s: Column, drift_per_s: Column | float = 0.0) -> Column:
    """Volatility that makes the binary price equal to ``p_up``; null where none exists."""
    drift = _c(drift_per_s)
    usable = (time_remaining_s > 0) & (s0 > 0) & (spot > 0)

    def solve(z: Column) -> Column:
        return F.when(
            usable & (F.abs(z) >= 1e-9),
            (F.log(spot / s0) + drift * time_remaining_s) / (z * F.sqrt(time_remaining_s)),
        )

    return let(let(inverse_normal_cdf(clamp(p_up, 0.01, 0.99)), solve), lambda sigma: F.when(sigma > 0, sigma))


def blend_sigma(realized: Column, implied: Column, implied_weight: Column | float, min_sigma: Column | float) -> Column:
    weight = clamp(implied_weight, 0.0, 1.0)
    mixed = (F.lit(1.0) - weight) * realized + weight * implied
    sigma = F.coalesce(mixed, realized, implied)
    return F.when(sigma.isNotNull(), F.greatest(_c(min_sigma), sigma))


def fixing_times(seconds_to_close: Column, remaining: Column, observed: Column, fixings: int = FIXINGS) -> Column:
    """Array of the seconds until each remaining settlement fixing."""
    interval = SETTLEMENT_WINDOW_S / fixings
    first = seconds_to_close - SETTLEMENT_WINDOW_S + interval
    ahead = F.transform(F.sequence(F.lit(0), remaining - 1), lambda i: first + F.lit(interval) * i)
    spacing = seconds_to_close / remaining
    inside = F.transform(F.sequence(F.lit(1), remaining), lambda i: spacing * i)
    return (
        F.when((remaining <= 0) | (seconds_to_close <= 0), F.array().cast("array<double>"))
        .when((observed == 0) & (seconds_to_close >= SETTLEMENT_WINDOW_S), ahead)
        .otherwise(inside)
    )


def average_moments(spot: Column, sigma_per_s: Column, times: Column, drift_per_s: Column | float = 0.0) -> Column:
    """Struct (mean, variance) of the arithmetic average of a geometric Brownian motion.

    ``times`` ascending.  Cov(S_i, S_j) depends on the earlier time only, so the
    double sum over pairs is one pass from the last fixing to the first with the
    suffix sum of means.
    """
    drift = _c(drift_per_s)
    n = F.size(times).cast("double")
    start = F.struct(F.lit(0.0).alias("suffix"), F.lit(0.0).alias("pairs"))

    def step(acc: Column, t: Column) -> Column:
        mean = spot * F.exp(drift * F.greatest(F.lit(0.0), t))
        return F.struct(
            (acc["suffix"] + mean).alias("suffix"),
            (acc["pairs"] + mean * (mean + F.lit(2.0) * acc["suffix"]) * F.expm1(sigma_per_s * sigma_per_s * t)).alias("pairs"),
        )

    def finish(acc: Column) -> Column:
        empty = n == 0
        return F.struct(
            F.when(empty, spot).otherwise(acc["suffix"] / n).alias("mean"),
            F.when(empty, F.lit(0.0)).otherwise(acc["pairs"] / (n * n)).alias("variance"),
        )

    return F.aggregate(F.reverse(times), start, step, finish)


def observed_from_array(values: Column, fixings: int = FIXINGS) -> tuple[Column, Column]:
    """(count, sum) of the positive observations, at most the last ``fixings``."""
    positive = F.filter(values, lambda v: v > 0)
    kept = F.when(F.size(positive) > fixings, F.slice(positive, F.lit(-fixings), F.lit(fixings))).otherwise(positive)
    return F.size(kept), F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v)


def settlement_moments(fixings: int = FIXINGS) -> Callable[..., Column]:
    """Arrow UDF (spot, sigma, seconds, observed count, drift) -> (mean, variance) of the open fixings.

    Same numbers as ``average_moments(fixing_times(...))``.  Folding sixty fixings
    per row with a lambda is interpreted element by element; a batch as one matrix
    is some hundred times faster.
    """

    @F.pandas_udf("mean double, variance double")
    def moments(spot: pd.Series, sigma: pd.Series, seconds: pd.Series, seen: pd.Series, drift: pd.Series) -> pd.DataFrame:
        s0, vol, left, count, mu = (x.to_numpy(dtype=float)[:, None] for x in (spot, sigma, seconds, seen, drift))
        n = fixings - count
        k = np.arange(1, fixings + 1)[None, :]
        interval = SETTLEMENT_WINDOW_S / fixings
        with np.errstate(all="ignore"):
            ahead = (count == 0) & (left >= SETTLEMENT_WINDOW_S)
            times = np.where(ahead, left - SETTLEMENT_WINDOW_S + interval * k, left / n * k)
            growth = np.where(k <= n, np.expm1(vol * vol * times), 0.0)
            # Per row, so that a row's price does not depend on what shares its batch.
            mean = s0[:, 0].copy()
            pairs = mean * mean * ((2.0 * (n - k) + 1.0) * growth).sum(axis=1)
            drifting = np.flatnonzero(mu[:, 0] != 0)
            if len(drifting):
                means = np.where(k <= n, s0 * np.exp(mu * np.maximum(0.0, times)), 0.0)[drifting]
                after = means.sum(axis=1, keepdims=True) - np.cumsum(means, axis=1)
                mean[drifting] = means.sum(axis=1) / n[drifting, 0]
                pairs[drifting] = (means * (means + 2.0 * after) * growth[drifting]).sum(axis=1)
            return pd.DataFrame({"mean": mean, "variance": pairs / (n[:, 0] ** 2)})

    return moments


def average_settlement_fair(
    strike: Column,
    spot: Column,
    sigma_per_s: Column,
    seconds_to_close: Column,
    observed_count: Column | int = 0,
    observed_sum: Column | float = 0.0,
    drift_per_s: Column | float = 0.0,
    *,
    fixings: int = FIXINGS,
    min_probability: float = 0.001,
    max_probability: float = 0.999,
) -> Column:
    """Fair value of "the final fixing average is at least the strike".

    Published fixings enter exactly; the average of the rest is matched to a
    lognormal by its first two moments.  Struct (yes, no, expected_average,
    average_std, observed_count, remaining_count).
    """
    seen = (observed_count if isinstance(observed_count, Column) else F.lit(observed_count)).cast("int")
    seen_sum = _c(observed_sum)
    remaining = F.lit(fixings) - seen
    done = (remaining == 0) | (seconds_to_close <= 0)

    settled_average = (seen_sum + remaining * spot) / fixings
    settled_yes = (settled_average >= strike).cast("double")

    required = fixings * strike - seen_sum

    def priced(moments: Column) -> Column:
        mean, variance = moments["mean"], moments["variance"]
        spread = F.log1p(F.greatest(F.lit(0.0), variance / (mean * mean)))

        def beyond(log_variance: Column) -> Column:
            z = (F.log(required / remaining) - (F.log(mean) - 0.5 * log_variance)) / F.sqrt(log_variance)
            return (
                F.when(required <= 0, F.lit(1.0))
                .when(
                    (variance <= 0) | (mean <= 0) | (log_variance <= 0),
                    (remaining * mean >= required).cast("double"),
                )
                .otherwise(F.lit(1.0) - normal_cdf(z))
            )

        return F.struct(
            clamp(let(spread, beyond), min_probability, max_probability).alias("yes"),
            ((seen_sum + remaining * mean) / fixings).alias("average"),
            (F.sqrt(F.greatest(F.lit(0.0), variance)) * remaining / fixings).alias("std"),
        )

    moments_of = settlement_moments(fixings)
    inputs = [c.cast("double") for c in (spot, sigma_per_s, seconds_to_close, seen, _c(drift_per_s))]
    still_open = let(moments_of(*inputs), priced)
    known = strike.isNotNull() & spot.isNotNull() & sigma_per_s.isNotNull() & seconds_to_close.isNotNull()
    settled = F.struct(settled_yes.alias("yes"), settled_average.alias("average"), F.lit(0.0).alias("std"))
    return let(
        F.when(known & done, settled).when(known, still_open),
        lambda r: F.struct(
            r["yes"].alias("yes"),
            (F.lit(1.0) - r["yes"]).alias("no"),
            r["average"].alias("expected_average"),
            r["std"].alias("average_std"),
            seen.alias("observed_count"),
            remaining.alias("remaining_count"),
        ),
    )


def moneyness_z(spot: Column, strike: Column, sigma_per_s: Column, seconds_to_close: Column) -> Column:
    denominator = sigma_per_s * F.sqrt(F.greatest(F.lit(1e-9), seconds_to_close))
    return F.when(denominator > 0, F.log(spot / strike) / denominator)

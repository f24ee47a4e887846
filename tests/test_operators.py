import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.asof import asof_join
from tickloom.functions.quoting import KEY_SCALE
from tickloom.operators.book import sweep
from tickloom.operators.bootstrap import PRIME, bootstrap_ci, bootstrap_draws, thinning
from tickloom.operators.flow import rolling
from tickloom.operators.linear import fit_logistic, fit_ridge
from tickloom.operators.quality import consecutive, sustained
from tickloom.operators.sampling import forced_sample, greedy_reference, greedy_sample
from tickloom.operators.slices import reflected_running_sum, running
from tickloom.operators.volatility import HORIZON_WEIGHTS, multi_horizon_forecast
from tickloom.plans.reports import regime_filter


@pytest.fixture(scope="module")
def rows(spark):
    """A hot key with many ties and a small one."""
    rnd = random.Random(1)
    data = [
        (k, rnd.randrange(0, 2000), i, rnd.randrange(-5, 6), rnd.choice([None, 1, 2, 3]))
        for k, n in (("a", 300), ("b", 40)) for i in range(n)
    ]
    pdf = pd.DataFrame(data, columns=["k", "t", "seq", "v", "n"]).sort_values(["k", "t", "seq"]).reset_index(drop=True)
    return spark.createDataFrame(data, "k string, t long, seq long, v long, n long"), pdf


def ordered(df):
    return df.orderBy("k", "t", "seq").toPandas()


def same(got, want):
    np.testing.assert_allclose(pd.to_numeric(got).to_numpy(float), pd.to_numeric(want).to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("width", [100, 5000])
def test_running_equals_whole_key_scan(rows, width):
    df, p = rows
    v, n = F.col("v"), F.col("n")
    got = ordered(running(df, ["k"], "t", "seq", width, {"s": ("sum", v), "mx": ("max", v), "la": ("last", n), "be": ("before", n), "lg": ("lag", n), "ld": ("lead", v), "nx": ("next", n), "af": ("after", n)}))
    g = p.groupby("k")
    same(got.s, g.v.cumsum())
    same(got.mx, g.v.cummax())
    same(got.la, g.n.ffill())
    same(got.be, p.assign(f=g.n.ffill()).groupby("k").f.shift())
    same(got.lg, g.n.shift())
    same(got.ld, g.v.shift(-1))
    same(got.nx, g.n.bfill())
    same(got.af, p.assign(f=g.n.bfill()).groupby("k").f.shift(-1))


def test_reflected_sum_equals_floor_loop(rows):
    df, p = rows
    want = []
    for _, g in p.groupby("k"):
        x = 0
        for v in g.v:
            x = max(0, x + v)
            want.append(x)
    same(ordered(reflected_running_sum(df, ["k"], "t", "seq", 100, "v", "z")).z, pd.Series(want))


def test_greedy_sample_equals_loop_across_slices(rows):
    df, p = rows
    for interval, width in ((37, 100), (37, 37), (250, 400)):
        got = greedy_sample(df, ["k"], "t", "seq", interval, width).toPandas()
        for k, g in p.groupby("k"):
            mine = got[got.k == k].sort_values("t")
            assert mine.t.tolist() == greedy_reference(g.t, interval)
            # Of equal times the first in order is kept, with its nulls intact.
            first = g.drop_duplicates("t").set_index("t").loc[mine.t]
            assert mine.seq.tolist() == first.seq.tolist()
            same(mine.n, first.n)


def test_rolling_counts_ties_in_order(rows):
    df, p = rows
    got = ordered(rolling(df, ["k"], "t", "seq", 100, {"f": (F.col("v"), 50)}))
    want = [
        sum(y.v for y in g.itertuples() if (y.t, y.seq) <= (x.t, x.seq) and y.t >= x.t - 50)
        for _, g in p.groupby("k") for x in g.itertuples()
    ]
    same(got.f, pd.Series(want))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 150])
def test_asof_join(rows, direction, strict, tolerance):
    df, p = rows
    got = asof_join(
        df.filter("seq % 3 = 0"), df.filter("seq % 3 <> 0"), ["k"], "t", "t", width=100, direction=direction, strict=strict,
        tolerance=tolerance, right_seq="seq", right_columns=["seq", "t"],
    ).toPandas()
    for x in got.itertuples():
        r = p[(p.k == x.k) & (p.seq % 3 != 0)]
        gap = x.t - r.t if direction == "backward" else r.t - x.t
        r = r[(gap > 0) if strict else (gap >= 0)]
        r = r[(x.t - r.t).abs() <= tolerance] if tolerance is not None else r
        want = None if r.empty else r.iloc[-1 if direction == "backward" else 0].seq
        assert (None if x.matched is None else x.matched["seq"]) == want


def test_sustained_and_consecutive(spark):
    on = [0, 1, 1, 1, 0, 1, 1]
    df = spark.createDataFrame([("a", i * 10, i, bool(x)) for i, x in enumerate(on)], "k string, t long, seq long, c boolean")
    held = ordered(sustained(df, ["k"], "t", "seq", F.col("c"), 20, 15))
    assert held.sustained.tolist() == [False, False, False, True, False, False, False]
    assert ordered(consecutive(df, ["k"], "t", "seq", F.col("c"), 15)).streak.tolist() == [0, 1, 2, 3, 0, 1, 2]


def test_bootstrap_chunks_cover_all_windows(spark):
    values = spark.createDataFrame([(i, float(i)) for i in range(100)], "w long, x double")
    low, high = bootstrap_ci(values, [], "x", "w", draws=300).select("low", "high").first()
    assert 35 < low < 49.5 < high < 64
    means = {c: bootstrap_draws(values, [], "x", "w", draws=300, chunk=c).orderBy("draw").toPandas()["mean"].to_numpy() for c in (7, 16, 1000)}
    np.testing.assert_allclose(means[7], means[16])
    np.testing.assert_allclose(means[7], means[1000])
    assert abs(means[16].mean() - 49.5) < 1.5 and 2.0 < means[16].std() < 4.0
    # More windows than the picks made one by one: the counts carry most of a draw.
    many = bootstrap_draws(spark.range(20_000).selectExpr("id AS w", "CAST(id % 100 AS DOUBLE) AS x"), [], "x", "w", draws=400, chunk=3000).toPandas()["mean"]
    assert abs(many.mean() - 49.5) < 0.05 and 0.85 < many.std() / (28.87 / np.sqrt(20_000)) < 1.15


def test_bootstrap_limits_are_poisson_steps():
    limits = thinning(10_000)
    mean = 1 - 8 / 100
    assert limits[0] == pytest.approx(PRIME * np.exp(-mean), abs=2) and limits[1] == pytest.approx(PRIME * np.exp(-mean) * (1 + mean), abs=2)
    assert thinning(50)[0] == PRIME and sorted(limits) == limits


def looped_volatility(ticks):
    """One tick after the other over the whole history, as the rule is stated."""
    seconds, out = [], []
    for ms, price in ticks:
        sec = ms // 1000
        if price > 0 and seconds and seconds[-1][0] == sec:
            seconds[-1] = (sec, price)
        elif price > 0 and (not seconds or sec > seconds[-1][0]):
            seconds.append((sec, price))
        else:
            continue
        while seconds[0][0] * 1000 < ms - 3_600_000:
            seconds.pop(0)
        returns = [(b[0], np.log(b[1] / a[1]) / np.sqrt(b[0] - a[0])) for a, b in zip(seconds, seconds[1:])]
        if len(returns) < 3:
            out.append(None)
            continue
        variance = returns[0][1] ** 2
        for _, r in returns[1:]:
            variance = 0.5 ** (1 / 60) * variance + (1 - 0.5 ** (1 / 60)) * r * r
        sigmas = {}
        for h in (10, 60, 300, 1800):
            inside = [r for s, r in returns if s > returns[-1][0] - h]
            sigmas[h] = np.sqrt(sum(r * r for r in inside) / len(inside)) if len(inside) >= 3 else None
        known = {h: s for h, s in sigmas.items() if s is not None}
        if not known:
            out.append(None)
            continue
        blended = sum(HORIZON_WEIGHTS[h] * s for h, s in known.items()) / sum(HORIZON_WEIGHTS[h] for h in known)
        sizes = sorted(abs(r) for _, r in returns)
        cutoff, total = max(5 * sizes[len(sizes) // 2], 1e-12), sum(a * a for a in sizes)
        jump = sum(a * a for a in sizes if a > cutoff) / total if total > 0 else 0.0
        out.append((max(1e-6, 0.5 * np.sqrt(variance) + 0.5 * blended), np.sqrt(variance), *(sigmas[h] for h in (10, 60, 300, 1800)), jump))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_volatility_over_more_than_its_history(spark, seed):
    r = np.random.default_rng(seed)
    ms, price, rows = 7_199_000_000, 100.0, []
    for i in range(2500):
        ms += int(r.choice([0, 300, 1000, 1700, 9000, 400_000], p=[0.1, 0.3, 0.25, 0.1, 0.248, 0.002]))
        price *= 1 + r.normal() * 1e-4 * (20 if r.random() < 0.03 else 1) * (r.random() > 0.1)
        rows.append(("a", ms, i, ms - int(r.choice([0, 0, 0, 2500])), float(price) if r.random() > 0.02 else -1.0))
    assert rows[-1][1] - rows[0][1] > 5_400_000
    df = spark.createDataFrame(rows, "k string, t long, seq long, tick_ms long, price double")
    got = {x.seq: x.vol for x in multi_horizon_forecast(df, ["k"], "t", "seq", "tick_ms", "price", width=60_000).collect()}
    want, at = looped_volatility([(x[3], x[4]) for x in rows]), 0
    # The loop answers for kept ticks only, in order.
    assert len(got) == len(want)
    for seq, expected in zip(sorted(got), want):
        vol = got[seq]
        assert (vol is None) == (expected is None)
        if expected is not None:
            np.testing.assert_allclose([np.nan if v is None else v for v in vol], [np.nan if v is None else v for v in expected], rtol=1e-8, atol=1e-15)


def test_forced_sample_does_not_depend_on_slices(spark):
    r = random.Random(3)
    t, rows = 0, []
    for i in range(400):
        t += r.choice([0, 1, 40, 90, 300])
        rows.append((r.choice("ab"), t, i, r.random() < 0.1))
    df = spark.createDataFrame(rows, "k string, t long, seq long, must boolean")
    want = []
    last = {}
    for k, now, i, must in rows:
        if must or k not in last or now - last[k] >= 250:
            last[k] = now
            want.append(i)
    for width in (250, 1000, 100_000):
        assert sorted(x.seq for x in forced_sample(df, ["k"], "t", "seq", 250, width, F.col("must")).collect()) == want


def test_best_levels_of_a_sweep():
    r = random.Random(5)
    kinds, snaps, sides, keys, sizes, want, book = [], [], [], [], [], [], {"bid": {}, "ask": {}}
    for side in ("bid", "ask"):
        for key in (5, 6, 7) if side == "bid" else (9, 10):
            kinds, snaps, sides, keys, sizes = kinds + [0], snaps + [None], sides + [side], keys + [key], sizes + [float(key)]
            book[side][key] = float(key)
    for _ in range(300):
        snap = r.random() < 0.05
        kinds, snaps, sides, keys, sizes = kinds + [1], snaps + [snap], sides + [None], keys + [None], sizes + [None]
        if snap:
            book = {"bid": {}, "ask": {}}
        for _ in range(r.randint(0, 3)):
            side, key, size = r.choice(["bid", "ask"]), r.randint(1, 8), r.choice([0.0, 1.5, 4.0])
            kinds, snaps, sides, keys, sizes = kinds + [2], snaps + [None], sides + [side], keys + [key], sizes + [size]
            book[side][key] = size
        live = {s: sorted(((k, v) for k, v in book[s].items() if v > 0), reverse=s == "bid") for s in book}
        want.append(tuple(x for s in ("bid", "ask") for x in ((live[s][0][0] / KEY_SCALE, live[s][0][1], sum(v for _, v in live[s][:3])) if live[s] else (None, 0.0, 0.0))))
    at, got = sweep(kinds, snaps, sides, keys, sizes, 3)
    assert got == want and [kinds[i] for i in at] == [1] * 300


def test_ridge_and_logistic_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 3)) * [1.0, 5.0, 0.1] + [0.0, 100.0, 3.0]
    z = (x - x.mean(0)) / x.std(0)
    y = z @ [0.5, -1.0, 0.2] + rng.normal(size=800)
    label = (rng.random(800) < 1 / (1 + np.exp(-(z @ [1.0, 0.5, -0.7] - 0.3)))).astype(float)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, label=label, g="all")
    df = spark.createDataFrame(pdf)
    ridge = fit_ridge(df, "g", ["a", "b", "c"], "y", min_rows=10)["all"]
    np.testing.assert_allclose(ridge["coefs"], np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())), rtol=1e-9)
    design, w = np.hstack([np.ones((800, 1)), z]), np.zeros(4)
    penalty = np.diag([0.0, 1.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w = w - np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (p - label) + penalty @ w)
    fit = fit_logistic(df, "g", ["a", "b", "c"], "label", min_rows=10)["all"]
    np.testing.assert_allclose([fit["intercept"], *fit["coefs"]], w, rtol=1e-7)


def test_bootstrap_picks_are_not_broadcast(spark):
    values = spark.range(500).selectExpr("id AS w", "CAST(id % 7 AS DOUBLE) AS x")
    plan = bootstrap_draws(values, [], "x", "w", draws=50)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_regime_filter_against_a_loop(spark):
    r = random.Random(11)
    rows = [(i, r.choice("ab"), r.choice([r.randrange(-50, 400), 7]), r.choice([None, r.uniform(-9, 9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, k string, t long, x double")
    out = regime_filter(df, ["k"], "t", "x", 60, 0.5, 500)
    assert "RangeFrame, -60" not in out._jdf.queryExecution().executedPlan().toString()
    got = {g.i: g for g in out.collect()}
    assert len(got) == len(rows)
    for i, k, t, _ in rows:
        held = [x for _, k2, t2, x in rows if k2 == k and t - 60 <= t2 < t and x is not None]
        mean = sum(held) / len(held) if held else None
        assert got[i].windows_seen == len(held) and got[i].stand_down == (mean is not None and mean < 0.5)
        assert got[i].trailing is None if mean is None else abs(got[i].trailing - mean) < 1e-9


def test_rolling_frames_share_their_scans(spark):
    rows = [("a", t, i, float(i % 3), f"n{i}") for i, t in enumerate([0, 5, 5, 40, 99, 100, 101, 160, 160, 205])]
    df = spark.createDataFrame(rows, "k string, t long, seq long, v double, name string")
    got = rolling(df, ["k"], "t", "seq", 100, {"f": (F.col("v"), 50), "g": (F.col("v"), 5), "n": (F.col("name").isNotNull().cast("int"), 100)})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 3, plan
    assert got.columns == ["k", "t", "seq", "v", "name", "f", "g", "n"]
    for r in got.collect():
        before = [x for x in rows if (x[1], x[2]) <= (r.t, r.seq)]
        want = [sum(x[3] for x in before if x[1] >= r.t - span) for span in (50, 5)]
        assert [r.f, r.g, r.n] == [*want, sum(x[1] >= r.t - 100 for x in before)], r

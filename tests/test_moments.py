"""Windows by doubling against plain windows in numpy."""

import math
import random

import numpy as np
import pytest

from eraflow.functions import moments
from eraflow.functions.rolling import HORIZONS, STAT_WINDOWS


def series(holes, n=700, seed=3):
    rng = random.Random(seed)
    out = [math.exp(rng.gauss(3, 0.2)) for _ in range(n)]
    out[200] = 1e9  # one spike: nothing of it may stay once it has left a window
    if holes:
        for k in rng.sample(range(n), 60):
            out[k] = None
    return out


def frame(spark, values, name="x"):
    rows = [(t, d, v) for t in ("a", "b") for d, v in enumerate(values if t == "a" else values[:40])]
    return spark.createDataFrame(rows, f"ticker string, date int, {name} double").repartition(3)


def close(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("holes", [False, True])
@pytest.mark.parametrize("windows", [tuple(STAT_WINDOWS), (3, 7, 64, 150)])
def test_rolling_stats_against_numpy(spark, holes, windows):
    values = series(holes)
    got = {r.date: r for r in moments.add_rolling_stats(frame(spark, values), ["x"], windows).where("ticker = 'a'").collect()}
    bare = {r.date: r for r in moments.add_rolling_stats(frame(spark, values), ["x"], windows, median=False).where("ticker = 'a'").collect()}
    for d in range(len(values)):
        for n in windows:
            own = [v for v in values[max(0, d - n + 1) : d + 1] if v is not None]
            enough = len(own) >= max(1, n // 2)
            want = {"mean": np.mean, "std": lambda v: np.std(v, ddof=1), "min": min, "max": max, "median": np.median}
            for kind, fn in want.items():
                w = float(fn(own)) if enough and not (kind == "std" and len(own) < 2) else None
                assert close(got[d][f"x_{kind}_{n}"], w), (d, n, kind)
                assert kind == "median" or close(bare[d][f"x_{kind}_{n}"], w)


def change(v):
    out = [None] * len(v)
    for k in range(1, len(v)):
        if v[k] is not None and v[k - 1] not in (None, 0):
            out[k] = v[k] / v[k - 1] - 1
    return out


@pytest.mark.parametrize("holes", [False, True])
def test_horizons_against_numpy(spark, holes):
    values = series(holes)
    d1 = change([None if v is None else math.log1p(v) for v in values])
    d2 = change(d1)
    horizons = [1, 4, 7, 57, 100, 300]
    rows = moments.horizons_long(frame(spark, values), ["x"], horizons, second=True).where("ticker = 'a'").selectExpr("date", "inline(packs)").collect()
    assert len(rows) == len(values) * len(horizons)
    for r in rows:
        n, at = r.horizon, r.date
        before = values[at - n] if at >= n else None
        ret = values[at] / before - 1 if None not in (values[at], before) else None
        assert close(r.ret, ret) and close(r.ret_abs, None if ret is None else abs(ret))
        for got, d in ((r.vol, d1), (r.vol2, d2)):
            own = d[max(0, at - n + 1) : at + 1]
            full = len(own) == n and None not in own and n > 1
            assert close(got, float(np.std(own, ddof=1)) if full else None), (at, n)
        own = values[max(0, at - n + 1) : at + 1]
        assert close(r.gap, values[at] / float(np.mean(own)) if len(own) == n and None not in own else None)


def test_pieces_and_chain():
    for n in (*HORIZONS, 1, 2, 255, 256):
        assert sum(1 << k for k, _ in moments.pieces(n)) == n
        assert [o for _, o in moments.pieces(n)] == [sum(1 << k for k, _ in moments.pieces(n)[:i]) for i in range(len(moments.pieces(n)))]
    for windows in ((5, 10, 20), (7, 14, 30), (200,), (1, 3), tuple(STAT_WINDOWS)):
        start, steps = moments.chain(windows)
        known = {start}
        for n, a, b in steps:
            assert {a, b} <= known and a + b == n
            known.add(n)
        assert set(windows) <= known


def test_one_shuffle_and_no_python(spark):
    for df in (moments.horizons_long(frame(spark, series(False)), ["x"]), moments.add_rolling_stats(frame(spark, series(False)), ["x"])):
        plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
        assert plan.count("Exchange hashpartitioning") == 1


def test_zero_means_and_empty(spark):
    flat = moments.horizons_long(frame(spark, [1.0, -1.0, 1.0, -1.0, 1.0]), ["x"], [2, 3]).where("ticker = 'a' and date = 4").selectExpr("inline(packs)").collect()
    assert [r.gap for r in flat] == [None, pytest.approx(3.0)]
    assert moments.add_rolling_stats(frame(spark, []), ["x"]).count() == 0

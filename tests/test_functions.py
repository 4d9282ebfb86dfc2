"""Semantics rules on tiny fixtures, pandas as the independent check."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eraflow.functions import calendar as cal
from eraflow.functions import ewm, grouped, rolling
from eraflow.functions import indicators as ind
from eraflow.functions.safe import div, finite, null_power, power, sqrt
from eraflow.operators import clean

W = rolling.Series("k", "t")


def frame(spark, values, key=1):
    rows = [(key, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k int, t int, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("k", "t").collect()]


def noisy(n, keys=3, holes=()):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(keys):
        x = 100 + np.cumsum(rng.normal(size=n))
        rows += [(k, i, None if (k == 1 and i in holes) else float(x[i])) for i in range(n)]
    return rows


def test_ema_forms(spark):
    df = frame(spark, [1, 2, 3])
    out = ewm.add_ewm(df, [ewm.Ewm("r", "x", 0.5, adjust=False), ewm.Ewm("n", "x", 0.5)], W)
    assert column(out, "r") == pytest.approx([1, 1.5, 2.25])
    assert column(out, "n") == pytest.approx([1, 5 / 3, 17 / 7])


def test_ema_blocks_match_pandas(spark):
    rows = noisy(1500, holes=(0, 1, 50, 51, 700))
    df = spark.createDataFrame(rows, "k int, t int, x double")
    pdf = pd.DataFrame(rows, columns=["k", "t", "x"])
    specs = [ewm.by_span("s2", "x", 2), ewm.by_span("s25", "x", 25), ewm.by_span("s200", "x", 200), ewm.wilder("w14", "x", 14)]
    a = ewm.add_ewm(df, specs, W).orderBy("k", "t").toPandas()
    args = {"s2": {"span": 2}, "s25": {"span": 25}, "s200": {"span": 200}, "w14": {"com": 13, "min_periods": 14}}
    for name, kw in args.items():
        want = pdf.groupby("k").x.transform(lambda s, kw=kw: s.ewm(**kw).mean()).to_numpy()
        np.testing.assert_allclose(a[name], want, rtol=1e-10)


def test_block_length_keeps_two_blocks_exact():
    for span in (2, 3, 9, 26, 200, 5000):
        a = 2 / (span + 1)
        n = ewm.block_length(a)
        assert (1 - a) ** n < 1e-19
        assert n * -math.log(1 - a) < 650


def test_flat_series(spark):
    df = frame(spark, [5.0] * 30).selectExpr("*", "x AS open", "x AS high", "x AS low", "x AS close", "10D AS volume")
    assert set(column(ind.add_rsi_simple(df, "x", [7], W), "rsi_7")) == {100.0}
    assert set(column(ind.add_stochastic(df, [7], [3], W), "stoch_k_7")) == {50.0}
    assert set(column(ewm.add_rsi_wilder(df, "x", [7], w=W), "rsi_7")) == {None}
    roc = df.selectExpr("k", "t", *[f"{e} AS {n}" for n, e in ind.roc("x", [5], W).items()])
    assert set(column(roc, "roc_5")) == {0.0}
    pack = rolling.horizon_pack(df.select("k", "t", "x"), ["x"], [4], W)
    assert set(column(pack, "x_volatility_4")[5:]) == {0.0}


def test_packs_agree(spark):
    df = spark.createDataFrame(noisy(400, holes=(0, 5, 6, 200)), "k int, t int, x double")
    for second in (False, True):
        a = rolling.horizon_pack(df, ["x"], [4, 20, 300], W, second_order=second).orderBy("k", "t").toPandas()
        b = grouped.horizon_pack(df, ["x"], [4, 20, 300], W, second_order=second).orderBy("k", "t").toPandas()
        pd.testing.assert_frame_equal(a, b, rtol=1e-7, atol=1e-9)


def test_pack_matches_pandas(spark):
    rows = noisy(200, keys=1)
    out = grouped.horizon_pack(spark.createDataFrame(rows, "k int, t int, x double"), ["x"], [5, 60], W).orderBy("t").toPandas()
    s = pd.DataFrame(rows, columns=["k", "t", "x"]).x
    for n in (5, 60):
        np.testing.assert_allclose(out[f"x_return_{n}"], s.pct_change(n), rtol=1e-9)
        np.testing.assert_allclose(out[f"x_volatility_{n}"], np.log1p(s).pct_change().rolling(n).std(), rtol=1e-7)
        np.testing.assert_allclose(out[f"x_gap_{n}"], s / s.rolling(n).mean(), rtol=1e-9)


def test_rsi_wilder_first_value(spark):
    out = ewm.add_rsi_wilder(frame(spark, [1, 2, 3, 4, 3]), "x", [3], w=W)
    assert column(out, "rsi_3")[:3] == [None, None, None]
    assert column(out, "rsi_3")[3] == 100.0


def test_adjusted_moments(spark):
    df = frame(spark, [1, 2, 4, 9])
    skew = df.selectExpr("k", "t", f"{ind.history_skew('x', False, W)} AS s")
    assert column(skew, "s")[0] == pytest.approx(pd.Series([1, 2, 4, 9]).skew())
    bar = spark.createDataFrame([(1.0, 2.0, 4.0, 9.0)], "open double, high double, low double, close double")
    row = ind.add_bar_moments(bar).first()
    assert row.bar_kurtosis == pytest.approx(1.5, abs=0.01)
    assert row.bar_median == 3.0


def test_zero_division(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 0D), (0D, 0D), (NULL, 1D) t(a, b)")
    assert [r.q for r in df.selectExpr(f"{div('a', 'b', 0.5)} AS q").collect()] == [0.5] * 3
    assert [r.q for r in df.selectExpr(f"{div('a', 'b')} AS q").collect()] == [None] * 3
    odd = spark.sql("SELECT double('NaN') x UNION ALL SELECT double('inf') UNION ALL SELECT -4D")
    assert sorted((r.f for r in odd.selectExpr(f"{finite('x')} AS f").collect()), key=str) == [-4.0, None, None]
    one = spark.sql("SELECT -4D AS x")
    assert one.selectExpr(f"{sqrt('x')} AS a", f"{power('x', 0.5)} AS b", f"{null_power('x', 2)} AS c").first() == (None, None, 16.0)


def test_week_key(spark):
    days = ["2024-01-01", "2024-01-05", "2024-01-20", "2024-01-27"]
    df = spark.createDataFrame([(1, dt.date.fromisoformat(d), float(i)) for i, d in enumerate(days)], "ticker int, date date, x double")
    weeks = [str(r.w) for r in df.selectExpr("date", f"{cal.week_end()} AS w").orderBy("date").collect()]
    assert weeks == ["2024-01-05", "2024-01-05", "2024-01-26", "2024-02-02"]
    dense = cal.weekly_last(df, ["x"], dense=True).orderBy("week_end").collect()
    assert [(str(r.week_end), r.x) for r in dense] == [
        ("2024-01-05", 1.0), ("2024-01-12", None), ("2024-01-19", None), ("2024-01-26", 2.0), ("2024-02-02", 3.0)
    ]
    friday = df.selectExpr(f"{cal.recent_friday('date')} AS f").where("f > DATE'2024-01-27'")
    assert friday.isEmpty()


def test_fill_order(spark):
    df = frame(spark, [None, 1, None, 2, None])
    both = df.selectExpr("k", "t", f"{rolling.filled('x', W, causal=False)} AS f", f"{rolling.filled('x', W)} AS c")
    assert column(both, "f") == [1, 1, 1, 2, 2]
    assert column(both, "c") == [None, 1, 1, 2, 2]


def test_causal_features_do_not_leak(spark):
    rows = noisy(120, keys=2)
    full = spark.createDataFrame(rows, "k int, t int, x double")
    cut = full.where("t < 100")

    def features(df):
        e = {"r": rolling.pct_change("x", 5, W), "m": rolling.roll_mean("x", 20, W), "z": ind.history_zscore("x", w=W)}
        wide = ewm.add_ewm(df.selectExpr("*", *[f"{v} AS {n}" for n, v in e.items()]), [ewm.by_span("e", "x", 9)], W)
        return wide.where("t < 100").orderBy("k", "t").toPandas()

    pd.testing.assert_frame_equal(features(full), features(cut))


def test_lags_long_equals_wide(spark):
    df = spark.createDataFrame(noisy(50), "k int, t int, x double").withColumn("y", F.expr("x * 2"))
    long = rolling.lags_long(df, ["x", "y"], [1, 3], W).where("feature = 'y'").orderBy("k", "t").toPandas()
    wide = df.selectExpr("k", "t", *[f"{e} AS {n}" for n, e in rolling.lags(["y"], [1, 3], W).items()]).orderBy("k", "t").toPandas()
    np.testing.assert_allclose(long["lag_3"], wide["y_lag_3"])


def test_probes_are_stable(spark):
    df = spark.range(2000)
    e = [f"{v} AS {n}" for n, v in clean.probe_columns(["id"]).items()]
    a = df.repartition(1).selectExpr("id", *e).orderBy("id").toPandas()
    b = df.repartition(16).selectExpr("id", *e).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert abs(a.random_uniform.mean() - 0.5) < 0.05 and abs(a.random_normal.std() - 1) < 0.1
    assert set(a.random_category) == {0, 1, 2, 3}


def test_suffix_country(spark):
    df = spark.createDataFrame([("ABC US",), ("X LN",), ("Q ZZ",)], "t string")
    assert [r.c for r in df.selectExpr(f"{clean.suffix_country('t')} AS c").collect()] == ["US", "GB", None]
    assert len(clean.SUFFIX_COUNTRY) == 49
    assert len(rolling.HORIZONS) == 84 and len(rolling.LAG_STEPS) == 28


def test_more_means_never_change_one(spark):
    df = frame(spark, [1, 2, 5, None, None, 6, 3, None, 8])
    one = [ewm.by_span("m", "x", 5)]
    more = one + [ewm.by_span(f"m{n}", "x", n) for n in range(2, 22)]
    alone, among = column(ewm.add_ewm(df, one, W), "m"), column(ewm.add_ewm(df, more, W), "m")
    want = pd.Series([1, 2, 5, None, None, 6, 3, None, 8], dtype=float).ewm(span=5).mean()
    np.testing.assert_allclose(np.array(alone, float), want, rtol=1e-12)
    np.testing.assert_allclose(np.array(among, float), want, rtol=1e-12)


def test_recursive_mean_refuses_holes(spark):
    lead = frame(spark, [None, None, 1, 2, 5])
    got = column(ewm.add_ewm(lead, [ewm.by_span("m", "x", 5, adjust=False)], W), "m")
    assert got[:2] == [None, None]
    np.testing.assert_allclose(got[2:], pd.Series([1.0, 2, 5]).ewm(span=5, adjust=False).mean())
    holed = ewm.add_ewm(frame(spark, [1, 2, None, 5]), [ewm.by_span("m", "x", 5, adjust=False)], W)
    with pytest.raises(Exception, match="has a hole"):
        holed.collect()


def test_volatility_after_one_large_change(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([[1e-7, 1.0, 1e-6], 1 + np.cumsum(rng.normal(size=400)) * 1e-4])
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, t int, x double")
    want = np.log1p(pd.Series(x)).pct_change().rolling(20).apply(lambda v: np.std(v, ddof=1), raw=True)
    for form in (rolling, grouped):
        got = form.horizon_pack(df, ["x"], [20], W).orderBy("t").toPandas()["x_volatility_20"]
        np.testing.assert_allclose(got, want, rtol=1e-6)

"""Packs computed in one pass over a series: values against pandas and the Window forms, plans without wide sorts."""

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from eraflow import plans
from eraflow.functions import moments, packs
from eraflow.functions.rolling import Series
from eraflow.operators import cross, portfolio

SF = "/root/testdata/sf0.001"
W = Series("k", "t")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def walk(n=420, holes=(), seed=5):
    x = 50 + np.cumsum(np.random.default_rng(seed).normal(size=n))
    return [None if i in holes else float(v) for i, v in enumerate(x)]


def frame(spark, values):
    rows = [(k, t, v) for k in (1, None) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "k int, t int, x double").repartition(3)


def made(df, *names):
    pdf = df.where("k IS NULL").orderBy("t").toPandas()
    return [pdf[n].to_numpy(float) for n in names]


@pytest.mark.parametrize("name", ["rsi_wilder", "ema_normalised", "wilder_mean", "macd_abs", "macd_pct", "money_pack", "atr", "return_space_pack"])
def test_weighted_means_sort_thin_rows_once(spark, name):
    """Block sums sorted rows that grew with every mean, once a block length and stage: the spill at size."""
    text = executed(plans.QUERIES[name](spark, SF))
    assert text.count("FlatMapGroupsInArrow") == 1 and text.count("Sort [") <= 2 and "RangeFrame" not in text


@pytest.mark.parametrize("name", ["rolling_median", "sma", "monthly_pack", "price_horizons", "lags", "pct_changes"])
def test_sliding_frames_left_the_plan(spark, name):
    text = executed(plans.QUERIES[name](spark, SF))
    assert "Window" not in text and "Generate" not in text


@pytest.mark.parametrize("name", ["features_trend", "features_spread", "features_strength"])
def test_slices_write_and_join_nothing(spark, name):
    text = executed(plans.QUERIES[name](spark, SF))
    assert "Join" not in text and "Exchange" not in text and text.count("Scan parquet") == 1


def test_terms_are_summed_before_any_shuffle(spark):
    text = executed(plans.QUERIES["poly_terms_full"](spark, SF))
    assert "Generate" not in text and "HashAggregate(keys=[ticker#" not in text.split("FlatMapGroupsInArrow")[0]


def test_rsi_and_macd_against_pandas(spark):
    values = walk()
    s = pd.Series(values)
    got = made(packs.add_packs(frame(spark, values), [packs.rsi_wilder("x", [14]), packs.macd("x", [(12, 26, 9)], True)], W), "rsi_14", "macd_12_26", "macd_signal_12_26_9")
    change = s.diff()
    gain, loss = (c.where(change.notna()).ewm(alpha=1 / 14, min_periods=14).mean() for c in (change.clip(lower=0), -change.clip(upper=0)))
    line = 100 * (s.ewm(span=12).mean() - s.ewm(span=26).mean()) / s.ewm(span=26).mean()
    for a, b in zip(got, (100 * gain / (gain + loss), line, line.ewm(span=9).mean()), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9)


def test_windows_with_holes_against_pandas(spark):
    values = walk(holes=(0, 3, 4, 100))
    s = pd.Series(values, dtype=float)
    df = packs.add_packs(frame(spark, values), [packs.sma(["x"], [7]), packs.medians("x", [5, 50]), packs.monthly("x"), packs.rolling_stats("x", [20])], W)
    names = ("x_sma_7", "x_median_50", "return_1month", "gap_1month", "volatility_2month", "x_std_20", "x_max_20")
    log = np.log(s)
    want = (s.rolling(7, 1).mean(), s.rolling(50, 25).median(), s / s.shift(20) - 1, s / s.rolling(20).mean(), (log - log.shift()).rolling(40).std(),
            s.rolling(20, 10).std(), s.rolling(20, 10).max())
    for a, b in zip(made(df, *names), want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9)


def test_horizons_equal_the_window_form(spark):
    values = walk(holes=(9, 200))
    values[50], values[60] = 0.0, -3.0
    df = frame(spark, values)
    got = packs.horizon_digests(df, ["x"], ["ret", "ret_abs", "vol", "vol2", "gap"], W, second=True).toPandas().sort_values(["k", "horizon"])
    rows = moments.horizons_long(df, ["x"], w=W, second=True).selectExpr("k", "series", "inline(packs)")
    kinds = ("ret", "ret_abs", "vol", "vol2", "gap")
    want = rows.groupBy("k", "series", "horizon").agg(*[e for k in kinds for e in _digest(k)]).toPandas().sort_values(["k", "horizon"])
    assert len(got) == 2 * 84
    for k in kinds:
        assert got[f"n_{k}"].tolist() == want[f"n_{k}"].tolist()
        np.testing.assert_allclose(got[k].to_numpy(float), want[k].to_numpy(float), rtol=1e-9)


def _digest(k):
    from pyspark.sql import functions as F

    return F.expr(f"count({k}) AS n_{k}"), F.expr(f"avg({k} / (1 + abs({k}))) AS {k}")


def test_terms_equal_the_long_form(spark):
    df = spark.createDataFrame([(k, float(i), None if i == 2 else float(-i), 0.5) for k in (1, None) for i in range(300)], "k int, a double, b double, c double")
    got = cross.monomial_digests(df, "k", ["a", "b", "c"], 3).toPandas().sort_values(["k", "term"])
    long = cross.monomials_long(df, ["k"], ["a", "b", "c"], 3)
    from pyspark.sql import functions as F

    want = long.groupBy("k", "term").agg(F.count("value").alias("n"), F.expr("avg(value / (1 + abs(value))) AS squashed")).toPandas().sort_values(["k", "term"])
    assert got["term"].tolist() == want["term"].tolist() and got["n"].tolist() == want["n"].tolist()
    np.testing.assert_allclose(got["squashed"], want["squashed"], rtol=1e-9)


def test_a_missing_time_comes_first_and_only_marked_rows_return(spark):
    rows = [(1, dt.date(2024, 1, 2), 2.0, True), (1, None, 1.0, False), (1, dt.date(2024, 1, 1), 4.0, None)]
    df = spark.createDataFrame(rows, "ticker int, date date, x double, m boolean")
    every = {r.date: r.x_lag_1 for r in packs.add_packs(df, [packs.lags(["x"], [1])]).collect()}
    assert every == {None: None, dt.date(2024, 1, 1): 1.0, dt.date(2024, 1, 2): 4.0}
    assert [r.x_lag_1 for r in packs.add_packs(df, [packs.lags(["x"], [1])], only="m").collect()] == [4.0]


def test_no_pair_of_the_market_is_shuffled(spark):
    text = executed(plans.QUERIES["market_covariance"](spark, SF))
    assert "Exchange" not in text.split("FlatMapGroupsInArrow")[0] and text.count("FlatMapGroupsInArrow") == 1


def test_long_lags_shuffle_rows_before_they_are_long(spark):
    text = executed(plans.QUERIES["lags_long"](spark, SF))
    assert text.index("Generate") < text.index("Window") and "Expand" not in text


def test_an_asset_is_sent_to_half_of_the_blocks(spark, monkeypatch):
    """Every block used to be sent to every other one."""
    rows = [(a, d.date(), float((a + 1) * (i % (a + 2)))) for a in range(40) for i, d in enumerate(pd.date_range("2001-01-01", periods=30))]
    df = spark.createDataFrame(rows, "ticker int, date date, ret double")
    wide = pd.DataFrame(rows, columns=["a", "d", "v"]).pivot(index="d", columns="a", values="v").cov() * 252
    for dealing in ({"width": 2, "parts": 7}, {"width": 40, "room": 100}):  # blocks by their assets, by their values
        found = portfolio.market_covariance(df, **dealing)
        assert executed(found).count("REPARTITION_BY_NUM") == 1
        assert found.count() == found.select("a", "b").distinct().count() == 40 * 41 // 2
        for r in found.collect():
            np.testing.assert_allclose(r.cov, wide.loc[r.a, r.b], rtol=1e-9, atol=1e-7)

    def arrived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"i": pa.array([0], pa.int32()), "j": pa.array([0], pa.int32()), "n": [len(b)], "cov": [0.0], "corr": [0.0]})

    monkeypatch.setattr(portfolio, "_meetings", lambda *_: arrived)
    assert sum(r.n for r in portfolio.market_covariance(df, width=2, parts=7).collect()) == 40 * 4

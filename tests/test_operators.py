"""Operators on skewed and tied inputs, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eraflow.operators import clean, cross, era, learn, portfolio, profile, ranking, relate
from eraflow.sources import readers, sinks


def skewed(spark, n=6000):
    """One era with most rows, a third of all rows with the same value, some NULLs."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        e = 0 if i % 3 else i % 7
        v = 0.5 if i % 3 == 1 else (None if i % 11 == 0 else float(rng.normal()))
        rows.append((e, i, v))
    return spark.createDataFrame(rows, "era int, ticker int, v double"), pd.DataFrame(rows, columns=["era", "ticker", "v"])


@pytest.mark.parametrize("parts", [1, 16])
def test_rank_is_exact_under_skew_and_ties(spark, parts):
    df, pdf = skewed(spark)
    got = ranking.add_rank(df.repartition(parts), ["era"], "v", ["ticker"], "r", total="n").toPandas()
    got = got.sort_values("ticker", ignore_index=True)
    present = pdf.dropna().sort_values(["era", "v", "ticker"])
    want = (present.groupby("era").cumcount() + 1).reindex(pdf.index)
    np.testing.assert_array_equal(got.r.fillna(-1), want.fillna(-1))
    totals = present.groupby("era").size()
    assert (got.dropna().n == got.dropna().era.map(totals)).all()


def test_global_rank_and_running_total(spark):
    df, pdf = skewed(spark, 3000)
    got = ranking.add_rank(df, [], "v", ["ticker"], "r").where("v IS NOT NULL").toPandas().sort_values("r")
    want = pdf.dropna().sort_values(["v", "ticker"])
    assert got.ticker.tolist() == want.ticker.tolist() and got.r.tolist() == list(range(1, len(want) + 1))
    run = ranking.running_total(df.where("v IS NOT NULL"), ["v", "ticker"], ["ticker"], slices=16).toPandas().sort_values(["v", "ticker"])
    np.testing.assert_array_equal(run.ticker_before, want.ticker.cumsum().shift(fill_value=0))


def test_quantile_bucket_equals_qcut(spark):
    rng = np.random.default_rng(5)
    rows = [(e, i, float(x)) for e in range(4) for i, x in enumerate(np.round(rng.normal(size=37 + e), 1))]
    df = spark.createDataFrame(rows, "era int, ticker int, v double")
    got = ranking.add_quantile_bucket(df, ["era"], "v", ["ticker"], 5, "q").toPandas().sort_values(["era", "ticker"])
    pdf = pd.DataFrame(rows, columns=["era", "ticker", "v"])
    want = pdf.groupby("era").v.transform(lambda g: pd.qcut(g, 5, labels=False, duplicates="drop"))
    np.testing.assert_array_equal(got.q, want)


def test_dense_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "s string")
    assert {(r.s, r.code) for r in ranking.dense_codes(df, "s").collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_first_per_key_takes_one_of_many_copies(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id % 2 AS p", "id AS v")
    out = clean.first_per_key(df, ["k"], ["p", "v"])
    assert out.count() == df.select("k").distinct().count()
    assert out.where("k = 0").first().v == 0


def test_asof_uses_only_published_facts(spark):
    import datetime as dt

    d = dt.date
    rows = spark.createDataFrame([(1, d(2024, 5, 14)), (1, d(2024, 5, 15)), (1, d(2024, 1, 1)), (2, d(2024, 6, 1))], "ticker int, date date")
    facts = spark.createDataFrame([(1, d(2024, 3, 31), 7.0), (1, d(2023, 12, 31), 5.0)], "ticker int, period_end date, revenue double")
    got = {(r.ticker, str(r.date)): r.revenue for r in relate.asof_facts(rows, facts, ["revenue"]).collect()}
    assert got == {(1, "2024-05-14"): 5.0, (1, "2024-05-15"): 7.0, (1, "2024-01-01"): None, (2, "2024-06-01"): None}


def test_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 800), np.round(rng.random(800), 1)
    got = era.auc(spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, s double"), "y", "s").first().auc
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert got == pytest.approx(want)


def test_era_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(e, i, float(rng.random()), float(round(rng.random(), 1))) for e in range(5) for i in range(60)]
    got = era.era_scores(spark.createDataFrame(rows, "week_end int, ticker int, t double, p double"), "t", "p").toPandas().sort_values("week_end")
    pdf = pd.DataFrame(rows, columns=["week_end", "ticker", "t", "p"])
    for r, (_, g) in zip(got.itertuples(), pdf.groupby("week_end")):
        assert r.score == pytest.approx(np.corrcoef(g.t, g.p.rank(pct=True, method="first"))[0, 1])
        assert r.rmse == pytest.approx(np.sqrt(((g.t - g.p) ** 2).mean()))


def test_portfolio_against_numpy(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(0.001, 0.02, (300, 3))
    m = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(r)], "date int, r0 double, r1 double, r2 double")
    mean, cov = portfolio.annualised_returns(m, [0, 1, 2]), portfolio.annualised_covariance(m, [0, 1, 2])
    w = spark.createDataFrame([(0, a, x) for a, x in enumerate((0.2, 0.3, 0.5))], "portfolio_id int, asset int, weight double")
    got = portfolio.score_portfolios(w, mean, cov, [0, 1, 2]).first()
    v = np.array([0.2, 0.3, 0.5])
    assert got.port_std == pytest.approx(np.sqrt(v @ (np.cov(r.T) * 252) @ v), abs=1e-4)
    assert got.port_return == pytest.approx(v @ ((1 + r).prod(axis=0) ** (252 / 300) - 1), abs=1e-4)


def test_polynomial_terms():
    terms = cross.polynomial_terms([f"x{i}" for i in range(11)], 4)
    assert len(terms) == 1365
    assert cross.polynomial_terms(["a", "b"], 2)["p_1_1"] == "a * b"


def test_splits(spark):
    df = spark.createDataFrame([(i % 50, i) for i in range(1000)], "date int, id int")
    split = learn.chrono_split(df)
    assert split.where("is_train").selectExpr("max(date)").first()[0] == 39
    share = spark.range(5000).selectExpr(f"avg(CAST({learn.hash_split('id')} AS INT)) AS s").first().s
    assert abs(share - 0.8) < 0.03


def test_input_contract(spark):
    df = spark.range(3)
    assert readers.require(df, ["id"]) is df
    with pytest.raises(readers.InputError):
        readers.require(df, ["id", "close"])
    with pytest.raises(readers.InputError):
        readers.require(df.where("id > 5"), ["id"])
    with pytest.raises(readers.InputError):
        learn.shape_submission(df, None, ["close"])


def test_narrow_and_widen(spark):
    df = spark.createDataFrame([(1, 40000, 1.5), (100, -40000, 2.5)], "a bigint, b bigint, c double")
    narrow = clean.narrow_types(df)
    assert [f.dataType.simpleString() for f in narrow.schema.fields] == ["tinyint", "int", "float"]
    assert [f.dataType.simpleString() for f in clean.widen_types(narrow).schema.fields] == ["int", "int", "double"]


def test_set_overlap_and_histogram(spark):
    a, b = spark.range(0, 10), spark.range(5, 20)
    got = {(r.in_a, r.in_b): r.ids for r in profile.set_overlap({"a": a, "b": b}, "id").collect()}
    assert got == {(True, False): 5, (True, True): 5, (False, True): 10}
    h = profile.histogram(spark.range(101).selectExpr("double(id) AS v"), "v", 10).orderBy("bin").collect()
    assert sum(r.n for r in h) == 101 and h[-1].n == 11


def test_sinks(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 4 AS friday_date")
    sinks.write_features(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("friday_date = 2").count() == 25
    sinks.write_csv(df, str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c"), "id bigint, friday_date bigint", ["id"]).count() == 100


def test_assets_of_any_type_and_order(spark):
    rows = [(t, d, 100.0 + 7 * i + (d * (3 + i)) % 11) for i, t in enumerate(["BBB US", "AAA", "O'X"]) for d in range(30)]
    prices = spark.createDataFrame(rows, "ticker string, date int, close double")
    assets = ["BBB US", "AAA", "O'X"]
    returns = portfolio.simple_returns(prices)
    matrix = portfolio.return_matrix(returns, assets)
    wide = pd.DataFrame(rows, columns=["t", "d", "c"]).pivot(index="d", columns="t", values="c").pct_change().dropna()
    cov = {(r["a"], r["b"]): r["cov"] for r in portfolio.annualised_covariance(matrix, assets).collect()}
    assert len(cov) == 9
    for (a, b), v in cov.items():
        assert v == pytest.approx(wide[a].cov(wide[b]) * 252)
    mean = {r["asset"]: r["annual_return"] for r in portfolio.annualised_returns(matrix, assets).collect()}
    assert mean["O'X"] == pytest.approx((1 + wide["O'X"]).prod() ** (252 / len(wide)) - 1)
    weights = spark.createDataFrame([(1, a, 0.5 if a == "AAA" else 0.25) for a in assets], "portfolio_id int, asset string, weight double")
    scored = portfolio.score_portfolios(weights, portfolio.annualised_returns(matrix, assets), portfolio.annualised_covariance(matrix, assets), assets).first()
    w = np.array([0.5 if a == "AAA" else 0.25 for a in assets])
    assert scored["port_std"] == pytest.approx(np.sqrt(w @ (wide[assets].cov().to_numpy() * 252) @ w), abs=1e-4)
    numbers = spark.createDataFrame([(t, d, 50.0 + (d * (t + 2)) % 7) for t in (1, 3) for d in range(20)], "ticker int, date int, close double")
    two = portfolio.annualised_covariance(portfolio.return_matrix(portfolio.simple_returns(numbers), [3, 1]), [3, 1])
    assert {(r["a"], r["b"]) for r in two.collect()} == {(1, 1), (1, 3), (3, 1), (3, 3)}
    assert {r["pair"] for r in cross.pair_spreads(prices, assets).collect()} == {"BBB US_AAA", "BBB US_O'X", "AAA_O'X"}


def test_awkward_numbers(spark):
    texts = [("1.6",), ("NaN",), ("Infinity",), ("1e30",), ("x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(texts, "v string").selectExpr(clean.lenient_number("v", 7) + " AS n").collect()]
    assert got == [2, 7, 7, 7, 7, 7]
    wide = spark.createDataFrame([(1.0, 1e300), (2.0, float("inf"))], "a double, b double")
    assert dict(clean.narrow_types(wide).dtypes) == {"a": "float", "b": "double"}


def test_carry_forward_leaves_rows_that_were_there(spark):
    rows = [(1, 1, 5.0), (1, 2, None), (2, 1, 6.0), (3, 2, 7.0)]
    out = clean.carry_forward_missing(spark.createDataFrame(rows, "ticker int, era int, x double"), "era", F.lit(2), F.lit(1), ["x"])
    assert out.columns == ["ticker", "era", "x"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([*rows, (2, 2, 6.0)], key=str)


def test_fridays_of_any_year(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2031-01-01', DATE'2031-01-31')) AS date")
    got = [r["friday_date"].isoformat() for r in relate.on_fridays(days).collect()]
    assert got == ["2031-01-03", "2031-01-10", "2031-01-17", "2031-01-24", "2031-01-31"]


def test_ranks_of_null_groups_and_hot_ties(spark):
    rows = [("a", 5.0, k) for k in range(400)] + [(None, float(k % 7), k) for k in range(90)] + [("b", None, 1), ("b", 2.0, 2), ("c", None, 1)]
    frame = spark.createDataFrame(rows, "era string, x double, id int").repartition(5)
    got = {(r.era, r.id): (r.place, r.n) for r in ranking.add_rank(frame, ["era"], "x", ["id"], "place", total="n").collect()}
    want = {}
    for era in ("a", "b", "c", None):
        own = sorted((x, i) for e, x, i in rows if e == era and x is not None)
        want |= {(era, i): (k + 1, len(own)) for k, (_, i) in enumerate(own)}
    assert len(got) == len(rows)
    assert {k: v for k, v in got.items() if v[0] is not None} == want
    assert [k for k, v in got.items() if v[0] is None] and all(k in {("b", 1), ("c", 1)} for k, v in got.items() if v[0] is None)
    share = {r.id: r.share for r in ranking.add_rank(frame.where("era = 'a'"), [], "x", ["id"], "share", percent=True).collect()}
    assert share == {k: (k + 1) / 400 for k in range(400)}
    assert ranking.add_rank(frame.limit(0), ["era"], "x", ["id"]).collect() == []


@pytest.mark.parametrize("text", [False, True])
def test_market_covariance_equals_pandas(spark, text):
    """Many blocks and slices of days, holes, a constant asset, one with few dates, values far from zero."""
    rng = np.random.default_rng(8)
    days = pd.date_range("1969-11-01", periods=90)
    wide = pd.DataFrame(1e4 + rng.normal(size=(90, 9)) @ rng.normal(size=(9, 9)), index=days, columns=range(9))
    wide[3] = 7.0
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    wide.iloc[5:, 8] = np.nan
    rows = [(f"t{a}" if text else a, d.date(), None if pd.isna(v) else float(v)) for a in wide for d, v in wide[a].items()]
    rows += [(None, days[0].date(), 1.0)]
    df = spark.createDataFrame(rows, f"ticker {'string' if text else 'int'}, date date, ret double")
    got = portfolio.market_covariance(df, days=1, least=20, width=3, span=25).toPandas()
    cov, corr = wide.cov(min_periods=20), wide.drop(columns=3).corr(min_periods=20)
    there = wide.notna().astype(int)
    assert len(got) == sum((there[a] * there[b]).any() for a in wide for b in wide if a <= b)
    for r in got.itertuples():
        a, b = (int(str(x).lstrip("t")) for x in (r.a, r.b))
        assert a <= b and r.n == (there[a] * there[b]).sum()
        want = cov.loc[a, b], np.nan if 3 in (a, b) else corr.loc[a, b]
        np.testing.assert_allclose((r.cov, r.corr), want, rtol=1e-7, atol=1e-9)
    assert portfolio.market_covariance(df.where("false")).count() == 0

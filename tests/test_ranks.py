"""Ranked inputs: what is shuffled for them, and that the results stay whole."""

import datetime as dt
import random

import pytest

from eraflow import plans
from eraflow.operators import learn, ranking
from eraflow.sources import panels, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    """Four suppliers over 40 weeks, one of them listed twice, and a line without a supplier."""
    at, rnd = tmp_path_factory.mktemp("market"), random.Random(5)
    start = dt.datetime(1998, 8, 3)
    lines = [
        (n, (n % 4 if n else None), start + dt.timedelta(days=n // 4), float(rnd.randint(1, 9)), float(rnd.randint(100, 900)))
        for n in range(1120)
    ]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k, f"s{k}", 0, 1.0) for k in (0, 1, 2, 2, 3)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{at}/region.parquet")
    return str(at)


@pytest.fixture
def unkept(monkeypatch):
    """Tables of a session are made on the spot, so that their plans can be seen."""
    monkeypatch.setattr(panels, "kept", lambda spark, folder, name, make, split_by=None: make())


def test_ranked_values_come_out_beside_their_ranks(spark):
    rnd = random.Random(3)
    rows = [(era, k, rnd.choice([None, 1.0, 2.0, 3.0]), rnd.choice([None, 1.0, 2.0])) for era in ("a", "b", None) for k in (*range(20), None)]
    df = spark.createDataFrame(rows, "era string, id int, x double, y double")
    got = ranking.percent_ranks(df, ["era"], {"px": "x", "py": "y"}, "id", keep=["x"]).collect()
    want = {}
    for era, k, x, y in rows:
        rank = []
        for c, v in ((2, x), (3, y)):
            there = sorted(((r[c], r[1] is not None, r[1] or 0) for r in rows if r[0] == era and r[c] is not None))
            rank.append(None if v is None else (there.index((v, k is not None, k or 0)) + 1) / len(there))
        want[era, k] = (*rank, x)
    assert len(got) == len(rows) and {(r.era, r.id): (r.px, r.py, r.x) for r in got} == want


def test_weeks_come_from_two_shuffles_of_thin_bars(spark, market, unkept):
    text = plan(panels.weekly(spark, market))
    assert text.count("Exchange hashpartitioning") == 3 and "max(cents" not in text  # by (ticker, date), by ticker, the listed tickers
    assert "eraflow_bars" not in text


def test_ranks_are_not_joined_back_to_the_weeks(spark, market, unkept):
    df = panels.weekly_ranks(spark, market)
    text = plan(df)
    assert text.count("Join") == 1, "only the table of beginnings is joined"
    assert df.columns == ["ticker", "week_end", "fwd", "data_type", "target", "pred_momentum", "pred_reversal"]
    got = {(r.ticker, r.week_end): r for r in df.collect()}
    weeks = panels.weekly(spark, market).where("ticker IS NOT NULL").collect()
    assert set(got) == {(r.ticker, r.week_end) for r in weeks}  # a line without a supplier has no rank
    close = {(r.ticker, r.week_end): r.close for r in weeks}
    for (t, w), r in got.items():
        later = close.get((t, w + dt.timedelta(days=28)))
        assert (r.fwd is None) == (later is None) and (later is None or r.fwd == pytest.approx(later / close[t, w] - 1))


def test_partitions_follow_the_raw_rows(spark, market):
    b = panels.bars(spark, market)
    assert panels.by_ticker(spark, market, b, rows=100).rdd.getNumPartitions() == 12  # 1,120 rows
    assert panels.by_ticker(spark, market, b, rows=400).rdd.getNumPartitions() == 4  # not below the session's
    assert panels.by_ticker(spark, market, b, rows=2000) is b


def test_direction_model_reads_its_bars_once_in_even_tasks(spark, market, monkeypatch):
    seen = []
    monkeypatch.setattr(panels, "by_ticker", lambda s, f, b, real=panels.by_ticker: seen.append(real(s, f, b, rows=100)) or seen[-1])
    fitted = []
    monkeypatch.setattr(learn, "direction_model", lambda train, fields, real=learn.direction_model: fitted.append(train) or real(train, fields))
    assert plans.QUERIES["direction_auc"](spark, market).count() == 1
    assert len(seen) == 1 and fitted[0].rdd.getNumPartitions() == 12
    assert "lineitem" not in plan(fitted[0])  # the split is taken from the kept rows


def test_leaderboard_caches_its_rows_and_lets_them_go(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(dt.date(2020, 1, 3) + dt.timedelta(days=7 * (n // 10)), rnd.random(), rnd.random(), "x" * 50) for n in range(400)]
    df = spark.createDataFrame(rows, "week_end date, target double, a double, more string")
    seen = []
    monkeypatch.setattr(learn, "train_models", lambda train, *a, real=learn.train_models: seen.append((train, train.storageLevel.useMemory, train.columns)) or real(train, *a))
    got = learn.leaderboard(df.where("target < 0.7"), df.where("target >= 0.7"), ["a"], sets=((2, 2, 0.1), (3, 2, 0.1)))
    assert {n for n, _ in got} == {"gbt", "forest", "linear", "gbt_search"}
    (train, cached, columns), = seen
    assert cached and columns == ["week_end", "target", "a"] and not train.storageLevel.useMemory


def test_era_files_need_one_shuffle_of_the_rows(spark, tmp_path):
    df = spark.range(1000).selectExpr("CASE WHEN id % 3 > 0 THEN 1 WHEN id % 9 > 0 THEN CAST(id % 5 AS INT) END AS era", "id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(sinks.sized(df, "era", 100))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    sinks.write_features(df, f"{tmp_path}/f", "era", rows_per_file=100)
    back = spark.read.parquet(f"{tmp_path}/f").select("era", "id")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)

"""The feature pass in buckets, terms and pairs in long form."""

from itertools import combinations, combinations_with_replacement
from math import prod

import pytest

from eraflow.operators import cross
from eraflow.plans import features
from eraflow.sources import panels, store

SF = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frame_has_all_groups_and_no_shuffle_after_the_buckets(spark):
    frame = features.feature_frame(spark, SF)
    text = executed(frame)
    assert "Exchange" not in text and "Python" not in text and text.count("SortMergeJoin") >= 10
    wanted = {"wilder_140", "rsi_7", "macd_12_26", "macd_pct_12_26", "ema_200", "atr_200", "close_median_200", "open_z", "return_251", "ret_rsi_120", "ret_macd_20_48",
              "ret_pow_05", "month_end", "random_normal", "poly", "close_ret", "close_vol2", "bb_width_50_2p5", "stoch_d_30_5", "money_wilder_14", "volume_wilder_14"}
    assert wanted <= set(frame.columns)
    assert len(frame.columns) > 400
    first = frame.select("poly", "close_gap").first()
    assert len(first.poly) == 1365 and len(first.close_gap) == 84
    assert frame.count() == frame.select("ticker", "date").distinct().count()


def test_groups_read_bars_without_a_shuffle(spark):
    for name, group in features.feature_groups(spark, SF).items():
        assert "Exchange" not in executed(group), name


def test_groups_are_joined_as_structs(spark, monkeypatch):
    """Every join used to copy all columns of the groups before it."""
    tables = []
    monkeypatch.setattr(features, "joined", lambda found, keys: tables.extend(found) or store.joined(found, keys))
    frame = features.feature_frame(spark, SF)
    groups = features.feature_groups(spark, SF)
    assert len(tables) == len(groups) and all(len(t.columns) == 3 for t in tables)
    assert frame.columns == ["ticker", "date", *[c for n, g in groups.items() if n != "polynomials" for c in g.columns[2:]], "poly"]
    for name in ("macd", "price_packs", "calendar"):
        group, mine = groups[name], frame.select(groups[name].columns)
        assert group.count() == mine.count() and not group.exceptAll(mine).take(1), name


def test_buckets_follow_the_raw_rows(spark):
    """As many as shuffle partitions were set: tasks of a few hundred rows, or of too many."""
    rows = panels.table(spark, SF, "lineitem").count()
    assert panels.buckets(spark, SF) == spark.sparkContext.defaultParallelism
    assert panels.buckets(spark, SF, rows // 50) in (50, 51)


def test_store_finds_tables_again_and_forgets_them(spark, tmp_path):
    spark.range(40).selectExpr("id", "id % 3 AS k").write.parquet(f"{tmp_path}/in")
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/in")

    for _ in range(2):
        assert store.bucketed(spark, f"{tmp_path}/in", "t", make, ["k"], ["k", "id"]).count() == 40
    assert len(made) == 1
    spark.range(5).selectExpr("id", "id AS k").write.mode("append").parquet(f"{tmp_path}/in")  # another state of the input
    assert store.bucketed(spark, f"{tmp_path}/in", "t", make, ["k"], ["k", "id"]).count() == 45
    store.forget(spark)
    assert not [k for k in store._known if k[0] == spark.sparkContext.applicationId]
    assert store.bucketed(spark, f"{tmp_path}/in", "t", make, ["k"], ["k", "id"]).count() == 45 and len(made) == 3


@pytest.mark.parametrize("degree", [1, 2, 4])
def test_monomials_against_products(spark, degree):
    values = (2.0, 3.0, 5.0)
    frame = spark.createDataFrame([(1, *values), (2, 2.0, None, 5.0)], "k int, a double, b double, c double")
    got = {(r.k, r.term): r.value for r in cross.monomials_long(frame, ["k"], ["a", "b", "c"], degree).collect()}
    want = {}
    for d in range(degree + 1):
        for pick in combinations_with_replacement(range(3), d):
            name = "p_" + "_".join(str(pick.count(i)) for i in range(3))
            want[1, name] = prod(values[i] for i in pick)
            want[2, name] = None if 1 in pick else prod(values[i] for i in pick)
    assert got == want


def test_pairs(spark):
    frame = spark.createDataFrame([(1, 2.0, 4.0, 0.0), (2, None, 1.0, 3.0)], "k int, a double, b double, c double")
    got = {(r.k, r.a, r.b): (r.product, r.ratio, r.diff, r.sum) for r in cross.interactions_long(frame, ["k"], ["a", "b", "c"]).collect()}
    assert {x[1:] for x in got} == set(combinations("abc", 2)) and len(got) == 6
    assert got[1, "a", "b"] == (8.0, 0.5, -2.0, 6.0) and got[1, "a", "c"] == (0.0, 0.0, 2.0, 2.0)
    assert got[2, "a", "b"] == (None, 0.0, None, None) and got[2, "b", "c"] == (3.0, 1 / 3, -2.0, 4.0)
    with pytest.raises(ValueError):
        cross.interactions_long(frame, ["k"], ["a"])

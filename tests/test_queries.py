"""Registry contract: every query runs at the smallest scale, oracles match DuckDB, plans have the wanted shape."""

import duckdb
import pytest

import __spark_entry__ as entry
from eraflow import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
# the broad comparison at sf0.01 is tools/check_oracle.py; here one query per family
SAMPLE = [
    "flagship_weekly_signal", "weekly_last", "dedup_first", "label_encode", "asof_report_lag", "live_universe", "rolling_frames",
    "rsi_wilder", "macd_pct", "pair_spread_ratio", "era_score", "era_quintiles", "portfolio_score", "auc_rank", "chrono_split",
    "stream_daily_bars", "rolling_stats", "price_horizons", "volume_horizons", "zscore_inputs", "poly_terms_full", "interactions_panel",
    "features_trend", "features_strength", "portfolio_best", "sequences", "pct_changes",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*[[str(v) for v in table.column(n).to_pylist()] for n in names]))


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toArrow()
    want = duck.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert rows(got) == rows(want)


def test_registry():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
    assert len(plans.QUERIES) > 110


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_plan_is_pruned_hash_aggregation(spark):
    text = plan(plans.QUERIES["bars_daily"](spark, SF))
    assert "SortAggregate" not in text and "l_returnflag" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_many_windows_share_one_shuffle(spark):
    for name in ("bollinger", "stochastic", "ema_recursive", "feature_expansion"):
        text = plan(plans.QUERIES[name](spark, SF))
        # one exchange for the daily aggregation, one to bring a ticker together
        assert text.count("Exchange hashpartitioning") <= 2, name


def test_no_cartesian_products(spark):
    for name in ("minmax", "histogram", "portfolio_score", "rolling_corr", "asof_report_lag"):
        text = plan(plans.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_range_filter_reaches_the_scan_columns(spark):
    text = plan(plans.QUERIES["range_cutoff"](spark, SF))
    assert "PushedFilters" in text and "l_discount" not in text

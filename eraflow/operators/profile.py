"""Counts, spans, profiles, histograms, cross-tabs, set overlaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def records_per_key(df: DataFrame, by: str = "ticker", at: str = "date", approximate: bool = False) -> DataFrame:
    """Distinct dates per key; the HyperLogLog sketch is an option for unbounded dates."""
    count = F.approx_count_distinct(at) if approximate else F.count_distinct(at)
    return df.groupBy(by).agg(count.alias("records"))


def keys_between(df: DataFrame, low: int, high: int, by: str = "ticker", at: str = "date") -> DataFrame:
    """Rows of the keys that have low <= distinct dates < high."""
    keep = records_per_key(df, by, at).where(f"records >= {low} AND records < {high}")
    return df.join(keep, by, "left_semi")


def span_per_key(df: DataFrame, by: str = "ticker", at: str = "date") -> DataFrame:
    return df.groupBy(by).agg(F.min(at).alias("first_date"), F.max(at).alias("last_date"), F.count(at).alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: present and missing values, in one aggregation."""
    counts = df.selectExpr("count(*) AS _all", *[f"count({c}) AS {c}" for c in df.columns])
    return counts.unpivot(["_all"], list(df.columns), "column_name", "present").selectExpr(
        "column_name", "present", "_all - present AS missing"
    )


def number_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min and max per column, in one aggregation."""
    stats = [f"struct('{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, "
             f"double(min({c})) AS low, double(max({c})) AS high)" for c in cols]
    return df.agg(F.expr(f"array({', '.join(stats)}) AS s")).selectExpr("inline(s)")


def live_universe(df: DataFrame, recent: Column, previous: Column, at_least: int = 5, by: str = "ticker", era: str = "week_end") -> DataFrame:
    """Keys whose last era is the recent one; the previous one if fewer than ``at_least`` keys have it."""
    last = df.groupBy(by).agg(F.max(era).alias(era))
    enough = last.select((F.count_if(F.col(era) == recent) >= at_least).alias("enough")).scalar()
    return last.where(F.col(era) == F.when(enough, recent).otherwise(previous))


def crosstab_percent(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Row percentages of the counts of two labels; ``values`` lists the column labels."""
    parts = [F.expr(f"count_if({col} = {v!r}) AS _c{i}") for i, v in enumerate(values)]
    n = df.where(f"{col} IS NOT NULL").groupBy(row).agg(F.expr("count(*) AS _n"), *parts)
    return n.selectExpr(row, *[f"100D * _c{i} / _n AS pct_{i}" for i in range(len(values))])


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max]; the maximum falls into the last bin."""
    lo, hi = (df.selectExpr(f"{f}({value})").scalar() for f in ("min", "max"))
    ranged = df.where(f"{value} IS NOT NULL").select(F.col(value).alias("_v"), lo.alias("_lo"), hi.alias("_hi"))
    bin_no = f"least(CAST(floor((_v - _lo) * {bins} / (_hi - _lo)) AS INT), {bins - 1})"
    counts = ranged.groupBy(F.expr(f"coalesce(CASE WHEN _hi > _lo THEN {bin_no} END, 0) AS bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).selectExpr("CAST(id AS INT) AS bin")
    return grid.join(counts, "bin", "left").fillna(0, ["n"])


def set_overlap(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """How many ids are in each combination of two or three sets."""
    tagged = None
    for name, df in sets.items():
        one = df.selectExpr(key, *[f"{'true' if n == name else 'false'} AS in_{n}" for n in sets])
        tagged = one if tagged is None else tagged.unionByName(one)
    per_id = tagged.groupBy(key).agg(*[F.expr(f"bool_or(in_{n}) AS in_{n}") for n in sets])
    return per_id.groupBy(*[f"in_{n}" for n in sets]).agg(F.count("*").alias("ids"))

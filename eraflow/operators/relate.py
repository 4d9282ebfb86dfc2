"""Joins between prices, attributes, labels and calendars.

Dimension tables grow with the market, so no join here forces a broadcast: the
planner broadcasts what it measures to be small and otherwise shuffles, with
adaptive skew splitting. Only calendars, bounded by the number of weeks, are
broadcast by hint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_attributes(prices: DataFrame, dim: DataFrame, left: str = "ticker", right: str = "ticker") -> DataFrame:
    """Every price row with the attributes of its ticker, where known."""
    d = dim.withColumnRenamed(right, "_key")
    return prices.join(d, F.col(left) == F.col("_key"), "left").drop("_key")


def on_calendar(prices: DataFrame, calendar: DataFrame, at: str = "date", day: str = "friday_date") -> DataFrame:
    """Rows whose date is in the calendar; Spark sends it to every task if it measures it to be small."""
    return prices.join(calendar, F.col(at) == F.col(day), "inner")


def on_fridays(prices: DataFrame, at: str = "date", day: str = "friday_date") -> DataFrame:
    """Rows of Fridays, whatever the range of dates; equal to a calendar of all Fridays."""
    return prices.where(f"weekday({at}) = 4").selectExpr("*", f"{at} AS {day}")


def labels_onto_prices(labels: DataFrame, prices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right join: every price row, with its label where one exists."""
    return labels.join(prices, list(keys), "right")


def with_market_week(labels: DataFrame, market: DataFrame, era: str) -> DataFrame:
    """Add the market row of the week to every label; Spark sends the weeks to every task if they are few."""
    return labels.join(market, era, "left")


def lookup_last(df: DataFrame, pairs: DataFrame, key: str, value: str, order: str, on: str, out: str) -> DataFrame:
    """Dictionary lookup: the last pair of a key wins, a key that is not found gives NULL."""
    table = pairs.groupBy(F.col(key).alias("_k")).agg(F.max_by(value, order).alias(out))
    return df.join(table, F.col(on) == F.col("_k"), "left").drop("_k")


def asof_facts(
    df: DataFrame,
    facts: DataFrame,
    cols: Sequence[str],
    by: str = "ticker",
    at: str = "date",
    known: str = "period_end",
    lag_days: int = 45,
) -> DataFrame:
    """Latest fact published on or before each row's date (published = period end + lag).

    Both sides are put on one time line per key and the last fact is carried
    forward: one shuffle, no range join. Facts of a key on the same day must be unique.
    """
    fields = ", ".join([*cols, known])
    events = facts.selectExpr(by, f"date_add({known}, {lag_days}) AS {at}", f"struct({fields}) AS _fact", "0 AS _side")
    rows = df.selectExpr("*", "1 AS _side")
    line = rows.unionByName(events, allowMissingColumns=True)
    carried = line.selectExpr(
        *df.columns,
        "_side",
        f"last(_fact, true) OVER (PARTITION BY {by} ORDER BY {at}, _side "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _fact",
    )
    return carried.where("_side = 1").selectExpr(*df.columns, *[f"_fact.{c} AS {c}" for c in [*cols, known]])

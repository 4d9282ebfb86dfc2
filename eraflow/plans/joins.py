"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.rolling import log_return
from ..functions.safe import rounded
from ..operators import relate
from ..sources import panels
from ..sources.panels import DAILY
from .registry import query
from .twins import r6, using, week_of


@query("sector_left", using("bars", "dim") + "SELECT b.ticker, date, close, sector, code FROM bars b LEFT JOIN dim d ON b.ticker = d.ticker AND d.ticker % 9 <> 4")
def sector_left(spark, folder):
    dim = panels.attributes(spark, folder).where("ticker % 9 <> 4").selectExpr("ticker AS vendor_ticker", "sector", "code")
    b = panels.bars(spark, folder).select("ticker", "date", "close")
    return relate.with_attributes(b, dim, right="vendor_ticker")


@query("friday_inner", using("bars") + "SELECT ticker, date, close, date AS friday_date FROM bars WHERE isodow(date) = 5")
def friday_inner(spark, folder):
    return relate.on_fridays(panels.bars(spark, folder).select("ticker", "date", "close"))


_PREP = using("bars", "dim", "labels_w") + """SELECT b.ticker, d.name, b.date AS friday_date, l.data_type, b.close, b.high, b.low, b.volume, d.code,
 l.target FROM labels_w l RIGHT JOIN (SELECT * FROM bars WHERE isodow(date) = 5) b ON l.ticker = b.ticker AND l.week_end = b.date
 LEFT JOIN dim d ON d.ticker = b.ticker"""


@query("price_right", _PREP)
def price_right(spark, folder):
    """The data preparation path: prices with sectors, Fridays only, labels joined on."""
    b = panels.stored_bars(spark, folder).drop("shares")
    dim = panels.attributes(spark, folder).select("ticker", "name", "code")
    fridays = relate.with_attributes(relate.on_fridays(b), dim)
    labels = panels.labels_weekly(spark, folder).selectExpr("ticker", "week_end AS friday_date", "data_type", "target")
    out = relate.labels_onto_prices(labels, fridays, ["ticker", "friday_date"])
    return out.select("ticker", "name", "friday_date", "data_type", "close", "high", "low", "volume", "code", "target")


@query(
    "market_broadcast",
    using("bars", "weekly", extra=f"""m AS (SELECT {week_of('date')} AS week_end, arg_max(close, date) AS market_close,
  arg_max(volume, date) AS market_volume FROM bars WHERE ticker = 0 GROUP BY 1)""")
    + "SELECT ticker, week_end, close, market_close, market_volume FROM weekly LEFT JOIN m USING (week_end)",
)
def market_broadcast(spark, folder):
    lead = cal.weekly_last(panels.bars(spark, folder).where("ticker = 0"), ["close", "volume"])
    market = lead.selectExpr("week_end", "close AS market_close", "volume AS market_volume")
    labels = panels.weekly(spark, folder).select("ticker", "week_end", "close")
    return relate.with_market_week(labels, market, "week_end")


@query(
    "attr_chain",
    using("bars", "dim", "fundamentals", extra="f AS (SELECT ticker, max(revenue) AS best_revenue FROM fundamentals WHERE ticker % 6 <> 1 GROUP BY 1)")
    + """SELECT b.ticker, b.date, b.close, d.sector, f.best_revenue FROM bars b LEFT JOIN dim d USING (ticker) LEFT JOIN f USING (ticker)""",
)
def attr_chain(spark, folder):
    f = panels.agg(panels.fundamentals(spark, folder).where("ticker % 6 <> 1"), ["ticker"], "max(revenue) AS best_revenue")
    dim = panels.attributes(spark, folder).select("ticker", "sector").join(f, "ticker", "left")
    return relate.with_attributes(panels.bars(spark, folder).select("ticker", "date", "close"), dim)


@query(
    "feature_label_join",
    using("bars", "labels_w", extra="f AS (SELECT ticker, date, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS lret FROM bars)")
    + f"SELECT f.ticker, f.date, {r6('f.lret')} AS lret, l.data_type, l.target FROM f LEFT JOIN labels_w l ON f.ticker = l.ticker AND f.date = l.week_end",
)
def feature_label_join(spark, folder):
    f = panels.stored_bars(spark, folder).selectExpr("ticker", "date", f"{rounded(log_return('close', DAILY))} AS lret")
    labels = panels.labels_weekly(spark, folder).selectExpr("ticker", "week_end AS date", "data_type", "target")
    return f.join(labels, ["ticker", "date"], "left")


@query("universe_semi", using("bars", "dim") + "SELECT ticker, date, close FROM bars WHERE ticker IN (SELECT ticker FROM dim WHERE shares > 0)")
def universe_semi(spark, folder):
    universe = panels.attributes(spark, folder).where("shares > 0")
    return panels.bars(spark, folder).select("ticker", "date", "close").join(universe, "ticker", "left_semi")


@query(
    "missing_anti",
    using("bars") + """SELECT DISTINCT ticker FROM bars WHERE date < DATE '1996-01-01'
 AND ticker NOT IN (SELECT ticker FROM bars WHERE date >= DATE '2001-11-02')""",
)
def missing_anti(spark, folder):
    b = panels.bars(spark, folder).select("ticker", "date")
    old = b.where("date < DATE'1996-01-01'").select("ticker").distinct()
    return old.join(b.where("date >= DATE'2001-11-02'"), "ticker", "left_anti")


@query(
    "id_map",
    """SELECT o.o_orderkey, m.last_part AS part_id FROM orders o
LEFT JOIN (SELECT l_orderkey, arg_max(l_partkey, l_partkey + CAST(1000000000 AS BIGINT) * l_linenumber) AS last_part FROM lineitem
 WHERE l_quantity > 25 GROUP BY 1) m ON m.l_orderkey = o.o_orderkey""",
)
def id_map(spark, folder):
    pairs = panels.table(spark, folder, "lineitem").where("l_quantity > 25").selectExpr(
        "l_orderkey", "l_partkey", "l_partkey + 1000000000L * l_linenumber AS seq"
    )
    orders = panels.table(spark, folder, "orders").select("o_orderkey")
    return relate.lookup_last(orders, pairs, "l_orderkey", "l_partkey", "seq", "o_orderkey", "part_id")


@query(
    "asof_report_lag",
    using("bars", "fundamentals", extra="f AS (SELECT ticker, CAST(period_end + 45 AS DATE) AS known, period_end, revenue FROM fundamentals)")
    + """SELECT b.ticker, b.date, b.close, f.revenue, f.period_end FROM bars b
 ASOF LEFT JOIN f ON b.ticker = f.ticker AND b.date >= f.known""",
)
def asof_report_lag(spark, folder):
    b = panels.bars(spark, folder).select("ticker", "date", "close")
    return relate.asof_facts(b, panels.fundamentals(spark, folder), ["revenue"])


@query(
    "outer_suffix",
    using("bars") + """SELECT coalesce(a.date, b.date) AS date, a.close AS close_0, b.close AS close_1
FROM (SELECT * FROM bars WHERE ticker = 0) a FULL JOIN (SELECT * FROM bars WHERE ticker = 1) b ON a.date = b.date""",
)
def outer_suffix(spark, folder):
    b = panels.bars(spark, folder)
    left = b.where("ticker = 0").selectExpr("date", "close AS close_0")
    return left.join(b.where("ticker = 1").selectExpr("date", "close AS close_1"), "date", "full")


@query(
    "union_sets",
    using("labels_w") + """SELECT data_type, ticker, week_end, target, CAST(NULL AS DOUBLE) AS fwd FROM labels_w WHERE data_type = 'train'
 UNION ALL SELECT data_type, ticker, week_end, target, round(fwd, 6) FROM labels_w WHERE data_type = 'validation'""",
)
def union_sets(spark, folder):
    lab = panels.labels_weekly(spark, folder).selectExpr("data_type", "ticker", "week_end", "target", "round(fwd, 6) AS fwd")
    train = lab.where("data_type = 'train'").drop("fwd")
    return train.unionByName(lab.where("data_type = 'validation'"), allowMissingColumns=True)


@query(
    "set_ops",
    """SELECT o_custkey AS id, 'only_early' AS kind FROM (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1996-01-01'
  EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2000-01-01')
UNION ALL SELECT o_custkey, 'both' FROM (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1996-01-01'
  INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2000-01-01')""",
)
def set_ops(spark, folder):
    o = panels.table(spark, folder, "orders").select("o_custkey", "o_orderdate")
    early = o.where("o_orderdate < DATE'1996-01-01'").select("o_custkey")
    late = o.where("o_orderdate >= DATE'2000-01-01'").select("o_custkey")
    # subtract = difference of the distinct ids
    only = early.subtract(late).selectExpr("o_custkey AS id", "'only_early' AS kind")
    return only.unionByName(early.intersect(late).selectExpr("o_custkey AS id", "'both' AS kind"))


@query("distinct_ids", "SELECT DISTINCT l_suppkey AS ticker, l_returnflag FROM lineitem")
def distinct_ids(spark, folder):
    return panels.table(spark, folder, "lineitem").selectExpr("l_suppkey AS ticker", "l_returnflag").distinct()

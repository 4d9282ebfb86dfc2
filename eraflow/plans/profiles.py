"""Counts, spans, histograms, cross-tabs, overlaps, rankings of importances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import profile
from ..sources import panels
from .registry import query
from .twins import using, week_of

LAST_WEEK = "(SELECT max(week_end) FROM weekly)"


@query(
    "records_per_ticker",
    "SELECT l_suppkey AS ticker, count(DISTINCT CAST(l_shipdate AS DATE)) AS records FROM lineitem GROUP BY 1",
)
def records_per_ticker(spark, folder):
    line = panels.table(spark, folder, "lineitem").selectExpr("l_suppkey AS ticker", "CAST(l_shipdate AS DATE) AS date")
    return profile.records_per_key(line)


@query(
    "records_between",
    using("bars") + """SELECT ticker, date, close FROM bars WHERE ticker IN
 (SELECT ticker FROM bars GROUP BY 1 HAVING count(DISTINCT date) >= 520 AND count(DISTINCT date) < 560)""",
)
def records_between(spark, folder):
    return profile.keys_between(panels.bars(spark, folder).select("ticker", "date", "close"), 520, 560)


@query("ticker_span", using("bars") + "SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(date) AS n FROM bars GROUP BY 1")
def ticker_span(spark, folder):
    return profile.span_per_key(panels.bars(spark, folder))


_D = ("ticker", "name", "country", "sector", "shares", "code")


@query(
    "null_profile",
    using("dim") + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS present, count(*) - count({c}) AS missing FROM dim" for c in _D),
)
def null_profile(spark, folder):
    return profile.null_profile(panels.attributes(spark, folder))


_N = ("open", "close", "volume")


@query(
    "number_profile",
    using("bars") + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS low, max({c}) AS high FROM bars"
        for c in _N
    ),
)
def number_profile(spark, folder):
    p = profile.number_profile(panels.bars(spark, folder), _N)
    return p.selectExpr("column_name", "n", "round(mean, 6) AS mean", "round(std, 6) AS std", "low", "high")


@query(
    "live_universe",
    using("weekly", extra=f"""l AS (SELECT ticker, max(week_end) AS week_end FROM weekly GROUP BY 1)""")
    + f"""SELECT * FROM l WHERE week_end = CASE WHEN (SELECT count(*) FROM l WHERE week_end = {LAST_WEEK}) >= 5
 THEN {LAST_WEEK} ELSE {LAST_WEEK} - 7 END""",
)
def live_universe(spark, folder):
    w = panels.bars(spark, folder).selectExpr("ticker", f"{cal.week_end()} AS week_end")
    newest = w.agg(F.max("week_end").alias("d")).scalar()
    return profile.live_universe(w, newest, F.date_sub(newest, 7))


_FLAG = ["A", "N", "R"]


@query(
    "label_crosstab",
    "SELECT l_linestatus, "
    + ", ".join(f"round(100.0 * count(*) FILTER (WHERE l_returnflag = '{v}') / count(*), 6) AS pct_{i}" for i, v in enumerate(_FLAG))
    + " FROM lineitem GROUP BY 1",
)
def label_crosstab(spark, folder):
    t = profile.crosstab_percent(panels.table(spark, folder, "lineitem"), "l_linestatus", "l_returnflag", _FLAG)
    return t.selectExpr("l_linestatus", *[f"round(pct_{i}, 6) AS pct_{i}" for i in range(3)])


@query(
    "histogram",
    """SELECT g.bin, count(v.bin) AS n FROM (SELECT CAST(unnest(range(100)) AS INTEGER) AS bin) g LEFT JOIN
 (SELECT least(CAST(floor((o_totalprice - lo) * 100 / (hi - lo)) AS INTEGER), 99) AS bin FROM orders,
   (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)) v ON g.bin = v.bin GROUP BY 1""",
)
def histogram(spark, folder):
    return profile.histogram(panels.table(spark, folder, "orders"), "o_totalprice", 100)


@query(
    "id_overlap",
    """SELECT a AS in_customers, b AS in_early, c AS in_late, count(*) AS ids FROM (
 SELECT id, bool_or(s = 1) AS a, bool_or(s = 2) AS b, bool_or(s = 3) AS c FROM (
  SELECT c_custkey AS id, 1 AS s FROM customer UNION ALL
  SELECT o_custkey, 2 FROM orders WHERE o_orderdate < DATE '1998-01-01' UNION ALL
  SELECT o_custkey, 3 FROM orders WHERE o_orderdate >= DATE '1998-01-01') GROUP BY id) GROUP BY 1, 2, 3""",
)
def id_overlap(spark, folder):
    o = panels.table(spark, folder, "orders")
    return profile.set_overlap(
        {
            "customers": panels.table(spark, folder, "customer").selectExpr("c_custkey AS id"),
            "early": o.where("o_orderdate < DATE'1998-01-01'").selectExpr("o_custkey AS id"),
            "late": o.where("o_orderdate >= DATE'1998-01-01'").selectExpr("o_custkey AS id"),
        },
        "id",
    )


_GAIN = "SELECT l_partkey AS feature, sum(l_quantity) AS gain FROM lineitem GROUP BY 1"


@query("top_importance", f"SELECT feature, gain FROM ({_GAIN}) ORDER BY gain DESC, feature LIMIT 20")
def top_importance(spark, folder):
    # the limit is the feature: a top-20 report (a bounded heap per task, merged)
    gain = panels.agg(panels.table(spark, folder, "lineitem"), ["l_partkey AS feature"], "sum(l_quantity) AS gain")
    return gain.orderBy(F.desc("gain"), "feature").limit(20)


@query(
    "rank_slice",
    f"SELECT feature, gain, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY gain DESC, feature) AS INTEGER) AS rank FROM ({_GAIN})) WHERE rank BETWEEN 2 AND 50",
)
def rank_slice(spark, folder):
    """Ranks 2 to 50: the report leaves out the best feature."""
    gain = panels.agg(panels.table(spark, folder, "lineitem"), ["l_partkey AS feature"], "sum(l_quantity) AS gain")
    top = gain.orderBy(F.desc("gain"), "feature").limit(50)
    return top.selectExpr("*", "row_number() OVER (ORDER BY gain DESC, feature) AS rank").where("rank BETWEEN 2 AND 50")


@query("sorted_bars", using("bars") + "SELECT ticker, date, close FROM bars ORDER BY ticker, date")
def sorted_bars(spark, folder):
    return panels.bars(spark, folder).select("ticker", "date", "close").orderBy("ticker", "date")

"""Dates, sources and assembled tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.rolling import Series, filled
from ..functions.safe import named, rounded
from ..sources import panels, readers
from .registry import query
from .twins import r6, using, week_of

DATES = "(SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) t"


def dates(spark, folder):
    return panels.table(spark, folder, "lineitem").selectExpr("CAST(l_shipdate AS DATE) AS date").distinct()


@query(
    "friday_calendar",
    """SELECT f.friday_date, count(l.l_orderkey) AS shipped
FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-06', DATE '2001-12-28', INTERVAL 7 DAY)) AS DATE) AS friday_date) f
LEFT JOIN lineitem l ON CAST(l.l_shipdate AS DATE) = f.friday_date GROUP BY 1""",
)
def friday_calendar(spark, folder):
    days = cal.fridays(spark, "1995-01-01", "2001-12-31")
    shipped = panels.table(spark, folder, "lineitem").groupBy(F.expr("CAST(l_shipdate AS DATE) AS friday_date")).agg(
        F.count("*").alias("shipped")
    )
    return days.join(shipped, "friday_date", "left").fillna(0, ["shipped"])


@query(
    "date_parts",
    f"""SELECT date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
 CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
 CAST(month(date) AS INTEGER) AS month_of_year, CAST(quarter(date) AS INTEGER) AS quarter_of_year,
 CAST(year(date) AS INTEGER) AS year FROM {DATES}""",
)
def date_parts(spark, folder):
    return dates(spark, folder).selectExpr("date", *named(cal.date_parts()))


@query(
    "cyclical_dates",
    "SELECT date, "
    + ", ".join(
        f"{r6(f'{fn}(2 * pi() * {x} / {p})')} AS {n}_{fn}"
        for n, x, p in (
            ("day_of_year", "dayofyear(date)", "365.25"),
            ("month_of_year", "month(date)", "12.0"),
            ("day_of_week", "(isodow(date) - 1)", "7.0"),
        )
        for fn in ("sin", "cos")
    )
    + f" FROM {DATES}",
)
def cyclical_dates(spark, folder):
    return dates(spark, folder).selectExpr("date", *[f"{rounded(e)} AS {n}" for n, e in cal.cyclical().items()])


_FLAGS = {
    "month_start": "day(date) = 1",
    "month_end": "date = last_day(date)",
    "quarter_start": "date = date_trunc('quarter', date)",
    "quarter_end": "date = CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)",
    "year_start": "dayofyear(date) = 1",
    "year_end": "month(date) = 12 AND day(date) = 31",
}


@query("period_flags", "SELECT date, " + ", ".join(f"({e}) AS {n}" for n, e in _FLAGS.items()) + f" FROM {DATES}")
def period_flags(spark, folder):
    return dates(spark, folder).selectExpr("date", *named(cal.period_flags()))


_F = {n: f"CAST(({e}) AS INTEGER)" for n, e in _FLAGS.items()}
_DAY, _DOW = "CAST(day(date) AS INTEGER)", "CAST(isodow(date) - 1 AS INTEGER)"
_SUMS = (
    {"dow_day": f"{_DOW} + {_DAY}"}
    | {f"{n}_day": f"{e} + {_DAY}" for n, e in _F.items()}
    | {f"{n}_dow": f"{e} + {_DOW}" for n, e in _F.items()}
    | {f"year_end_{n}": f"{_F['year_end']} + {_F[n]}" for n in ("month_start", "month_end", "quarter_start", "quarter_end")}
)


@query("calendar_sums", "SELECT date, " + ", ".join(f"{e} AS {n}" for n, e in _SUMS.items()) + f" FROM {DATES}")
def calendar_sums(spark, folder):
    return dates(spark, folder).selectExpr("date", *named(cal.flag_sums()))


@query(
    "date_keys",
    f"""SELECT date, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, strftime(date, '%Y-%m-%d') AS iso,
 date AS from_key, date AS from_iso, CAST(NULL AS DATE) AS bad FROM {DATES}""",
)
def date_keys(spark, folder):
    d = dates(spark, folder).selectExpr("date", f"{cal.date_key()} AS date_key", "date_format(date, 'yyyy-MM-dd') AS iso")
    return d.selectExpr(
        "*",
        f"{cal.parse_key('date_key')} AS from_key",
        f"{cal.parse_iso('iso')} AS from_iso",
        f"{cal.parse_key('concat(iso, iso)')} AS bad",
    )


@query(
    "recent_fridays",
    f"""SELECT date, CAST(date - CAST((isodow(date) + 2) % 7 AS INTEGER) AS DATE) AS recent_friday,
 CAST(date - CAST((isodow(date) + 2) % 7 AS INTEGER) - 7 AS DATE) AS second_friday, {week_of('date')} AS week_end FROM {DATES}""",
)
def recent_fridays(spark, folder):
    return dates(spark, folder).selectExpr(
        "date",
        f"{cal.recent_friday('date')} AS recent_friday",
        f"{cal.recent_friday('date', 2)} AS second_friday",
        f"{cal.week_end()} AS week_end",
    )


_FIELDS = ("open", "high", "low", "close", "volume")


@query(
    "panel_pivot",
    using("bars", extra=", ".join(f"a{a} AS (SELECT * FROM bars WHERE ticker = {a})" for a in range(7)))
    + "SELECT date, "
    + ", ".join(f"a{a}.{f} AS a{a}_{f}" for a in range(7) for f in _FIELDS)
    + " FROM a0 "
    + " ".join(f"FULL JOIN a{a} USING (date)" for a in range(1, 7)),
)
def panel_pivot(spark, folder):
    return readers.assemble_market(panels.bars(spark, folder), panels.MARKET_ASSETS)


def macro(spark, folder, align):
    m = panels.macro_monthly(spark, folder)
    series = {
        "weekly_orders": panels.macro_weekly(spark, folder).selectExpr("date", "weekly_orders AS value"),
        "order_count": m.selectExpr("date", "order_count AS value"),
        "mean_price": m.selectExpr("date", "mean_price AS value"),
        "urgent_share": m.selectExpr("date", "urgent_share AS value"),
    }
    return readers.assemble_macro(series, align=align)


_MACRO = "date, weekly_orders, order_count, round(mean_price, 6) AS mean_price, round(urgent_share, 6) AS urgent_share"


@query(
    "macro_first_index",
    using("macro_m", "macro_w") + f"SELECT {_MACRO} FROM macro_w LEFT JOIN macro_m USING (date)",
)
def macro_first_index(spark, folder):
    return macro(spark, folder, "first").selectExpr(*_MACRO.split(", ", 3)[:3], "round(mean_price, 6) AS mean_price",
                                                    "round(urgent_share, 6) AS urgent_share")


@query(
    "macro_outer_ffill",
    using("macro_m", "macro_w", extra="j AS (SELECT * FROM macro_w FULL JOIN macro_m USING (date))")
    + "SELECT date, "
    + ", ".join(
        f"round(CAST(coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS DOUBLE), 6) AS {c}"
        for c in ("weekly_orders", "order_count", "mean_price", "urgent_share")
    )
    + " FROM j",
)
def macro_outer_ffill(spark, folder):
    m = macro(spark, folder, "outer").selectExpr("*", "'macro' AS panel")  # one row per week and month
    w = Series("panel", "date")
    return m.selectExpr(
        "date",
        *[f"round(CAST({filled(c, w, causal=False)} AS DOUBLE), 6) AS {c}" for c in m.columns if c not in ("date", "panel")],
    )


@query(
    "range_cutoff",
    using("bars") + "SELECT ticker, date, close FROM bars WHERE date >= DATE '1997-03-01' AND date < DATE '1998-03-01'",
)
def range_cutoff(spark, folder):
    return readers.date_range(panels.bars(spark, folder), "1997-03-01", "1998-03-01").select("ticker", "date", "close")


@query(
    "weekly_last",
    using("bars", extra=f"""
wk AS (SELECT ticker, {week_of('date')} AS week_end, arg_max(close, date) AS close, arg_max(volume, date) AS volume
  FROM bars GROUP BY 1, 2),
grid AS (SELECT ticker, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end
  FROM wk GROUP BY ticker)""")
    + "SELECT ticker, week_end, close, volume FROM grid LEFT JOIN wk USING (ticker, week_end)",
)
def weekly_last(spark, folder):
    return cal.weekly_last(panels.bars(spark, folder), ["close", "volume"], dense=True)


@query("literal_list", "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def literal_list(spark, folder):
    wanted = readers.literal_table(spark, ["1-URGENT", "2-HIGH"], "o_orderpriority")
    o = panels.table(spark, folder, "orders").join(F.broadcast(wanted), "o_orderpriority", "left_semi")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("orders"))

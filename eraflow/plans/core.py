"""Bars, calendar, sources and the flagship weekly signal."""

from __future__ import annotations

from ..functions import calendar as cal
from ..functions.rolling import log_return, roll_mean
from ..functions.safe import rounded
from ..sources import panels
from ..sources.panels import DAILY
from .registry import query
from .twins import frame, r6, using, week_of


@query(
    "flagship_weekly_signal",
    using("bars", "dim", extra=f"""
signal AS (SELECT ticker, date, close,
    CASE WHEN count(close) OVER w5 >= 5 THEN avg(close) OVER w5 END AS sma5,
    ln(close) - ln(lag(close) OVER w) AS lret
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date), w5 AS {frame(5)}),
weekly_signal AS (SELECT ticker, {week_of('date')} AS week_end, arg_max(close, date) AS close,
    arg_max(sma5, date) AS sma5, arg_max(lret, date) AS lret FROM signal GROUP BY 1, 2)""")
    + f"""SELECT s.ticker, s.week_end, d.sector, d.country, s.close, {r6('s.sma5')} AS sma5, {r6('s.lret')} AS lret
FROM weekly_signal s LEFT JOIN dim d USING (ticker) WHERE s.sma5 IS NOT NULL AND s.close > s.sma5""",
)
def flagship_weekly_signal(spark, folder):
    b = panels.bars(spark, folder).selectExpr(
        "*", f"{roll_mean('close', 5, DAILY)} AS sma5", f"{log_return('close', DAILY)} AS lret"
    )
    week = cal.weekly_last(b, ["close", "sma5", "lret"]).where("sma5 IS NOT NULL AND close > sma5")
    dim = panels.attributes(spark, folder).select("ticker", "sector", "country")
    return week.join(dim, "ticker", "left").selectExpr(
        "ticker", "week_end", "sector", "country", "close", f"{rounded('sma5')} AS sma5", f"{rounded('lret')} AS lret"
    )


@query("bars_daily", using("bars") + "SELECT * FROM bars")
def bars_daily(spark, folder):
    return panels.bars(spark, folder)


@query("labels_weekly", using("labels_w") + "SELECT ticker, week_end, data_type, target, round(fwd, 6) AS fwd FROM labels_w")
def labels_weekly(spark, folder):
    return panels.labels_weekly(spark, folder).selectExpr("ticker", "week_end", "data_type", "target", "round(fwd, 6) AS fwd")


@query("predictions_weekly", using("preds") + "SELECT * FROM preds")
def predictions_weekly(spark, folder):
    return panels.predictions(spark, folder)

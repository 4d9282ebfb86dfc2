"""Streaming extensions next to their batch definition in SQL."""

from __future__ import annotations

from ..streaming import events
from .registry import query
from .twins import week_of


@query(
    "stream_daily_bars",
    """SELECT user_id AS ticker, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2""",
)
def stream_daily_bars(spark, folder):
    return events.bars_table(spark, folder)


@query(
    "stream_weekly_last",
    f"SELECT user_id AS ticker, {week_of('CAST(ts AS DATE)')} AS week_end, arg_max(value, ts) AS close FROM events GROUP BY 1, 2",
)
def stream_weekly_last(spark, folder):
    return events.weekly_table(spark, folder)


@query(
    "stream_dedup",
    "SELECT user_id, event_type, CAST(ts AS DATE) AS day, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1, 2, 3",
)
def stream_dedup(spark, folder):
    return events.first_table(spark, folder)

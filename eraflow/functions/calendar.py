"""Dates: the Friday week key, date parts, cyclical encodings, period flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def week_end(d: str = "date") -> str:
    """Friday that closes the Saturday-to-Friday week of a date."""
    return f"next_day(date_sub({d}, 1), 'FRI')"


def recent_friday(d: str, back: int = 1) -> str:
    """Latest Friday not after the date (back=1), the one before it (back=2), ..."""
    return f"date_sub(next_day({d}, 'FRI'), {7 * back})"


def fridays(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All Fridays in [start, end], generated on the executors."""
    first, stop = week_end(f"DATE'{start}'"), f"DATE'{end}'"
    return spark.range(1).selectExpr(
        f"explode(CASE WHEN {first} <= {stop} THEN sequence({first}, {stop}, INTERVAL 7 DAYS) END) AS friday_date"
    )


def date_key(d: str = "date") -> str:
    """Date to integer yyyymmdd."""
    return f"(year({d}) * 10000 + month({d}) * 100 + dayofmonth({d}))"


def parse_key(x: str) -> str:
    """yyyymmdd integer or text to date; unparsable input is NULL."""
    return f"CAST(try_to_timestamp(CAST({x} AS STRING), 'yyyyMMdd') AS DATE)"


def parse_iso(x: str) -> str:
    return f"CAST(try_to_timestamp({x}, 'yyyy-MM-dd') AS DATE)"


def date_parts(d: str = "date") -> dict[str, str]:
    return {
        "day_of_week": f"weekday({d})",
        "day_of_month": f"dayofmonth({d})",
        "day_of_year": f"dayofyear({d})",
        "week_of_year": f"weekofyear({d})",
        "month_of_year": f"month({d})",
        "quarter_of_year": f"quarter({d})",
        "year": f"year({d})",
    }


def cyclical(d: str = "date") -> dict[str, str]:
    parts = date_parts(d)
    out = {}
    for name, period in {"day_of_year": "365.25D", "month_of_year": "12D", "day_of_week": "7D"}.items():
        for fn in ("sin", "cos"):
            out[f"{name}_{fn}"] = f"{fn}(2 * pi() * {parts[name]} / {period})"
    return out


def period_flags(d: str = "date") -> dict[str, str]:
    return {
        "month_start": f"({d} = trunc({d}, 'MM'))",
        "month_end": f"({d} = last_day({d}))",
        "quarter_start": f"({d} = trunc({d}, 'QUARTER'))",
        "quarter_end": f"({d} = last_day(add_months(trunc({d}, 'QUARTER'), 2)))",
        "year_start": f"({d} = trunc({d}, 'YEAR'))",
        "year_end": f"({d} = last_day(add_months(trunc({d}, 'YEAR'), 11)))",
    }


def flag_sums(d: str = "date") -> dict[str, str]:
    """The 17 sums of period flags, day of month and day of week."""
    flags = {k: f"CAST({v} AS INT)" for k, v in period_flags(d).items()}
    day, dow = f"dayofmonth({d})", f"weekday({d})"
    out = {"dow_day": f"{dow} + {day}"}
    out |= {f"{k}_day": f"{v} + {day}" for k, v in flags.items()}
    out |= {f"{k}_dow": f"{v} + {dow}" for k, v in flags.items()}
    for other in ("month_start", "month_end", "quarter_start", "quarter_end"):
        out[f"year_end_{other}"] = f"{flags['year_end']} + {flags[other]}"
    return out


def weekly_last(df: DataFrame, cols: Sequence[str], by: str = "ticker", at: str = "date", dense: bool = False) -> DataFrame:
    """Last non-null value of each column per key and Friday week.

    ``max_by`` on a fixed-width time combines before the shuffle. dense=True also
    returns, as NULL rows, the weeks inside a key's span that have no rows.
    """
    aggs = [F.expr(f"max_by({c}, CASE WHEN {c} IS NOT NULL THEN {at} END) AS {c}") for c in cols]
    keyed = df.groupBy(by, F.expr(f"{week_end(at)} AS week_end"))
    weekly = keyed.agg(*aggs)
    if not dense:
        return weekly
    span = df.groupBy(by).agg(F.expr(f"min({week_end(at)}) AS _a"), F.expr(f"max({week_end(at)}) AS _b"))
    grid = span.selectExpr(by, "explode(sequence(_a, _b, INTERVAL 7 DAYS)) AS week_end")
    return grid.join(weekly, [by, "week_end"], "left")

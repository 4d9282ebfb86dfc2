"""Exponentially weighted means, and the indicators built on them.

A weighted mean with decay d = 1 - alpha follows num(t) = d * num(t - 1) + x(t). All
means of a call run this recurrence side by side in one pass over the series (see
``packs``): linear in the history, exact to double precision, and the only rows that
are shuffled and sorted are the thin input rows, however many means are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import packs
from .rolling import Series

_FORGET = 46.0  # -ln(1e-20)


@dataclass(frozen=True)
class Ewm:
    """One weighted mean: ``out`` = mean of ``src`` with smoothing ``alpha``.

    adjust=True divides by the sum of weights; a hole lets older weights decay.
    adjust=False starts the recurrence at the first value. Over a hole that
    recurrence has no agreed meaning, so a missing value after the first one is
    an error when the query runs.
    """

    out: str
    src: str
    alpha: float
    adjust: bool = True
    min_periods: int = 1


def by_span(out: str, src: str, span: float, adjust: bool = True, min_periods: int = 1) -> Ewm:
    return Ewm(out, src, 2.0 / (span + 1.0), adjust, min_periods)


def wilder(out: str, src: str, period: int) -> Ewm:
    return Ewm(out, src, 1.0 / period, True, period)


def block_length(alpha: float) -> int:
    rate = -math.log1p(-alpha)
    length = 4.0
    while length * rate < _FORGET:
        length *= 12
    return int(length)


def add_ewm(df: DataFrame, specs: Sequence[Ewm], w: Series = Series()) -> DataFrame:
    """Append every requested weighted mean; all of them share one shuffle by key. Asking for more never changes a column."""
    return packs.add_packs(df, [packs.means(specs)], w)


# ---- compositions -------------------------------------------------------------------------


def add_rsi_wilder(df: DataFrame, src: str, periods: Sequence[int], out: str = "rsi", w: Series = Series()) -> DataFrame:
    """Wilder RSI of one column for many periods: 100 without losses, NULL when flat."""
    return packs.add_packs(df, [packs.rsi_wilder(src, periods, out)], w)


def add_macd(
    df: DataFrame,
    src: str,
    triples: Sequence[tuple[int, int, int]],
    percent: bool = False,
    out: str = "macd",
    w: Series = Series(),
) -> DataFrame:
    """MACD line, signal and histogram per (fast, slow, signal).

    percent=False: difference of recursive means. percent=True: 100 * difference
    over the slow mean, all means in the normalised form.
    """
    return packs.add_packs(df, [packs.macd(src, triples, percent, out)], w)


def add_atr(df: DataFrame, periods: Sequence[int], w: Series = Series()) -> DataFrame:
    """Recursive mean of the true range."""
    return packs.add_packs(df, [packs.atr(periods)], w)

"""Per-series windows: lags, changes and rolling statistics.

Every function takes a :class:`Series`. Expressions that share its key and order
are planned into the same Window operator: one shuffle and one sort serve all.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .safe import div, ln, log1p

#: Horizons of the long return / volatility / gap packs.
HORIZONS = (
    list(range(4, 50))
    + [51, 52, 53, 54, 55, 57, 60, 80, 89]
    + list(range(100, 115))
    + [120, 130, 144, 150, 160, 170, 180, 190, 200, 210, 220, 250, 270, 300]
)
#: Lag steps of the bulk lag expansion.
LAG_STEPS = list(range(1, 21)) + list(range(30, 101, 10))
#: Windows of the rolling statistics bundle.
STAT_WINDOWS = [5, 10, 20, 30, 50, 100, 200]


@dataclass(frozen=True)
class Series:
    """Rows of one key in time order; (by, at) is unique."""

    by: str = "ticker"
    at: str = "date"

    @property
    def over(self) -> str:
        return f"OVER (PARTITION BY {self.by} ORDER BY {self.at})"

    def rows(self, start: int | None, end: int | None) -> str:
        return (
            f"OVER (PARTITION BY {self.by} ORDER BY {self.at} "
            f"ROWS BETWEEN {_bound(start, 'PRECEDING')} AND {_bound(end, 'FOLLOWING')})"
        )

    def last_n(self, n: int) -> str:
        return self.rows(-(n - 1), 0)

    @property
    def so_far(self) -> str:
        return self.rows(None, 0)

    @property
    def ahead(self) -> str:
        return self.rows(0, None)

    @property
    def whole(self) -> str:
        return self.rows(None, None)


def _bound(n: int | None, side: str) -> str:
    if n is None:
        return f"UNBOUNDED {side}"
    return "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"


def lag(x: str, k: int, w: Series) -> str:
    return f"lag({x}, {k}) {w.over}"


def lead(x: str, k: int, w: Series) -> str:
    return f"lead({x}, {k}) {w.over}"


def diff(x: str, w: Series, k: int = 1) -> str:
    return f"({x} - {lag(x, k, w)})"


def filled_forward(x: str, w: Series) -> str:
    return f"last({x}, true) {w.so_far}"


def filled_backward(x: str, w: Series) -> str:
    return f"first({x}, true) {w.ahead}"


def filled(x: str, w: Series, causal: bool = True, default: str = "0") -> str:
    """Forward fill; causal=False then fills the head from later rows; then a default."""
    if causal:
        return filled_forward(x, w)
    return f"coalesce({filled_forward(x, w)}, {filled_backward(x, w)}, {default})"


def pct_change(x: str, k: int, w: Series) -> str:
    """x / x[k rows before] - 1. Inputs with holes are padded by the caller first."""
    return f"({div(x, lag(x, k, w))} - 1)"


def log_return(x: str, w: Series, k: int = 1) -> str:
    return f"({ln(x)} - {ln(lag(x, k, w))})"


def gated(x: str, stat: str, n: int, w: Series, min_periods: int | None) -> str:
    """A statistic of the last n rows, NULL below ``min_periods`` (default n) present values."""
    need = n if min_periods is None else min_periods
    if need <= 1:
        return stat  # aggregates of no value are NULL anyway
    return f"CASE WHEN count({x}) {w.last_n(n)} >= {need} THEN {stat} END"


def roll(fn: str, x: str, n: int, w: Series, min_periods: int | None = None) -> str:
    return gated(x, f"{fn}({x}) {w.last_n(n)}", n, w, min_periods)


def roll_mean(x: str, n: int, w: Series, min_periods: int | None = None) -> str:
    return roll("avg", x, n, w, min_periods)


def roll_std(x: str, n: int, w: Series, min_periods: int | None = None) -> str:
    return roll("stddev_samp", x, n, w, min_periods)


def roll_median(x: str, n: int, w: Series, min_periods: int | None = None) -> str:
    return gated(x, f"percentile({x}, 0.5D) {w.last_n(n)}", n, w, min_periods)


def roll_min(x: str, n: int, w: Series, min_periods: int | None = None) -> str:
    return roll("min", x, n, w, min_periods)


def roll_max(x: str, n: int, w: Series, min_periods: int | None = None) -> str:
    return roll("max", x, n, w, min_periods)


def roll_corr(a: str, b: str, n: int, w: Series, min_periods: int | None = None) -> str:
    """Rolling Pearson correlation over rows where both series are present."""
    need = max(2, n if min_periods is None else min_periods)
    a2, b2 = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    f = w.last_n(n)
    return (
        f"CASE WHEN count({a} + {b}) {f} >= {need} AND stddev_pop({a2}) {f} > 0 AND stddev_pop({b2}) {f} > 0 "
        f"THEN corr({a}, {b}) {f} END"
    )


def shifted_range(x: str, w: Series, n: int = 30) -> dict[str, str]:
    """Max, min and mean of the n rows before the current one and the ratios to them."""
    f = w.rows(-n, -1)
    out = {f"{name}{n}_{x}": f"{fn}({x}) {f}" for name, fn in (("max", "max"), ("min", "min"), ("mean", "avg"))}
    return out | {f"{name}{n}_range": div(x, out[f"{name}{n}_{x}"]) for name in ("max", "min", "mean")}


def rolling_stats(
    cols: Iterable[str], windows: Iterable[int] = tuple(STAT_WINDOWS), w: Series = Series(), median: bool = True
) -> dict[str, str]:
    """Mean, std, min, max and median per window with min_periods = max(1, n // 2)."""
    fns = {"mean": roll_mean, "std": roll_std, "min": roll_min, "max": roll_max}
    if median:
        fns["median"] = roll_median
    return {f"{c}_{k}_{n}": fn(c, n, w, max(1, n // 2)) for c in cols for n in windows for k, fn in fns.items()}


def horizon_pack(
    df: DataFrame,
    cols: Sequence[str],
    horizons: Sequence[int] = tuple(HORIZONS),
    w: Series = Series(),
    absolute: bool = True,
    second_order: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Return, |return|, volatility and mean gap of each column for many horizons.

    The mean comes from running sums of the values. The deviation of the one-step
    changes is taken over the window's own rows: differences of running squares
    would lose all digits for the rest of a series after one large change.
    second_order=True takes the change of the change.
    """
    base = list(keep) or df.columns
    step = df.selectExpr("*", *[f"{pct_change(log1p(c), 1, w)} AS _d_{c}" for c in cols])
    d = "_d"
    if second_order:
        step = step.selectExpr("*", *[f"{pct_change(f'_d_{c}', 1, w)} AS _dd_{c}" for c in cols])
        d = "_dd"
    out = []
    for c in cols:
        for n in horizons:
            ret = f"({div(c, lag(c, n, w))} - 1)"
            out.append(f"{ret} AS {c}_return_{n}")
            if absolute:
                out.append(f"abs({ret}) AS {c}_return_abs_{n}")
            out.append(f"{roll_std(f'{d}_{c}', n, w)} AS {c}_volatility_{n}")
            out.append(f"{div(c, f'({roll_mean(c, n, w)})')} AS {c}_gap_{n}")
    return step.selectExpr(*base, *out)


def lags(cols: Sequence[str], steps: Sequence[int] = tuple(LAG_STEPS), w: Series = Series()) -> dict[str, str]:
    return {f"{c}_lag_{k}": lag(c, k, w) for c in cols for k in steps}


def lags_long(df: DataFrame, cols: Sequence[str], steps: Sequence[int] = tuple(LAG_STEPS), w: Series = Series()) -> DataFrame:
    """Lags of a very wide table in long form: one row per (key, time, feature).

    All features of a row move together, so a lag is one expression however many there are
    and the shuffle and sort hold the rows before they are turned into long form.
    """
    row = f"struct({', '.join(cols)})"
    moved = df.select(w.by, w.at, *cols).selectExpr("*", *[f"{lag(row, k, w)} AS _lag_{k}" for k in steps])
    parts = [f"struct('{c}' AS feature, {c} AS value, {', '.join(f'_lag_{k}.{c} AS lag_{k}' for k in steps)})" for c in cols]
    return moved.selectExpr(w.by, w.at, f"inline(array({', '.join(parts)}))")

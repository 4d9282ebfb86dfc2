"""Named per-series indicators that need only lags and sliding frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .rolling import Series, diff, lag, log_return, pct_change, roll_max, roll_mean, roll_min, roll_std
from .safe import div, ln, log1p, num

#: Parameter lists of the indicator sets.
PRICE_WINDOWS = [5, 10, 20, 30, 50, 100, 200]
RSI_PERIODS = [7, 14, 21, 30]
BAND_WINDOWS = [10, 20, 50]
BAND_WIDTHS = [1.5, 2.0, 2.5]
ROC_PERIODS = [5, 10, 20, 30, 60, 90]
STOCH_SMOOTH = [3, 5]
MACD_FAST, MACD_SLOW, MACD_SIGNAL = [6, 12, 26], [13, 26, 52], [5, 9, 13]
MACD_ABS = [(f, s, g) for f in MACD_FAST for s in MACD_SLOW if s > f for g in MACD_SIGNAL]
MACD_PCT = [
    (12, 26, 9), (10, 24, 8), (20, 48, 16), (30, 72, 24),
    (40, 96, 32), (52, 128, 36), (52, 128, 48), (60, 128, 48),
]
WILDER_PERIODS = list(range(2, 15)) + [20, 40, 60, 80, 100, 120, 140]
EMA_SPANS = list(range(3, 17)) + [20, 40, 60, 80]

DAILY = Series()


def add_rsi_simple(df: DataFrame, src: str = "close", periods: Sequence[int] = tuple(RSI_PERIODS), w: Series = DAILY) -> DataFrame:
    """RSI on plain rolling means; 100 where there is no loss to divide by."""
    names = df.columns
    work = df.selectExpr("*", f"{diff(src, w)} AS _chg").selectExpr(
        "*",
        "CASE WHEN _chg IS NOT NULL THEN greatest(_chg, 0D) END AS _up",
        "CASE WHEN _chg IS NOT NULL THEN greatest(-_chg, 0D) END AS _down",
    )
    work = work.selectExpr("*", *[f"avg({c}) {w.last_n(p)} AS {c}{p}" for p in periods for c in ("_up", "_down")])
    rsi = [f"CASE WHEN _down{p} > 0 THEN 100 - 100 / (1 + _up{p} / _down{p}) ELSE 100D END AS rsi_{p}" for p in periods]
    return work.selectExpr(*names, *rsi)


def add_bollinger(df: DataFrame, src: str = "close", windows=tuple(BAND_WINDOWS), widths=tuple(BAND_WIDTHS), w: Series = DAILY) -> DataFrame:
    """Upper and lower band, basis and relative width. Mean and deviation of a window are computed once."""
    names = df.columns
    base = [f"{roll_mean(src, n, w, 1)} AS _mid{n}" for n in windows] + [f"{roll_std(src, n, w, 1)} AS _dev{n}" for n in windows]
    out = []
    for n in windows:
        for k in widths:
            tag = f"{n}_{str(k).replace('.', 'p')}"
            up, low = f"(_mid{n} + _dev{n} * {num(k)})", f"(_mid{n} - _dev{n} * {num(k)})"
            out += [
                f"{up} AS bb_upper_{tag}",
                f"{low} AS bb_lower_{tag}",
                f"_mid{n} AS bb_basis_{tag}",
                f"{div(f'{up} - {low}', f'_mid{n}', 0.0)} AS bb_width_{tag}",
            ]
    return df.selectExpr("*", *base).selectExpr(*names, *out)


def bollinger_names(windows=tuple(BAND_WINDOWS), widths=tuple(BAND_WIDTHS)) -> list[str]:
    return [f"bb_{k}_{n}_{str(x).replace('.', 'p')}" for n in windows for x in widths for k in ("upper", "lower", "basis", "width")]


def roc(src: str = "close", periods=tuple(ROC_PERIODS), w: Series = DAILY) -> dict[str, str]:
    return {f"roc_{k}": f"{div(diff(src, w, k), lag(src, k, w), 0.0)} * 100" for k in periods}


def add_stochastic(df: DataFrame, periods=tuple(RSI_PERIODS), smooth=tuple(STOCH_SMOOTH), w: Series = DAILY) -> DataFrame:
    names = df.columns
    base = [f"{roll_min('low', n, w, 1)} AS _lo{n}" for n in periods] + [f"{roll_max('high', n, w, 1)} AS _hi{n}" for n in periods]
    k = [f"{div(f'close - _lo{n}', f'_hi{n} - _lo{n}', 0.5)} * 100 AS stoch_k_{n}" for n in periods]
    d = [f"{roll_mean(f'stoch_k_{n}', m, w, 1)} AS stoch_d_{n}_{m}" for n in periods for m in smooth]
    return df.selectExpr("*", *base).selectExpr(*names, *k).selectExpr("*", *d)


def sma(cols=("close", "volume"), windows=tuple(PRICE_WINDOWS), w: Series = DAILY) -> dict[str, str]:
    return {f"{c}_sma_{n}": roll_mean(c, n, w, 1) for c in cols for n in windows}


def volume_change(w: Series = DAILY) -> str:
    return f"{div(diff('volume', w), lag('volume', 1, w), 0.0)} * 100"


def bar_basics() -> dict[str, str]:
    return {
        "price_range": "high - low",
        "ochl_ratio": div("open - close", "high - low", 0.0),
        "close_times_volume": "close * volume",
    }


def add_log1p_volatility(df: DataFrame, windows: Sequence[int], src: str = "close", w: Series = DAILY) -> DataFrame:
    """Std of the relative change of log1p(price), and of the change of that change."""
    names = df.columns
    work = df.selectExpr("*", f"{pct_change(log1p(src), 1, w)} AS _c1")
    work = work.selectExpr("*", f"{pct_change('_c1', 1, w)} AS _c2")
    return work.selectExpr(
        *names,
        *[f"{roll_std('_c1', n, w)} AS volatility_{n}" for n in windows],
        *[f"{roll_std('_c2', n, w)} AS volatility_change_{n}" for n in windows],
    )


def mean_gap(src: str, windows: Sequence[int], w: Series = DAILY) -> dict[str, str]:
    return {f"{src}_gap_{n}": div(src, roll_mean(src, n, w)) for n in windows}


def add_monthly_pack(df: DataFrame, src: str = "close", w: Series = DAILY) -> DataFrame:
    """One, two and three month (20/40/60 rows) return, log-return volatility and mean gap."""
    names = df.columns
    out = [f"{pct_change(src, 251, w)} AS return_251"]
    for months in (1, 2, 3):
        n = 20 * months
        out += [
            f"{pct_change(src, n, w)} AS return_{months}month",
            f"{roll_std('_lr', n, w)} AS volatility_{months}month",
            f"{div(src, roll_mean(src, n, w))} AS gap_{months}month",
        ]
    return df.selectExpr("*", f"{log_return(src, w)} AS _lr").selectExpr(*names, *out)


def derived_series(w: Series = DAILY) -> dict[str, str]:
    """Log returns of every bar field, money volume, market cap (thousands), day ranges."""
    out = {f"lret_{c}": log_return(c, w) for c in ("close", "open", "low", "high", "volume")}
    out["lret_money"] = log_return("close * volume", w)
    out["money_volume"] = "close * volume"
    out["market_cap"] = "shares * close / 1000"
    out["daily_range"] = "close - open"
    out |= {f"daily_range_{k}": f"close - {lag('open', k, w)}" for k in (1, 2, 3)}
    return out


def money_volume_lags(steps=range(1, 11), w: Series = DAILY) -> dict[str, str]:
    return {f"money_volume_{k}": f"{lag('volume', k, w)} * {lag('close', k, w)}" for k in steps}


# ---- statistics over the history of a series ----------------------------------------------


def history(w: Series, causal: bool) -> str:
    """Frame up to now, or (causal=False) over the whole series including later rows."""
    return w.so_far if causal else w.whole


def history_zscore(x: str, causal: bool = True, propagate_null: bool = False, w: Series = DAILY) -> str:
    """(x - mean) / population std of the series."""
    f = history(w, causal)
    z = div(f"{x} - avg({x}) {f}", f"stddev_pop({x}) {f}")
    return f"CASE WHEN count({x}) {f} = count(*) {f} THEN {z} END" if propagate_null else z


def history_std(x: str, causal: bool = True, w: Series = DAILY) -> str:
    return f"stddev_samp({x}) {history(w, causal)}"


def adjusted_skew(n: str, g1: str) -> str:
    return f"CASE WHEN {n} >= 3 THEN {g1} * sqrt({n} * ({n} - 1)) / nullif({n} - 2, 0) END"


def adjusted_kurtosis(n: str, g2: str) -> str:
    return (
        f"CASE WHEN {n} >= 4 THEN ({n} - 1) / nullif(({n} - 2) * ({n} - 3), 0) * (({n} + 1) * {g2} + 6) END"
    )


def history_skew(x: str, causal: bool = True, w: Series = DAILY) -> str:
    f = history(w, causal)
    return adjusted_skew(f"count({x}) {f}", f"nullif(skewness({x}) {f}, double('NaN'))")


def realized_volatility(x: str, causal: bool = True, w: Series = DAILY) -> str:
    return f"sqrt(sum({x} * {x}) {history(w, causal)})"


# ---- one-bar shapes -----------------------------------------------------------------------


def add_bar_moments(df: DataFrame, prices: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """Mean, median, adjusted skew and kurtosis of the four prices of a bar."""
    names = df.columns
    total, every = " + ".join(prices), ", ".join(prices)
    work = df.selectExpr("*", f"({total}) / 4 AS bar_mean", f"(({total}) - greatest({every}) - least({every})) / 2 AS bar_median")
    powers = {k: " + ".join(f"pow({p} - bar_mean, {num(k)})" for p in prices) for k in (2, 3, 4)}
    work = work.selectExpr("*", *[f"({e}) / 4 AS _m{k}" for k, e in powers.items()])
    return work.selectExpr(
        *names,
        "bar_mean",
        "bar_median",
        f"{adjusted_skew('4', div('_m3', 'pow(_m2, 1.5D)'))} AS bar_skew",
        f"{adjusted_kurtosis('4', '(' + div('_m4', '_m2 * _m2') + ' - 3)')} AS bar_kurtosis",
        f"({prices[0]} + {prices[3]}) / 2 AS open_close_mean",
    )


def candle_shape(w: Series = DAILY) -> dict[str, str]:
    return {
        "high_low": "high - low",
        "close_open": "close - open",
        "close_over_open": div("close", "open"),
        "upper_shadow": "high - greatest(close, open)",
        "lower_shadow": "least(close, open) - low",
        "range_over_body": div("high - low", "close - open"),
        "open_close": "open - close",
        "prev_close_open": f"{lag('close', 1, w)} - open",
    }


def bar_ratios() -> dict[str, str]:
    """Ratios of a bar's fields; needs bar_mean and bar_median."""
    return {
        "high_to_mean": div("high", "bar_mean"),
        "low_to_mean": div("low", "bar_mean"),
        "high_to_median": div("high", "bar_median"),
        "low_to_median": div("low", "bar_median"),
        "volume_share": div("volume", "volume + 1"),
        "volume_to_close": div("volume", "close"),
        "hl_spread": ln(div("high - low", "close")),
        "co_spread": div("close - open", "open"),
        "log_volume": ln("volume"),
        "high_to_body": div("high", "greatest(close, open)"),
        "body_to_low": div("least(close, open)", "low"),
        "high_to_low": div("high", "low"),
    }

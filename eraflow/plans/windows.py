"""Lags, changes, rolling statistics and the indicators built on sliding frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grouped, moments, packs
from ..functions import indicators as ind
from ..functions import rolling as rl
from ..functions.safe import log1p, named, rounded
from ..operators.clean import probe_columns
from ..sources import panels
from ..sources.panels import DAILY
from .registry import query
from .twins import frame, r6, using

B = using("bars")


def rounding(exprs, digits=6):
    return [f"{rounded(e, digits)} AS {n}" for n, e in exprs.items()]


def sql_rounding(exprs, digits=6):
    return ", ".join(f"{r6(e, digits)} AS {n}" for n, e in exprs.items())


def keys_and(df, exprs, digits=6):
    return df.selectExpr("ticker", "date", *rounding(exprs, digits))


RAW = ("ticker", "date", "open", "high", "low", "close", "volume")


def rounded_columns(df, digits=6):
    return df.selectExpr("ticker", "date", *[f"{rounded(c, digits)} AS {c}" for c in df.columns if c not in RAW])


def singles(df):
    """Single precision: means of 2**k prices are exact decimal halves, which decimal rounding treats differently."""
    return df.selectExpr("ticker", "date", *[f"CAST({c} AS FLOAT) AS {c}" for c in df.columns if c not in RAW])


def sql_singles(exprs):
    return ", ".join(f"CAST({e} AS FLOAT) AS {n}" for n, e in exprs.items())


W = "(PARTITION BY ticker ORDER BY date)"


_OHLCV = ["open", "high", "low", "close", "volume"]


@query("lags", B + "SELECT ticker, date, " + ", ".join(f"lag({c}, {k}) OVER {W} AS {c}_lag_{k}" for c in _OHLCV for k in rl.LAG_STEPS) + " FROM bars")
def lags(spark, folder):
    return packs.add_packs(panels.bars(spark, folder), [packs.lags(_OHLCV, rl.LAG_STEPS)], DAILY, ["ticker", "date"])


@query(
    "lags_long",
    using("bars", extra="l AS (" + " UNION ALL ".join(f"SELECT ticker, date, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM bars" for c in _OHLCV) + ")")
    + "SELECT ticker, date, feature, value, " + ", ".join(f"lag(value, {k}) OVER (PARTITION BY ticker, feature ORDER BY date) AS lag_{k}" for k in rl.LAG_STEPS) + " FROM l",
)
def lags_long(spark, folder):
    return rl.lags_long(panels.bars(spark, folder).withColumn("volume", F.col("volume").cast("double")), _OHLCV)


@query("first_difference", B + f"SELECT ticker, date, {r6('close - lag(close) OVER ' + W)} AS diff_1 FROM bars")
def first_difference(spark, folder):
    return keys_and(panels.bars(spark, folder), {"diff_1": rl.diff("close", DAILY)})


_K = list(rl.HORIZONS)


@query(
    "pct_changes",
    B + "SELECT ticker, date, " + sql_singles({f"ret_{k}": f"close / lag(close, {k}) OVER {W} - 1" for k in _K} | {f"abs_ret_{k}": f"abs(close / lag(close, {k}) OVER {W} - 1)" for k in _K}) + " FROM bars",
)
def pct_changes(spark, folder):
    return packs.add_packs(panels.bars(spark, folder), [packs.changes("close", _K)], DAILY, ["ticker", "date"])


@query("log_returns", B + "SELECT ticker, date, " + sql_rounding({f"lret_{k}": f"ln(close) - ln(lag(close, {k}) OVER {W})" for k in (1, 2, 3)}) + " FROM bars")
def log_returns(spark, folder):
    return keys_and(panels.bars(spark, folder), {f"lret_{k}": rl.log_return("close", DAILY, k) for k in (1, 2, 3)})


def _gate(fn, x, n, mp):
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {mp} THEN {fn}({x}) OVER {frame(n)} END"


_STAT = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
_STAT5 = _STAT | {"median": "median"}


@query(
    "rolling_stats",
    B + "SELECT ticker, date, " + sql_singles({f"close_{k}_{n}": _gate(f, "close", n, max(1, n // 2)) for n in rl.STAT_WINDOWS for k, f in _STAT5.items()}) + " FROM bars",
)
def rolling_stats(spark, folder):
    b = panels.bars(spark, folder)
    return singles(moments.add_rolling_stats(b.select("ticker", "date", "close"), ["close"]))


@query(
    "rolling_frames",
    B + "SELECT ticker, date, " + sql_singles({f"volume_{k}_{n}": _gate(f, "volume", n, max(1, n // 2)) for n in (5, 10, 20) for k, f in _STAT.items()}) + " FROM bars",
)
def rolling_frames(spark, folder):
    """The same bundle from Window frames."""
    b = panels.bars(spark, folder)
    return singles(b.selectExpr("ticker", "date", *named(rl.rolling_stats(["volume"], (5, 10, 20), median=False))))


@query("rolling_median", B + "SELECT ticker, date, " + sql_rounding({f"close_median_{n}": _gate("median", "close", n, max(1, n // 2)) for n in rl.STAT_WINDOWS}) + " FROM bars")
def rolling_median(spark, folder):
    m = packs.add_packs(panels.bars(spark, folder), [packs.medians("close", rl.STAT_WINDOWS)], DAILY, ["ticker", "date"])
    return rounded_columns(m)


@query(
    "range30",
    B + "SELECT ticker, date, " + sql_rounding(
        {"max30_close": "max(close) OVER w", "min30_close": "min(close) OVER w", "mean30_close": "avg(close) OVER w",
         "max30_range": "close / max(close) OVER w", "min30_range": "close / min(close) OVER w", "mean30_range": "close / avg(close) OVER w"})
    + " FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)",
)
def range30(spark, folder):
    return keys_and(panels.bars(spark, folder), rl.shifted_range("close", DAILY))


_RSI = using("bars", extra=f"d AS (SELECT ticker, date, close - lag(close) OVER {W} AS c FROM bars)")


@query(
    "rsi_simple",
    _RSI + "SELECT ticker, date, " + sql_rounding({
        f"rsi_{p}": f"CASE WHEN avg(greatest(-c, 0)) OVER {frame(p)} > 0 THEN 100 - 100 / (1 + avg(greatest(c, 0)) OVER {frame(p)} / avg(greatest(-c, 0)) OVER {frame(p)}) ELSE 100 END"
        for p in ind.RSI_PERIODS}) + " FROM d",
)
def rsi_simple(spark, folder):
    return rounded_columns(ind.add_rsi_simple(panels.bars(spark, folder).select("ticker", "date", "close")))


def _bb():
    out = {}
    for n in ind.BAND_WINDOWS:
        m, s = f"avg(close) OVER {frame(n)}", f"stddev_samp(close) OVER {frame(n)}"
        for k in ind.BAND_WIDTHS:
            t = f"{n}_{str(k).replace('.', 'p')}"
            out |= {f"bb_upper_{t}": f"{m} + {s} * {k}", f"bb_lower_{t}": f"{m} - {s} * {k}", f"bb_basis_{t}": m,
                    f"bb_width_{t}": f"coalesce((({m} + {s} * {k}) - ({m} - {s} * {k})) / nullif({m}, 0), 0)"}
    return out


@query("bollinger", B + "SELECT ticker, date, " + sql_singles(_bb()) + " FROM bars")
def bollinger(spark, folder):
    return singles(ind.add_bollinger(panels.bars(spark, folder)))


@query("roc", B + "SELECT ticker, date, " + sql_rounding({f"roc_{k}": f"coalesce((close - lag(close, {k}) OVER {W}) / lag(close, {k}) OVER {W}, 0) * 100" for k in ind.ROC_PERIODS}) + " FROM bars")
def roc(spark, folder):
    return keys_and(panels.bars(spark, folder), ind.roc())


_KSQL = using("bars", extra="k AS (SELECT ticker, date, " + ", ".join(
    f"coalesce((close - min(low) OVER {frame(n)}) / nullif(max(high) OVER {frame(n)} - min(low) OVER {frame(n)}, 0), 0.5) * 100 AS k{n}" for n in ind.RSI_PERIODS) + " FROM bars)")


@query(
    "stochastic",
    _KSQL + "SELECT ticker, date, " + sql_rounding({f"stoch_k_{n}": f"k{n}" for n in ind.RSI_PERIODS} | {f"stoch_d_{n}_{m}": f"avg(k{n}) OVER {frame(m)}" for n in ind.RSI_PERIODS for m in ind.STOCH_SMOOTH}) + " FROM k",
)
def stochastic(spark, folder):
    return rounded_columns(ind.add_stochastic(panels.bars(spark, folder)))


@query("sma", B + "SELECT ticker, date, " + sql_singles({f"{c}_sma_{n}": f"avg({c}) OVER {frame(n)}" for c in ("close", "volume") for n in ind.PRICE_WINDOWS}) + " FROM bars")
def sma(spark, folder):
    return singles(packs.add_packs(panels.bars(spark, folder), [packs.sma(("close", "volume"), ind.PRICE_WINDOWS)], DAILY, ["ticker", "date"]))


@query("volume_change", B + f"SELECT ticker, date, {r6(f'coalesce((volume - lag(volume) OVER {W}) / nullif(lag(volume) OVER {W}, 0), 0) * 100')} AS volume_change FROM bars")
def volume_change(spark, folder):
    return keys_and(panels.bars(spark, folder), {"volume_change": ind.volume_change()})


@query(
    "bar_basics",
    B + "SELECT ticker, date, " + sql_rounding({"price_range": "high - low", "ochl_ratio": "coalesce((open - close) / nullif(high - low, 0), 0)", "close_times_volume": "close * volume"}) + " FROM bars",
)
def bar_basics(spark, folder):
    return keys_and(panels.bars(spark, folder), ind.bar_basics())


_V = [5, 20, 60]
_CHG = f"c1 AS (SELECT ticker, date, ln(1 + close) / lag(ln(1 + close)) OVER {W} - 1 AS c1 FROM bars), c2 AS (SELECT *, c1 / nullif(lag(c1) OVER {W}, 0) - 1 AS c2 FROM c1)"


@query(
    "volatility_log1p",
    using("bars", extra=_CHG) + "SELECT ticker, date, " + sql_rounding({f"volatility_{n}": _gate("stddev_samp", "c1", n, n) for n in _V}, 6) + ", "
    + sql_rounding({f"volatility_change_{n}": _gate("stddev_samp", "c2", n, n) for n in _V}, 3) + " FROM c2",
)
def volatility_log1p(spark, folder):
    v = ind.add_log1p_volatility(panels.bars(spark, folder).select("ticker", "date", "close"), _V)
    return v.selectExpr(
        "ticker", "date",
        *[f"{rounded(f'volatility_{n}')} AS volatility_{n}" for n in _V],
        *[f"{rounded(f'volatility_change_{n}', 3)} AS volatility_change_{n}" for n in _V],
    )


@query("ma_gap", B + "SELECT ticker, date, " + sql_rounding({f"close_gap_{n}": f"close / ({_gate('avg', 'close', n, n)})" for n in (5, 20, 60)}) + " FROM bars")
def ma_gap(spark, folder):
    return keys_and(panels.bars(spark, folder), ind.mean_gap("close", (5, 20, 60)))


@query(
    "monthly_pack",
    using("bars", extra=f"r AS (SELECT *, ln(close) - ln(lag(close) OVER {W}) AS lr FROM bars)") + "SELECT ticker, date, "
    + sql_rounding({"return_251": f"close / lag(close, 251) OVER {W} - 1"}
        | {f"return_{m}month": f"close / lag(close, {20 * m}) OVER {W} - 1" for m in (1, 2, 3)}
        | {f"volatility_{m}month": _gate("stddev_samp", "lr", 20 * m, 20 * m) for m in (1, 2, 3)}
        | {f"gap_{m}month": f"close / ({_gate('avg', 'close', 20 * m, 20 * m)})" for m in (1, 2, 3)}) + " FROM r",
)
def monthly_pack(spark, folder):
    return rounded_columns(packs.add_packs(panels.bars(spark, folder), [packs.monthly()], DAILY, ["ticker", "date"]))


_DER = (
    {f"lret_{c}": f"ln({c}) - ln(lag({c}) OVER {W})" for c in ("close", "open", "low", "high", "volume")}
    | {"lret_money": f"ln(close * volume) - ln(lag(close * volume) OVER {W})", "money_volume": "close * volume",
       "market_cap": "shares * close / 1000", "daily_range": "close - open"}
    | {f"daily_range_{k}": f"close - lag(open, {k}) OVER {W}" for k in (1, 2, 3)}
)


@query("derived_series", using("bars", "dim", extra="j AS (SELECT b.*, d.shares FROM bars b LEFT JOIN dim d USING (ticker))") + "SELECT ticker, date, " + sql_rounding(_DER, 8) + " FROM j")
def derived_series(spark, folder):
    b = panels.bars(spark, folder).join(panels.attributes(spark, folder).select("ticker", "shares"), "ticker", "left")
    return keys_and(b, ind.derived_series(), 8)


_H = [5, 20, 60, 250]
_VF = ["money", "lret"]
_VFX = using("bars", extra=f"""s AS (SELECT ticker, date, close * volume / 1000 AS money, ln(close) - ln(lag(close) OVER {W}) AS lret FROM bars),
g AS (SELECT *, {', '.join(f"ln(1 + {c}) / nullif(lag(ln(1 + {c})) OVER {W}, 0) - 1 AS d_{c}" for c in _VF)} FROM s)""")


@query(
    "volume_family",
    _VFX + "SELECT ticker, date, " + sql_rounding({f"{c}_return_{n}": f"{c} / nullif(lag({c}, {n}) OVER {W}, 0) - 1" for c in _VF for n in _H}, 4) + ", "
    + sql_rounding({f"{c}_return_abs_{n}": f"abs({c} / nullif(lag({c}, {n}) OVER {W}, 0) - 1)" for c in _VF for n in _H}, 4) + ", "
    + sql_rounding({f"money_volatility_{n}": _gate("stddev_samp", "d_money", n, n) for n in _H}, 5) + ", "
    + sql_rounding({f"money_gap_{n}": f"money / nullif({_gate('avg', 'money', n, n)}, 0)" for n in _H}, 5) + " FROM g",
)
def volume_family(spark, folder):
    b = panels.bars(spark, folder)
    s = b.selectExpr("ticker", "date", "close * volume / 1000 AS money", f"{rl.log_return('close', DAILY)} AS lret")
    p = grouped.horizon_pack(s, _VF, _H, keep=["ticker", "date"])
    fine = [c for c in p.columns if c.startswith(("money_volatility", "money_gap"))]
    coarse = [c for c in p.columns if "_return_" in c]
    return p.selectExpr("ticker", "date", *[f"{rounded(c, 5)} AS {c}" for c in fine], *[f"{rounded(c, 4)} AS {c}" for c in coarse])


_ALL = list(rl.HORIZONS)
_WIDE = ", ".join(
    f"""('return', {n}, close / lag(close, {n}) OVER {W} - 1), ('volatility', {n}, {_gate('stddev_samp', 'd', n, n)}), ('gap', {n}, close / ({_gate('avg', 'close', n, n)}))"""
    for n in _ALL
)


@query(
    "horizon_frames",
    using("bars", extra=f"s AS (SELECT ticker, date, volume FROM bars), g AS (SELECT *, ln(1 + volume) / lag(ln(1 + volume)) OVER {W} - 1 AS d FROM s)")
    + "SELECT ticker, date, " + sql_rounding({f"volume_return_{n}": f"volume / lag(volume, {n}) OVER {W} - 1" for n in (5, 60)}, 6) + ", "
    + sql_rounding({f"volume_volatility_{n}": _gate("stddev_samp", "d", n, n) for n in (5, 60)}, 5) + ", "
    + sql_rounding({f"volume_gap_{n}": f"volume / ({_gate('avg', 'volume', n, n)})" for n in (5, 60)}, 6) + " FROM g",
)
def horizon_frames(spark, folder):
    """The horizon pack from running sums in Window operators."""
    p = rl.horizon_pack(panels.bars(spark, folder).select("ticker", "date", "volume"), ["volume"], (5, 60), absolute=False)
    d = {c: 5 if "volatility" in c else 6 for c in p.columns if c not in RAW}
    return p.selectExpr("ticker", "date", *[f"{rounded(c, n)} AS {c}" for c, n in d.items()])


@query(
    "horizon_summary",
    using("bars", extra=f"g AS (SELECT ticker, date, close, ln(1 + close) / lag(ln(1 + close)) OVER {W} - 1 AS d FROM bars)")
    + "SELECT ticker, kind, horizon, count(v) AS n, round(avg(v), 6) AS mean, round(max(v), 6) AS top FROM ("
    + " UNION ALL ".join(
        f"SELECT ticker, '{k}' AS kind, {n} AS horizon, {e} AS v FROM g"
        for n in _ALL
        for k, e in (("return", f"close / lag(close, {n}) OVER {W} - 1"), ("volatility", _gate("stddev_samp", "d", n, n)),
                     ("gap", f"close / ({_gate('avg', 'close', n, n)})")))
    + ") GROUP BY 1, 2, 3",
)
def horizon_summary(spark, folder):
    """All 84 horizons of the price pack, summarised per ticker."""
    h = grouped.horizon_summary(panels.bars(spark, folder), "close")
    return h.selectExpr("ticker", "kind", "horizon", "n", "round(mean, 6) AS mean", "round(top, 6) AS top")


def _long_packs(columns, second=False):
    """All horizons of several series of a table ``s``: a row per (ticker, series, horizon) with the kinds' values."""
    out = []
    for n in _ALL:
        kinds = {"ret": f"x / nullif(lag(x, {n}) OVER o, 0) - 1", "vol": _gate("stddev_samp", "d", n, n),
                 "gap": f"CASE WHEN abs({_gate('avg', 'x', n, n)}) > {moments.ZERO} THEN x / ({_gate('avg', 'x', n, n)}) END"}
        if second:
            kinds["vol2"] = _gate("stddev_samp", "e", n, n)
        text = ", ".join(f"{e} AS {k}" for k, e in kinds.items()).replace("(PARTITION BY ticker ORDER BY date", "(PARTITION BY ticker, series ORDER BY date")
        out.append(f"SELECT ticker, series, {n} AS horizon, {text} FROM g WINDOW o AS (PARTITION BY ticker, series ORDER BY date)")
    unpivoted = " UNION ALL ".join(f"SELECT ticker, date, '{c}' AS series, CAST({c} AS DOUBLE) AS x FROM s" for c in columns)
    change = "u AS (" + unpivoted + "), c AS (SELECT *, CASE WHEN x > -1 THEN ln(1 + x) END AS y FROM u), " \
        "f AS (SELECT *, y / nullif(lag(y) OVER (PARTITION BY ticker, series ORDER BY date), 0) - 1 AS d FROM c), " \
        "g AS (SELECT *, d / nullif(lag(d) OVER (PARTITION BY ticker, series ORDER BY date), 0) - 1 AS e FROM f)"
    return change, " UNION ALL ".join(out)


def _squash(x):
    """Between -1 and 1: a mean of quotients that may be very large shouldn't hang on the largest."""
    return f"avg({x} / (1 + abs({x})))"


def _digests(kinds):
    out = []
    for k in kinds:
        out += [f"count({k}) AS n_{k}", f"round({_squash(k)}, 6) + 0 AS {k}"]
    return out


def _rounded_digests(df, kinds):
    return df.selectExpr("ticker", "series", "horizon", *[e for k in kinds for e in (f"n_{k}", f"round({k}, 6) + 0 AS {k}")])


_PRICE_CHANGE, _PRICE_ROWS = _long_packs(["close"], second=True)


@query(
    "price_horizons",
    using("bars", extra="s AS (SELECT ticker, date, close FROM bars), " + _PRICE_CHANGE)
    + "SELECT ticker, series, horizon, " + ", ".join(_digests(["ret", "vol", "vol2", "gap"])) + f" FROM ({_PRICE_ROWS}) GROUP BY ticker, series, horizon",
)
def price_horizons(spark, folder):
    """Return, both volatilities and mean gap of the price for all horizons, every row of them summed up per ticker."""
    kinds = ["ret", "vol", "vol2", "gap"]
    return _rounded_digests(packs.horizon_digests(panels.bars(spark, folder), ["close"], kinds, DAILY, second=True), kinds)


def volume_series(spark, folder):
    """The six series of the volume family: standardised volume, log returns of price, volume and money, standardised money and market value."""
    b = panels.bars(spark, folder).join(panels.attributes(spark, folder).select("ticker", "shares"), "ticker", "left")
    b = b.selectExpr("ticker", "date", "close", "volume", "close * volume / 1000 AS money", "shares * close / 1000 AS value")
    return b.selectExpr(
        "ticker", "date", f"{ind.history_zscore('volume', causal=False)} AS volume_z", f"{rl.log_return('close', DAILY)} AS lret",
        f"{rl.log_return('volume', DAILY)} AS lret_volume", f"{rl.log_return('money', DAILY)} AS lret_money",
        f"{ind.history_zscore('money', causal=False)} AS money_z", f"{ind.history_zscore('value', causal=False)} AS value_z",
    )


VOLUME_SERIES = ["volume_z", "lret", "lret_volume", "lret_money", "money_z", "value_z"]


def _z(c):
    return f"({c} - avg({c}) OVER p) / nullif(stddev_pop({c}) OVER p, 0)"


_VOLUME_SQL = f"""m AS (SELECT ticker, date, close, volume, close * volume / 1000 AS money, shares * close / 1000 AS value FROM bars LEFT JOIN dim USING (ticker)),
s AS (SELECT ticker, date, {_z('volume')} AS volume_z, ln(close) - ln(lag(close) OVER w) AS lret, ln(volume) - ln(lag(volume) OVER w) AS lret_volume,
  ln(money) - ln(lag(money) OVER w) AS lret_money, {_z('money')} AS money_z, {_z('value')} AS value_z
  FROM m WINDOW w AS (PARTITION BY ticker ORDER BY date), p AS (PARTITION BY ticker))"""
_VOLUME_CHANGE, _VOLUME_ROWS = _long_packs(VOLUME_SERIES)


@query(
    "volume_horizons",
    using("bars", "dim", extra=f"{_VOLUME_SQL}, {_VOLUME_CHANGE}")
    + "SELECT ticker, series, horizon, " + ", ".join(_digests(["ret", "ret_abs", "vol", "gap"])) + f" FROM (SELECT *, abs(ret) AS ret_abs FROM ({_VOLUME_ROWS})) GROUP BY ticker, series, horizon",
)
def volume_horizons(spark, folder):
    """Return, its size, volatility and mean gap of all six series for all horizons, every row of them summed up per ticker."""
    kinds = ["ret", "ret_abs", "vol", "gap"]
    return _rounded_digests(packs.horizon_digests(volume_series(spark, folder), VOLUME_SERIES, kinds, DAILY), kinds)


@query("money_volume_lags", B + "SELECT ticker, date, " + sql_rounding({f"money_volume_{k}": f"lag(volume, {k}) OVER {W} * lag(close, {k}) OVER {W}" for k in range(1, 11)}, 4) + " FROM bars")
def money_volume_lags(spark, folder):
    return keys_and(panels.bars(spark, folder), ind.money_volume_lags(), 4)


_WHOLE = "(PARTITION BY ticker)"
_SOFAR = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_ZC = ("open", "high", "low", "close", "volume")


@query(
    "zscore_hist",
    B + "SELECT ticker, date, " + sql_rounding(
        {f"{c}_z": f"({c} - avg({c}) OVER {_WHOLE}) / nullif(stddev_pop({c}) OVER {_WHOLE}, 0)" for c in _ZC}
        | {f"{c}_z_causal": f"({c} - avg({c}) OVER {_SOFAR}) / nullif(stddev_pop({c}) OVER {_SOFAR}, 0)" for c in ("close",)}) + " FROM bars",
)
def zscore_hist(spark, folder):
    e = {f"{c}_z": ind.history_zscore(c, causal=False) for c in _ZC} | {"close_z_causal": ind.history_zscore("close")}
    return keys_and(panels.bars(spark, folder), e)


@query(
    "zscore_nulls",
    using("bars", extra=f"r AS (SELECT ticker, date, close - lag(open) OVER {W} AS rng FROM bars)")
    + f"SELECT ticker, date, CAST(-20000 AS DOUBLE) AS rng_z, {r6(f'(rng - avg(rng) OVER {_WHOLE}) / nullif(stddev_pop(rng) OVER {_WHOLE}, 0)')} AS rng_z_skip FROM r",
)
def zscore_nulls(spark, folder):
    """A hole anywhere in the series makes the propagating z-score NULL for the whole series."""
    r = panels.bars(spark, folder).selectExpr("ticker", "date", f"close - {rl.lag('open', 1, DAILY)} AS rng")
    z = ind.history_zscore("rng", causal=False, propagate_null=True)
    return keys_and(r, {"rng_z": f"coalesce({z}, -20000D)", "rng_z_skip": ind.history_zscore("rng", causal=False)})


@query(
    "hist_std_skew",
    using("bars", extra="m AS (SELECT *, close * volume AS money FROM bars)") + "SELECT ticker, date, "
    + sql_rounding({"money_std": f"stddev_samp(money) OVER {_WHOLE}", "money_skew": f"skewness(money) OVER {_WHOLE}", "money_std_causal": f"stddev_samp(money) OVER {_SOFAR}"}, 4) + " FROM m",
)
def hist_std_skew(spark, folder):
    m = panels.bars(spark, folder).selectExpr("ticker", "date", "close * volume AS money")
    return keys_and(m, {"money_std": ind.history_std("money", False), "money_skew": ind.history_skew("money", False),
                        "money_std_causal": ind.history_std("money")}, 4)


@query(
    "realized_vol",
    using("bars", extra=f"r AS (SELECT ticker, date, ln(close) - ln(lag(close) OVER {W}) AS lr FROM bars)") + "SELECT ticker, date, "
    + sql_rounding({"rvol": f"sqrt(sum(lr * lr) OVER {_WHOLE})", "rvol_causal": f"sqrt(sum(lr * lr) OVER {_SOFAR})"}) + " FROM r",
)
def realized_vol(spark, folder):
    r = panels.bars(spark, folder).selectExpr("ticker", "date", f"{rl.log_return('close', DAILY)} AS lr")
    return keys_and(r, {"rvol": ind.realized_volatility("lr", False), "rvol_causal": ind.realized_volatility("lr")})


_P4 = "(open), (high), (low), (close)"


@query(
    "row_moments",
    B + """SELECT ticker, date, round(bar_mean, 6) AS bar_mean, round(bar_median, 6) AS bar_median,
 CASE WHEN high > low THEN round(bar_skew, 4) + 0.0 END AS bar_skew, CASE WHEN high > low THEN round(bar_kurtosis, 4) + 0.0 END AS bar_kurtosis,
 round((open + close) / 2, 6) AS open_close_mean
FROM (SELECT *, (open + high + low + close) / 4 AS bar_mean, list_aggregate([open, high, low, close], 'median') AS bar_median,
  list_aggregate([open, high, low, close], 'skewness') AS bar_skew, list_aggregate([open, high, low, close], 'kurtosis') AS bar_kurtosis FROM bars)""",
)
def row_moments(spark, folder):
    m = ind.add_bar_moments(panels.bars(spark, folder))
    return m.selectExpr(
        "ticker", "date", "round(bar_mean, 6) AS bar_mean", "round(bar_median, 6) AS bar_median",
        f"CASE WHEN high > low THEN {rounded('bar_skew', 4)} END AS bar_skew",
        f"CASE WHEN high > low THEN {rounded('bar_kurtosis', 4)} END AS bar_kurtosis",
        "round(open_close_mean, 6) AS open_close_mean",
    )


@query(
    "candle_shape",
    B + "SELECT ticker, date, " + sql_rounding({
        "high_low": "high - low", "close_open": "close - open", "close_over_open": "close / open",
        "upper_shadow": "high - greatest(close, open)", "lower_shadow": "least(close, open) - low",
        "range_over_body": "(high - low) / nullif(close - open, 0)", "open_close": "open - close",
        "prev_close_open": f"lag(close) OVER {W} - open"}) + " FROM bars",
)
def candle_shape(spark, folder):
    return keys_and(panels.bars(spark, folder), ind.candle_shape())


@query(
    "bar_ratios",
    using("bars", extra="m AS (SELECT *, (open + high + low + close) / 4 AS bm, (open + high + low + close - greatest(open, high, low, close) - least(open, high, low, close)) / 2 AS bd FROM bars)")
    + "SELECT ticker, date, " + sql_rounding({
        "high_to_mean": "high / bm", "low_to_mean": "low / bm", "high_to_median": "high / bd", "low_to_median": "low / bd",
        "volume_share": "volume / (volume + 1)", "volume_to_close": "volume / close",
        "hl_spread": "CASE WHEN high > low THEN ln((high - low) / close) END", "co_spread": "(close - open) / open",
        "log_volume": "ln(volume)", "high_to_body": "high / greatest(close, open)", "body_to_low": "least(close, open) / low",
        "high_to_low": "high / low"}) + " FROM m",
)
def bar_ratios(spark, folder):
    return keys_and(ind.add_bar_moments(panels.bars(spark, folder)), ind.bar_ratios())

"""Interactions, powers, polynomial terms, pairs of assets, random probes, sequences."""

from __future__ import annotations

from itertools import combinations

from ..functions import rolling as rl
from ..functions.safe import named, rounded
from ..operators import cross
from ..operators.clean import probe_columns
from ..sources import panels
from ..sources.panels import DAILY, MARKET_ASSETS
from .registry import query
from .twins import r6, using
from .windows import sql_rounding

W = "(PARTITION BY ticker ORDER BY date)"
_BASE = {"lret": f"ln(close) - ln(lag(close) OVER {W})", "rng": "high - low", "money": "close * volume"}
_X = using("bars", extra="b AS (SELECT ticker, date, " + ", ".join(f"{e} AS {n}" for n, e in _BASE.items()) + " FROM bars)")
_PAIRS = {}
for _a, _b in combinations(_BASE, 2):
    _PAIRS |= {f"{_a}_x_{_b}": f"{_a} * {_b}", f"{_a}_ratio_{_b}": f"coalesce({_a} / nullif({_b}, 0), 0)", f"{_a}_diff_{_b}": f"{_a} - {_b}", f"{_a}_sum_{_b}": f"{_a} + {_b}"}


def base(spark, folder):
    b = panels.bars(spark, folder)
    return b.selectExpr("ticker", "date", f"{rl.log_return('close', DAILY)} AS lret", "high - low AS rng", "close * volume AS money")


@query("interactions", _X + "SELECT ticker, date, " + ", ".join(f"CAST({e} AS FLOAT) AS {n}" for n, e in _PAIRS.items()) + " FROM b")
def interactions(spark, folder):
    return base(spark, folder).selectExpr("ticker", "date", *[f"CAST({e} AS FLOAT) AS {n}" for n, e in cross.interactions(list(_BASE)).items()])


@query("powers", _X + "SELECT ticker, date, " + ", ".join(f"CAST(pow({c}, {d}) AS FLOAT) AS {c}_poly_{d}" for c in _BASE for d in (2, 3)) + " FROM b")
def powers(spark, folder):
    return base(spark, folder).selectExpr("ticker", "date", *[f"CAST({e} AS FLOAT) AS {n}" for n, e in cross.powers(list(_BASE)).items()])


_PT = cross.polynomial_terms(["o", "c", "v"], 4)


def _monomial(name):
    parts = [f"pow({c}, {k})" for c, k in zip("ocv", name.split("_")[1:]) if k != "0"]
    return " * ".join(parts) or "1"


@query(
    "poly_terms",
    using("bars", extra="b AS (SELECT ticker, date, open / 5000 AS o, close / 5000 AS c, volume / 100 AS v FROM bars)") + "SELECT ticker, date, "
    + ", ".join(f"CAST({_monomial(n)} AS FLOAT) AS {n}" for n in _PT) + " FROM b",
)
def poly_terms(spark, folder):
    b = panels.bars(spark, folder).selectExpr("ticker", "date", "open / 5000 AS o", "close / 5000 AS c", "volume / 100 AS v")
    return b.selectExpr("ticker", "date", *[f"CAST({e} AS FLOAT) AS {n}" for n, e in _PT.items()])


_ASSETS = ", ".join(map(str, MARKET_ASSETS))
_PJ = f"""w AS (PIVOT (SELECT ticker, date, {{v}} AS v FROM {{t}} WHERE ticker IN ({_ASSETS})) ON ticker IN ({_ASSETS}) USING max(v) GROUP BY date),
pairs AS (""" + " UNION ALL ".join(f"""SELECT '{a}_{b}' AS pair, date, "{a}" AS a, "{b}" AS b FROM w""" for a, b in combinations(MARKET_ASSETS, 2)) + ")"


@query("pair_spread_ratio", using("bars", extra=_PJ.format(v="close", t="bars")) + f"SELECT pair, date, {r6('a - b')} AS spread, {r6('coalesce(a / nullif(b, 0), 0)')} AS ratio FROM pairs")
def pair_spread_ratio(spark, folder):
    p = cross.pair_spreads(panels.bars(spark, folder), MARKET_ASSETS)
    return p.selectExpr("pair", "date", f"{rounded('spread')} AS spread", f"{rounded('ratio')} AS ratio")


def _corr(n):
    f = f"(PARTITION BY pair ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count(a + b) OVER {f} >= {max(2, n // 2)} THEN corr(a, b) OVER {f} END"


_CW = tuple(rl.STAT_WINDOWS)


@query(
    "rolling_corr",
    using("bars", extra=f"lr AS (SELECT ticker, date, ln(close) - ln(lag(close) OVER {W}) AS lret FROM bars), " + _PJ.format(v="lret", t="lr"))
    + "SELECT pair, date, " + sql_rounding({f"corr_{n}": f"CASE WHEN isfinite({_corr(n)}) THEN {_corr(n)} END" for n in _CW}, 5) + " FROM pairs",
)
def rolling_corr(spark, folder):
    lr = panels.bars(spark, folder).selectExpr("ticker", "date", f"{rl.log_return('close', DAILY)} AS lret")
    c = cross.pair_correlations(lr, MARKET_ASSETS, "lret", _CW)
    return c.selectExpr("pair", "date", *[f"{rounded(f'corr_{n}', 5)} AS corr_{n}" for n in _CW])


@query("column_transforms", using("bars") + "SELECT ticker, date, " + ", ".join(
    f"CAST(ln(greatest({c}, 1e-9)) AS FLOAT) AS {c}_log, CAST(sqrt(greatest({c}, 0)) AS FLOAT) AS {c}_sqrt, CAST({c} * {c} AS FLOAT) AS {c}_sq" for c in ("close", "high", "volume")) + " FROM bars")
def column_transforms(spark, folder):
    t = cross.transforms(["volume", "high", "close"])
    return panels.bars(spark, folder).selectExpr("ticker", "date", *[f"CAST({e} AS FLOAT) AS {n}" for n, e in t.items()])


def _unit(seed):
    return f"(('0x' || substr(md5('{seed}|' || ticker || '|' || date), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(
    "probe_columns",
    using("bars") + f"""SELECT ticker, date, {_unit(42)} AS random_uniform, {r6(f'sqrt(-2 * ln(1 - {_unit(42)})) * cos(2 * pi() * {_unit(43)})')} AS random_normal,
 CAST(floor(4 * {_unit(44)}) AS INTEGER) AS random_category FROM bars""",
)
def probes(spark, folder):
    e = probe_columns(["ticker", "date"])
    e["random_normal"] = rounded(e["random_normal"])
    return panels.bars(spark, folder).selectExpr("ticker", "date", *named(e))


@query(
    "sequences",
    using("bars", extra=f"s AS (SELECT ticker, date, close, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS past FROM bars)")
    + "SELECT ticker, date, close AS next_value, past[1] AS oldest, past[60] AS newest, len(past) AS n, round(list_sum(past), 4) AS total, array_to_string(list_transform(past, lambda x: CAST(round(x * 100) AS BIGINT)), ',') AS past_cents FROM s WHERE len(past) = 60",
)
def sequences(spark, folder):
    """60 past values per sample: the ends, the sum, and all of them in cents."""
    f = DAILY.rows(-60, -1)
    s = panels.bars(spark, folder).selectExpr("ticker", "date", "close", f"collect_list(close) {f} AS past").where("size(past) = 60")
    return s.selectExpr(
        "ticker", "date", "close AS next_value", "past[0] AS oldest", "past[59] AS newest", "bigint(size(past)) AS n",
        "round(aggregate(past, 0D, (a, x) -> a + x), 4) AS total",
        "array_join(transform(past, x -> string(bigint(round(x * 100)))), ',') AS past_cents",
    )

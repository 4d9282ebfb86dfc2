"""Era scoring, metrics, ensembles and portfolio analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import lag
from ..functions.safe import rounded
from ..operators import era, portfolio, ranking
from ..session import durable
from ..sources import panels
from ..sources.panels import DAILY, MARKET_ASSETS, WEEKLY
from .registry import query
from .twins import r6, using
from .windows import sql_rounding

_SCORES = """scores AS (SELECT week_end, corr(target, pct) AS score, sqrt(avg((target - pred_momentum) ** 2)) AS rmse FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY week_end ORDER BY pred_momentum, ticker) AS DOUBLE) / count(*) OVER (PARTITION BY week_end) AS pct FROM scored)
  GROUP BY 1 HAVING TRUE),
clean AS (SELECT week_end, CASE WHEN isfinite(score) THEN score END AS score, rmse FROM scores)"""


def scores(spark, folder):
    return era.era_scores(panels.scored(spark, folder), "target", "pred_momentum")


@query("era_score", using("scored", extra=_SCORES) + f"SELECT week_end, {r6('score')} AS score, {r6('rmse')} AS rmse FROM clean")
def era_score(spark, folder):
    return scores(spark, folder).selectExpr("week_end", f"{rounded('score')} AS score", f"{rounded('rmse')} AS rmse")


_SUM = {
    "mean_score": "avg(score)", "median_score": "median(score)", "std_score": "stddev_samp(score)",
    "mean_sharpe": "avg(score) / stddev_samp(score)", "median_sharpe": "median(score) / stddev_samp(score)",
    "hit_rate": "CAST(count(*) FILTER (WHERE score > 0) AS DOUBLE) / count(*)", "mean_rmse": "avg(rmse)",
}


@query("era_summary", using("scored", extra=_SCORES) + "SELECT " + sql_rounding(_SUM) + " FROM clean")
def era_summary(spark, folder):
    return era.era_summary(scores(spark, folder)).selectExpr(*[f"{rounded(c)} AS {c}" for c in _SUM])


@query(
    "era_cumulative",
    using("scored", extra=_SCORES) + "SELECT week_end, " + sql_rounding({
        "score": "score", "cumulative": "sum(score) OVER (ORDER BY week_end ROWS UNBOUNDED PRECEDING)",
        "rolling_mean": "CASE WHEN count(score) OVER (ORDER BY week_end ROWS 19 PRECEDING) >= 20 THEN avg(score) OVER (ORDER BY week_end ROWS 19 PRECEDING) END"}) + " FROM clean",
)
def era_cumulative(spark, folder):
    c = era.era_cumulative(scores(spark, folder))
    return c.selectExpr("week_end", *[f"{rounded(x)} AS {x}" for x in ("score", "cumulative", "rolling_mean")])


_Q = """n AS (SELECT ticker, week_end, rsi, row_number() OVER (PARTITION BY week_end ORDER BY rsi, ticker) - 1 AS rn, count(*) OVER (PARTITION BY week_end) AS n FROM weekly),
pos AS (SELECT DISTINCT week_end, n, k, ((n - 1) * k) // 5 AS lo, ((n - 1) * k) % 5 AS part FROM n, (SELECT unnest(range(6)) AS k)),
edge AS (SELECT p.week_end, p.k, CASE WHEN p.part = 0 THEN a.rsi ELSE a.rsi + (b.rsi - a.rsi) * (p.part / 5e0) END AS e
  FROM pos p JOIN n a ON a.week_end = p.week_end AND a.rn = p.lo JOIN n b ON b.week_end = p.week_end AND b.rn = least(p.lo + 1, p.n - 1)),
uniq AS (SELECT DISTINCT week_end, e FROM edge),
q AS (SELECT n.ticker, n.week_end, n.rsi, CAST(greatest(count(u.e) - 1, 0) AS INTEGER) AS quintile
  FROM n LEFT JOIN uniq u ON u.week_end = n.week_end AND u.e < n.rsi GROUP BY 1, 2, 3)"""
_WK = "(PARTITION BY ticker ORDER BY week_end)"


@query(
    "era_quintiles",
    using("weekly", extra=_Q) + "SELECT ticker, week_end, rsi, quintile, "
    + ", ".join(f"lag(quintile, {k}) OVER {_WK} AS lag_{k}" for k in range(1, 6)) + ", "
    + ", ".join(f"{a} - {b} AS diff_{k}, abs({a} - {b}) AS abs_diff_{k}" for k in range(5)
                for a, b in [(f"lag(quintile, {k}) OVER {_WK}", f"lag(quintile, {k + 1}) OVER {_WK}")]) + " FROM q",
)
def era_quintiles(spark, folder):
    w = panels.weekly(spark, folder).select("ticker", "week_end", "rsi")
    q = ranking.add_quantile_bucket(w, ["week_end"], "rsi", ["ticker"], 5, "quintile")
    q = q.selectExpr("*", *[f"{lag('quintile', k, WEEKLY)} AS lag_{k}" for k in range(1, 6)])
    name = lambda k: f"lag_{k}" if k else "quintile"
    diffs = [e for k in range(5) for e in (f"{name(k)} - {name(k + 1)} AS diff_{k}", f"abs({name(k)} - {name(k + 1)}) AS abs_diff_{k}")]
    return q.selectExpr("*", *diffs)


def _metric(p):
    return (f"SELECT '{p}' AS model, sqrt(avg((target - {p}) ** 2)) AS rmse, 1 - sum((target - {p}) ** 2) / (var_pop(target) * count(*)) AS r2, "
            f"avg(abs(target - {p}) / greatest(abs(target), 2.220446049250313e-16)) AS mape FROM e")


_MODELS = ("pred_momentum", "pred_reversal", "ensemble")
_ENS = "e AS MATERIALIZED (SELECT *, (pred_momentum + pred_reversal) / 2 AS ensemble FROM scored)"
_MET = _ENS + ", m AS (" + " UNION ALL ".join(map(_metric, _MODELS)) + ")"


def metrics(spark, folder):
    s = panels.scored(spark, folder).selectExpr("*", era.ensemble_mean(_MODELS[:2]))
    return era.regression_metrics(s, "target", _MODELS)


@query("metrics_rmse_r2", using("scored", extra=_MET) + f"SELECT model, {r6('rmse')} AS rmse, {r6('r2')} AS r2 FROM m")
def metrics_rmse_r2(spark, folder):
    return metrics(spark, folder).selectExpr("model", f"{rounded('rmse')} AS rmse", f"{rounded('r2')} AS r2")


@query("mape", using("scored", extra=_MET) + f"SELECT model, {r6('mape')} AS mape FROM m")
def mape(spark, folder):
    return metrics(spark, folder).selectExpr("model", f"{rounded('mape')} AS mape")


@query(
    "ensemble",
    using("preds") + """SELECT ticker, week_end, round((coalesce(pred_momentum, 0) + coalesce(pred_reversal, 0))
 / nullif((pred_momentum IS NOT NULL)::INT + (pred_reversal IS NOT NULL)::INT, 0), 6) AS ensemble FROM preds""",
)
def ensemble(spark, folder):
    p = panels.predictions(spark, folder)
    return p.selectExpr("ticker", "week_end", era.ensemble_mean(_MODELS[:2])).selectExpr("ticker", "week_end", "round(ensemble, 6) AS ensemble")


@query(
    "threshold_check",
    using("scored", extra=_MET) + f"SELECT model, {r6('rmse')} AS rmse, rmse < 0.4 AS reached, count(*) FILTER (WHERE rmse < 0.4) OVER () AS reached_count FROM m",
)
def threshold_check(spark, folder):
    t = era.threshold_check(metrics(spark, folder), 0.4)
    return t.selectExpr("model", f"{rounded('rmse')} AS rmse", "reached", "reached_count")


@query(
    "auc_rank",
    """SELECT round(sum(CASE WHEN y = 1 THEN r END - 0.0) / np / nn - (np + 1) / 2.0 / nn, 6) AS auc, CAST(np AS BIGINT) AS positives, CAST(nn AS BIGINT) AS negatives FROM (
 SELECT y, r, sum(y) OVER () AS np, sum(1 - y) OVER () AS nn FROM (
  SELECT y, avg(rn) OVER (PARTITION BY s) AS r FROM (
   SELECT CAST(l_returnflag = 'A' AS INTEGER) AS y, l_quantity AS s, row_number() OVER (ORDER BY l_quantity) AS rn FROM lineitem)))
GROUP BY np, nn""",
)
def auc_rank(spark, folder):
    line = panels.table(spark, folder, "lineitem").selectExpr("CAST(l_returnflag = 'A' AS INT) AS y", "l_quantity AS s")
    return era.auc(line, "y", "s").selectExpr("round(auc, 6) AS auc", "positives", "negatives")


# ---- portfolios ---------------------------------------------------------------------------

_A = ", ".join(map(str, MARKET_ASSETS))
_RET = f"""rets AS MATERIALIZED (SELECT * FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars) WHERE ret IS NOT NULL),
mat AS MATERIALIZED (SELECT r.ticker AS asset, r.date, r.ret FROM rets r WHERE ticker IN ({_A}) AND date IN (SELECT date FROM rets WHERE ticker = 0)),
mu AS MATERIALIZED (SELECT asset, product(1 + ret) ** (252.0 / (SELECT count(*) FROM rets WHERE ticker = 0)) - 1 AS annual_return FROM mat GROUP BY 1),
cov AS MATERIALIZED (SELECT x.asset AS a, y.asset AS b, covar_samp(x.ret, y.ret) * 252 AS cov FROM mat x JOIN mat y ON x.date = y.date GROUP BY 1, 2)"""
_PF = _RET + f""",
spent AS MATERIALIZED (SELECT o_custkey AS portfolio_id, l_suppkey AS asset, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey IN ({_A}) GROUP BY 1, 2),
prop AS (SELECT portfolio_id, asset, coalesce(cents, 0) AS proportion FROM (SELECT DISTINCT portfolio_id FROM spent) CROSS JOIN (SELECT unnest([{_A}]) AS asset) LEFT JOIN spent USING (portfolio_id, asset)),
wt AS MATERIALIZED (SELECT portfolio_id, asset, round(CAST(proportion AS DOUBLE) / sum(proportion) OVER (PARTITION BY portfolio_id), 3) AS weight FROM prop),
risk AS (SELECT x.portfolio_id, round(sqrt(sum(x.weight * y.weight * cov)), 4) AS port_std FROM wt x JOIN wt y USING (portfolio_id) JOIN cov ON x.asset = a AND y.asset = b GROUP BY 1),
gain AS (SELECT portfolio_id, round(sum(weight * annual_return), 4) AS port_return FROM wt JOIN mu USING (asset) GROUP BY 1),
pf AS (SELECT portfolio_id, port_std, port_return, round((port_return - 0.04) / nullif(port_std, 0), 4) AS ratio FROM risk JOIN gain USING (portfolio_id))"""


def matrix(spark, folder):
    return portfolio.return_matrix(portfolio.simple_returns(panels.bars(spark, folder)), MARKET_ASSETS)


@query("asset_returns", using("bars", extra=_RET) + "SELECT ticker, date, round(ret, 6) + 0.0 AS ret FROM rets")
def asset_returns(spark, folder):
    return portfolio.simple_returns(panels.bars(spark, folder)).selectExpr("ticker", "date", f"{rounded('ret')} AS ret")


@query("return_matrix", using("bars", extra=_RET) + "SELECT date, " + ", ".join(f"round(max(ret) FILTER (WHERE asset = {a}), 6) + 0.0 AS r{a}" for a in MARKET_ASSETS) + " FROM mat GROUP BY 1")
def return_matrix(spark, folder):
    return matrix(spark, folder).selectExpr("date", *[f"{rounded(f'r{a}')} AS r{a}" for a in MARKET_ASSETS])


@query("annualised_return", using("bars", extra=_RET) + "SELECT CAST(asset AS INTEGER) AS asset, round(annual_return, 6) AS annual_return FROM mu")
def annualised_return(spark, folder):
    return portfolio.annualised_returns(matrix(spark, folder), MARKET_ASSETS).selectExpr("asset", "round(annual_return, 6) AS annual_return")


@query("annualised_cov", using("bars", extra=_RET) + "SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(cov, 4) AS cov FROM cov")
def annualised_cov(spark, folder):
    return portfolio.annualised_covariance(matrix(spark, folder), MARKET_ASSETS).selectExpr("a", "b", "round(cov, 4) AS cov")


@query(
    "market_covariance",
    using("bars", extra="""rets AS MATERIALIZED (SELECT * FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars) WHERE ret IS NOT NULL),
pairs AS (SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, covar_samp(x.ret, y.ret) * 252 AS cov,
  covar_pop(x.ret, y.ret) / nullif(stddev_pop(x.ret) * stddev_pop(y.ret), 0) AS corr FROM rets x JOIN rets y ON x.date = y.date AND x.ticker <= y.ticker GROUP BY 1, 2)""")
    + "SELECT a, b, n, CASE WHEN n >= 20 THEN round(cov, 4) + 0.0 END AS cov, CASE WHEN n >= 20 THEN round(corr, 6) + 0.0 END AS corr FROM pairs",
)
def market_covariance(spark, folder):
    """Covariance and correlation of all pairs of tickers, not of a declared list."""
    r = portfolio.simple_returns(panels.stored_bars(spark, folder))
    return portfolio.market_covariance(r).selectExpr("a", "b", "n", "round(cov, 4) + 0D AS cov", "round(corr, 6) + 0D AS corr")


@query("price_dispersion", using("bars") + "SELECT ticker, round(stddev_pop(close), 5) AS std, round(var_pop(close), 3) AS var FROM bars GROUP BY 1")
def price_dispersion(spark, folder):
    return portfolio.price_dispersion(panels.bars(spark, folder)).selectExpr("ticker", "round(std, 5) AS std", "round(var, 3) AS var")


@query("portfolio_weights", using("bars", extra=_PF) + "SELECT CAST(portfolio_id AS INTEGER) AS portfolio_id, CAST(asset AS BIGINT) AS asset, weight FROM wt")
def portfolio_weights(spark, folder):
    return portfolio.normalised_weights(panels.portfolio_weights(spark, folder))


def scored_portfolios(spark, folder):
    m = durable(matrix(spark, folder))
    w = portfolio.normalised_weights(panels.portfolio_weights(spark, folder))
    return portfolio.score_portfolios(
        w, portfolio.annualised_returns(m, MARKET_ASSETS), portfolio.annualised_covariance(m, MARKET_ASSETS), MARKET_ASSETS
    )


_PFC = "CAST(portfolio_id AS INTEGER) AS portfolio_id, port_std, port_return, ratio"


@query("portfolio_score", using("bars", extra=_PF) + f"SELECT {_PFC} FROM pf")
def portfolio_score(spark, folder):
    return scored_portfolios(spark, folder)


@query("portfolio_best", using("bars", extra=_PF) + f"""SELECT {_PFC}, 'min_risk' AS kind FROM pf WHERE port_std = (SELECT min(port_std) FROM pf)
 UNION ALL SELECT {_PFC}, 'max_ratio' FROM pf WHERE ratio = (SELECT max(ratio) FROM pf)""")
def portfolio_best(spark, folder):
    return portfolio.best_portfolios(durable(scored_portfolios(spark, folder)))

"""Scores per era and their summary, model metrics, ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import div, num
from .ranking import add_rank, running_total


def era_scores(df: DataFrame, target: str, prediction: str, era: str = "week_end", tie: str = "ticker") -> DataFrame:
    """Per era: correlation of the raw target with the percent rank of the prediction, and RMSE.

    The rank needs no era in one place (see ``ranking``), the statistics combine before
    the shuffle, so an era may hold any share of the rows.
    """
    ranked = add_rank(df.select(era, tie, target, prediction), [era], prediction, [tie], "_pct", percent=True)
    return ranked.groupBy(era).agg(
        F.expr(f"CASE WHEN count({target} + _pct) >= 2 AND stddev_pop({target}) > 0 AND stddev_pop(_pct) > 0 "
               f"THEN corr({target}, _pct) END AS score"),
        F.expr(f"sqrt(avg(pow({target} - {prediction}, 2))) AS rmse"),
    )


def era_summary(scores: DataFrame) -> DataFrame:
    """One row over all eras; eras are weeks, so the table is small by nature."""
    return scores.selectExpr(
        "avg(score) AS mean_score",
        "percentile(score, 0.5D) AS median_score",
        "stddev_samp(score) AS std_score",
        f"{div('avg(score)', 'stddev_samp(score)')} AS mean_sharpe",
        f"{div('percentile(score, 0.5D)', 'stddev_samp(score)')} AS median_sharpe",
        "count_if(score > 0) / count(*) AS hit_rate",
        "avg(rmse) AS mean_rmse",
    )


def era_cumulative(scores: DataFrame, era: str = "week_end", window: int = 20) -> DataFrame:
    """Cumulative sum and rolling mean of the era scores (one row per week: a bounded table)."""
    rows = f"OVER (ORDER BY {era} ROWS BETWEEN {{}} AND CURRENT ROW)"
    last = rows.format(f"{window - 1} PRECEDING")
    return scores.selectExpr(
        era,
        "score",
        f"sum(score) {rows.format('UNBOUNDED PRECEDING')} AS cumulative",
        f"CASE WHEN count(score) {last} >= {window} THEN avg(score) {last} END AS rolling_mean",
    )


def regression_metrics(df: DataFrame, target: str, predictions: Sequence[str], eps: float = 2.0**-52) -> DataFrame:
    """RMSE, R2 and MAPE per prediction column, one pass."""
    parts = [
        f"struct('{p}' AS model, sqrt(avg(pow({target} - {p}, 2))) AS rmse, "
        f"1 - {div(f'sum(pow({target} - {p}, 2))', f'nullif(var_pop({target}) * count({target}), 0)')} AS r2, "
        f"avg(abs({target} - {p}) / greatest(abs({target}), {num(eps)})) AS mape)"
        for p in predictions
    ]
    return df.agg(F.expr(f"array({', '.join(parts)}) AS m")).selectExpr("inline(m)")


def ensemble_mean(predictions: Sequence[str], out: str = "ensemble") -> str:
    """Row mean of the predictions that are present."""
    total = " + ".join(f"coalesce({p}, 0D)" for p in predictions)
    n = " + ".join(f"CAST({p} IS NOT NULL AS INT)" for p in predictions)
    return f"{div(f'({total})', f'({n})')} AS {out}"


def threshold_check(metrics: DataFrame, limit: float = 0.16) -> DataFrame:
    """Models below the error limit, and how many reach it."""
    return metrics.selectExpr("model", "rmse", f"rmse < {num(limit)} AS reached", f"count_if(rmse < {num(limit)}) OVER () AS reached_count")


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums; ties count half.

    Rows are first reduced to one per distinct score (before the shuffle), so a
    score shared by many rows is one key; the running count over the distinct
    scores is cut into slices.
    """
    per_score = (
        df.where(f"{label} IS NOT NULL AND {score} IS NOT NULL")
        .groupBy(F.col(score).alias("_s"))
        .agg(F.expr(f"count_if({label} = 1) AS _pos"), F.expr(f"count_if({label} = 0) AS _neg"))
    )
    ranked = running_total(per_score, ["_s"], ["_neg"])
    return ranked.selectExpr(
        f"{div('sum(_pos * (double(_neg_before) + 0.5D * _neg))', 'double(sum(_pos)) * double(sum(_neg))')} AS auc",
        "sum(_pos) AS positives",
        "sum(_neg) AS negatives",
    )

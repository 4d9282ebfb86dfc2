"""Scaling, splits, training, feature selection and submission on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import date_key
from ..functions.safe import div
from ..session import durable
from ..sources.readers import InputError

#: Fixed value: gain below which a feature is dropped.
GAIN_CUT = 0.8588


def standardise(df: DataFrame, fit_on: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std, both learned from ``fit_on``; a constant column becomes 0."""
    stats = fit_on.agg(F.expr("struct(" + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols) + ") AS s"))
    with_stats = df.select("*", stats.scalar().alias("_s"))
    scaled = {c: f"CASE WHEN _s.s_{c} = 0 THEN {c} - _s.m_{c} ELSE {div(f'({c} - _s.m_{c})', f'_s.s_{c}')} END" for c in cols}
    return with_stats.selectExpr(*[f"{scaled[c]} AS {c}" if c in scaled else c for c in df.columns])


def minmax(df: DataFrame, fit_on: DataFrame, col: str, out: str = "scaled", back: str | None = None) -> DataFrame:
    """(x - min) / (max - min); ``back`` names a column for the inverse transform."""
    stats = fit_on.agg(F.expr(f"struct(min({col}) AS lo, max({col}) AS hi) AS s"))
    with_stats = df.select("*", stats.scalar().alias("_s"))
    scaled = with_stats.selectExpr(*df.columns, "_s", f"{div(f'({col} - _s.lo)', '(_s.hi - _s.lo)')} AS {out}")
    cols = [*df.columns, out] + ([f"{out} * (_s.hi - _s.lo) + _s.lo AS {back}"] if back else [])
    return scaled.selectExpr(*cols)


def chrono_cut(df: DataFrame, at: str = "date", share: float = 0.8) -> DataFrame:
    """The first date by which ``share`` of all rows have occurred: one row, column ``cut``.

    Rows are counted per date before anything is ordered, so the ordered table is
    bounded by the calendar.
    """
    days = df.groupBy(at).agg(F.count("*").alias("_n"))
    run = days.selectExpr(at, f"sum(_n) OVER (ORDER BY {at}) AS _run", "sum(_n) OVER () AS _all")
    return run.where(f"_run >= {share} * _all").agg(F.min(at).alias("cut"))


def chrono_split(df: DataFrame, at: str = "date", share: float = 0.8, out: str = "is_train") -> DataFrame:
    return df.withColumn(out, F.col(at) <= chrono_cut(df, at, share).scalar())


def hash_split(key: str, share: float = 0.8) -> str:
    """Row-stable random split: true for about ``share`` of the keys, the same in any engine and partitioning."""
    return f"CAST(conv(substring(md5(CAST({key} AS STRING)), 1, 8), 16, 10) AS BIGINT) < {int(share * 2**32)}"


def gbt(features: Sequence[str], label: str = "target", indicator: str | None = None, **params) -> Pipeline:
    """Assembler and gradient-boosted trees; ``indicator`` marks validation rows for early stopping."""
    options = {"maxIter": 5, "maxDepth": 3, "seed": 42} | params
    if indicator:
        options["validationIndicatorCol"] = indicator
    model = GBTRegressor(featuresCol="features", labelCol=label, **options)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"), model])


def candidates(features: Sequence[str], label: str = "target") -> dict[str, Pipeline]:
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    return {
        "gbt": gbt(features, label),
        "forest": Pipeline(stages=[assemble, RandomForestRegressor(labelCol=label, numTrees=10, maxDepth=4, seed=42)]),
        "linear": Pipeline(stages=[assemble, LinearRegression(labelCol=label)]),
    }


def train_models(train: DataFrame, features: Sequence[str], label: str = "target") -> dict[str, PipelineModel]:
    return {name: p.fit(train) for name, p in candidates(features, label).items()}


def predict_all(df: DataFrame, models: Mapping[str, PipelineModel]) -> DataFrame:
    """One ``pred_<model>`` column per model; all models run in one pass over the rows."""
    names, out = list(df.columns), df
    for name, model in models.items():
        scored = model.transform(out).withColumnRenamed("prediction", f"pred_{name}")
        names.append(f"pred_{name}")
        out = scored.select(*names)
    return out


def rmse(model: PipelineModel, df: DataFrame, label: str = "target") -> float:
    return RegressionEvaluator(labelCol=label, metricName="rmse").evaluate(model.transform(df))


def forward_select(
    train: DataFrame,
    validation: DataFrame,
    batches: Sequence[Sequence[str]],
    label: str = "target",
    min_gain: float = 0.001,
    target_rmse: float | None = None,
    max_features: int | None = None,
    start: Sequence[str] = (),
) -> list[dict]:
    """Batch-wise forward selection: keep a batch when the validation error falls by more than ``min_gain``.

    The first batch is kept when there is no start set. One distributed fit per
    batch; the driver holds only names and errors.
    """
    chosen = list(start)
    best = rmse(gbt(chosen, label).fit(train), validation, label) if chosen else float("inf")
    log = []
    for i, batch in enumerate(batches):
        error = rmse(gbt([*chosen, *batch], label).fit(train), validation, label)
        kept = best - error > min_gain
        if kept:
            chosen, best = [*chosen, *batch], error
        log.append({"step": i, "features": ",".join(batch), "rmse": float(error), "kept": kept, "best": float(best)})
        if kept and target_rmse is not None and best < target_rmse:
            break
        if max_features and len(chosen) >= max_features:
            break
    return log


#: maxIter, maxDepth, stepSize of the boosted trees tried by ``leaderboard``
TREE_SETS = ((5, 2, 0.1), (5, 4, 0.1), (10, 3, 0.05))


def leaderboard(
    train: DataFrame, validation: DataFrame, features: Sequence[str], label: str = "target", era: str = "week_end",
    sets: Sequence[tuple[int, int, float]] = TREE_SETS,
) -> list[tuple[str, float]]:
    """Best of several model kinds and parameter sets, by validation error.

    The parameter set is chosen on the last fifth of the training eras: whole eras,
    in order of time, so the split is the same in any partitioning and overlapping
    targets don't leak. The chosen set is fitted on all training rows.

    All fits and scores read the same rows many times over, so these are cached, in memory
    as far as it goes; the few columns needed, in the partitions they came in.
    """
    train, validation = (df.select(era, label, *features).persist() for df in (train, validation))
    try:
        scores = [(n, float(rmse(m, validation, label))) for n, m in train_models(train, features, label).items()]
        split = chrono_split(train, era)
        early, late = split.where("is_train"), split.where("NOT is_train")
        errors = {s: rmse(_tree(features, label, s).fit(early), late, label) for s in sets}
        best = min(sets, key=lambda s: errors[s])
        scores.append(("gbt_search", float(rmse(_tree(features, label, best).fit(train), validation, label))))
    finally:
        train.unpersist()
        validation.unpersist()
    return sorted(scores, key=lambda s: s[1])


def _tree(features: Sequence[str], label: str, chosen: tuple[int, int, float]) -> Pipeline:
    rounds, depth, rate = chosen
    return gbt(features, label, maxIter=rounds, maxDepth=depth, stepSize=rate)


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    return [(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray())]


def importance_cut(rows: Sequence[tuple[str, float]], probe: str | None = None, cut: float = GAIN_CUT) -> list[str]:
    """Features above a fixed gain, or above the importance of a random probe column."""
    floor = dict(rows)[probe] if probe else cut
    return [f for f, v in rows if v > floor and f != probe]


def direction_model(train: DataFrame, features: Sequence[str], label: str = "up") -> PipelineModel:
    """Up/down classifier; the whole pipeline is fitted on the training rows only."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"),
        GBTClassifier(featuresCol="features", labelCol=label, maxIter=5, maxDepth=3, seed=42),
    ]
    return Pipeline(stages=stages).fit(train)


def shape_submission(live: DataFrame, model: PipelineModel, features: Sequence[str], key: str = "ticker", era: str = "week_end") -> DataFrame:
    """Score live rows: ``id, friday_date, signal``. The features must be present."""
    missing = [f for f in features if f not in live.columns]
    if missing:
        raise InputError(f"features missing from the live rows: {', '.join(missing)}")
    scored = model.transform(live.select(key, era, *features))
    return scored.selectExpr(f"{key} AS id", f"{date_key(era)} AS friday_date", "prediction AS signal")


def prepared(df: DataFrame, features: Sequence[str], label: str = "target") -> DataFrame:
    """Complete rows in single precision, kept once for the many passes of training."""
    cols = [c for c in df.columns if c not in features]
    return durable(df.dropna(subset=list(features)).selectExpr(*cols, *[f"CAST(CAST({f} AS FLOAT) AS DOUBLE) AS {f}" for f in features]))

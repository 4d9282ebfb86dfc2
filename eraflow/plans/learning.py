"""Scaling and splits (with reference SQL), training and submission (rows only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import weekly_last
from ..functions.indicators import add_rsi_simple
from ..functions.rolling import lead, pct_change, roll_mean, roll_std
from ..functions.safe import div, rounded
from ..operators import clean, era, learn
from ..operators.ranking import percent_ranks
from ..session import durable
from ..sources import panels, sinks
from ..sources.panels import DAILY
from .registry import query
from .twins import frame, r6, using, week_of

FEATURES = ["ret5", "ret20", "rsi", "gap20", "vol20", "random_uniform"]


def model_table(spark, folder):
    """Weekly features per ticker with the ranked target and the data split."""
    b = add_rsi_simple(panels.by_ticker(spark, folder, panels.bars(spark, folder).select("ticker", "date", "close")), periods=[14])
    b = b.selectExpr(
        "ticker", "date", "close", f"{pct_change('close', 5, DAILY)} AS ret5", f"{pct_change('close', 20, DAILY)} AS ret20",
        "rsi_14 AS rsi", f"{div('close', roll_mean('close', 20, DAILY))} AS gap20", f"{roll_std('close', 20, DAILY)} AS vol20",
    )
    w = weekly_last(b, ["close", "ret5", "ret20", "rsi", "gap20", "vol20"])
    probe = clean.probe_columns(["ticker", "week_end"])["random_uniform"]
    w = durable(w.selectExpr("*", f"{div(f'({panels.LATER})', 'close')} - 1 AS fwd", f"{probe} AS random_uniform"))
    ranked = percent_ranks(w, ["week_end"], {"target": "fwd"}, "ticker")
    newest = w.agg(F.max("week_end")).scalar()
    kind = F.when(F.col("week_end") == newest, "live").when(F.expr("week_end < DATE'1999-01-01'"), "train").otherwise("validation")
    full = w.join(ranked, ["ticker", "week_end"]).withColumn("data_type", kind)
    return learn.prepared(full.select("ticker", "week_end", "data_type", "target", *FEATURES), FEATURES)


_C = ("close", "volume")
_ST = "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _C) + " FROM bars WHERE date < DATE '1999-01-01')"


@query("standardise", using("bars", extra=_ST) + "SELECT ticker, date, " + ", ".join(f"{r6(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in _C) + " FROM bars, st")
def standardise(spark, folder):
    b = panels.bars(spark, folder).select("ticker", "date", *_C)
    s = learn.standardise(b, b.where("date < DATE'1999-01-01'"), _C)
    return s.selectExpr("ticker", "date", *[f"{rounded(c)} AS {c}" for c in _C])


@query(
    "minmax",
    using("bars", extra="st AS (SELECT min(close) AS lo, max(close) AS hi FROM bars)")
    + "SELECT ticker, date, round((close - lo) / (hi - lo), 6) AS scaled, round(close, 2) AS restored FROM bars, st",
)
def minmax(spark, folder):
    b = panels.bars(spark, folder).select("ticker", "date", "close")
    return learn.minmax(b, b, "close", back="restored").selectExpr("ticker", "date", "round(scaled, 6) AS scaled", "round(restored, 2) AS restored")


@query(
    "chrono_split",
    using("bars", extra="""d AS (SELECT date, count(*) AS n FROM bars GROUP BY 1),
c AS (SELECT min(date) AS cut FROM (SELECT date, sum(n) OVER (ORDER BY date) AS run, sum(n) OVER () AS total FROM d) WHERE run >= 0.8 * total)""")
    + "SELECT date <= cut AS is_train, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars, c GROUP BY 1",
)
def chrono_split(spark, folder):
    s = learn.chrono_split(panels.bars(spark, folder).select("ticker", "date"))
    return panels.agg(s, ["is_train"], "count(*) AS n", "min(date) AS first_date", "max(date) AS last_date")


@query(
    "hash_split",
    "SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) < 3435973836 AS is_train FROM orders",
)
def hash_split(spark, folder):
    return panels.table(spark, folder, "orders").selectExpr("o_orderkey", f"{learn.hash_split('o_orderkey')} AS is_train")


_W = "(PARTITION BY ticker ORDER BY date)"
_INPUT = using("bars", extra=f"""c AS (SELECT *, close - lag(close) OVER {_W} AS chg FROM bars),
f AS (SELECT ticker, date, {week_of('date')} AS week_end, close, close / lag(close, 5) OVER {_W} - 1 AS ret5, close / lag(close, 20) OVER {_W} - 1 AS ret20,
  CASE WHEN avg(greatest(-chg, 0)) OVER {frame(14)} > 0 THEN 100 - 100 / (1 + avg(greatest(chg, 0)) OVER {frame(14)} / avg(greatest(-chg, 0)) OVER {frame(14)}) ELSE 100 END AS rsi,
  CASE WHEN count(close) OVER {frame(20)} >= 20 THEN close / avg(close) OVER {frame(20)} END AS gap20,
  CASE WHEN count(close) OVER {frame(20)} >= 20 THEN stddev_samp(close) OVER {frame(20)} END AS vol20 FROM c),
w AS (SELECT ticker, week_end, arg_max(close, date) AS close, arg_max(ret5, date) AS ret5, arg_max(ret20, date) AS ret20, arg_max(rsi, date) AS rsi,
  arg_max(gap20, date) AS gap20, arg_max(vol20, date) AS vol20 FROM f GROUP BY 1, 2),
l AS (SELECT *, first(close) OVER (PARTITION BY ticker ORDER BY week_end RANGE BETWEEN INTERVAL 28 DAYS FOLLOWING AND INTERVAL 28 DAYS FOLLOWING) / close - 1 AS fwd FROM w),
t AS (SELECT *, CASE WHEN fwd IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY week_end, fwd IS NULL ORDER BY fwd, ticker) AS DOUBLE)
  / count(fwd) OVER (PARTITION BY week_end) END AS target,
  CASE WHEN week_end = (SELECT max(week_end) FROM w) THEN 'live' WHEN week_end < DATE '1999-01-01' THEN 'train' ELSE 'validation' END AS data_type FROM l)
""")
_COMPLETE = "ret5 IS NOT NULL AND ret20 IS NOT NULL AND rsi IS NOT NULL AND gap20 IS NOT NULL AND vol20 IS NOT NULL"


@query(
    "model_inputs",
    _INPUT + "SELECT ticker, week_end, data_type, " + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in ("target", "ret5", "ret20", "rsi", "gap20"))
    + f", ('0x' || substr(md5('42|' || ticker || '|' || week_end), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.5 AS probe_low FROM t WHERE {_COMPLETE}",
)
def model_inputs(spark, folder):
    """The table all models are trained on and scored with."""
    t = model_table(spark, folder)
    return t.selectExpr(
        "ticker", "week_end", "data_type", *[f"CAST({c} AS FLOAT) AS {c}" for c in ("target", "ret5", "ret20", "rsi", "gap20")], "random_uniform < 0.5 AS probe_low"
    )


@query("submission_keys", _INPUT + f"SELECT ticker AS id, CAST(strftime(week_end, '%Y%m%d') AS INTEGER) AS friday_date FROM t WHERE data_type = 'live' AND {_COMPLETE}")
def submission_keys(spark, folder):
    """The rows a submission has to hold, after the CSV round trip."""
    return submission(spark, folder).where("signal IS NOT NULL").select("id", "friday_date")


@query("gbt_predict")
def gbt_predict(spark, folder):
    """Trees with early stopping on the validation eras; all labelled rows scored by three models and their mean."""
    t = model_table(spark, folder).where("target IS NOT NULL")
    fitted = learn.gbt(FEATURES, indicator="is_val").fit(t.where("data_type <> 'live'").withColumn("is_val", F.expr("data_type = 'validation'")))
    models = learn.train_models(t.where("data_type = 'train'"), FEATURES) | {"early": fitted}
    scored = learn.predict_all(t, models)
    return scored.selectExpr("ticker", "week_end", "data_type", "target", *[f"pred_{m}" for m in models], era.ensemble_mean([f"pred_{m}" for m in models]))


@query("model_metrics")
def model_metrics(spark, folder):
    """Error of every model and of the ensemble on the validation eras, and the threshold check."""
    t = model_table(spark, folder).where("target IS NOT NULL")
    models = learn.train_models(t.where("data_type = 'train'"), FEATURES)
    cols = [f"pred_{m}" for m in models]
    scored = learn.predict_all(t.where("data_type = 'validation'"), models).selectExpr("*", era.ensemble_mean(cols))
    return era.threshold_check(era.regression_metrics(scored, "target", [*cols, "ensemble"]))


@query("forward_select")
def forward_select(spark, folder):
    t = model_table(spark, folder).where("target IS NOT NULL")
    batches = [["random_uniform"], ["ret5", "ret20"], ["rsi", "gap20"], ["vol20"]]
    log = learn.forward_select(t.where("data_type = 'train'"), t.where("data_type = 'validation'"), batches, min_gain=1e-5)
    return spark.createDataFrame(log, "step int, features string, rmse double, kept boolean, best double")


@query("leaderboard")
def leaderboard(spark, folder):
    t = model_table(spark, folder).where("target IS NOT NULL")
    rows = learn.leaderboard(t.where("data_type = 'train'"), t.where("data_type = 'validation'"), FEATURES)
    return spark.createDataFrame(rows, "model string, rmse double")


@query("importance_cut")
def importance_cut(spark, folder):
    t = model_table(spark, folder).where("target IS NOT NULL AND data_type = 'train'")
    rows = learn.importances(learn.gbt(FEATURES).fit(t), FEATURES)
    keep = set(learn.importance_cut(rows, probe="random_uniform"))
    return spark.createDataFrame([(f, v, f in keep) for f, v in rows], "feature string, importance double, kept boolean")


@query("direction_auc")
def direction_auc(spark, folder):
    """Next-day up/down classifier on four bar fields; AUC on the later fifth of the dates."""
    fields = ["open", "high", "low", "volume"]
    b = panels.by_ticker(spark, folder, panels.bars(spark, folder))
    b = b.selectExpr("date", *fields, f"CAST({lead('close', 1, DAILY)} > close AS INT) AS up").where("up IS NOT NULL")
    b = learn.chrono_split(durable(b))
    scored = learn.direction_model(b.where("is_train"), fields).transform(b.where("NOT is_train"))
    from pyspark.ml.functions import vector_to_array

    return era.auc(scored.select("up", vector_to_array("probability")[1].alias("score")), "up", "score")


@query("submission")
def submission(spark, folder):
    """Score the live era, write it as CSV and read it back."""
    t = model_table(spark, folder)
    model = learn.gbt(FEATURES).fit(t.where("data_type = 'train' AND target IS NOT NULL"))
    out = learn.shape_submission(t.where("data_type = 'live'"), model, FEATURES)
    path = sinks.fresh_path(spark, "submission")
    sinks.write_csv(out, path)
    return spark.read.schema("id bigint, friday_date int, signal double").option("header", True).csv(path)


@query(
    "feature_table_sink",
    using("labels_w") + "SELECT ticker, week_end, data_type, target FROM labels_w",
)
def feature_table_sink(spark, folder):
    """The label table written by era and read back."""
    path = sinks.fresh_path(spark, "features")
    sinks.write_features(panels.labels_weekly(spark, folder).drop("fwd"), path, "week_end")
    return spark.read.parquet(path).select("ticker", "week_end", "data_type", "target")


@query(
    "split_outputs",
    using("labels_w") + "SELECT 'diagnostics' AS output, ticker, week_end FROM labels_w WHERE data_type = 'validation' UNION ALL SELECT 'submission', ticker, week_end FROM labels_w",
)
def split_outputs(spark, folder):
    parts = sinks.split_outputs(panels.labels_weekly(spark, folder))
    rows = [df.selectExpr(f"'{name}' AS output", "ticker", "week_end") for name, df in parts.items()]
    return rows[0].unionByName(rows[1])


@query(
    "csv_round_trip",
    "SELECT s_suppkey AS ticker, s_name AS sedol, CAST(s_nationkey AS VARCHAR) AS industry_code FROM supplier",
)
def csv_round_trip(spark, folder):
    """CSV sink, then the two CSV sources: text with renames, and a declared schema."""
    from ..sources import readers

    path = sinks.fresh_path(spark, "sector")
    s = panels.table(spark, folder, "supplier").selectExpr("s_name AS SEDOL", "s_suppkey AS ticker_bb", "s_nationkey AS code")
    sinks.write_csv(s, path)
    names = readers.read_ticker_map(spark, path, {"SEDOL": "sedol", "ticker_bb": "ticker", "code": "industry_code"})
    typed = readers.read_csv(spark, path, "sedol string, ticker bigint, industry_code string", ["ticker", "industry_code"])
    return typed.join(names.selectExpr("CAST(ticker AS BIGINT) AS ticker", "sedol"), "ticker").select("ticker", "sedol", "industry_code")

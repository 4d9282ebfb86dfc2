"""Cleaning, encoding, splitting, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.rolling import filled, lag, log_return, pct_change
from ..functions.safe import clip_low, div, ln, named, rounded, sqrt
from ..operators import clean
from ..operators.ranking import label_codes
from ..sources import panels
from ..sources.panels import DAILY, WEEKLY
from .registry import query
from .twins import r6, using, week_of

LAST_WEEK = "(SELECT max(week_end) FROM weekly)"


@query(
    "fill_defaults",
    using("dim") + """SELECT ticker, coalesce(shares, 1000000) AS shares, coalesce(sector, 'unknown') AS sector,
 coalesce(CASE WHEN ticker % 4 <> 1 THEN country END, 'unknown') AS industry,
 coalesce(CASE WHEN ticker % 5 <> 2 THEN shares END, 1) AS "priceToBook_raw" FROM dim""",
)
def fill_defaults(spark, folder):
    d = panels.attributes(spark, folder).selectExpr(
        "ticker",
        "shares",
        "sector",
        "CASE WHEN ticker % 4 <> 1 THEN country END AS industry",
        "CASE WHEN ticker % 5 <> 2 THEN shares END AS priceToBook_raw",
    )
    return clean.fill_defaults(d)


_HOLES = "CASE WHEN (ticker + day(date)) % 3 <> 0 THEN close END"


@query(
    "ffill_bfill",
    using("bars", extra=f"h AS (SELECT ticker, date, {_HOLES} AS x FROM bars)")
    + """SELECT ticker, date, last_value(x IGNORE NULLS) OVER a AS causal,
 coalesce(last_value(x IGNORE NULLS) OVER a, first_value(x IGNORE NULLS) OVER b, 0) AS both_ways
FROM h WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def ffill_bfill(spark, folder):
    h = panels.bars(spark, folder).selectExpr("ticker", "date", f"{_HOLES} AS x")
    return h.selectExpr(
        "ticker", "date", f"{filled('x', DAILY)} AS causal", f"{filled('x', DAILY, causal=False)} AS both_ways"
    )


@query(
    "sentinel_clean",
    using("bars", extra="r AS (SELECT ticker, date, close, close / lag(close, 20) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars)")
    + "SELECT ticker, date, round(coalesce(ret, -20000), 6) AS ret FROM r",
)
def sentinel_clean(spark, folder):
    r = panels.bars(spark, folder).selectExpr("ticker", "date", f"{pct_change('close', 20, DAILY)} AS ret")
    # an infinite value on the way must end as the sentinel too
    r = r.selectExpr("ticker", "date", "CASE WHEN ret IS NULL THEN double('inf') ELSE ret END AS ret")
    return r.selectExpr("ticker", "date", *[f"round({e}, 6) AS {n}" for n, e in clean.sentinel_fill(["ret"]).items()])


@query(
    "drop_incomplete",
    using("bars", extra="r AS (SELECT ticker, date, close, close / lag(close, 60) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars)")
    + "SELECT ticker, date, round(ret, 6) AS ret FROM r WHERE ret IS NOT NULL",
)
def drop_incomplete(spark, folder):
    r = panels.bars(spark, folder).selectExpr("ticker", "date", f"round({pct_change('close', 60, DAILY)}, 6) AS ret")
    return clean.complete_rows(r, ["ret"])


@query(
    "safe_divide",
    using("bars") + """SELECT ticker, date, round(coalesce((open - close) / nullif(high - low, 0), 0), 6) + 0.0 AS ratio,
 round(coalesce((close - low) / nullif(high - low, 0), 0.5), 6) AS place, round((close - open) / nullif(high - low, 0), 6) + 0.0 AS open_ratio FROM bars""",
)
def safe_divide(spark, folder):
    return panels.bars(spark, folder).selectExpr(
        "ticker",
        "date",
        f"{rounded(div('open - close', 'high - low', 0.0))} AS ratio",
        f"round({div('close - low', 'high - low', 0.5)}, 6) AS place",
        f"{rounded(div('close - open', 'high - low'))} AS open_ratio",
    )


@query(
    "clip_transform",
    using("bars") + """SELECT ticker, date, round(ln(greatest(close, 1e-9)), 6) AS close_log,
 round(sqrt(greatest(close - open, 0)), 6) AS body_sqrt, round(close * close, 4) AS close_sq,
 greatest(close - open, 0.0) AS body_clip FROM bars""",
)
def clip_transform(spark, folder):
    return panels.bars(spark, folder).selectExpr(
        "ticker",
        "date",
        f"round({ln(clip_low('close', 1e-9))}, 6) AS close_log",
        f"round({sqrt(f'({clip_low("close - open", 0)})')}, 6) AS body_sqrt",
        "round(close * close, 4) AS close_sq",
        f"{clip_low('close - open', 0)} AS body_clip",
    )


@query(
    "lenient_cast",
    """SELECT s_suppkey AS ticker, CAST(round(coalesce(TRY_CAST(CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE CAST(s_acctbal AS VARCHAR) END AS DOUBLE), 1000000)) AS BIGINT) AS shares
FROM supplier""",
)
def lenient_cast(spark, folder):
    s = panels.table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS ticker", "CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE CAST(s_acctbal AS STRING) END AS raw"
    )
    return s.selectExpr("ticker", f"{clean.lenient_number('raw', 1000000)} AS shares")


@query(
    "narrow_types",
    """SELECT CAST(l_linenumber AS TINYINT) AS l_linenumber, CAST(l_suppkey AS {t}) AS l_suppkey, CAST(l_orderkey AS {o}) AS l_orderkey,
 CAST(sum(l_quantity) AS FLOAT) AS qty FROM lineitem GROUP BY 1, 2, 3""".format(t="TINYINT", o="SMALLINT"),
)
def narrow_types(spark, folder):
    line = panels.table(spark, folder, "lineitem")
    qty = line.groupBy("l_linenumber", "l_suppkey", "l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    return clean.narrow_types(qty)


@query(
    "widen_types",
    "SELECT CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(sum(CAST(l_quantity AS FLOAT)) AS DOUBLE) AS qty FROM lineitem GROUP BY 1",
)
def widen_types(spark, folder):
    line = panels.table(spark, folder, "lineitem").selectExpr(
        "CAST(l_linenumber AS SMALLINT) AS l_linenumber", "CAST(l_quantity AS FLOAT) AS q"
    )
    return clean.widen_types(line).groupBy("l_linenumber").agg(F.sum("q").alias("qty"))


@query(
    "code_prefix",
    using("dim") + "SELECT ticker, code, substr(code, 1, 2) AS code_1, substr(code, 1, 4) AS code_2, substr(code, 1, 6) AS code_3 FROM dim",
)
def code_prefix(spark, folder):
    return panels.attributes(spark, folder).selectExpr("ticker", "code", *named(clean.code_prefixes()))


#: nine text columns, as many as the reference encodes
_CODED = {
    "name": "name", "country": "country", "sector": "sector", "code": "code", "code_1": "substring(code, 1, 2)", "code_2": "substring(code, 1, 4)",
    "code_3": "substring(code, 1, 6)", "country_initial": "substring(country, 1, 1)", "name_end": "substring(name, -2, 2)",
}


@query(
    "label_encode",
    using("dim") + "SELECT ticker, " + ", ".join(f"CAST(dense_rank() OVER (ORDER BY {e}) - 1 AS BIGINT) AS {c}_code" for c, e in _CODED.items()) + " FROM dim",
)
def label_encode(spark, folder):
    d = panels.attributes(spark, folder).selectExpr("ticker", *[f"{e} AS {c}" for c, e in _CODED.items()])
    return label_codes(d, "ticker", list(_CODED))


_SUFFIX = "split_part('US LN JP GY FP HK XX', ' ', CAST(s_suppkey % 7 AS INTEGER) + 1)"


@query(
    "suffix_country",
    f"""SELECT s_suppkey AS id, s_name || ' ' || {_SUFFIX} AS ticker, CASE {_SUFFIX} WHEN 'US' THEN 'US' WHEN 'LN' THEN 'GB'
 WHEN 'JP' THEN 'JP' WHEN 'GY' THEN 'DE' WHEN 'FP' THEN 'FR' WHEN 'HK' THEN 'HK' END AS country FROM supplier""",
)
def suffix_country(spark, folder):
    s = panels.table(spark, folder, "supplier").selectExpr("s_suppkey AS id", f"s_name || ' ' || {_SUFFIX} AS ticker")
    return s.selectExpr("*", f"{clean.suffix_country('ticker')} AS country")


@query(
    "rename_project",
    using("dim") + "SELECT ticker AS signal_ticker, replace(country, '_', '-') AS risk_country, 'training' AS data_type FROM dim WHERE shares > 0",
)
def rename_project(spark, folder):
    d = panels.attributes(spark, folder).where("shares > 0")
    d = d.withColumnsRenamed({"ticker": "signal_ticker", "country": "risk_country"})
    return d.selectExpr("signal_ticker", "replace(risk_country, '_', '-') AS risk_country", "'training' AS data_type")


@query(
    "select_features",
    using("labels_w") + "SELECT fwd FROM labels_w WHERE fwd IS NOT NULL",
)
def select_features(spark, folder):
    lab = panels.labels_weekly(spark, folder)
    target = clean.first_available(lab, ["target_20d", "target_4d", "target"])
    keep = clean.feature_columns(lab, ["ticker", "week_end", "data_type"])
    return lab.where(f"{target} IS NOT NULL").select(*keep)


@query(
    "relabel_live",
    using("weekly") + f"SELECT ticker, week_end, CASE WHEN week_end = {LAST_WEEK} THEN 'live' ELSE 'validation' END AS data_type FROM weekly",
)
def relabel_live(spark, folder):
    w = panels.weekly(spark, folder).selectExpr("ticker", "week_end", "'validation' AS data_type")
    newest = panels.table(spark, folder, "lineitem").selectExpr(f"max({cal.week_end('CAST(l_shipdate AS DATE)')}) AS d").scalar()
    return clean.relabel_live(w, "week_end", newest)


@query(
    "split_sets",
    using("labels_w") + """SELECT data_type AS part, count(*) AS n, round(avg(target), 6) AS mean_target, min(week_end) AS first_era, max(week_end) AS last_era
FROM labels_w WHERE data_type = 'live' OR target IS NOT NULL GROUP BY 1""",
)
def split_sets(spark, folder):
    parts = clean.split_sets(panels.labels_weekly(spark, folder))
    out = None
    for name, df in parts.items():
        one = df.selectExpr(f"'{name}' AS part", "target", "week_end")
        out = one if out is None else out.unionByName(one)
    return panels.agg(out, ["part"], "count(*) AS n", "round(avg(target), 6) AS mean_target",
                      "min(week_end) AS first_era", "max(week_end) AS last_era")


@query(
    "dedup_first",
    f"""SELECT ticker, week_end, priority, l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
 SELECT l_suppkey AS ticker, {week_of('CAST(l_shipdate AS DATE)')} AS week_end, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS priority,
 l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY ticker, week_end ORDER BY priority, l_orderkey, l_linenumber, l_partkey, l_quantity) = 1""",
)
def dedup_first(spark, folder):
    rows = panels.table(spark, folder, "lineitem").selectExpr(
        "l_suppkey AS ticker",
        f"{cal.week_end('CAST(l_shipdate AS DATE)')} AS week_end",
        "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS priority",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
    )
    order = ["priority", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    return clean.first_per_key(rows, ["ticker", "week_end"], order)


@query(
    "carry_forward_missing",
    using("weekly") + f"""SELECT ticker, week_end, close, volume FROM weekly UNION ALL
SELECT p.ticker, {LAST_WEEK}, p.close, p.volume FROM weekly p WHERE p.week_end = {LAST_WEEK} - 7
 AND p.ticker NOT IN (SELECT ticker FROM weekly WHERE week_end = {LAST_WEEK})""",
)
def carry_forward_missing(spark, folder):
    w = panels.weekly(spark, folder).select("ticker", "week_end", "close", "volume")
    newest = panels.table(spark, folder, "lineitem").selectExpr(f"max({cal.week_end('CAST(l_shipdate AS DATE)')}) AS d").scalar()
    return clean.carry_forward_missing(w, "week_end", newest, F.date_sub(newest, 7), ["close", "volume"])


@query(
    "preview_rows",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
)
def preview_rows(spark, folder):
    # the limit is the feature: a head() of the ordered table
    return panels.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(100)

"""Market-shaped inputs derived from the order-management tables.

Daily bars are unique per (ticker, date), so the history of one ticker is
bounded by the calendar (some 25,000 days a century) however many raw rows it
has; all per-ticker windows of the library run at that grain. The raw rows are
combined before the shuffle, so a ticker holding a third of them is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import week_end, weekly_last
from ..functions.indicators import add_rsi_simple
from ..functions.rolling import Series, pct_change
from ..functions.safe import div
from ..operators.ranking import percent_ranks
from .store import bucketed, kept

MARKET_ASSETS = list(range(7))
DAILY, WEEKLY = Series("ticker", "date"), Series("ticker", "week_end")
LATER = "first(close) OVER (PARTITION BY ticker ORDER BY unix_date(week_end) RANGE BETWEEN 28 FOLLOWING AND 28 FOLLOWING)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def agg(df: DataFrame, keys: list[str], *exprs: str) -> DataFrame:
    """Grouped aggregation from SQL text."""
    return df.groupBy(*[F.expr(k) for k in keys]).agg(*[F.expr(e) for e in exprs])


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily OHLCV per supplier, prices in whole cents.

    Inside a day lines are ordered by order key, then by price. Both fit one
    BIGINT, so every aggregate has a fixed-width buffer and the query stays a
    hash aggregation with map-side combine (a struct key would turn it into a
    sort of all raw rows).
    """
    ticks = table(spark, folder, "lineitem").selectExpr(
        "l_suppkey AS ticker",
        "CAST(l_shipdate AS DATE) AS date",
        "floor(try_divide(l_extendedprice * 100, l_quantity)) AS cents",
        "l_quantity AS qty",
        "l_orderkey AS key",
    )
    at = f"key * {2**24} + cents"
    return agg(
        ticks,
        ["ticker", "date"],
        f"min_by(cents, {at}) / 100D AS open",
        "max(cents) / 100D AS high",
        "min(cents) / 100D AS low",
        f"max_by(cents, {at}) / 100D AS close",
        "sum(qty) AS volume",
    )


def by_ticker(spark: SparkSession, folder: str, b: DataFrame, rows: int = 400_000) -> DataFrame:
    """Bars with those of a ticker in one task.

    Beyond ``rows`` raw rows the number of partitions follows the raw rows, so that what one
    task sorts or trains on stays the same however large the input is, and Spark does not pack
    partitions by their compressed bytes. Smaller inputs are left to Spark.
    """
    parts = -(-table(spark, folder, "lineitem").count() // rows)
    return b.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "ticker") if parts > 1 else b


def buckets(spark: SparkSession, folder: str, rows: int = 100_000) -> int:
    """As many as there are ``rows`` raw rows each, and one for each core: what a task costs by itself is paid for by its rows."""
    return max(-(-table(spark, folder, "lineitem").count() // rows), spark.sparkContext.defaultParallelism)


def stored_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The daily bars with the ticker's shares, written once a session in buckets: windows by ticker need no shuffle."""
    make = lambda: bars(spark, folder).join(attributes(spark, folder).select("ticker", "shares"), "ticker", "left")
    return bucketed(spark, folder, "bars", make, ["ticker"], ["ticker", "date"], buckets(spark, folder))


def attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Sector dimension of the tickers."""
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    parts = ["r_regionkey", "n_nationkey", "s_suppkey % 100", "s_suppkey % 7"]
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .selectExpr(
            "s_suppkey AS ticker",
            "s_name AS name",
            "n_name AS country",
            "r_name AS sector",
            "CASE WHEN s_suppkey % 10 <> 3 THEN s_acctbal END AS shares",
            "concat(" + ", ".join(f"lpad(CAST({p} AS STRING), 2, '0')" for p in parts) + ") AS code",
        )
    )


def fundamentals(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly revenue per ticker, dated by the quarter's last day."""
    return agg(
        table(spark, folder, "lineitem").withColumnRenamed("l_suppkey", "ticker"),
        ["ticker", "last_day(add_months(trunc(l_shipdate, 'QUARTER'), 2)) AS period_end"],
        "sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) / 100D AS revenue",
    )


def macro_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return agg(
        table(spark, folder, "orders"),
        ["trunc(o_orderdate, 'MM') AS date"],
        "count(*) AS order_count",
        "sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100D / count(*) AS mean_price",
        "count_if(o_orderpriority = '1-URGENT') / count(*) AS urgent_share",
    )


def macro_weekly(spark: SparkSession, folder: str) -> DataFrame:
    return agg(
        table(spark, folder, "orders"),
        [f"{week_end('CAST(o_orderdate AS DATE)')} AS date"],
        "count(*) AS weekly_orders",
    )


def _weekly_ahead(spark: SparkSession, folder: str) -> DataFrame:
    """``weekly`` with ``fwd``, the return to the week four weeks later, written once a session.

    Only the two bar fields it needs are shuffled; the bars come together by ticker once,
    for the windows over bars, the weeks and the look ahead.
    """

    def make() -> DataFrame:
        b = by_ticker(spark, folder, bars(spark, folder).select("ticker", "date", "close", "volume"))
        # as in ``stored_bars``, a ticker that is listed twice has each of its bars twice
        b = add_rsi_simple(b.join(attributes(spark, folder).select("ticker"), "ticker", "left"), periods=[14])
        b = b.selectExpr("*", f"{pct_change('close', 5, DAILY)} AS ret5", "round(rsi_14, 6) AS rsi")
        w = weekly_last(b, ["close", "volume", "ret5", "rsi"])
        return w.selectExpr("*", f"{div(f'({LATER})', 'close')} - 1 AS fwd")

    return kept(spark, folder, "weekly", make)


def weekly(spark: SparkSession, folder: str) -> DataFrame:
    """Per ticker and Friday week: last close, trailing 5-bar return, 14-bar RSI, volume."""
    return _weekly_ahead(spark, folder).drop("fwd")


def weekly_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly table with percent ranks inside each era, written once a session in a folder per split.

    ``target``: rank of the return to the week four weeks later (NULL where the
    ticker has no bar in that week, as for the newest eras). ``pred_momentum`` and ``pred_reversal``: two deterministic
    models, the rank of the trailing return and of the negated RSI.
    """

    def make() -> DataFrame:
        w = _weekly_ahead(spark, folder).selectExpr("ticker", "week_end", "fwd", "ret5", "-rsi AS neg_rsi")
        ranked = percent_ranks(w, ["week_end"], {"target": "fwd", "pred_momentum": "ret5", "pred_reversal": "neg_rsi"}, "ticker", keep=["fwd"])
        newest = w.agg(F.max("week_end")).scalar()
        kind = (
            F.when(F.col("week_end") == newest, "live")
            .when(F.expr("week_end < DATE'1999-01-01'"), "train")
            .otherwise("validation")
        )
        named = ranked.where("ticker IS NOT NULL AND week_end IS NOT NULL")
        return named.select("ticker", "week_end", "fwd", kind.alias("data_type"), "target", "pred_momentum", "pred_reversal")

    return kept(spark, folder, "weekly_ranks", make, split_by="data_type")


def labels_weekly(spark: SparkSession, folder: str) -> DataFrame:
    return weekly_ranks(spark, folder).select("ticker", "week_end", "data_type", "target", "fwd")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return weekly_ranks(spark, folder).select("ticker", "week_end", "pred_momentum", "pred_reversal")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with predictions, rows that have a target and both predictions."""
    return weekly_ranks(spark, folder).where(
        "target IS NOT NULL AND pred_momentum IS NOT NULL AND pred_reversal IS NOT NULL"
    )


def portfolio_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate portfolios: what each customer spent on each declared asset, in cents; all assets of a customer with any."""
    lines = table(spark, folder, "lineitem").where(F.col("l_suppkey").isin(MARKET_ASSETS))
    spent = lines.selectExpr("l_orderkey", "l_suppkey", "CAST(round(l_extendedprice * 100) AS BIGINT) AS cents")
    bought = table(spark, folder, "orders").selectExpr("o_orderkey AS l_orderkey", "CAST(o_custkey AS INT) AS portfolio_id").join(spent, "l_orderkey")
    wide = agg(bought, ["portfolio_id"], *[f"sum(CASE WHEN l_suppkey = {a} THEN cents ELSE 0 END) AS a{a}" for a in MARKET_ASSETS])
    rows = ", ".join(f"struct(CAST({a} AS BIGINT) AS asset, a{a} AS proportion)" for a in MARKET_ASSETS)
    return wide.selectExpr("portfolio_id", f"inline(array({rows}))")

"""File sources with declared schemas, date ranges, input contracts, small literal tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_SCHEMA = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("date", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
SECTOR_SCHEMA = "sedol string, ticker string, industry_code string"
TICKER_MAP_SCHEMA = "ticker string, local_ticker string, vendor_ticker string"
LABEL_SCHEMA = "ticker string, friday_date int, data_type string, target double"


class InputError(ValueError):
    """A source does not satisfy the contract of an operator."""


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header. Without a schema all columns are text; nothing is inferred by a second scan."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.select(*columns) if columns else df


def read_ticker_map(spark: SparkSession, path: str, names: Mapping[str, str]) -> DataFrame:
    return read_csv(spark, path).withColumnsRenamed(dict(names))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label table with the era key as integer."""
    return spark.read.parquet(path).withColumn("friday_date", F.col("friday_date").cast("int"))


def date_range(df: DataFrame, start: str, end: str | None = None, at: str = "date") -> DataFrame:
    """Rows with start <= date < end; comparisons on the bare column reach the scan."""
    df = df.where(F.col(at) >= F.lit(start).cast("date"))
    return df.where(F.col(at) < F.lit(end).cast("date")) if end else df


def literal_table(spark: SparkSession, values: Iterable, name: str = "value") -> DataFrame:
    """One-column table from a short literal list."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def require(df: DataFrame, columns: Iterable[str], non_empty: bool = True) -> DataFrame:
    """Raise InputError when a column is missing or (optionally) there is no row."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InputError(f"missing columns: {', '.join(missing)}")
    if non_empty and df.isEmpty():
        raise InputError("the table has no rows")
    return df


def assemble_market(bars: DataFrame, assets: Sequence, by: str = "ticker", at: str = "date", fields: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Wide market table: one row per date, ``a<asset>_<field>`` columns.

    Equals the full outer join of the assets' bar tables on date, in one pass.
    """
    wide = (
        bars.where(F.col(by).isin(list(assets)))
        .groupBy(at)
        .agg(*[F.max(F.when(F.col(by) == a, F.col(f))).alias(f"a{a}_{f}") for a in assets for f in fields])
    )
    return wide


def assemble_macro(series: Mapping[str, DataFrame], at: str = "date", align: str = "outer") -> DataFrame:
    """Columns from (date, value) series. align='first' keeps only the first series' dates."""
    items = list(series.items())
    out = items[0][1].select(at, F.col("value").alias(items[0][0]))
    how = "left" if align == "first" else "full"
    for name, df in items[1:]:
        out = out.join(df.select(at, F.col("value").alias(name)), at, how)
    return out

"""File sinks for submissions and feature tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def sized(df: DataFrame, era: str, rows_per_file: int) -> DataFrame:
    """Rows dealt out by era and ``_salt``, as many salts an era as it needs files.

    The sizes of the eras, one row for each folder to be written, are sent to all tasks;
    the rows are shuffled once.
    """
    files = df.groupBy(F.col(era).alias("_era")).agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    salted = df.join(F.broadcast(files), F.col(era).eqNullSafe(F.col("_era")), "left").withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.col("_files")))
    return salted.repartition(era, "_salt").drop("_era", "_files", "_salt")


def write_features(df: DataFrame, path: str, era: str = "friday_date", mode: str = "overwrite", rows_per_file: int = 1_000_000) -> None:
    """Parquet partitioned by era. An era is spread over as many tasks as its rows need at
    ``rows_per_file`` each, so a large era is not written by one task and small eras do
    not make small files."""
    sized(df, era, rows_per_file).write.mode(mode).partitionBy(era).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, mode: str = "overwrite") -> None:
    """Bucketed and sorted table: later joins on the keys need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def split_outputs(df: DataFrame, kind: str = "data_type") -> dict[str, DataFrame]:
    """Validation rows for diagnostics, all rows for submission."""
    return {"diagnostics": df.where(F.col(kind) == "validation"), "submission": df}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder of the cluster."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A result kept as Parquet in the shared folder: read back with its size known and no lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

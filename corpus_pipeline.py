"""Corpus preparation in five stages, each by one operator of ``eraflow.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame that is written as Parquet and read again for the next one:

1. toxicity: documents that the clause grammar rejects go;
2. near-duplicates: one document of each group stays (five words, similarity 0.8);
3. repeated passages: characters inside strings of 200 bytes that occur elsewhere go;
4. decontamination: documents that hold half of a benchmark item or more go;
5. mixture: rows by square-root smoothed source weights, in global random order.

The columns stay those of the input; a column ``n_chars`` follows the text. The last
stage adds copy, n_copies and shuffle_key. Nulls, empty tables, repeated rows and
further columns are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eraflow.llm import minhash, mixing, suffixes, tiling, toxicity
from eraflow.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~toxicity.is_held_out())
    return toxicity.clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, size=5, percent=80)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.trimmed(docs, length=200)
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", counted)
    return cut


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs, power=0.5)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("decontamination", decontamination_stage),
    ("mixture", mixture_stage),
]

#: SQL can't express the fitted grammar of the first stage; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

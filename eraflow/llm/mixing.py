"""Mixing sources to target weights by Poisson replication.

A source with share w of the mixture and n rows gets the mean repetition rate
``total * w / n``. Each row draws its number of copies by inverting the Poisson
distribution of that rate at a number in [0, 1) hashed from seed, id and text, so the
draw is the same on every run and machine and needs no state. Rows are exploded by
their count and put into one global random order by a second hash. Everything is
DataFrame expressions; the only tables are row counts per source.

A rate above ``SPLIT`` is the sum of several draws of equal rates, as exp(-rate) would
vanish otherwise. Nothing is cut off: the summed terms go on until what is left is
below the resolution of the hashed number.

A null source is a source of its own. Sources without a target get the rate 0 and
vanish; with ``targets`` None the weights are the ``power``-th powers of the shares.
Rows with equal id and text draw the same count. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, quoted, stored, unpacked

SPLIT = 500


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 of the parts."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_count(rate: Column, number: Column) -> Column:
    """The count k whose Poisson interval [cdf(k - 1), cdf(k)) holds ``number``."""
    last = F.ceil(rate + 9 * F.sqrt(rate) + 20).cast("int")  # what lies beyond has a chance below 2**-52
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"), F.lit(0).cast("bigint").alias("k"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * rate / k
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"), (acc["k"] + F.when(acc["sum"] <= number, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["k"])


def rates(docs: DataFrame, source_col: str, targets: dict | None, total: int | None, power: float) -> DataFrame:
    """(source, rows, rate): one row per source."""
    counts = stored(docs.groupBy(quoted(source_col).alias("source")).agg(F.count("*").alias("rows")), "sources")
    if targets is None:
        weighed = counts.withColumn("weight", F.sqrt("rows") if power == 0.5 else F.pow("rows", F.lit(power)))
    else:
        pairs = [(k, float(v)) for k, v in targets.items()]
        asked = docs.sparkSession.createDataFrame(pairs, "name string, weight double")
        weighed = counts.join(asked, F.col("source").cast("string").eqNullSafe(F.col("name")), "left").drop("name").fillna(0.0, ["weight"])
    sums = weighed.agg(F.sum("rows").alias("all_rows"), F.sum(F.col("weight").cast("decimal(30,12)")).cast("double").alias("all_weights"))
    size = F.col("all_rows") if total is None else F.lit(total)
    full = weighed.join(F.broadcast(sums))  # one row
    return full.select("source", "rows", F.coalesce(F.try_divide(size * F.col("weight"), F.col("all_weights") * F.col("rows")), F.lit(0.0)).alias("rate"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict | None = None,
            total: int | None = None, power: float = 0.5, seed: int = 17) -> DataFrame:
    """Rows of ``docs``, each as often as drawn, in global random order, with copy (from 1),
    n_copies and shuffle_key; columns of ``docs`` with those names are replaced."""
    base = docs.drop("copy", "n_copies", "shuffle_key")
    rate = stored(rates(base, source_col, targets, total, power), "rates").select("source", "rate")
    rows = packed(base, id=quoted(id_col), digest=F.md5(F.coalesce(quoted(text_col), F.lit(""))), own=quoted(source_col))
    key = F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("digest")
    rated = rows.join(rate, F.col("own").eqNullSafe(F.col("source")), "left")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT)).cast("int")
    drawn = F.aggregate(
        F.sequence(F.lit(1), parts), F.lit(0).cast("bigint"), lambda acc, j: acc + poisson_count(F.col("rate") / parts, unit(str(seed), j.cast("string"), *key))
    )
    counted = rated.withColumn("n_copies", drawn).where("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))))
    shuffled = copies.withColumn("shuffle_key", unit(f"order {seed}", F.col("copy").cast("string"), *key))
    # keys are uniform: equal ranges of them are equal parts, and no sample of the draws is needed
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shuffled.repartitionById(parts, F.floor(F.col("shuffle_key") * parts).cast("int")).sortWithinPartitions("shuffle_key", "id")
    return dealt.select(*unpacked(dealt, base.columns), "n_copies", "copy", "shuffle_key")

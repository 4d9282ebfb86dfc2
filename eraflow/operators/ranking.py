"""Exact ranks and running totals inside groups of any size.

A Window partitioned by era puts a whole era into one task; with every ticker of a
market in one era, or one era for everything, that task does not scale. Ranks come
from one range shuffle over (group, value, ties) instead: a group is cut wherever it
has to be, a value shared by a third of all rows by its ties. Rows are numbered in
that order, and a small table says with which number each group begins in each part
and how many of its rows lie in parts before: the rank is a difference.

Running totals cut one group into ordered slices by a bounded, deterministic sample
of keys, count the rows of each slice, and add the slices below. The cut points only
balance the work; the totals are exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from ..sources.sinks import written

_PER_CUT = 4  # sampled keys per cut point


def _list(names: Sequence[str]) -> str:
    return ", ".join(names)


def _cuts(df: DataFrame, group: Sequence[str], order: Sequence[str], slices: int) -> DataFrame:
    everything = _list([*group, *order])
    # the bin and the priority inside it must not come from the same hash bits
    keyed = df.selectExpr(
        *group,
        *order,
        f"pmod(xxhash64({everything}), {slices * _PER_CUT}) AS _bin",
        f"xxhash64(11, {everything}) AS _prio",
    )
    sample = keyed.groupBy(*group, "_bin").agg(*[F.expr(f"min_by({c}, _prio) AS {c}") for c in order])
    cuts = F.expr(
        f"filter(sort_array(collect_list(struct({_list(order)}))), (k, i) -> i % {_PER_CUT} = {_PER_CUT - 1}) AS _cuts"
    )
    return sample.groupBy(*group).agg(cuts)  # at most ``slices`` keys per group


def _sliced(df: DataFrame, group: Sequence[str], order: Sequence[str], slices: int, present: str = "TRUE") -> DataFrame:
    """Add ``_slice``; rows that are not ``present`` are spread over negative slices."""
    names = df.columns
    cuts = _cuts(df.where(present), group, order, slices)
    if group:
        joined = df.join(cuts, list(group), "left")
    else:
        joined = df.select("*", cuts.select("_cuts").scalar().alias("_cuts"))
    # sorting the key into its group's few cut points keeps the generated code small
    key = f"struct({_list(order)})"
    at = f"coalesce(array_position(sort_array(array_append(_cuts, {key})), {key}) - 1, 0)"
    return joined.selectExpr(
        *names, f"CASE WHEN {present} THEN {at} ELSE -1 - pmod(hash({_list(order)}), {slices}) END AS _slice"
    )


def _placed(df: DataFrame, group: Sequence[str], value: str, ties: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in one order over (group, value, ties) with their place ``_at``, and where each group begins in each part.

    One range shuffle; a group of any size is cut by its values and ties. The result is
    written, so that the places of the rows and the table of beginnings agree.
    """
    order = [*map(F.col, group), F.col(value).isNull(), F.col(value), *map(F.col, ties)]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows, "placed").withColumn("_part", F.shiftright("_at", 33))
    parts = rows.where(F.col(value).isNotNull()).groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of = f"PARTITION BY {_list(group)}" if group else ""
    below = f"sum(_n) OVER ({of} ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - _n"
    begins = parts.selectExpr(*[f"{g} AS _g{i}" for i, g in enumerate(group)], "_part AS _p", f"{below} - _first + 1 AS _shift", f"sum(_n) OVER ({of}) AS _total")
    return rows, written(begins, "begins")  # a row for each group and part that holds some of it: known size, so Spark may send it


def add_rank(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    ties: Sequence[str],
    out: str = "rank",
    percent: bool = False,
    total: str | None = None,
) -> DataFrame:
    """1-based position of ``value`` inside its group, ties broken by ``ties``.

    Rows whose value is NULL get no rank and do not count; a NULL group is a group.
    percent=True divides by the group's number of ranked rows; ``total`` names a column
    for that number.
    """
    names = df.columns
    rows, begins = _placed(df, group, value, ties)
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    ranked = rows.join(begins, same & F.col(value).isNotNull(), "left")
    position = "(_at + _shift)"
    cols = [f"{position + ' / _total' if percent else position} AS {out}"]
    if total:
        cols.append(f"_total AS {total}")
    return ranked.selectExpr(*names, *cols)


def _offsets(sliced: DataFrame, group: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Totals of lower slices and of the group, one row per (group, slice)."""
    per_slice = sliced.groupBy(*group, "_slice").agg(*[F.expr(f"{e} AS {c}") for c, e in sums.items()])
    part = f"PARTITION BY {_list(group)}" if group else ""
    cols = []
    for c in sums:
        cols.append(f"sum({c}) OVER ({part} ORDER BY _slice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - {c} AS {c}_before")
        cols.append(f"sum({c}) OVER ({part}) AS {c}_total")
    return per_slice.selectExpr(*group, "_slice", *cols)


def percent_ranks(df: DataFrame, group: Sequence[str], values: Mapping[str, str], key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Percent ranks of several columns, one row per (group, key): {new name: column}.

    The columns are put below each other under a number and ranked together, so how many
    there are does not multiply the passes over the input. ``keep`` names ranked columns
    that come out beside their ranks, so that they need not be joined back.
    """
    columns = list(dict.fromkeys(values.values()))
    long = df.selectExpr(*group, key, f"posexplode(array({_list(columns)})) AS (_what, _value)")
    ranked = add_rank(long, [*group, "_what"], "_value", [key], "_pct", percent=True)
    of = lambda x, c: f"max(CASE WHEN _what = {columns.index(c)} THEN {x} END)"
    return ranked.groupBy(*group, key).agg(
        *[F.expr(f"{of('_pct', c)} AS {name}") for name, c in values.items()], *[F.expr(f"{of('_value', c)} AS {c}") for c in keep]
    )


def running_total(df: DataFrame, order: Sequence[str], sums: Sequence[str], slices: int = 128) -> DataFrame:
    """Append ``<name>_before``: the sum over all rows with a smaller key (``order`` is unique)."""
    names = df.columns
    sliced = _sliced(df, [], order, slices)
    below = _offsets(sliced, [], {f"_t{c}": f"sum({c})" for c in sums})  # one row per slice
    inner = f"OVER (PARTITION BY _slice ORDER BY {_list(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    local = sliced.selectExpr("*", *[f"coalesce(sum({c}) {inner}, 0) AS _l{c}" for c in sums])
    return local.join(F.broadcast(below), "_slice").selectExpr(
        *names, *[f"_l{c} + _t{c}_before AS {c}_before" for c in sums]
    )


def dense_codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Distinct values of a column with their 0-based position in sorted order."""
    values = df.select(column).where(f"{column} IS NOT NULL").distinct()
    return add_rank(values, [], column, [], "_rank").selectExpr(column, f"_rank - 1 AS {out}")


def label_codes(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key`` (unique) and <column>_code per column: the 0-based position in the sorted distinct values.

    All columns are unpivoted and ranked together, so their number multiplies no pass.
    """
    long = df.select(key, *columns).unpivot([key], list(columns), "_what", "_value")
    pairs = durable(long.where("_value IS NOT NULL").select("_what", "_value").distinct())
    codes = add_rank(pairs, ["_what"], "_value", [], "_rank")
    coded = long.join(codes, ["_what", "_value"], "left")
    return coded.groupBy(key).agg(*[F.expr(f"CAST(max(CASE WHEN _what = '{c}' THEN _rank - 1 END) AS BIGINT) AS {c}_code") for c in columns])


def add_quantile_bucket(
    df: DataFrame, group: Sequence[str], value: str, ties: Sequence[str], buckets: int = 5, out: str = "bucket"
) -> DataFrame:
    """Quantile bucket 0..k-1 with interpolated edges; equal edges are merged.

    The edge values come from exact ranks, so no group is sorted or held in one
    place. A value equal to an edge belongs to the lower bucket.
    """
    names = df.columns
    ranked = add_rank(df, group, value, ties, "_rank", total="_all")
    picks, edges = [], []
    for k in range(buckets + 1):
        at = f"(_all - 1) * {k} div {buckets}"
        picks.append(f"max(CASE WHEN _rank - 1 = {at} THEN {value} END) AS _lo{k}")
        picks.append(f"max(CASE WHEN _rank - 1 = least({at} + 1, _all - 1) THEN {value} END) AS _hi{k}")
        part = f"((_all - 1) * {k} % {buckets})"
        edges.append(f"CASE WHEN {part} = 0 THEN _lo{k} ELSE _lo{k} + (_hi{k} - _lo{k}) * ({part} / {buckets}D) END")
    found = ranked.where("_rank IS NOT NULL").groupBy(*group).agg(F.expr("max(_all) AS _all"), *map(F.expr, picks))
    found = found.selectExpr(*group, f"array_distinct(array({_list(edges)})) AS _edges")
    bucket = f"greatest(size(filter(_edges, e -> e < {value})) - 1, 0)"
    return df.join(found, list(group), "left").selectExpr(
        *names, f"CASE WHEN {value} IS NOT NULL THEN {bucket} END AS {out}"
    )

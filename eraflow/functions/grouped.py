"""Wide per-series packs as one vectorised pass per key.

A Window operator pays per expression and row, and a sliding frame also per row
of the frame; for dozens of horizons up to 300 rows that is two orders of
magnitude more than array arithmetic. These packs therefore run as a grouped map
over Arrow: Spark partitions and shuffles the bars by key once, and numpy works
on one series at a time. A series is bounded by the calendar because bars are
unique per (key, date). The Window forms in ``rolling`` give the same numbers,
spill to disk, and are the choice for a few horizons or for finer time grains.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .rolling import HORIZONS, Series

Arrays = Mapping[str, np.ndarray]

# executors need not have this package installed: its task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _arrow(a: np.ndarray) -> pa.Array:
    """NULL, never NaN or infinity."""
    if a.dtype != np.float64:
        return pa.array(a)
    bad = ~np.isfinite(a)
    return pa.array(a, mask=bad) if bad.any() else pa.array(a)


def map_series(
    df: DataFrame, cols: Sequence[str], make: Callable[[Arrays], Arrays], names: Sequence[str], w: Series = Series(), keep: Sequence[str] = ()
) -> DataFrame:
    """Append double columns computed from ``cols`` of the time-ordered rows of each key."""
    keep = list(keep) or df.columns
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    at, names = w.at, list(names)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(at).combine_chunks()
        made = make({c: table.column(c).to_numpy().astype(np.float64) for c in cols})
        return pa.table([table.column(c) for c in keep] + [_arrow(made[n]) for n in names], names=keep + names)

    needed = list(dict.fromkeys([w.by, at, *keep, *cols]))
    return df.select(*needed).groupBy(w.by).applyInArrow(one, f"{kept}, {', '.join(f'{n} double' for n in names)}")


def _change(a: np.ndarray) -> np.ndarray:
    """a / previous a - 1, NaN where undefined."""
    out = np.full(len(a), np.nan)
    with np.errstate(all="ignore"):
        out[1:] = a[1:] / a[:-1] - 1
    out[~np.isfinite(out)] = np.nan
    return out


def _deviation(e: np.ndarray, horizons: Sequence[int]) -> np.ndarray:
    """Sample deviation of the last n values, each window centred on its own mean: one large
    change leaves no trace once it has left the window, which running sums can't promise."""
    out = np.full((len(horizons), len(e)), np.nan)
    for i, n in enumerate(horizons):
        if n > 1 and len(e) >= n:
            views = np.lib.stride_tricks.sliding_window_view(e, n)
            for at in range(0, len(views), 4096):
                part = views[at : at + 4096]
                flat = part.max(axis=1) == part.min(axis=1)
                out[i, n - 1 + at : n - 1 + at + 4096] = np.where(flat, 0.0, part.std(axis=1, ddof=1))
    return out


def _pack(x: np.ndarray, horizons: Sequence[int], absolute: bool, second_order: bool) -> list[np.ndarray]:
    """Return, (|return|,) volatility and gap: one matrix (horizon x row) each."""
    row, h = np.arange(len(x)), np.asarray(horizons)[:, None]
    at = row[None, :] - h
    inside = at >= 0
    at = np.maximum(at, 0)

    def span(cum: np.ndarray) -> np.ndarray:
        return cum[None, :] - np.where(inside, cum[at], 0)

    with np.errstate(all="ignore"):
        d = _change(np.where(x > -1, np.log1p(x), np.nan))
        if second_order:
            d = _change(d)
        seen = ~np.isnan(d)
        e = np.where(seen, d, 0.0)
        ret = np.where(inside, x[None, :] / x[at] - 1, np.nan)
        vol = _deviation(e, horizons)
        vol[span(np.cumsum(seen)) < h] = np.nan
        gap = x[None, :] / (span(np.cumsum(np.nan_to_num(x))) / h)
        gap[span(np.cumsum(~np.isnan(x))) < h] = np.nan
    return [ret, np.abs(ret), vol, gap] if absolute else [ret, vol, gap]


def _pack_names(c: str, horizons: Sequence[int], absolute: bool) -> list[str]:
    kinds = ["return", "return_abs", "volatility", "gap"] if absolute else ["return", "volatility", "gap"]
    return [f"{c}_{k}_{n}" for n in horizons for k in kinds]


def horizon_pack(
    df: DataFrame,
    cols: Sequence[str],
    horizons: Sequence[int] = tuple(HORIZONS),
    w: Series = Series(),
    absolute: bool = True,
    second_order: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Same columns as the Window form in ``rolling.horizon_pack``."""
    names = {c: _pack_names(c, horizons, absolute) for c in cols}

    def make(x: Arrays) -> dict:
        out = {}
        for c in cols:
            by_horizon = np.stack(_pack(x[c], horizons, absolute, second_order), axis=1)
            out |= zip(names[c], by_horizon.reshape(-1, len(x[c])))
        return out

    return map_series(df, cols, make, [n for c in cols for n in names[c]], w, keep)


def horizon_summary(df: DataFrame, col: str, horizons: Sequence[int] = tuple(HORIZONS), w: Series = Series()) -> DataFrame:
    """Count, mean and maximum of every pack column per key, in long form; the wide rows never leave the task."""
    kinds = ["return", "volatility", "gap"]
    by, at = w.by, w.at

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(at).combine_chunks()
        packed = np.stack(_pack(table.column(col).to_numpy().astype(np.float64), horizons, False, False), axis=1)
        packed = packed.reshape(-1, packed.shape[2])
        good = np.isfinite(packed)
        n, size = good.sum(axis=1), len(packed)
        mean = np.where(good, packed, 0.0).sum(axis=1) / np.where(n > 0, n, np.nan)
        top = np.where(good, packed, -np.inf).max(axis=1)
        return pa.table({
            by: pa.repeat(table.column(by)[0], size),
            "kind": kinds * len(horizons),
            "horizon": pa.array(np.repeat(np.asarray(horizons, dtype=np.int32), len(kinds))),
            "n": pa.array(n, pa.int64()),
            "mean": _arrow(mean),
            "top": _arrow(top),
        })

    key = df.schema[by].dataType.simpleString()
    return df.select(by, at, col).groupBy(by).applyInArrow(
        one, f"{by} {key}, kind string, horizon int, n bigint, mean double, top double"
    )

"""Indicators of one series in numpy, made to be computed together: one shuffle, one pass, no wide row is ever sorted.

A chain of Window operators over many columns sorts rows that grow with every
operator; at size those sorts spill more than the result holds. Here Spark brings the
thin input of a series together once, and every pack of a query is computed over it in
the same task. A series is bounded by the calendar, bars being unique per (key, date).
NULL is a hole and becomes NaN inside; what isn't finite comes out as NULL.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .rolling import HORIZONS, Series

Arrays = Mapping[str, np.ndarray]

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROWS = 4096  # rows whose windows are spread out at once


@dataclass(frozen=True)
class Pack:
    """``make`` computes the columns ``names`` from the columns ``cols`` of one series in time order."""

    cols: tuple[str, ...]
    names: tuple[str, ...]
    make: Callable[[Arrays], Arrays]
    kind: str = "double"


def _ordered(table: pa.Table, at: str) -> pa.Table:
    """In time order, a missing time first as in a Window."""
    return table.take(pc.sort_indices(table, sort_keys=[(at, "ascending")], null_placement="at_start")).combine_chunks()


def _values(table: pa.Table, c: str) -> np.ndarray:
    return pc.cast(table.column(c), pa.float64(), safe=False).to_numpy()


def _column(a: np.ndarray, kind: str = "double") -> pa.Array:
    if kind.startswith("array"):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), _column(a.ravel(), kind[6:-1]))
    return pa.array(a, pa.float32() if kind == "float" else pa.float64(), mask=~np.isfinite(a))


def add_packs(df: DataFrame, packs: Sequence[Pack], w: Series = Series(), keep: Sequence[str] = (), only: str | None = None) -> DataFrame:
    """Append the columns of all packs; ``keep`` names the columns of ``df`` that stay (default all).

    ``only`` names a boolean column: rows where it doesn't hold take part and aren't returned.
    """
    keep, by, at = list(keep) or df.columns, w.by.split(", "), w.at
    cols, kinds = list(dict.fromkeys(c for p in packs for c in p.cols)), {n: p.kind for p in packs for n in p.names}
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]

    def one(table: pa.Table) -> pa.Table:
        table = _ordered(table, at)
        x, made = {c: _values(table, c) for c in cols}, {}
        with np.errstate(all="ignore"):
            for p in packs:
                made |= p.make(x)
        if only:
            rows = np.flatnonzero(table.column(only).fill_null(False).to_numpy())
            table, made = table.take(pa.array(rows)), {n: a[rows] for n, a in made.items()}
        return pa.table([table.column(c) for c in keep] + [_column(made[n], kind) for n, kind in kinds.items()], names=keep + list(kinds))

    needed = list(dict.fromkeys([*by, at, *keep, *cols, *([only] if only else [])]))
    return df.select(*needed).groupBy(*by).applyInArrow(one, ", ".join([*kept, *[f"`{n}` {kind}" for n, kind in kinds.items()]]))


# ---- parts ---------------------------------------------------------------------------------


def before(x: np.ndarray, k: int) -> np.ndarray:
    """Values k rows earlier, along the last axis."""
    out = np.full(x.shape, np.nan)
    if k < x.shape[-1]:
        out[..., k:] = x[..., : x.shape[-1] - k]
    return out


def quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, missing where the divisor is zero."""
    return a / np.where(b == 0, np.nan, b)


def _decayed(x: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """y(t) = keep * y(t - 1) + x(t) for every column, in place."""
    for t in range(1, len(x)):
        x[t] += x[t - 1] * keep
    return x


@dataclass(frozen=True)
class Mean:
    """See ``ewm.Ewm``."""

    out: str
    src: str
    alpha: float
    adjust: bool
    min_periods: int


def weighted_means(x: Arrays, specs: Sequence[Mean]) -> dict[str, np.ndarray]:
    """The recurrences themselves, row by row, all of them side by side."""
    smooth = [s for s in specs if s.alpha < 1.0]
    sides = list(dict.fromkeys(side for s in smooth for side in ([(s.src, s.alpha, "n"), (s.src, s.alpha, "d")] if s.adjust else [(s.src, s.alpha, "r")])))
    out = {s.out: x[s.src] for s in specs if s.alpha >= 1.0}
    if sides:
        seen = {c: ~np.isnan(x[c]) for c, _, _ in sides}
        count = {c: np.cumsum(v) for c, v in seen.items()}
        start = {c: int(np.argmax(v)) if v.any() else len(v) for c, v in seen.items()}
        columns = []
        for c, alpha, side in sides:
            column = seen[c].astype(np.float64) if side == "d" else np.where(seen[c], x[c], 0.0)
            if side == "r":
                first = column[start[c] : start[c] + 1].copy()
                column *= alpha
                column[start[c] : start[c] + 1] = first
            columns.append(column)
        y = _decayed(np.stack(columns, axis=1), np.array([1.0 - a for _, a, _ in sides]))
        found = {side: y[:, i] for i, side in enumerate(sides)}
    for s in smooth:
        enough = count[s.src] >= s.min_periods
        if s.adjust:
            value = quotient(found[s.src, s.alpha, "n"], found[s.src, s.alpha, "d"])
        else:
            value = found[s.src, s.alpha, "r"]
            if (enough & (count[s.src] > 0) & (count[s.src] != np.arange(1, len(value) + 1) - start[s.src])).any():
                raise ValueError(f"recursive mean {s.out}: {s.src} has a hole after its first value")
        out[s.out] = np.where(enough & (count[s.src] > 0), value, np.nan)
    return out


def rolling_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of the last n rows, fewer at the start; from sums of 2**k rows side by side, so nothing is ever subtracted."""
    total, level, offset, size = np.zeros(x.shape), x, 0, 1
    while size <= n:
        if n & size:
            total = total + _moved(level, offset)
            offset += size
        level, size = level + _moved(level, size), 2 * size
    return total


def _moved(x: np.ndarray, k: int) -> np.ndarray:
    """k rows earlier, zero before the start."""
    if not k:
        return x
    out = np.zeros(x.shape)
    if k < x.shape[-1]:
        out[..., k:] = x[..., : x.shape[-1] - k]
    return out


def rolling_mean(x: np.ndarray, n: int, least: int = 1) -> np.ndarray:
    seen = ~np.isnan(x)
    count = rolling_sum(seen.astype(np.float64), n)
    return np.where(count >= max(1, least), rolling_sum(np.where(seen, x, 0.0), n) / count, np.nan)


def windows(x: np.ndarray, n: int):
    """The last n values of every row, NaN before the start: (first row, matrix) for some rows at a time."""
    padded = np.concatenate([np.full(n - 1, np.nan), x])
    views = np.lib.stride_tricks.sliding_window_view(padded, n) if len(x) else np.empty((0, n))
    for at in range(0, len(views), _ROWS):
        yield at, views[at : at + _ROWS]


def rolling_std(x: np.ndarray, n: int, least: int) -> np.ndarray:
    """Sample deviation of the present values of the last n rows, about their own mean."""
    out = np.full(len(x), np.nan)
    for at, part in windows(x, n):
        seen = ~np.isnan(part)
        count = seen.sum(axis=1)
        mean = np.where(seen, part, 0.0).sum(axis=1) / count
        off = np.where(seen, part - mean[:, None], 0.0)
        found = np.sqrt((off * off).sum(axis=1) / (count - 1))
        flat = np.fmax.reduce(part, axis=1) == np.fmin.reduce(part, axis=1)
        out[at : at + len(part)] = np.where((count >= max(2, least)), np.where(flat, 0.0, found), np.nan)
    return out


def _sorted_windows(x: np.ndarray, n: int, want: Callable[[np.ndarray, np.ndarray], Arrays]) -> dict[str, np.ndarray]:
    """What ``want`` reads off the sorted present values of every window, and their number."""
    parts: list[Arrays] = []
    for _, part in windows(x, n):
        parts.append(want(np.sort(part, axis=1), (~np.isnan(part)).sum(axis=1)))
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def _median(v: np.ndarray, count: np.ndarray) -> np.ndarray:
    low, high = ((np.maximum(k, 0))[:, None] for k in ((count - 1) // 2, count // 2))
    low, high = (np.take_along_axis(v, np.minimum(k, v.shape[1] - 1), axis=1)[:, 0] for k in (low, high))
    return np.where(low == high, low, low + (high - low) * 0.5)


# ---- packs ---------------------------------------------------------------------------------


def means(specs: Sequence) -> Pack:
    own = [Mean(s.out, s.src, s.alpha, s.adjust, s.min_periods) for s in specs]
    return Pack(tuple(dict.fromkeys(s.src for s in own)), tuple(s.out for s in own), lambda x: weighted_means(x, own))


def rsi_wilder(src: str, periods: Sequence[int], out: str = "rsi") -> Pack:
    names = [f"{out}_{p}" for p in periods]

    def make(x: Arrays) -> dict:
        change = x[src] - before(x[src], 1)
        seen = ~np.isnan(change)
        sides = {"u": np.where(seen, np.maximum(change, 0.0), np.nan), "d": np.where(seen, np.maximum(-change, 0.0), np.nan)}
        m = weighted_means(sides, [Mean(f"{k}{p}", k, 1.0 / p, True, p) for p in periods for k in "ud"])
        return {n: 100 * quotient(m[f"u{p}"], m[f"u{p}"] + m[f"d{p}"]) for n, p in zip(names, periods, strict=True)}

    return Pack((src,), tuple(names), make)


def macd(src: str, triples: Sequence[tuple[int, int, int]], percent: bool = False, out: str = "macd") -> Pack:
    spans = sorted({s for f, s, _ in triples} | {f for f, _, _ in triples})
    pairs = sorted({(f, s) for f, s, _ in triples})
    names = [f"{out}_{f}_{s}" for f, s in pairs]
    for f, s, g in triples:
        names += [f"{out}_signal_{f}_{s}_{g}"] + ([] if percent else [f"{out}_hist_{f}_{s}_{g}"])

    def make(x: Arrays) -> dict:
        e = weighted_means(x, [Mean(str(n), src, 2.0 / (n + 1.0), percent, 1) for n in spans])
        lines = {}
        for f, s in pairs:
            gap = e[str(f)] - e[str(s)]
            lines[f"{out}_{f}_{s}"] = 100 * quotient(gap, e[str(s)]) if percent else gap
        signals = weighted_means(lines, [Mean(f"{out}_signal_{f}_{s}_{g}", f"{out}_{f}_{s}", 2.0 / (g + 1.0), percent, 1) for f, s, g in triples])
        hist = {} if percent else {f"{out}_hist_{f}_{s}_{g}": lines[f"{out}_{f}_{s}"] - signals[f"{out}_signal_{f}_{s}_{g}"] for f, s, g in triples}
        return lines | signals | hist

    return Pack((src,), tuple(names), make)


def atr(periods: Sequence[int]) -> Pack:
    names = [f"atr_{p}" for p in periods]

    def make(x: Arrays) -> dict:
        last = before(x["close"], 1)
        tr = np.fmax(np.fmax(x["high"] - x["low"], np.abs(x["high"] - last)), np.abs(x["low"] - last))
        return weighted_means({"tr": tr}, [Mean(n, "tr", 2.0 / (p + 1.0), False, 1) for n, p in zip(names, periods, strict=True)])

    return Pack(("high", "low", "close"), tuple(names), make)


def lags(cols: Sequence[str], steps: Sequence[int], name: str = "{c}_lag_{k}") -> Pack:
    names = [name.format(c=c, k=k) for c in cols for k in steps]
    return Pack(tuple(cols), tuple(names), lambda x: dict(zip(names, (before(x[c], k) for c in cols for k in steps), strict=True)))


def changes(src: str, steps: Sequence[int]) -> Pack:
    """x / x[k rows before] - 1 in single precision, and its size."""

    def make(x: Arrays) -> dict:
        ret = {k: (quotient(x[src], before(x[src], k)) - 1).astype(np.float32) for k in steps}
        return {f"ret_{k}": v for k, v in ret.items()} | {f"abs_ret_{k}": np.abs(v) for k, v in ret.items()}

    return Pack((src,), (*[f"ret_{k}" for k in steps], *[f"abs_ret_{k}" for k in steps]), make, "float")


def sma(cols: Sequence[str], sizes: Sequence[int]) -> Pack:
    names = {f"{c}_sma_{n}": (c, n) for c in cols for n in sizes}
    return Pack(tuple(cols), tuple(names), lambda x: {k: rolling_mean(x[c], n) for k, (c, n) in names.items()})


def medians(src: str, sizes: Sequence[int]) -> Pack:
    """Median of the present values, where at least max(1, n // 2) are."""
    names = [f"{src}_median_{n}" for n in sizes]

    def make(x: Arrays) -> dict:
        out = {}
        for name, n in zip(names, sizes, strict=True):
            out |= _sorted_windows(x[src], n, lambda v, c, name=name, n=n: {name: np.where(c >= max(1, n // 2), _median(v, c), np.nan)})
        return out

    return Pack((src,), tuple(names), make)


def rolling_stats(src: str, sizes: Sequence[int]) -> Pack:
    """Mean, std, min, max and median as in ``moments.add_rolling_stats``."""
    kinds = ("mean", "std", "min", "max", "median")

    def make(x: Arrays) -> dict:
        out = {}
        for n in sizes:
            least = max(1, n // 2)

            def read(v, c, n=n, least=least):
                ends = np.take_along_axis(v, np.maximum(c - 1, 0)[:, None], axis=1)[:, 0]
                found = {"min": v[:, 0], "max": ends, "median": _median(v, c)}
                return {f"{src}_{k}_{n}": np.where(c >= least, a, np.nan) for k, a in found.items()}

            out |= _sorted_windows(x[src], n, read)
            out |= {f"{src}_mean_{n}": rolling_mean(x[src], n, least), f"{src}_std_{n}": rolling_std(x[src], n, least)}
        return out

    return Pack((src,), tuple(f"{src}_{k}_{n}" for n in sizes for k in kinds), make)


def monthly(src: str = "close") -> Pack:
    """One, two and three month (20/40/60 rows) return, log-return volatility and mean gap."""
    names = ["return_251", *[f"{k}_{m}month" for m in (1, 2, 3) for k in ("return", "volatility", "gap")]]

    def make(x: Arrays) -> dict:
        p = x[src]
        log = np.log(np.where(p > 0, p, np.nan))
        change = log - before(log, 1)
        out = {"return_251": quotient(p, before(p, 251)) - 1}
        for m in (1, 2, 3):
            n = 20 * m
            out |= {f"return_{m}month": quotient(p, before(p, n)) - 1, f"volatility_{m}month": rolling_std(change, n, n), f"gap_{m}month": quotient(p, rolling_mean(p, n, n))}
        return out

    return Pack((src,), tuple(names), make)


# ---- the horizon packs ---------------------------------------------------------------------


def horizons(x: np.ndarray, sizes: Sequence[int] = tuple(HORIZONS), second: bool = False, zero: float = 1e-12) -> dict[str, np.ndarray]:
    """ret, vol, gap (and vol2) of the series in the rows of ``x``, as (horizon, series, row): see ``moments.add_horizons``."""
    top, n = max(sizes), x.shape[-1]
    x = np.concatenate([np.full((*x.shape[:-1], top), np.nan), x], axis=-1)  # rows before the start are holes, so an earlier row is a slice
    log = np.where(x > -1, np.log1p(x), np.nan)
    change = quotient(log, before(log, 1)) - 1
    moved = {"vol": change} | ({"vol2": quotient(change, before(change, 1)) - 1} if second else {})
    sums, pairs, levels = x, {k: (c, np.where(np.isnan(c), np.nan, 0.0)) for k, c in moved.items()}, []
    for k in range(top.bit_length()):
        levels.append((sums, pairs))
        half, merged = 1 << k, {}
        for kind, (s, q) in pairs.items():
            old = before(s, half)
            merged[kind] = s + old, q + before(q, half) + (s - old) ** 2 / (2.0 * half)
        sums, pairs = sums + before(sums, half), merged
    out = {k: np.full((len(sizes), *x.shape[:-1], n), np.nan) for k in ("ret", *moved, "gap")}
    for i, size in enumerate(sizes):
        parts, offset = [], 0
        for k in range(size.bit_length() - 1, -1, -1):
            if size >> k & 1:
                parts.append((1 << k, levels[k], slice(top - offset, top - offset + n)))
                offset += 1 << k
        out["ret"][i] = x[..., top - size : top - size + n]
        out["gap"][i] = sum(level[0][..., at] for _, level, at in parts)
        for kind in moved if size > 1 else ():
            own = [(m, level[1][kind][0][..., at], level[1][kind][1][..., at]) for m, level, at in parts]
            if len(own) > 1:
                middle = sum(s for _, s, _ in own) / size
                out[kind][i] = sum(q + m * (s / m - middle) ** 2 for m, s, q in own)
            else:
                out[kind][i] = own[0][2]
    per = np.asarray(sizes, float).reshape(-1, *[1] * x.ndim)
    now = x[..., top:]
    out["ret"] = quotient(now, out["ret"]) - 1
    mean = out["gap"] / per
    out["gap"] = now / np.where(np.abs(mean) > zero, mean, np.nan)
    return out | {k: np.sqrt(out[k] / (per - 1)) for k in moved}


def horizon_lists(src: str, out: Mapping[str, str]) -> Pack:
    """An array over the horizons for each kind (ret, vol, gap, vol2) that ``out`` gives a name."""

    def make(x: Arrays) -> dict:
        found = horizons(x[src], second=True)
        return {name: np.ascontiguousarray(found[k].T) for k, name in out.items()}

    return Pack((src,), tuple(out.values()), make, "array<float>")


def _squashed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count of the finite values and mean of x / (1 + |x|), along the last axis."""
    good = np.isfinite(a)
    n = good.sum(axis=-1)
    v = np.where(good, a, 0.0)
    return n, (v / (1 + np.abs(v))).sum(axis=-1) / np.where(n > 0, n, np.nan)


def horizon_digests(df: DataFrame, cols: Sequence[str], kinds: Sequence[str], w: Series = Series(), second: bool = False) -> DataFrame:
    """key, series, horizon, and n_<kind>, <kind> of every kind: how many values there are and the mean of x / (1 + |x|)
    over the history. The rows by horizon never leave the task."""
    by, at, cols, kinds = w.by, w.at, list(cols), list(kinds)

    def one(table: pa.Table) -> pa.Table:
        table = _ordered(table, at)
        x, sizes = np.stack([_values(table, c) for c in cols]), list(HORIZONS)
        with np.errstate(all="ignore"):
            found = horizons(x, sizes, second)
            if "ret_abs" in kinds:
                found["ret_abs"] = np.abs(found["ret"])
            digests = {k: _squashed(found[k]) for k in kinds}
        first = {
            by: table.column(by).take(pa.array(np.zeros(len(cols) * len(sizes), np.int64))),
            "series": cols * len(sizes),
            "horizon": pa.array(np.repeat(np.asarray(sizes, np.int32), len(cols))),
        }
        return pa.table(first | {name: a for k, (n, v) in digests.items() for name, a in ((f"n_{k}", pa.array(n.ravel().astype(np.int64))), (k, _column(v.ravel())))})

    key = df.schema[by].dataType.simpleString()
    return df.select(by, at, *cols).groupBy(by).applyInArrow(
        one, f"{by} {key}, series string, horizon int, " + ", ".join(f"n_{k} bigint, {k} double" for k in kinds)
    )

"""Rolling sums, deviations and extremes of many window lengths by doubling.

The last 2**k rows are the last 2**(k-1) rows and the same window 2**(k-1) rows
before, so one ``lag`` a level makes a sum of any power of two, and a window of n
rows is a few of those side by side, one for each binary digit of n. Sums of squares
about the own mean merge the same way:

    q = qa + qb + (mean a - mean b)**2 * na * nb / (na + nb)

Nothing is ever subtracted from a running total, so a spike leaves no trace once it
is out of a window, and the work a row grows with the number of windows, not with
their lengths. Two overlapping windows of a power of two give a window's extremes.
All levels share one key and order: one shuffle and one sort, in the JVM, spillable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .rolling import HORIZONS, STAT_WINDOWS, Series, lag, pct_change
from .safe import div, log1p


#: a mean up to this size counts as zero
ZERO = 1e-12


def pieces(n: int) -> list[tuple[int, int]]:
    """(k, offset) of windows of 2**k rows that make up the last n rows, the longest first."""
    out, offset = [], 0
    for k in range(n.bit_length() - 1, -1, -1):
        if n >> k & 1:
            out.append((k, offset))
            offset += 1 << k
    return out


def _at(level: str, k: int, offset: int) -> str:
    return f"_{level}{k}_{offset}" if offset else f"_{level}{k}"


def _shifted(level: str, wanted: Sequence[tuple[int, int]], w: Series) -> list[str]:
    return [f"{lag(f'_{level}{k}', offset, w)} AS {_at(level, k, offset)}" for k, offset in sorted(set(wanted)) if offset]


# ---- complete windows: return, volatility and gap of many horizons ------------------------


def add_horizons(df: DataFrame, x: str, d: str, horizons: Sequence[int] = tuple(HORIZONS), w: Series = Series(), out: str = "packs", second: str | None = None) -> DataFrame:
    """Append an array with a struct per horizon: horizon, ret, ret_abs, vol, gap (and vol2).

    ``ret`` is x over its value n rows before - 1, ``gap`` is x over the mean of the last n
    rows, ``vol`` the sample deviation of ``d`` over them (``vol2`` that of ``second``); a
    window with a hole, or a zero divisor, gives NULL, and so does a mean that is no more
    than rounding (the logarithmic returns of a series that came back to its old value).
    """
    names = df.columns
    moved = {"d": d} | ({"e": second} if second else {})
    start = ", ".join([f"'x', double({x})", *[f"'s{t}', double({c}), 'q{t}', CASE WHEN {c} IS NOT NULL THEN 0D END" for t, c in moved.items()]])
    work = df.selectExpr("*", f"named_struct({start}) AS _l0")
    top = max(horizons).bit_length() - 1
    for k in range(top):
        half, a, b = 1 << k, f"_l{k}", f"_l{k}_before"
        work = work.selectExpr("*", f"{lag(a, half, w)} AS {b}")
        parts = [f"'x', {a}.x + {b}.x"]
        for t in moved:
            gap = f"({a}.s{t} - {b}.s{t})"
            parts.append(f"'s{t}', {a}.s{t} + {b}.s{t}, 'q{t}', {a}.q{t} + {b}.q{t} + {gap} * {gap} / {2 * half}D")
        work = work.selectExpr(*[c for c in work.columns if c != b], f"named_struct({', '.join(parts)}) AS _l{k + 1}")
    wanted = [p for n in horizons for p in pieces(n)]
    work = work.selectExpr("*", *_shifted("l", wanted, w), *[f"{lag(x, n, w)} AS _x{n}" for n in horizons])
    packs = []
    for n in horizons:
        own = [(1 << k, _at("l", k, offset)) for k, offset in pieces(n)]
        ret = f"({div(x, f'_x{n}')} - 1)"
        mean = f"(({' + '.join(f'{c}.x' for _, c in own)}) / {n}D)"
        fields = [f"'horizon', {n}", f"'ret', {ret}", f"'ret_abs', abs({ret})"]
        for t, label in zip(moved, ("vol", "vol2"), strict=False):
            middle = f"(({' + '.join(f'{c}.s{t}' for _, c in own)}) / {n}D)"
            spread = " + ".join(f"{c}.q{t} + {m}D * pow({c}.s{t} / {m}D - {middle}, 2)" for m, c in own) if len(own) > 1 else f"{own[0][1]}.q{t}"
            fields.append(f"'{label}', sqrt(({spread}) / {n - 1}D)" if n > 1 else f"'{label}', CAST(NULL AS DOUBLE)")
        fields.append(f"'gap', CASE WHEN abs({mean}) > {ZERO!r}D THEN {x} / {mean} END")
        packs.append(f"named_struct({', '.join(fields)})")
    return work.selectExpr(*names, f"array({', '.join(packs)}) AS {out}")


def horizons_long(df: DataFrame, cols: Sequence[str], horizons: Sequence[int] = tuple(HORIZONS), w: Series = Series(), second: bool = False) -> DataFrame:
    """(key, time, series, value, packs) for every column of ``cols``: see ``add_horizons``.

    ``vol`` is the deviation of the relative change of log1p(value), ``vol2`` that of the
    change of this change. The series are unpivoted, so their number doesn't widen the plan.
    """
    long = df.selectExpr(w.by, w.at, *[f"double({c}) AS {c}" for c in cols]).unpivot([w.by, w.at], list(cols), "series", "value")
    s = Series(f"{w.by}, series", w.at)
    work = long.selectExpr("*", f"{pct_change(log1p('value'), 1, s)} AS _d")
    if second:
        work = work.selectExpr("*", f"{pct_change('_d', 1, s)} AS _e")
    packed = add_horizons(work, "value", "_d", horizons, s, second="_e" if second else None)
    return packed.select(w.by, w.at, "series", "value", "packs")


# ---- incomplete windows: the statistics bundle --------------------------------------------


def chain(windows: Sequence[int]) -> tuple[int, list[tuple[int, int, int]]]:
    """The length to start from, and steps (n, a, b): n rows are the last a rows and the b rows before them.

    Every wanted length comes up, with others in between where needed. The start is the
    shortest window if the others can be made of it, else a single row.
    """
    least = min(windows)
    start = least if all(n % least == 0 for n in windows) else 1
    known, steps = {start}, []

    def make(n: int) -> None:
        if n in known:
            return
        longest = max(a for a in known if a < n)
        if not any(n - a in known for a in known):
            make(2 * longest if 2 * longest < n else n - longest)
            make(n)
            return
        a = max(a for a in known if n - a in known)
        known.add(n)
        steps.append((n, a, n - a))

    for n in sorted(set(windows)):
        make(n)
    return start, steps


def add_rolling_stats(df: DataFrame, cols: Sequence[str], windows: Sequence[int] = tuple(STAT_WINDOWS), w: Series = Series(), median: bool = True) -> DataFrame:
    """Append mean, std, min, max (and median) of the last n rows per column and window.

    Missing values don't count; a window needs max(1, n // 2) present ones. A window is
    merged from two shorter ones that lie side by side, its sorted values too: two sorted
    runs are merged in linear time, and give the median and both extremes.
    """
    names, out = df.columns, []
    first, steps = chain(windows)
    work = df
    for i, c in enumerate(cols):
        t = f"_w{i}_"
        f = w.last_n(first)
        start = {"c": f"int(count({c}) {f})", "s": f"coalesce(double(sum({c}) {f}), 0D)", "q": f"coalesce(var_pop({c}) {f} * count({c}) {f}, 0D)"}
        if median:
            start["v"] = f"sort_array(transform(collect_list({c}) {f}, x -> double(x)))"
        else:
            start |= {"lo": f"double(min({c}) {f})", "hi": f"double(max({c}) {f})"}
        work = work.selectExpr("*", f"named_struct({', '.join(f"'{k}', {e}" for k, e in start.items())}) AS {t}{first}")
        for n, last, _ in steps:
            a, b = f"{t}{last}", f"{t}{n}_before"
            work = work.selectExpr("*", f"{lag(f'{t}{n - last}', last, w)} AS {b}")
            gap = f"({a}.s / {a}.c - {b}.s / {b}.c)"
            both = [
                f"'c', {a}.c + {b}.c", f"'s', {a}.s + {b}.s",
                f"'q', {a}.q + {b}.q + CASE WHEN {a}.c > 0 AND {b}.c > 0 THEN {gap} * {gap} * {a}.c * {b}.c / ({a}.c + {b}.c) ELSE 0D END",
            ]
            both += [f"'v', sort_array(concat({b}.v, {a}.v))"] if median else [f"'lo', least({a}.lo, {b}.lo)", f"'hi', greatest({a}.hi, {b}.hi)"]
            work = work.selectExpr(*[x for x in work.columns if x != b], f"CASE WHEN {b} IS NULL THEN {a} ELSE named_struct({', '.join(both)}) END AS {t}{n}")
        for n in windows:
            own = f"{t}{n}"
            gate = f"CASE WHEN {own}.c >= {max(1, n // 2)} THEN {{}} END AS {c}_{{}}_{n}"
            out.append(gate.format(f"{own}.s / {own}.c", "mean"))
            out.append(gate.format(f"CASE WHEN {own}.c > 1 THEN sqrt({own}.q / ({own}.c - 1)) END", "std"))
            out.append(gate.format(f"{own}.v[0]" if median else f"{own}.lo", "min"))
            out.append(gate.format(f"{own}.v[{own}.c - 1]" if median else f"{own}.hi", "max"))
            if median:
                out.append(gate.format(f"({own}.v[({own}.c - 1) div 2] + {own}.v[{own}.c div 2]) / 2", "median"))
    return work.selectExpr(*names, *out)

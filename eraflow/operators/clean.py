"""Cleaning: fills, sentinels, coercion, narrowing, encodings, duplicates, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rolling import Series, filled_forward
from ..functions.safe import finite, num

#: Default fills of the attribute columns.
ATTRIBUTE_DEFAULTS = {
    "shares": 1000000,
    "sector": "unknown",
    "industry": "unknown",
    "priceToBook_raw": 1,
    "earningsQuarterlyGrowth_raw": 1000000,
    "revenueGrowth_raw": 0.01,
    "grossMargins_raw": 0.2,
    "profitMargins_raw": 0.1,
    "payoutRatio_raw": 0.1,
    "dividendRate_raw": 0.05,
    "dividendYield_raw": 0.05,
    "fiveYearAvgDividendYield_raw": 0.02,
    "trailingAnnualDividendRate_raw": 0.04,
    "trailingAnnualDividendYield_raw": 0.04,
}
SENTINEL = -20000

#: Exchange suffix of a ticker to ISO country code.
SUFFIX_COUNTRY = {
    "AU": "AU", "AV": "AT", "BB": "BE", "BZ": "BR", "CA": "CA", "CB": "CO", "CH": "CN", "CI": "CL", "CN": "CA",
    "CP": "CZ", "DC": "DK", "EY": "EG", "FH": "FI", "FP": "FR", "GA": "GR", "GR": "DE", "GY": "DE", "HB": "HU",
    "HK": "HK", "ID": "IE", "IJ": "ID", "IM": "IT", "IN": "IN", "IT": "IL", "JP": "JP", "KS": "KR", "LN": "GB",
    "MF": "MX", "MK": "MY", "NA": "NL", "NO": "NO", "NZ": "NZ", "PE": "PE", "PL": "PT", "PM": "PH", "PW": "PL",
    "QD": "QA", "RM": "RU", "SJ": "ZA", "SM": "ES", "SP": "SG", "SS": "SE", "SW": "CH", "TB": "TH", "TI": "TR",
    "TT": "TW", "UH": "AE", "US": "US", "UQ": "US",
}


def fill_defaults(df: DataFrame, defaults: Mapping[str, object] = ATTRIBUTE_DEFAULTS) -> DataFrame:
    """Per-column default for missing values; columns the table lacks are ignored."""
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})


def lenient_number(x: str, default: float, digits: int = 0) -> str:
    """Text or number to a rounded integer; what does not parse, is not finite or does not fit becomes the default."""
    parsed = finite(f"try_cast({x} AS DOUBLE)")
    return f"coalesce(try_cast(round({parsed}, {digits}) AS BIGINT), CAST(round({num(default)}, {digits}) AS BIGINT))"


def sentinel_fill(cols: Sequence[str], value: float = SENTINEL) -> dict[str, str]:
    """Missing, NaN and infinite numbers become a sentinel."""
    return {c: f"coalesce({finite(c)}, {num(value)})" for c in cols}


def complete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(cols) if cols else None)


def code_prefixes(code: str = "code", widths: Sequence[int] = (2, 4, 6)) -> dict[str, str]:
    return {f"{code}_{i}": f"substring({code}, 1, {n})" for i, n in enumerate(widths, 1)}


def suffix_country(ticker: str, table: Mapping[str, str] = SUFFIX_COUNTRY) -> str:
    """Country of the exchange suffix (text after the last blank); unknown suffix is NULL."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return f"element_at(map({pairs}), substring_index({ticker}, ' ', -1))"


def feature_columns(df: DataFrame, ids: Sequence[str]) -> list[str]:
    """Columns that are neither identifiers nor targets."""
    return [c for c in df.columns if c not in ids and not c.startswith("target")]


def first_available(df: DataFrame, names: Sequence[str]) -> str:
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {list(names)} is a column")


def first_per_key(df: DataFrame, keys: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``priority``.

    An aggregate, not a window: copies are reduced before the shuffle, so a key
    with a huge number of copies is no hot spot.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*priority)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


_FLOAT_MAX = 3.4028234663852886e38
_INTS = [("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)]


def narrow_types(df: DataFrame, cols: Sequence[str] | None = None, floats: bool = True) -> DataFrame:
    """Cast numeric columns to the smallest type that holds their range.

    One aggregation gives all ranges; the driver receives a single row. Integers
    become byte, short or int. Doubles become floats (there is no half precision)
    if all finite values lie in the range of a float, and stay doubles otherwise.
    """
    numeric = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and (cols is None or f.name in cols)]
    whole = [f.name for f in numeric if isinstance(f.dataType, T.IntegralType)]
    doubles = [f.name for f in numeric if floats and isinstance(f.dataType, T.DoubleType)]
    casts = {}
    if whole or doubles:
        sizes = [f"max(abs({finite(c)})) AS top_{c}" for c in doubles]
        row = df.selectExpr(*[f"min({c}) AS lo_{c}" for c in whole], *[f"max({c}) AS hi_{c}" for c in whole], *sizes).first()
        casts = {c: "float" for c in doubles if (row[f"top_{c}"] or 0.0) <= _FLOAT_MAX}
        for c in whole:
            lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
            if lo is None:
                continue
            fit = next((t for t, top in _INTS if -top <= lo and hi < top), None)
            if fit:
                casts[c] = fit
    return df.selectExpr(*[f"CAST({c} AS {casts[c]}) AS {c}" if c in casts else c for c in df.columns])


def widen_types(df: DataFrame) -> DataFrame:
    """Undo the narrowing for consumers that need int and double."""
    wide = {T.ByteType: "int", T.ShortType: "int", T.FloatType: "double"}
    return df.selectExpr(
        *[
            f"CAST({f.name} AS {wide[type(f.dataType)]}) AS {f.name}" if type(f.dataType) in wide else f.name
            for f in df.schema.fields
        ]
    )


def relabel_live(df: DataFrame, era: str, live_era: Column, kind: str = "data_type") -> DataFrame:
    """Rows of the given era (a column, such as a scalar subquery) become ``live``."""
    named = F.when(F.col(era) == live_era, "live").otherwise(F.col(kind)).alias(kind)
    return df.select(*[c for c in df.columns if c != kind], named)


def split_sets(df: DataFrame, target: str = "target", kind: str = "data_type") -> dict[str, DataFrame]:
    """Training rows, validation rows with a target, live rows."""
    return {
        "train": df.where(f"{kind} = 'train' AND {target} IS NOT NULL"),
        "validation": df.where(f"{kind} = 'validation' AND {target} IS NOT NULL"),
        "live": df.where(f"{kind} = 'live'"),
    }


def carry_forward_missing(df: DataFrame, era: str, current: Column, previous: Column, cols: Sequence[str], by: str = "ticker") -> DataFrame:
    """Give keys that have the previous era but not the current one a row with their last values.

    ``current`` and ``previous`` are columns, such as scalar subqueries. Rows that were
    there keep their values, missing ones too.
    """
    now = df.where(F.col(era) == current).select(by)
    gone = df.where(F.col(era) == previous).select(by).distinct().join(now, by, "left_anti")
    added = gone.select(by, current.alias(era), F.lit(True).alias("_added"))
    rows = df.selectExpr("*", "false AS _added").unionByName(added, allowMissingColumns=True)
    w = Series(by, era)
    return rows.selectExpr(*[f"CASE WHEN _added THEN {filled_forward(c, w)} ELSE {c} END AS {c}" if c in cols else c for c in df.columns])


def hash_unit(keys: Sequence[str], seed: int) -> str:
    """Uniform number in [0, 1) from the row key: the same in every run and partitioning."""
    text = f"concat_ws('|', '{seed}', {', '.join(f'string({k})' for k in keys)})"
    return f"(CAST(conv(substring(md5({text}), 1, 13), 16, 10) AS BIGINT) / {float(2**52)!r}D)"


def probe_columns(keys: Sequence[str], seed: int = 42) -> dict[str, str]:
    """Random probe features: uniform, normal (Box-Muller) and one of four categories."""
    u1, u2 = hash_unit(keys, seed), hash_unit(keys, seed + 1)
    return {
        "random_uniform": u1,
        "random_normal": f"sqrt(-2 * ln(1 - {u1})) * cos(2 * pi() * {u2})",
        "random_category": f"CAST(floor(4 * {hash_unit(keys, seed + 2)}) AS INT)",
    }

"""NULL-safe arithmetic: a result is a finite number or NULL, never NaN or infinity.

Expressions of the library are Spark SQL text, made for ``selectExpr``,
``where`` and ``F.expr``. Wide feature sets have thousands of them, and building
those as Column objects costs several driver round trips per operator; text
costs one for a whole list.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def num(x: float) -> str:
    """DOUBLE literal."""
    return f"{float(x)!r}D"


def add(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """Append named expressions in one projection."""
    return df.selectExpr("*", *named(exprs))


def named(exprs: Mapping[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in exprs.items()]


def finite(x: str) -> str:
    """NaN and both infinities become NULL."""
    return f"CASE WHEN NOT isnan({x}) AND abs({x}) <> double('inf') THEN {x} END"


def div(a: str, b: str, fill: float | None = None) -> str:
    """a / b; a zero divisor or a missing operand gives ``fill`` (default NULL)."""
    q = f"try_divide({a}, {b})"
    return q if fill is None else f"coalesce({q}, {num(fill)})"


def ln(x: str) -> str:
    return f"ln({x})"  # NULL for x <= 0


def log1p(x: str) -> str:
    return f"log1p({x})"  # NULL for x <= -1


def sqrt(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN sqrt({x}) END"


def power(x: str, n: float) -> str:
    """x ** n; fractional exponents of negative numbers and 0 ** negative give NULL."""
    p = f"pow({x}, {num(n)})"
    if float(n).is_integer() and n >= 0:
        return p
    return f"CASE WHEN {x} {'>' if n < 0 else '>='} 0 THEN {p} END"


def clip_low(x: str, floor: float) -> str:
    """Lower bound that keeps NULL (``greatest`` alone would replace it)."""
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({x}, {num(floor)}) END"


def null_power(x: str, n: float) -> str:
    """Power with a missing base taken as 0."""
    return power(f"coalesce({x}, 0D)", n)


def rounded(x: str, digits: int = 6) -> str:
    """Round for reporting; adding zero turns -0.0 into 0.0."""
    return f"round({x}, {digits}) + 0D"

"""Exact decimal rounding (rule R1/R2).

The reference rounds numeric values half away from zero with numeric
precision. Averages of decimals in Spark carry scale 6, so rounding that
average again to 2 digits can go wrong once a group holds more than about
10,000 rows. These helpers round from integer numerators and denominators
instead, so the result is exact at any group size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDE = "decimal(38,0)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _idiv(a: Column, b: Column) -> Column:
    """SQL ``a div b``: integer quotient truncated toward zero."""
    return F.call_function("div", a, b)


def ratio_units(num, den, scale: int = 2, factor: int = 1, wide: bool = True) -> Column:
    """round(factor * num / den, scale) as an exact integer count of 10^-scale units.

    ``num`` and ``den`` are integer valued (sums of integer columns or of
    values already scaled to integers). Halves round away from zero. Null
    when ``den`` is 0 or null, like ``x / NULLIF(den, 0)``. ``wide`` computes
    in decimal(38,0) (sums of any size); per-row use on small integers passes
    ``wide=False`` for 64-bit arithmetic, which stays in generated code
    instead of BigDecimal (ANSI mode raises on overflow instead of wrapping).
    """
    t = _WIDE if wide else "long"
    n, d = _c(num).cast(t), _c(den).cast(t)
    m = factor * 10 ** scale
    sign = (F.signum(n) * F.signum(d)).cast("long")
    units = _idiv(F.abs(n) * (2 * m) + F.abs(d), F.abs(d) * 2) * sign
    return F.when(d != 0, units)


def units_to_double(units, scale: int = 2) -> Column:
    """Integer units of 10^-scale -> decimal -> double (the output type of measures)."""
    return (_c(units).cast(_WIDE) / 10 ** scale).cast(f"decimal(38,{scale})").cast("double")


def round_ratio(num, den, scale: int = 2, factor: int = 1) -> Column:
    """round(factor * num / den, scale), half away from zero, as double; see ratio_units."""
    return units_to_double(ratio_units(num, den, scale, factor), scale)


def round_mean(total, count, scale: int = 2, unit_scale: int = 2) -> Column:
    """Exact round(avg, scale) of values stored as integers in 10^-unit_scale units.

    ``total`` is the sum of the scaled integers, ``count`` the number of
    non-null values; null when ``count`` is 0 (AVG over no rows).
    """
    return round_ratio(total, _c(count) * (10 ** unit_scale), scale=scale)


def to_units(df: DataFrame, column: str, digits: int = 9) -> tuple[Column, int]:
    """(exact integer units, number of decimals) of a numeric column, from its own type.

    A decimal keeps all its digits, an integer has none; a float is rounded to
    ``digits`` decimals first.
    """
    kind = df.schema[column].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else digits if isinstance(kind, T.FractionalType) else 0
    return (F.col(column).cast(f"decimal(38,{scale})") * 10 ** scale).cast("decimal(38,0)").cast("long"), scale

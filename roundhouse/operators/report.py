"""Data half of the reference's charts and workbook (A14-A16, histograms, colour scale).

Bounds and totals come from one-row aggregates used as scalar subqueries
(``DataFrame.scalar()``): Spark runs each once and substitutes the value, so
no row is joined with a broadcast copy and no un-partitioned window runs
over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rounding import round_ratio
from ..session import materialize
from .quantiles import column_quantiles


def equal_width_histogram(df: DataFrame, column: str, bins: int = 15, digits: int | None = None) -> DataFrame:
    """Counts in ``bins`` equal-width bins over [min, max]; the last bin is closed.

    Every bin appears, empty ones with 0. A single distinct value puts all rows
    in bin 1 instead of dividing by zero. ``digits`` rounds the edges. Output: bin,
    bin_lo, bin_hi, n. Bounds and bins both read the counts per distinct value; as
    both plans are alike below, Spark reuses the shuffles of the input.
    """
    x = F.col("x")
    values = (df.select(F.col(column).alias("x")).filter(x.isNotNull())
              .groupBy("x").agg(F.count(F.lit(1)).alias("c")))
    bounds = values.select(F.struct(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"),
                                    F.sum("c").alias("rows")).alias("b")).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    width = hi - lo
    raw = F.floor((x.cast("double") - lo) * bins / width) + 1
    b = F.when(width == 0, F.lit(1)).otherwise(F.least(raw, F.lit(bins))).cast("int")
    counts = values.groupBy(b.alias("bin")).agg(F.sum("c").alias("n"))
    spark = df.sparkSession
    every = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    out = every.join(counts, "bin", "left")
    exact = lambda i: lo + (i * width) / bins
    edge = exact if digits is None else lambda i: F.round(exact(i), digits)
    return out.select(
        "bin",
        edge(F.col("bin") - 1).alias("bin_lo"),
        edge(F.col("bin")).alias("bin_hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
    ).orderBy("bin")


def fixed_width_bins(df: DataFrame, column: str, width: float) -> DataFrame:
    """Counts per bin [k*w, (k+1)*w): bin_start = floor(x / w) * w."""
    x = F.col(column)
    start = (F.floor(x / width) * width)
    if float(width).is_integer():
        start = start.cast("long")
    return (df.filter(x.isNotNull()).groupBy(start.alias("bin_start"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("bin_start"))


def nice_width_bins(df: DataFrame, column: str, max_bins: int = 20) -> DataFrame:
    """Fixed-width bins with the smallest 1, 2 or 5 x 10^k width w such that
    (max - min) / w <= ``max_bins`` (a chart asking for "at most N bins").

    Bins start at multiples of w, so one more bin appears when min is not a
    multiple. Output: width, bin_start, n. A single distinct value gets w = 1.
    """
    x = F.col(column).cast("double")
    raw = (F.max(x) - F.min(x)) / max_bins
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    nice = (F.when(raw <= 0, F.lit(1.0)).when(raw <= base, base).when(raw <= 2 * base, 2 * base)
            .when(raw <= 5 * base, 5 * base).otherwise(10 * base))
    width = df.select(nice).scalar()  # one scalar subquery over a one-row aggregate
    start = F.floor(x / width) * width
    return (df.filter(x.isNotNull()).groupBy(width.alias("width"), start.alias("bin_start"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("bin_start"))


def share_of_total(df: DataFrame, count_col: str, scale: int = 1, name: str = "share") -> DataFrame:
    """Adds 100 * count / total rounded to ``scale`` digits (the pie labels)."""
    total = df.select(F.sum(count_col)).scalar()
    return df.withColumn(name, round_ratio(F.col(count_col), total, scale=scale, factor=100))


def numeric_columns(df: DataFrame, min_numbers: int = 3) -> list[str]:
    """Columns the workbook colours: numeric type with at least ``min_numbers``
    values (booleans excluded)."""
    nums = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType)]
    if not nums:
        return []
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in nums]).first()
    return [c for c in nums if counts[c] >= min_numbers]


def exact_quantile(df: DataFrame, column: str, q: float = 0.5, final_rows: int = 200_000,
                   accuracy: int = 10_000, n: int | None = None):
    """Exact interpolated quantile (like quantile_cont) of a column of any size.

    ``percentile`` keeps every distinct value of a group in one buffer; here the
    rows at the two target ranks are found by narrowing (``_value_at``). Only
    scalars reach the driver.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n = values.count() if n is None else n
    if n == 0:
        return None
    pos = q * (n - 1)
    rank = int(pos)
    lo_v = _value_at(values, rank, n, final_rows, accuracy)
    if pos == rank:
        return lo_v
    return lo_v + (_value_at(values, rank + 1, n, final_rows, accuracy) - lo_v) * (pos - rank)


def _value_at(values: DataFrame, rank: int, n: int, final_rows: int, accuracy: int) -> float:
    """The value of ``rank`` (from 0) in sorted order.

    Each round asks ``percentile_approx`` for two values around the rank and
    counts exactly what is below, at and between them. The rank falls on one
    of the two, however often it occurs, or strictly between them, where the
    search goes on; the last ``final_rows`` rows are sorted.
    """
    v, below, m, slack = F.col("v"), 0, n, 2.0 / accuracy
    while m > final_rows:
        share = (rank - below + 0.5) / m
        a, b = values.select(F.percentile_approx(
            v, [max(0.0, share - slack), min(1.0, share + slack)], accuracy)).first()[0]
        less, at_a, between, at_b = values.agg(
            F.count_if(v < a), F.count_if(v == a), F.count_if((v > a) & (v < b)), F.count_if(v == b)).first()
        r = rank - below - less
        if 0 <= r < at_a:
            return a
        if at_a <= r < at_a + between:
            below, m = below + less + at_a, between
            values = values.filter((v > a) & (v < b))
        elif a < b and at_a + between <= r < at_a + between + at_b:
            return b
        else:  # outside the two values: look further
            slack *= 2
    return values.orderBy("v").offset(rank - below).first()[0]


def _anchors(df: DataFrame, columns: list[str]) -> list[tuple]:
    """(column, min, median, max) per column, in the given order, by a number of jobs that
    does not depend on the number of columns; a column without a value has nulls."""
    if not columns:
        return []
    found = {r["column"]: (r["min_value"], r["quantiles"][0], r["max_value"])
             for r in column_quantiles(df, columns).collect()}
    return [(c, *found.get(c, (None, None, None))) for c in columns]


def column_anchors(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """min, median (exact, interpolated) and max of each column: the colour-scale anchors.

    Without ``columns`` the numeric columns are detected as the workbook does
    (``numeric_columns``); the frame is written once for both steps.
    """
    spark = df.sparkSession
    if columns is None:
        df = materialize(df, "sheet")
        columns = numeric_columns(df)
    data = _anchors(df, columns)
    return spark.createDataFrame(
        data, "column string, min_value double, median_value double, max_value double")


def colour_position(df: DataFrame, column: str, name: str = "position", digits: int | None = None) -> DataFrame:
    """Position of each value on the min - median - max scale: 0 .. 0.5 .. 1.

    Piecewise linear between the anchors; a collapsed segment maps to its
    lower end. ``digits`` rounds the positions.
    """
    x = F.col(column).cast("double")
    _, a_lo, a_mid, a_hi = _anchors(df, [column])[0]
    lo, mid, hi = (F.lit(a).cast("double") for a in (a_lo, a_mid, a_hi))
    lower = F.when(mid == lo, F.lit(0.0)).otherwise((x - lo) / (mid - lo) * 0.5)
    upper = F.when(hi == mid, F.lit(0.5)).otherwise(0.5 + (x - mid) / (hi - mid) * 0.5)
    pos: Column = F.when(x.isNull(), F.lit(None)).when(x <= mid, lower).otherwise(upper)
    return df.withColumn(name, pos if digits is None else F.round(pos, digits))

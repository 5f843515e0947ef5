"""Exact quantiles of many columns and groups together.

A mergeable sketch (KLL) per group and column brackets the ranks that are asked
for, one counting pass finds how many values lie below each bracket and which lie in
it, and the rank is read off the counts. Both passes take all columns and groups at
once, so the number of jobs does not depend on how many there are; only groups
whose brackets hold too many values are bracketed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SKETCH_K = 4096
FINAL_ROWS = 200_000  # distinct values of a bracket that one task sorts
GRID = 1024
CHUNKS = 64
ROUNDS = 30


def _slack(k: int) -> float:
    """Three times the sketch's normalised rank error."""
    return 3 * 2.296 / k ** 0.9021


def column_quantiles(df: DataFrame, columns: list[str], qs: tuple = (0.5,), by: tuple = (),
                     k: int = SKETCH_K, final_rows: int = FINAL_ROWS) -> DataFrame:
    """(*by, column, n, min_value, max_value, quantiles): one row per group and column with a value.

    ``quantiles`` are interpolated as ``quantile_cont`` does, exactly, for each of ``qs``.
    Nulls are left out; NaN counts as larger than every number (quantiles that touch
    it are NaN). A null group is a group. The projected input is written once. Two
    jobs a round; a second round is needed where a bracket holds more than
    ``final_rows`` distinct values.
    """
    if k < 64 or final_rows < 16:
        raise ValueError("brackets need k >= 64 and final_rows >= 16 to become narrower")
    by = list(by)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = (materialize(df.select(*by, *[c for c in columns if c not in by]), "quantiles")
            .select(*by, F.inline(pairs)).filter("v IS NOT NULL"))
    number = F.when(~F.isnan("v"), F.col("v"))
    stats = materialize(long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("n"), F.count(number).alias("m"), F.min("v").alias("min_value"),
        F.max("v").alias("max_value"), F.kll_sketch_agg_double(number, k).alias("sketch")), "sketches")
    # one row per group, column and quantile: the smaller rank; rank + 1 is the other one
    wanted = stats.select(
        *by, "column", "m", "sketch", F.posexplode(F.array(*[F.lit(float(q)) for q in qs])).alias("t", "q"),
        (F.col("q") * (F.col("n") - 1)).alias("pos"), F.lit(0).cast("long").alias("below")).withColumn(
        "rank", F.floor("pos")).filter("rank < m")
    marks, found = _brackets(wanted, "m", _slack(k)), None
    for _ in range(ROUNDS):
        marks = materialize(marks, "brackets")
        lo = marks.select(*[F.col(c).alias(f"_{c}") for c in (*by, "column")], "t", "pos", "rank", "m", "lo", "hi")
        near = long.join(lo, [long[c].eqNullSafe(lo[f"_{c}"]) for c in (*by, "column")]).filter(
            F.col("v") <= F.col("hi"))
        cells = materialize(near.groupBy(*by, "column", "t", "pos", "rank", "m", "lo", "hi",
                                         F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("x"))
                            .agg(F.count(F.lit(1)).alias("c")), "cells")
        keys = [*by, "column", "t", "pos", "rank", "m", "lo", "hi"]
        seen = cells.groupBy(*keys).agg(
            F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("c"))), F.lit(0)).alias("below"),
            F.sum(F.when(F.col("x").isNotNull(), F.col("c"))).alias("inside"), F.count("x").alias("width"))
        hit = (F.col("below") <= F.col("rank")) & (
            F.least(F.col("rank") + 1, F.col("m") - 1) < F.col("below") + F.col("inside"))
        state = seen.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn(
            "done", F.col("hit") & ((F.col("width") <= final_rows) | (F.col("lo") == F.col("hi"))))
        done = state.agg(F.min("done")).first()[0]
        ready = cells if done or done is None else cells.join(
            state.filter("done").select(*[F.col(c).alias(f"_{c}") for c in (*by, "column")], F.col("t").alias("_t")),
            [*_same(cells, by), F.col("t") == F.col("_t")], "left_semi")
        part = _read_off(ready, by)
        found = part if found is None else found.unionByName(part)
        if done or done is None:
            break
        marks = _again(cells, state.filter("NOT done"), by, k)
    else:
        raise RuntimeError("quantiles did not settle")
    values = found.groupBy(*by, "column").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("_v"))
    values = values.select(*[F.col(c).alias(f"_{c}") for c in (*by, "column")], "_v")
    out = stats.join(values, [stats[c].eqNullSafe(values[f"_{c}"]) for c in (*by, "column")], "left")
    # ranks beyond the numbers are NaN
    at = lambda i: F.get(F.filter("_v", lambda x: x["t"] == i), F.lit(0))["value"]
    picked = F.array(*[F.coalesce(at(i), F.lit(float("nan"))) for i in range(len(qs))])
    return out.select(*by, "column", "n", "min_value", "max_value", picked.alias("quantiles"))


def _same(df: DataFrame, by: list[str]) -> list:
    return [df[c].eqNullSafe(F.col(f"_{c}")) for c in (*by, "column")]


def _brackets(rows: DataFrame, size: str, slack: float) -> DataFrame:
    """lo and hi around the ranks that lie below + [0, size) of ``sketch``."""
    local = F.col("rank") - F.col("below")
    n = F.col(size)
    # the sketch answers for constant shares: those around the wanted ones on a grid
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    at = lambda i: F.get("_grid", F.least(F.greatest(i, F.lit(0)), F.lit(GRID)).cast("int"))
    return (rows.withColumn("_grid", grid)
            .withColumn("lo", at(F.floor(((local - 1) / n - slack) * GRID)))
            .withColumn("hi", at(F.ceil(((local + 2) / n + slack) * GRID))).drop("sketch", "_grid"))


def _again(cells: DataFrame, state: DataFrame, by: list[str], k: int) -> DataFrame:
    """Narrower brackets, by the counts of ``CHUNKS`` chunks of the distinct values in the present ones
    (so that a value with most of the rows does not hold a bracket open). Where a bracket missed its
    ranks (the sketch was further off than three times its bound) all values are looked at next."""
    keys = [*by, "column", "t"]
    mine = lambda other: [cells[c].eqNullSafe(other[f"_{c}"]) for c in keys]
    named = [F.col(c).alias(f"_{c}") for c in keys]
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / CHUNKS) for i in range(CHUNKS + 1)]))
    cuts = (cells.filter("x IS NOT NULL").groupBy(*keys).agg(F.kll_sketch_agg_double("x", k).alias("sketch"))
            .select(*named, grid.alias("_grid")))
    cuts = cuts.join(state.filter("hit").select(*[F.col(c).alias(f"s_{c}") for c in keys], "below"),
                     [F.col(f"_{c}").eqNullSafe(F.col(f"s_{c}")) for c in keys]).drop(*[f"s_{c}" for c in keys])
    chunk = F.size(F.filter("_grid", lambda g: g < F.col("x")))
    sums = (cells.filter("x IS NOT NULL").join(cuts, mine(cuts))
            .groupBy(*keys, "pos", "rank", "m", "below", chunk.alias("_chunk"))
            .agg(F.sum("c").alias("_c"), F.min("x").alias("_lo"), F.max("x").alias("_hi")))
    upto = F.col("below") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_chunk"))
    narrow = sums.withColumn("_upto", upto).groupBy(*keys, "pos", "rank", "m").agg(
        F.min(F.when(F.col("_upto") > F.col("rank"), F.col("_lo"))).alias("lo"),
        F.min(F.when(F.col("_upto") > F.least(F.col("rank") + 1, F.col("m") - 1), F.col("_hi"))).alias("hi"))
    missed = state.filter("NOT hit").select(*keys, "pos", "rank", "m", F.lit(float("-inf")).alias("lo"),
                                            F.lit(float("inf")).alias("hi"))
    return narrow.unionByName(missed)


def _read_off(cells: DataFrame, by: list[str]) -> DataFrame:
    """The interpolated value of each rank from the counts of its bracket's values."""
    keys = [*by, "column", "t"]
    upto = Window.partitionBy(*keys).orderBy(F.col("x").asc_nulls_first())
    run = cells.withColumn("_upto", F.sum("c").over(upto)).filter("x IS NOT NULL")
    pick = run.groupBy(*keys, "pos", "rank", "m").agg(
        F.min(F.when(F.col("_upto") > F.col("rank"), F.col("x"))).alias("a"),
        F.min(F.when(F.col("_upto") > F.col("rank") + 1, F.col("x"))).alias("b"))
    share = F.col("pos") - F.col("rank")
    b = F.when(F.col("rank") + 1 < F.col("m"), F.col("b")).otherwise(F.lit(float("nan")))
    value = F.when(share == 0, F.col("a")).otherwise(F.col("a") + (b - F.col("a")) * share)
    return pick.select(*keys, value.alias("value"))


def group_anchors(df: DataFrame, columns: list[str], by: list[str], **options) -> DataFrame:
    """(*by, column, min_value, median_value, max_value): colour-scale anchors of every group and column."""
    return column_quantiles(df, columns, (0.5,), tuple(by), **options).select(
        *by, "column", "min_value", F.col("quantiles")[0].alias("median_value"), "max_value")

"""Staging -> final table steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def dedupe_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the smallest row by the remaining columns in their order.

    The reference lets the first conflicting row win in an unspecified order; a
    minimum makes the survivor deterministic. Written as an aggregate of a
    struct, it is combined map-side, so a key holding a third of all rows is
    reduced in every task before the shuffle instead of landing in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    best = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return best.select(*[F.col(k) for k in keys], *[F.col("_row")[c].alias(c) for c in rest]) \
        .select(*df.columns)


def insert_ignore(new: DataFrame, existing: DataFrame | None, keys: list[str] | None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO NOTHING, returning the resulting table.

    With ``keys``: rows of ``new`` whose key already exists are dropped (left
    anti join), duplicates inside ``new`` keep one deterministic survivor.
    As in a SQL unique constraint, a key with a NULL part never conflicts, so
    such rows are always inserted. Without keys (the constraint is unknown)
    the rows are appended.
    """
    new = new.select(*(existing.columns if existing is not None else new.columns))
    if not keys:
        return new if existing is None else existing.unionByName(new)
    # a key with a NULL part gets a row number of its own, so one aggregate serves both kinds
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    alone = F.when(has_null, F.monotonically_increasing_id())
    fresh = dedupe_by_key(new.withColumn("_alone", alone), [*keys, "_alone"]).drop("_alone")
    if existing is not None:
        fresh = fresh.join(existing.select(*keys), on=keys, how="left_anti")  # NULL never equals
        fresh = existing.unionByName(fresh)
    return fresh


def append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert without a key: plain UNION ALL by column name."""
    return existing.unionByName(new.select(*existing.columns))


def assign_ids(new: DataFrame, start, order: list[str], id_col: str = "id") -> DataFrame:
    """Number ``new`` consecutively after ``start`` in the order of ``order``.

    ``start`` is a Column (e.g. the scalar subquery COALESCE(MAX(id), 0)) or an
    int. A global ``row_number()`` would move every row into one task; instead
    the rows are range-partitioned and sorted, each partition counts its rows,
    and the offsets come from a running sum over the (few) partition counts.
    ``order`` must be unique per row for the numbering to be repeatable; the
    positions are written once below the shared checkpoint folder, so the
    count pass and the numbering pass read the same rows and a lost executor
    cannot renumber them.
    """
    start = F.lit(start) if isinstance(start, int) else start
    ranged = (new.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id()))
    ranged = materialize(ranged, "numbered")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    # one row per partition: the window below sees at most numPartitions rows
    offsets = counts.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(
            Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranged.join(offsets.select("_part", "_offset", "_first"), "_part")
    new_id = start.cast("long") + F.col("_offset") + (F.col("_mono") - F.col("_first")) + 1
    return numbered.select(new_id.alias(id_col), *new.columns)

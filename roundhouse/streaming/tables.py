"""Batch tables of streaming sinks: one folder per micro-batch, readable once committed.

    <target>/batch_id=<n>/           rows of micro-batch n
    <target>/compacted=<m>/          all rows up to batch m, folded
    <target>/_commits/batch_id=<n>   empty marker: the batch is complete
    <target>/_commits/compacted=<m>  empty marker: stands for batches 0..m

A folder without its marker is not read, so a batch or a compaction that broke off
leaves the table as it was. A batch that is replayed after its commit (the stream
restarts before it noted the batch as done) is skipped: its rows are there, in its
folder or in a compacted one, which no batch number can name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.etl import dedupe_by_key

COMMITS = "_commits"


class Folder:
    """Names, markers and removal below a table's folder, on any file system Spark reads."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._new(self.target).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._new(f"{self.target}/{name}")

    def names(self, pattern: str) -> list[str]:
        found = self.fs.globStatus(self.path(pattern))
        return [f.getPath().getName() for f in found] if found is not None else []

    def mark(self, name: str) -> None:
        self.fs.create(self.path(f"{COMMITS}/{name}"), True).close()

    def numbers(self, kind: str) -> list[int]:
        """The committed numbers of ``kind`` (batch_id or compacted), ascending."""
        return sorted(int(n.split("=")[1]) for n in self.names(f"{COMMITS}/{kind}=*"))

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def committed(spark: SparkSession, target: str) -> tuple[int | None, list[int]]:
    """(newest compaction, committed batches after it): a snapshot of the table."""
    folder = Folder(spark, target)
    base = max(folder.numbers("compacted"), default=None)
    return base, [n for n in folder.numbers("batch_id") if base is None or n > base]


def is_committed(spark: SparkSession, target: str, batch_id: int) -> bool:
    base, batches = committed(spark, target)
    return batch_id in batches or (base is not None and batch_id <= base)


def claim(spark: SparkSession, target: str, checkpoint: str) -> None:
    """Binds the table to the checkpoint whose batch numbers it counts by."""
    folder = Folder(spark, target)
    name = re.sub(r"\W+", "-", checkpoint).strip("-")[-200:]
    others = [n for n in folder.names(f"{COMMITS}/checkpoint=*") if n != f"checkpoint={name}"]
    if others:
        raise ValueError(f"{target} is written by a stream with another checkpoint ({others[0]})")
    folder.mark(f"checkpoint={name}")


def write_batch(batch: DataFrame, target: str, batch_id: int) -> None:
    """Writes micro-batch ``batch_id`` and commits it; does nothing if it is committed."""
    spark = batch.sparkSession
    if is_committed(spark, target, batch_id):
        return
    batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
    Folder(spark, target).mark(f"batch_id={batch_id}")


def read_batches(spark: SparkSession, target: str, newest: int | None = None) -> DataFrame | None:
    """All committed rows with their batch_id (None: nothing committed), up to batch ``newest``."""
    base, batches = committed(spark, target)
    batches = [n for n in batches if newest is None or n <= newest]
    parts = []
    if batches:
        rows = spark.read.option("basePath", target).parquet(*[f"{target}/batch_id={n}" for n in batches])
        parts.append(rows.withColumn("batch_id", F.col("batch_id").cast("long")))
    if base is not None:
        parts.append(spark.read.parquet(f"{target}/compacted={base}").withColumn("batch_id", F.lit(base).cast("long")))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None


def latest_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key by batch_id; rows with a null key part are all kept."""
    columns = [c for c in df.columns if c != "batch_id"]
    alone = F.when(F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True),
                   F.monotonically_increasing_id())
    order = (-F.col("batch_id")).alias("_newest")
    found = dedupe_by_key(df.select(*keys, alone.alias("_alone"), order, *[c for c in columns if c not in keys]),
                          [*keys, "_alone"])
    return found.select(*columns)


def compact(spark: SparkSession, target: str, merge: Callable[[DataFrame], DataFrame]) -> int | None:
    """Folds all committed batches into one folder: ``merge`` gets their rows with batch_id.

    The folded rows are written and committed beside the batches; only then do the
    folders they stand for go. Whatever step a run breaks off at, the table reads the
    same, and the next run clears what is left over. Streams may go on meanwhile;
    readers that planned before the removal have to plan again.
    """
    folder = Folder(spark, target)
    base, batches = committed(spark, target)
    if batches:
        newest = batches[-1]
        merge(read_batches(spark, target, newest)).drop("batch_id").write.mode("overwrite").parquet(
            f"{target}/compacted={newest}")
        folder.mark(f"compacted={newest}")
        base = newest
    if base is not None:
        for kind, gone in (("batch_id", lambda n: n <= base), ("compacted", lambda n: n < base)):
            for n in {int(x.split("=")[1]) for x in folder.names(f"{kind}=*") + folder.names(f"{COMMITS}/{kind}=*")}:
                if gone(n):
                    folder.remove(f"{kind}={n}")
                    folder.remove(f"{COMMITS}/{kind}={n}")
    return base

"""Date-partitioned sample tables and their retention by removal of whole days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.samples import retain_recent

DAY_COLUMN = "day"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder of rows without a day


def write_dated(samples: DataFrame, folder: str, ts: str = "ts", also: list[str] | None = None) -> None:
    """Writes rows into folders ``day=<date of ts>`` (and ``also`` below).

    Folders that the rows fall into are replaced, others stay. Days are rebalanced, so
    a day has few files and one with a large share of the rows is split over tasks.
    Rows without a time get a folder of their own, which never expires.
    """
    dated = samples.withColumn(DAY_COLUMN, F.col(ts).cast("date")).hint("rebalance", DAY_COLUMN)
    (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(DAY_COLUMN, *(also or [])).parquet(folder))


def _interval_days(spark: SparkSession, keep: str) -> dt.timedelta:
    return spark.sql(f"SELECT timestamp_ntz'2000-01-01' - (timestamp_ntz'2000-01-01' - INTERVAL {keep})").first()[0]


def retain_stored(spark: SparkSession, folder: str, keep: str = "7 days") -> list[str]:
    """Removes the days of which every row lies outside ``keep`` of the newest row; returns their names.

    Reads folder names only: the newest row is not before its day, so a day that ends
    ``keep`` before the newest day begins is expired as a whole. What remains holds
    every retained row and at most the rest of one more day, which ``read_retained`` cuts.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path(f"{folder}/{DAY_COLUMN}=*"))
    days = {f.getPath().getName().split("=")[1]: f.getPath() for f in (found or [])}
    days.pop(NO_DAY, None)
    if not days:
        return []
    limit = dt.datetime.fromisoformat(max(days)) - _interval_days(spark, keep)
    gone = sorted(d for d in days if dt.datetime.fromisoformat(d) + dt.timedelta(days=1) <= limit)
    for d in gone:
        fs.delete(days[d], True)
    return gone


def read_retained(spark: SparkSession, folder: str, keep: str = "7 days", ts: str = "ts") -> DataFrame:
    """The rows within ``keep`` of the newest one; the filter on the day prunes expired folders."""
    stored = spark.read.parquet(folder)
    newest = stored.select(F.max(DAY_COLUMN)).scalar()
    near = stored.filter(F.col(DAY_COLUMN) >= (newest.cast("timestamp_ntz") - F.expr(f"INTERVAL {keep}")).cast("date"))
    return retain_recent(near, keep, ts).drop(DAY_COLUMN)

"""Result sinks (S6 CSV, S7 report of named sheets, S8 skip empty, S9 row totals, E8)."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, no index column; executors write their partitions in parallel."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def _path(df: DataFrame, path: str):
    """(file system, path) of a stored folder."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), p


def write_report(sheets: dict[str, DataFrame], folder: str, fmt: str = "parquet",
                 skip_empty: bool = True, counts: dict[str, int] | None = None) -> dict[str, str]:
    """One output folder per named sheet (the workbook re-aimed as a data set).

    Empty sheets are skipped when ``skip_empty`` (the reference skips output
    of an empty result). Returns name -> written path. Each sheet is evaluated once:
    its rows are counted while they are written (into ``counts`` if given), and
    the folder of an empty one is removed.
    """
    written = {}
    for name, df in sheets.items():
        if df is None:
            continue
        path = os.path.join(folder, name)
        seen = Observation()
        out = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if fmt == "csv":
            write_csv(out, path)
        else:
            out.write.mode("overwrite").parquet(path)
        n = seen.get["n"]
        if counts is not None:
            counts[name] = n
        if skip_empty and n == 0:
            fs, p = _path(df, path)
            fs.delete(p, True)
        else:
            written[name] = path
    return written


def create_if_absent(df: DataFrame, path: str) -> bool:
    """CREATE TABLE IF NOT EXISTS for a Parquet folder; True if it was written."""
    fs, p = _path(df, path)
    absent = not fs.exists(p)
    df.write.mode("ignore").parquet(path)
    return absent


def report_row_counts(sheets: dict[str, DataFrame]) -> DataFrame:
    """Rows per sheet plus the total over all sheets, as one small frame; each sheet is
    evaluated once (the total is a rollup of the counts)."""
    parts = [df.select(F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("n"))
             for name, df in sheets.items()]
    return (reduce(DataFrame.unionByName, parts).rollup("sheet").agg(F.sum("n").alias("row_count"))
            .select(F.coalesce("sheet", F.lit("__total__")).alias("sheet"), "row_count"))

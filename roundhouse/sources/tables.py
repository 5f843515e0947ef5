"""Parquet tables of one data folder (S3: table scan with a column list)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class TableSource:
    """Reads ``<root>/<name>.parquet``; Catalyst prunes columns and pushes filters."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


BROADCAST_ROWS = 1_250_000  # rows of few columns take about 80 bytes each in a broadcast table


class CountedSource(TableSource):
    """Parts and customers of more than ``BROADCAST_ROWS`` rows are never broadcast: the size of their files,
    which Spark decides by, says little of their rows in memory. Counting reads the footers of the files only."""

    COUNTED = ("customer", "part")

    def __init__(self, spark: SparkSession, root: str, most: int = BROADCAST_ROWS):
        super().__init__(spark, root)
        self.most, self.large = most, {}

    def table(self, name: str) -> DataFrame:
        df = super().table(name)
        if name in self.COUNTED and name not in self.large:
            self.large[name] = df.count() > self.most
        return df.hint("merge") if self.large.get(name) else df

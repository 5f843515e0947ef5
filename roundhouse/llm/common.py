"""Small shared pieces: written intermediate tables, components, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Written:
    """Tables written once below the shared folder of ``spark.checkpoint.dir``.

    Writing cuts the lineage (a lost executor re-reads files). ``drop`` frees a
    table as soon as nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")

    def put(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict]) -> DataFrame:
    """``mapInArrow`` with a function from a batch to one or more dicts of columns."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            made = fn(batch)
            for columns in ([made] if isinstance(made, dict) else made):
                yield pa.RecordBatch.from_arrays(
                    [_as(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def components(edges: DataFrame, out: Written, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): (id, component_id = smallest id).

    Alternates two contractions until no edge changes: every node links its
    larger neighbours to its smallest neighbour, then its smaller ones. Each
    is one aggregate (map-side combined minimum) and one join; the edge list
    never grows and halves the distance to the root each round. Every round is
    written to the shared folder. Nodes without an edge do not appear.
    """
    spark = edges.sparkSession
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    now = out.put(edges.filter("a <> b").select(lo.alias("a"), hi.alias("b")).distinct(), f"{name}-0")
    for i in range(1, max_rounds + 1):
        # larger neighbours of each node join its smallest neighbour (or itself)
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.filter("b > a").join(least, "a").filter("b <> m")
                 .select(F.col("m").alias("a"), "b").distinct())
        # smaller neighbours of each node (and the node) join the smallest of them
        floor = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(floor, "b").select(
            F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
                              F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
                 .select("e.a", "e.b").filter("a <> b").distinct())
        after = out.put(small, f"{name}-{i}")
        digest = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        same = now.agg(digest).first() == after.agg(digest).first()
        out.drop(f"{name}-{i - 1}")
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return now.select(F.col("b").alias("id"), F.col("a").alias("component_id")).union(roots)

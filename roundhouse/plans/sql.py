"""SQL text with named parameters over the reference-shaped tables (S4), and
running a list of registered queries into one output folder each (S10)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import write_csv


def run_sql(spark: SparkSession, text: str, frames: dict[str, DataFrame] | None = None, **params) -> DataFrame:
    """``spark.sql`` with named parameter markers (``:event_id``), whose values are bound, not
    pasted, and ``{name}`` for each of ``frames``, so no view of the session is replaced."""
    return spark.sql(text, args=params or None, **(frames or {}))


def save_results(spark: SparkSession, sf_dir: str, names: list[str], out_dir: str) -> dict[str, str]:
    """Run registered queries and write each result as CSV with a header (S10 + S6)."""
    from .catalog import queries
    qs = queries()
    written = {}
    for name in names:
        path = os.path.join(out_dir, name)
        write_csv(qs[name](spark, sf_dir), path)
        written[name] = path
    return written

"""roundhouse: match analytics expressed as Spark DataFrame plans.

Subpackages
-----------
sources    file and table readers, report sinks
functions  column expressions (exact rounding, names, slugs, dates)
operators  reusable relational building blocks (unpivot, top-k, ETL,
           change logs, gauge samples, report data)
plans      adapters from the test tables, the named queries and the
           registry used by ``__spark_entry__``
streaming  Structured Streaming forms of the live operators
"""

__all__ = ["session"]

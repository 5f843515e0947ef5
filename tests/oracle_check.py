"""Side-by-side check of a Spark result against its DuckDB SQL twin.

Used by the tests and by hand; both sides are small query results.
"""

from __future__ import annotations

import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    from decimal import Decimal
    if isinstance(v, Decimal):
        return round(float(v), 9)
    return v


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


def compare(spark_df, con, sql: str):
    """Returns (ok, message). Columns compared by name, rows as multisets."""
    srows = [r.asDict() for r in spark_df.collect()]
    scols = sorted(spark_df.columns)
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    if sorted(dcols) != scols:
        return False, f"columns differ: spark={scols} duck={sorted(dcols)}"
    a, b = _rows(srows, scols), _rows(drows, scols)
    if len(a) != len(b):
        return False, f"row count differs: spark={len(a)} duck={len(b)}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ ({len(a)} rows), first: {diff}"
    return True, f"{len(a)} rows equal"

"""Sorting and top-k with the reference's NULL order and deterministic ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, measure: str, k: int | None, keys: list[str] | tuple = (),
          nulls: str = "first", ascending: bool = False) -> DataFrame:
    """ORDER BY measure DESC [NULLS FIRST], keys ASC LIMIT k.

    PostgreSQL sorts NULL above every value in a descending order, so an
    all-NULL group wins a LIMIT 1 there; ``nulls="first"`` keeps that,
    ``nulls="last"`` is the alternative. Group keys break ties so the result
    does not depend on partitioning. With ``k`` the plan is a bounded
    TakeOrderedAndProject (per-partition top k, then a merge of k rows each).
    """
    m = F.col(measure)
    if ascending:
        first = m.asc_nulls_first() if nulls == "first" else m.asc_nulls_last()
    else:
        first = m.desc_nulls_first() if nulls == "first" else m.desc_nulls_last()
    ordered = df.orderBy(first, *[F.col(c).asc_nulls_first() for c in keys])
    return ordered.limit(k) if k is not None else ordered


def random_pick(df: DataFrame, key: str, n: int = 1, seed: int = 0) -> DataFrame:
    """n rows in the repeatable order of a digest of key and seed (``ORDER BY RANDOM()`` that
    draws the same rows on every run); only the bounded top n is kept."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(digest, F.col(key)).limit(n)

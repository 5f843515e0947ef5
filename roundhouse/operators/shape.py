"""Reshaping: two-sided unpivot (U1) and union of distinct columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def two_sided(df: DataFrame, sides: list[dict], keep: list[str] | tuple = ()) -> DataFrame:
    """One row per side of each input row.

    ``sides`` is a list of {output column: expression} dicts with the same keys,
    e.g. ``[{"team": "team_1", "rounds_won": "result_1"},
    {"team": "team_2", "rounds_won": "result_2"}]``. The reference writes this as
    a UNION ALL of two selects over the same join; here the join runs once and a
    generator emits the sides (one scan and one shuffle instead of two).
    """
    names = list(sides[0])
    structs = [F.struct(*[_c(s[n]).alias(n) for n in names]) for s in sides]
    return df.select(*[F.col(k) for k in keep], F.inline(F.array(*structs)))


def distinct_union(frames: list[DataFrame]) -> DataFrame:
    """UNION of several single-shape frames, duplicates removed.

    Each input is de-duplicated map-side by the final aggregate, so no frame is
    shuffled whole.
    """
    return reduce(DataFrame.union, frames).distinct()

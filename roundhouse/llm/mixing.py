"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Written

WEIGHTS = (5, 2, 1)
SHARE = 1.5        # of all sizes
LIMIT = 2.0        # times a source's size
SEED = 20240611
DP_BUDGET = 1 << 15  # words left to the dynamic programme, at least twice the longest document
BUCKETS = 4096       # seeded sub-buckets of the documents of one length


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each length to take so that the words come to ``budget``.

    Every length first gives its proportional share; lengths in seeded order
    give one more until little is left, and a bounded knapsack over the
    documents still free fills the rest exactly where a subset sum exists
    (else as far as one reaches below it).
    """
    sizes, counts = np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    total = int((sizes * counts).sum())
    budget = min(int(budget), total)
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget == total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((take * sizes).sum())
    order = np.random.default_rng(seed).permutation(len(sizes))
    room = max(DP_BUDGET, 2 * int(sizes.max()))
    for i in order:
        if left <= room:
            break
        if take[i] < counts[i] and sizes[i] <= left:
            take[i] += 1
            left -= int(sizes[i])
    # reach[s]: the piece by which s was first reached; a piece is 1, 2, 4.. documents of one length
    reach = np.full(left + 1, -1, dtype=np.int64)
    reach[0] = 0
    pieces: list[tuple[int, int]] = [(0, 0)]
    for i in order:
        free, k = int(counts[i] - take[i]), 1
        while free > 0 and reach[left] < 0 and sizes[i] > 0:
            k = min(k, free)
            w = k * int(sizes[i])
            if w > left:
                break
            new = np.flatnonzero((reach[:left + 1 - w] >= 0) & (reach[w:] < 0)) + w
            pieces.append((int(i), k))
            reach[new] = len(pieces) - 1
            free, k = free - k, 2 * k
        if reach[left] >= 0:
            break
    s = int(np.flatnonzero(reach >= 0)[-1])
    while s:
        i, k = pieces[reach[s]]
        take[i] += k
        s -= k * int(sizes[i])
    return take


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target per source.

    One row per source goes through two ordered windows: sources get their
    weights by code point order (null last); the shared level is where every
    source up to it is full (``limit`` times its size) and the others share
    the rest by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(limit)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_w", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    free = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    per = per.withColumn("_level", left / free)
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(
        (F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("l")))).over(every)["l"]
    return per.select("source", "source_size",
                      F.coalesce(F.least(level * F.col("_w"), F.col("_cap")), F.col("_cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT,
        seed: int = SEED, scratch: Written | None = None, keep: tuple = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies, source per document.

    Null texts have size 0, a null source is a source of its own, an empty
    table gives none. Rows that repeat a doc_id are mixed as rows of their own.
    ``limit`` may be up to 2: a source is taken as one whole pass if its target
    allows, the rest by documents chosen through ``fit_budget``. ``keep`` names
    further columns to carry along.
    """
    scratch = scratch or Written(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    bucket = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 52)
    sizes = scratch.put(docs.select("doc_id", "source", size.alias("size"), *keep)
                        .withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
                        .withColumn("_bucket", bucket)
                        .withColumn("_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "sizes")
    goal = (targets(sizes, weights, share, limit)
            .withColumn("_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source"))
    goal = goal.withColumn("_passes", F.when((F.col("target") >= F.col("source_size")) & (F.col("source_size") > 0), 1)
                           .otherwise(0))
    goal = goal.withColumn("_budget", F.round(F.col("target") - F.col("_passes") * F.col("source_size")).cast("long"))
    goal = scratch.put(goal, "goal")

    lengths = sizes.groupBy("_src", "size").agg(F.count(F.lit(1)).alias("n"))  # a row per source and length

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        return pdf.assign(take=fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(),
                                          int(pdf["_budget"].iloc[0]), seed))[["_src", "size", "take"]]

    chosen = scratch.put(lengths.join(goal.select("_src", "_budget"), "_src").groupBy("_src")
                         .applyInPandas(choose, "_src string, size long, take long"), "chosen")
    # the first `take` documents of each length in seeded order: whole sub-buckets, then ranks in one
    per = sizes.groupBy("_src", "size", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("_src", "size").orderBy("_bucket")
    cuts = (per.withColumn("_before", F.sum("n").over(upto) - F.col("n")).join(chosen, ["_src", "size"])
            .select("_src", "size", "_bucket", (F.col("take") - F.col("_before")).alias("_take"), "n"))
    rows = sizes.join(cuts, ["_src", "size", "_bucket"])
    rank = F.row_number().over(Window.partitionBy("_src", "size", "_bucket").orderBy("_h", "doc_id"))
    split = (F.col("_take") > 0) & (F.col("_take") < F.col("n"))
    cut = rows.filter(split).withColumn("_more", (rank <= F.col("_take")).cast("int"))
    whole = rows.filter(~split).withColumn("_more", (F.col("_take") > 0).cast("int"))
    return (whole.unionByName(cut).join(goal, "_src")
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * (F.col("_passes") + F.col("_more"))).alias("taken"),
                    (F.col("_passes") + F.col("_more")).alias("copies"), "source", *keep))


def apply(docs: DataFrame, scratch: Written | None = None, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (0, 1 or 2 times).

    Extra columns travel in one struct, whatever their names.
    """
    scratch = scratch or Written(docs.sparkSession, "mix")
    rows = scratch.put(docs.select(F.struct(*docs.columns).alias("u"), F.monotonically_increasing_id().alias("_row")),
                       "rows")  # fixes the row numbers
    plain = rows.select(*[F.col("u")[c].alias(c) for c in ("doc_id", "source", "text")], "_row")
    taken = mix(plain, scratch=scratch, keep=("_row",), **options).filter("copies > 0").select("_row", "copies")
    return (rows.join(taken, "_row").select("u", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*[F.col("u")[c].alias(c) for c in docs.columns]))

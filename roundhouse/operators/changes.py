"""Applying a change log of inserts, increments and deletes to a keyed table.

The reference's simulator inserts rows, adds to a counter of a random row and
deletes random rows. As a log, per key and in sequence order:

* insert(v): creates the row with value v when the key is absent, else ignored
* update(d): adds d when the row exists, else ignored
* delete:    removes the row

The log of a hot key is cut into time buckets. Within one (key, bucket) only the events after
the bucket's last delete count: the first insert there, the updates after it and
the sum of all updates. That takes aggregations and joins on (key, bucket),
so the events of a key with a third of the log are dealt over its buckets. What is
left, one summary per key and bucket, is folded in bucket order per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


DAY = 86_400
NUMBERS = 1 << 16    # sequence numbers of a bucket
HOT_EVENTS = 1_000_000
HOT_SHARE = 1_000    # a key is dealt over buckets if it has a thousandth of the log, too; so at most as many are


def time_bucket(log: DataFrame, column: str) -> Column:
    """Bucket of a sequence column: its day, or ``NUMBERS`` numbers."""
    kind = log.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        number = F.floor(F.col(column).cast("timestamp").cast("long") / DAY)
    else:
        number = F.floor(F.col(column) / NUMBERS).cast("long")
    return F.coalesce(number, F.lit(-(1 << 63)).cast("long"))  # no time: before all others


def hot_bucket(log: DataFrame, key: str, column: str, events: int = HOT_EVENTS, share: int = HOT_SHARE) -> Column:
    """``time_bucket`` for keys with more than ``events`` events and a ``share``-th of the log, one
    bucket for every other key, so that the log of a key with few events is combined map-side.

    The hot keys (fewer than ``share``) are a scalar subquery over counts per key.
    """
    counts = log.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    least = F.greatest(F.lit(events), counts.select(F.sum("_c") / share).scalar())
    hot = counts.filter(F.col("_c") > least).agg(F.collect_list("_k")).scalar()
    return F.when(F.array_contains(hot, F.col(key)), time_bucket(log, column)).otherwise(F.lit(0).cast("long"))


def apply_changes(log: DataFrame, key: str = "id", seq: tuple = ("ts", "seq"),
                  op: str = "op", value: str = "v", out: str = "value",
                  carry: tuple = (), bucket: Column | None = None) -> DataFrame:
    """Final (key, value, *carry) after the log; keys absent at the end are dropped.

    ``op`` holds 'insert', 'update' or 'delete'; ``seq`` columns give the order
    (compared as a tuple, so input order never matters). ``carry`` columns are
    set by the insert that created the row and not changed by updates (like
    a score stored on insert). ``bucket`` must not decrease with ``seq``
    (default: ``hot_bucket``, i.e. by the first of its columns for hot keys only); it bounds
    how much of one key's log meets in one task.
    """
    b = hot_bucket(log, key, seq[0]) if bucket is None else bucket
    return fold(summarise(log, key, seq, op, value, carry, b), key, out, carry)


def summarise(log: DataFrame, key: str, seq: tuple, op: str, value: str, carry: tuple, bucket: Column) -> DataFrame:
    """What each (key, bucket) of the log does: (_k, _b, reset, _ins, _all, _add).

    ``reset``: it deletes; ``_ins``: the first insert after its last delete; ``_all`` and
    ``_add``: sums of the updates after that delete and after that insert.
    """
    s = F.struct(*[F.col(c) for c in seq])
    ev = log.select(F.col(key).alias("_k"), bucket.alias("_b"), s.alias("_s"), F.col(op).alias("_op"),
                    F.col(value).alias("_v"), *[F.col(c) for c in carry]) \
        .filter(F.col("_op").isin("insert", "update", "delete"))
    chunk = ["_k", "_b"]
    last = ev.groupBy(*chunk).agg(F.max(F.when(F.col("_op") == "delete", F.col("_s"))).alias("_del"))
    after = (ev.filter(F.col("_op") != "delete").join(last.filter("_del IS NOT NULL"), chunk, "left")
             .filter(F.col("_del").isNull() | (F.col("_s") > F.col("_del"))))
    alive = after.groupBy(*chunk).agg(
        F.min(F.when(F.col("_op") == "insert", F.struct("_s", "_v", *carry))).alias("_ins"),
        F.sum(F.when(F.col("_op") == "update", F.col("_v"))).alias("_all"))
    opened = alive.filter("_ins IS NOT NULL").select(*chunk, F.col("_ins._s").alias("_at"))
    added = (after.filter(F.col("_op") == "update").join(opened, chunk).filter(F.col("_s") > F.col("_at"))
             .groupBy(*chunk).agg(F.sum("_v").alias("_add")))
    return last.join(alive, chunk, "left").join(added, chunk, "left").select(
        *chunk, F.col("_del").isNotNull().alias("reset"), "_ins", "_all", "_add")


def fold(chunks: DataFrame, key: str, out: str, carry: tuple = ()) -> DataFrame:
    """Each key's bucket summaries applied in order; one entry per bucket of a key."""
    number = chunks.schema["_all"].dataType
    kinds = {f.name: f.dataType for f in chunks.schema["_ins"].dataType}

    def row(present: Column, value: Column, kept: list[Column]) -> Column:
        return F.struct(present.alias("present"), value.cast(number).alias("value"),
                        *[x.cast(kinds[c]).alias(c) for x, c in zip(kept, carry)])

    def step(now: Column, c: Column) -> Column:
        stays = now["present"] & ~c["reset"]
        opens = c["_ins"].isNotNull()
        value = F.when(stays, now["value"] + F.coalesce(c["_all"], F.lit(0))).when(
            opens, c["_ins"]["_v"] + F.coalesce(c["_add"], F.lit(0)))
        return row(stays | opens, value, [F.when(stays, now[x]).when(opens, c["_ins"][x]) for x in carry])

    absent = row(F.lit(False), F.lit(None), [F.lit(None)] * len(carry))
    c = F.struct("_b", "reset", "_ins", "_all", "_add")
    return (chunks.groupBy("_k").agg(F.sort_array(F.collect_list(c)).alias("cs"))
            .select(F.col("_k").alias(key), F.aggregate("cs", absent, step).alias("_row"))
            .filter("_row.present")
            .select(key, F.col("_row.value").alias(out), *[F.col("_row")[x].alias(x) for x in carry]))

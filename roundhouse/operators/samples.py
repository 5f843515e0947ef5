"""Gauge samples: latest value, tumbling samples, availability, source fallback,
retention and the sample-and-hold (as-of) read of a scraper (W4-W8, J7).

Samples are long rows (ts, metric, value, ok). All operators group by metric
*and* time, or combine map-side, so a metric holding a third of the rows is
still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_ratio
from ..session import materialize


def _order(seq):
    return F.struct(*[F.col(c) for c in seq])


def latest_value(samples: DataFrame, keys=("metric",), seq=("ts",), value: str = "value") -> DataFrame:
    """Gauge `set`: the value with the greatest (seq) per key, and its time."""
    o = _order(seq)
    return samples.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(seq[0]).alias("ts"), F.col(value).alias("value")), o).alias("_l")
    ).select(*keys, "_l.ts", "_l.value")


def tumbling_last(samples: DataFrame, every: str, keys=("metric",), seq=("ts",),
                  value: str = "value", ts: str = "ts") -> DataFrame:
    """Last value and sample count per key and tumbling window of length ``every``."""
    w = F.window(F.col(ts), every)
    return (samples.groupBy(*keys, w.alias("w"))
            .agg(F.max_by(F.col(value), _order(seq)).alias("value"), F.count(F.lit(1)).alias("samples"))
            .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "value", "samples"))


def availability(samples: DataFrame, every: str, keys=("metric",), ok: str = "ok",
                 ts: str = "ts", scale: int = 4) -> DataFrame:
    """Share of successful polls per key and window, rounded to ``scale`` digits."""
    w = F.window(F.col(ts), every)
    return (samples.groupBy(*keys, w.alias("w"))
            .agg(F.sum(F.col(ok).cast("int")).alias("_ok"), F.count(F.lit(1)).alias("polls"))
            .select(*keys, F.col("w.start").alias("window_start"),
                    round_ratio("_ok", "polls", scale=scale).alias("availability"), "polls"))


def retain_recent(samples: DataFrame, keep: str = "7 days", ts: str = "ts") -> DataFrame:
    """Rows within ``keep`` of the newest sample (the store's retention)."""
    newest = samples.select(F.max(ts)).scalar()
    return samples.filter(F.col(ts) >= newest - F.expr(f"INTERVAL {keep}"))


def source_fallback(readings: DataFrame, poll: str = "poll", priority: str = "priority",
                    a: str = "usd", b: str = "eur", last_priority: int | None = None) -> DataFrame:
    """Per poll, the pair (a, b) of the first source (by priority) that has both.

    The last source must also give non-zero values. When no source qualifies
    the pair is (0.0, 0.0) with ok = 0 - the reference's failed-poll values.
    ``readings`` holds one row per (poll, source).
    """
    complete = F.col(a).isNotNull() & F.col(b).isNotNull()
    if last_priority is not None:
        nonzero = (F.col(a) != 0) & (F.col(b) != 0)
        complete = complete & ((F.col(priority) != last_priority) | nonzero)
    best = readings.groupBy(poll).agg(
        F.min(F.when(complete, F.struct(F.col(priority).alias("p"), F.col(a).alias("a"),
                                        F.col(b).alias("b")))).alias("_best"))
    found = F.col("_best").isNotNull()
    return best.select(
        poll,
        F.col("_best.p").alias("source"),
        F.coalesce(F.col("_best.a"), F.lit(0.0)).alias(a),
        F.coalesce(F.col("_best.b"), F.lit(0.0)).alias(b),
        found.cast("int").alias("ok"),
    )


def forward_fill(df: DataFrame, keys: list[str], order: str, value: str, chunk: str) -> DataFrame:
    """last(value, ignorenulls) in ``order`` per ``keys``, computed as a two-level scan.

    Rows are filled inside (keys, chunk) groups first; each chunk's carry-in is
    the last value of the earlier chunks, found by a window over one row per
    chunk. No task ever sorts more than one chunk of one key.
    """
    v = F.col(value)
    within = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumn("_fill", F.last(v, ignorenulls=True).over(within))
    tails = df.groupBy(*keys, chunk).agg(
        F.max(F.when(v.isNotNull(), F.struct(F.col(order).alias("o"), v.alias("v")))).alias("_t"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, chunk, F.last(F.col("_t.v"), ignorenulls=True).over(before).alias("_carry"))
    out = filled.join(carry, [*keys, chunk], "left")
    return out.withColumn(value, F.coalesce(F.col("_fill"), F.col("_carry"))).drop("_fill", "_carry")


def asof_sample(samples: DataFrame, every_seconds: int, keys=("metric",), seq=("ts",),
                value: str = "value", ts: str = "ts", chunk_ticks: int = 4096) -> DataFrame:
    """Sample-and-hold read on a regular tick grid (a scraper reading gauges).

    For every key and every tick t of the grid (multiples of ``every_seconds``
    since the epoch) between the key's first sample and the last sample
    overall, the latest sample with ts <= t (a sample exactly at a tick
    counts for it). Samples are first reduced to the latest one per (key,
    tick) - a map-side aggregate - then ticks without samples take the
    previous tick's value by the two-level forward fill. The reduced samples are
    written once, as the bounds, the grid and the fill all read them. The grid is built
    chunk by chunk, so no row expands into more than ``chunk_ticks`` ticks.
    """
    keys = list(keys)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    step = every_seconds * 1_000_000
    span = step * chunk_ticks
    tick = micros + F.pmod(-micros, F.lit(step))  # first tick >= ts (exact for any sign)
    per_tick = materialize(samples.withColumn("_tick", tick).groupBy(*keys, "_tick")
                           .agg(F.max_by(F.struct(F.col(ts).alias("sample_ts"), F.col(value).alias("value")),
                                         _order(seq)).alias("_st")), "ticks")
    last_tick = per_tick.select(F.max("_tick")).scalar()
    first = per_tick.groupBy(*keys).agg(F.min("_tick").alias("_from"))
    # floor(c / span): c - pmod(c, span) is an exact multiple of span for any sign
    chunk_of = lambda c: F.call_function("div", c - F.pmod(c, F.lit(span)), F.lit(span))
    chunks = first.select(*keys, "_from", F.explode(
        F.sequence(chunk_of(F.col("_from")), chunk_of(last_tick))).alias("_chunk"))
    lo = F.greatest(F.col("_from"), F.col("_chunk") * span)
    lo = lo + F.pmod(-lo, F.lit(step))
    hi = F.least(last_tick, F.col("_chunk") * span + (span - 1))
    grid = chunks.select(*keys, "_chunk", F.explode(F.sequence(lo, hi, F.lit(step))).alias("_tick"))
    g = grid.join(per_tick, [*keys, "_tick"], "left")
    filled = forward_fill(g, keys, "_tick", "_st", "_chunk")
    return filled.select(*keys, F.timestamp_micros("_tick").cast("timestamp_ntz").alias("tick"),
                         F.col("_st.sample_ts").alias("sample_ts"), F.col("_st.value").alias("value"))

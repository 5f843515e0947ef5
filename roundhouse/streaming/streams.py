"""Structured Streaming forms of the live operators.

The reference's live parts are loops that insert a row, sleep and repeat.
Here they are streaming queries over a file source. Sinks use
``foreachBatch`` and write every micro-batch once into its own committed folder
(``tables``), so the tables are exactly-once without a transactional table
format. Readers take the newest version of each key. State is kept in RocksDB with
changelog checkpoints: what a batch uploads is what it changed.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import DAY, time_bucket
from ..session import scratch_path
from ..sources.dated import retain_stored, write_dated
from .state import ChangeLog, Fallback, FirstRow, HoldSamples
from .tables import compact as compact_batches
from .tables import Folder, claim, latest_rows, read_batches, write_batch


def event_stream(spark: SparkSession, folder: str, table: str = "events",
                 files_per_batch: int | None = None) -> DataFrame:
    """Streaming read of a table with the batch table's schema.

    The table is a folder of part files (``<folder>/<table>.parquet/`` or
    ``<folder>/<table>/``) or, failing that, the files ``<folder>/<table>*.parquet``.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [p for p in (f"{folder}/{table}.parquet", f"{folder}/{table}") if fs.isDirectory(path(p))]
    options = {} if whole else {"pathGlobFilter": f"{table}*.parquet"}
    source = whole[0] if whole else folder
    schema = spark.read.options(**options).parquet(source).schema
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(source)


def run_available(query_builder, name: str, trigger_every: str | None = None):
    """Run a streaming query.

    Without ``trigger_every``: the availableNow trigger, waiting until the input
    present at the start is consumed (batch-like runs, tests). With it (e.g.
    "5 seconds"): a processing-time trigger, and the running query is returned
    for the caller to monitor and stop (the live form).
    """
    if trigger_every:
        return query_builder.trigger(processingTime=trigger_every).queryName(name).start()
    q = query_builder.trigger(availableNow=True).queryName(name).start()
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover - surfaced to the caller
        raise RuntimeError(str(q.exception()))
    return q


ROWS_PER_FILE = 1_000_000


# state outside the JVM heap, of which each batch checkpoints its changes only
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own settings come back."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_stateful(df: DataFrame, target: str, checkpoint: str, name: str, mode: str = "update",
                 trigger_every: str | None = None, sink=None):
    """``run_available`` of a query with state, in RocksDB, whose batches go to ``target``."""
    sink = sink or _batch_writer(target)
    claim(df.sparkSession, target, checkpoint)
    with rocksdb_state(df.sparkSession):
        return run_available(df.writeStream.outputMode(mode).foreachBatch(sink)
                             .option("checkpointLocation", checkpoint), f"{name}_{uuid.uuid4().hex[:8]}",
                             trigger_every)


def state_size(query) -> dict[str, int]:
    """Rows and bytes that the query's state operators held after its last batch with state."""
    for progress in reversed(query.recentProgress):
        if progress["stateOperators"]:
            ops = progress["stateOperators"]
            return {"rows": sum(o["numRowsTotal"] for o in ops), "bytes": sum(o["memoryUsedBytes"] for o in ops)}
    return {"rows": 0, "bytes": 0}


def _batch_writer(target: str, rows_per_file: int = ROWS_PER_FILE, sized: bool = True):
    """Writer of one micro-batch into ``target/batch_id=<n>`` (see ``tables``).

    AQE does not coalesce inside ``foreachBatch``, so a batch of a stateful
    query would otherwise write one small file per state partition. The batch
    is persisted (the pattern for using a micro-batch twice), counted, and
    written as ceil(rows / rows_per_file) files. ``sized=False`` writes the
    batch as it comes (one file per non-empty partition).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if not sized:
            write_batch(batch, target, batch_id)
            return
        batch.persist()
        try:
            files = max(1, -(-batch.count() // rows_per_file))
            write_batch(batch.repartition(files), target, batch_id)
        finally:
            batch.unpersist()
    return write


def latest_versions(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The newest committed row of each key (versions are ordered by batch id)."""
    df = read_batches(spark, target)
    if df is None:
        raise FileNotFoundError(f"{target} has no committed batch")
    return latest_rows(df, keys)


def compact(spark: SparkSession, target: str, keys: list[str]) -> None:
    """Fold all batches of a versioned table into one folder of its newest rows."""
    compact_batches(spark, target, lambda df: latest_rows(df, keys))


def stream_insert_ignore(stream: DataFrame, keys: list[str], columns: list[str],
                         target: str, checkpoint: str, trigger_every: str | None = None,
                         stored: DataFrame | None = None, horizon: str | None = None, ts: str = "ts"):
    """Continuous INSERT ... ON CONFLICT (keys) DO NOTHING into the Parquet table ``target``.

    Keys that ``stored`` (e.g. a table that the ETL loaded) holds when the stream
    first starts are not inserted again: they are written beside the table once and
    enter the state with the first batch, so no later batch reads them.

    The state remembers, per key, the smallest (batch time, row): the batch time is
    the micro-batch timestamp (recorded in the offset log, so a replay sees the same
    value), hence the first batch that brought a key wins and, inside it, the smallest
    row. Update mode hands each batch only the keys it touched; nothing rescans the
    target. The streaming aggregate is combined map-side, so a hot key is one state
    row, not one big task. As in a SQL unique constraint a key with a null part never
    conflicts: such rows are all inserted and need no state.

    Without ``horizon`` keys are remembered for ever and the result is exact. With it
    (an interval such as "7 days") a key is forgotten once event time ``ts`` is that far
    past its last row, which bounds the state; a later row of the key is inserted
    anew, and rows older than the horizon are dropped. ``stored`` needs ``ts`` then.

    Spark 4.1 cannot re-plan (count, persist, repartition) a micro-batch of this
    min(struct) aggregate inside ``foreachBatch``, so its batches are written as they
    come: one file per state partition that has updates.
    """
    spark, rest = stream.sparkSession, [c for c in columns if c not in keys]
    null_part = F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True)
    rows = stream.select(*columns)
    keyed = rows.filter(~null_part).select(*keys, *rest, F.lit(False).alias("_stored"))
    if stored is not None:
        kept = [*keys, *([ts] if horizon and ts not in keys else [])]
        path = f"{target}/_stored"
        if not Folder(spark, target).names("_stored/_SUCCESS"):
            stored.select(*kept).filter(~null_part).distinct().write.mode("overwrite").parquet(path)
        known = spark.readStream.schema(stored.select(*kept).schema).parquet(path)
        types = dict(rows.dtypes)
        keyed = keyed.unionByName(known.select(
            *keys, *[(F.col(c) if c in kept else F.lit(None)).cast(types[c]).alias(c) for c in rest],
            F.lit(True).alias("_stored")))
    row = F.struct((~F.col("_stored")).alias("_live"), *rest)
    if horizon:
        timed = keyed.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", horizon)
        grouped = timed.select(*keys, "_t", row.alias("_r")).groupBy(*keys)
        schema = T.StructType([f for f in timed.schema.fields if f.name in keys]
                              + [T.StructField("_r", timed.select(row.alias("_r")).schema["_r"].dataType)])
        out = grouped.transformWithState(FirstRow(keys), schema, "Update", "EventTime")
        out = out.filter("_r._live").select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
    else:
        row = F.struct((~F.col("_stored")).alias("_live"), F.current_timestamp().alias("_arrival"), *rest)
        agg = keyed.select(*keys, row.alias("_r")).groupBy(*keys).agg(F.min("_r").alias("_r"))
        out = agg.filter("_r._live").select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
    out = out.select(*columns).unionByName(rows.filter(null_part))
    return run_stateful(out, target, checkpoint, "insert_ignore", trigger_every=trigger_every,
                        sink=_batch_writer(target, sized=False))


def stream_window_counts(stream: DataFrame, every: str, keys: list[str], ts: str,
                         seq: list[str], value: str, target: str, checkpoint: str,
                         watermark: str | None = None, trigger_every: str | None = None):
    """Tumbling-window count and last value per key, kept current.

    Update mode emits only the windows a batch changed. Without ``watermark``
    every row counts, however late; with one, windows older than it leave the
    state store and later rows are dropped. Each emitted version is written by
    batch id.
    """
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp"))
    agg = ((timed.withWatermark("_t", watermark) if watermark else timed)
           .groupBy(*keys, F.window("_t", every).alias("w"))
           .agg(F.count(F.lit(1)).alias("samples"),
                F.max_by(F.col(value), F.struct(*[F.col(c) for c in seq])).alias("value")))
    out = agg.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("w.end").cast("timestamp_ntz").alias("window_end"), "samples", "value")
    return run_stateful(out, target, checkpoint, "window_counts", trigger_every=trigger_every)


def stream_standings(results_stream: DataFrame, matches: DataFrame, target: str,
                     checkpoint: str, trigger_every: str | None = None):
    """Live standings: result rows won per team, kept current.

    New result rows arrive as a stream and are joined with the static
    matches table (a stream-static join: AQE broadcasts a small static side,
    otherwise it is shuffled by match id); the count per team is a streaming
    aggregate in update mode, so each batch writes only the teams it changed.
    """
    from ..functions.scalars import side_winner
    j = results_stream.join(matches.select("match_id", "team_1", "team_2"), "match_id")
    won = j.select(side_winner("match_winner").alias("team")).filter(F.col("team").isNotNull())
    agg = won.groupBy("team").agg(F.count(F.lit(1)).alias("wins"))
    return run_stateful(agg, target, checkpoint, "standings", trigger_every=trigger_every)


def stream_standings_live(results_stream: DataFrame, matches_stream: DataFrame, target: str,
                          checkpoint: str, trigger_every: str | None = None, horizon: str | None = None,
                          result_ts: str = "ts", match_ts: str = "ts"):
    """Live standings when the matches arrive live, too (W2): read them with ``standings``.

    A stream-stream join: both sides are kept in state, so a result counts whether it
    comes before, with or after its match. A match id that is inserted again is
    ignored (the first one stays). Both sides are dealt by match id. Each batch writes
    the wins it adds per team (counted map-side); the standings are their sums, so a
    batch costs its own rows, and ``compact_standings`` folds what has been written.

    Without ``horizon`` both sides are kept for ever and the result is the batch answer.
    With it, a result counts if its ``result_ts`` lies within the horizon of its match's
    ``match_ts``; older state is dropped and rows later than that are ignored.
    Null match ids join nothing. Without ``horizon`` the state holds a row per match and winner
    with the number of its results in a batch (of a part of the batch, where one match has very
    many), and none of results without a winner.
    """
    from ..functions.scalars import side_winner
    columns = ["match_id", "team_1", "team_2"]
    if horizon:
        matches = (matches_stream.withColumn("_m", F.col(match_ts).cast("timestamp")).withWatermark("_m", horizon)
                   .select(*columns, "_m").filter("match_id IS NOT NULL").dropDuplicatesWithinWatermark(["match_id"]))
        results = (results_stream.withColumn("_w", F.col(result_ts).cast("timestamp")).withWatermark("_w", horizon)
                   .select(F.col("match_id").alias("_id"), "match_winner", "_w", F.lit(1).cast("long").alias("n")))
        near = F.expr(f"_id = match_id AND _w BETWEEN _m - INTERVAL {horizon} AND _m + INTERVAL {horizon}")
        joined = results.join(matches, near)
    else:
        matches = matches_stream.select(*columns).filter("match_id IS NOT NULL").dropDuplicates(["match_id"])
        joined = _decided(results_stream).join(matches, "match_id")
    won = joined.select(side_winner("match_winner").alias("team"), "n").filter(F.col("team").isNotNull())

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.groupBy("team").agg(F.sum("n").alias("wins")).coalesce(1), target, batch_id)

    return run_stateful(won, target, checkpoint, "standings_live", "append", trigger_every, sink)


def _decided(results: DataFrame) -> DataFrame:
    """(match_id, match_winner, n): results that can count, counted per match and winner of a batch.

    A streaming aggregate would keep state of its own; here the rows of a batch are dealt by
    match and counted where they lie, a million at a time.
    """
    keys = ["match_id", "match_winner"]
    rows = results.select(*keys).filter(F.col("match_id").isNotNull() & F.col("match_winner").isin(1, 2))
    schema = T.StructType([*rows.schema.fields, T.StructField("n", T.LongType())])

    def count(batches):
        import pyarrow as pa

        def counted():
            found = pa.Table.from_batches(held).group_by(keys).aggregate([([], "count_all")])
            return found.rename_columns([*keys, "n"]).combine_chunks().to_batches()

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS_PER_FILE:
                yield from counted()
                held, size = [], 0
        if size:
            yield from counted()

    return rows.repartition("match_id").mapInArrow(count, schema)


def standings(spark: SparkSession, target: str) -> DataFrame:
    """(team, wins) so far of a ``stream_standings_live`` table."""
    return _wins(read_batches(spark, target))


def compact_standings(spark: SparkSession, target: str) -> None:
    compact_batches(spark, target, _wins)


def _wins(added: DataFrame) -> DataFrame:
    return added.groupBy("team").agg(F.sum("wins").alias("wins"))


def stream_apply_changes(stream: DataFrame, key: str, seq: tuple, op: str, value: str,
                         state_target: str, checkpoint: str, out: str = "value",
                         horizon: str | None = None, trigger_every: str | None = None):
    """Keep the change-log state current (W3): (key, value, present), a version per touched key.

    State per key (``ChangeLog``): its events since its last delete, cut into the
    buckets of ``time_bucket``, with the row as it stood before each bucket, and the row
    now. A batch in time order reads and writes the newest bucket of its keys, whatever
    has been before; a late event is put into its bucket and only the buckets from
    there on are folded again. So a batch costs its own events, and the log itself
    is not stored. All events of one key are folded by one task, one after another.

    Without ``horizon`` every late event counts, as in ``apply_changes``. With it, buckets
    older than the horizon before the newest event are reduced to the row they leave,
    and events later than that are ignored, which bounds the state by the keys.
    """
    number = stream.groupBy().agg(F.sum(value).alias("s")).schema["s"].dataType
    events = stream.filter(F.col(op).isin("insert", "update", "delete")).select(
        F.col(key).alias("_k"), time_bucket(stream, seq[0]).alias("_b"), F.struct(*[F.col(c) for c in seq]).alias("_s"),
        F.col(op).alias("_op"), F.col(value).cast(number).alias("_v"),
        *([F.col(seq[0]).cast("timestamp").alias("_t")] if horizon else []))
    if horizon:
        events = events.withWatermark("_t", horizon)
    schema = T.StructType([T.StructField("_k", stream.schema[key].dataType), T.StructField("value", number),
                           T.StructField("present", T.BooleanType())])
    rows = events.groupBy("_k").transformWithState(
        ChangeLog(day=DAY if horizon else None), schema, "Update", "EventTime" if horizon else "None")
    rows = rows.select(F.col("_k").alias(key), F.col("value").alias(out), "present")
    return run_stateful(rows, state_target, checkpoint, "apply_changes", trigger_every=trigger_every)


def stream_asof(samples: DataFrame, every_seconds: int, target: str, checkpoint: str, delay: str = "0 seconds",
                key: str = "metric", ts: str = "ts", seq: tuple = ("ts",), value: str = "value",
                trigger_every: str | None = None):
    """Sample-and-hold read as a stream (J7): read it with ``held_ticks``.

    Timers on event time (``HoldSamples``) emit the held value of a gauge at every tick
    that the watermark (newest sample - ``delay``) has passed, with or without a new
    sample. Ticks are final: samples later than the watermark are dropped by Spark.
    A row of the table is a run of ticks that show one sample, so its size follows the
    samples, not the ticks. State per gauge: its held sample and those after it.
    A sample without a time or key is ignored.
    """
    timed = (samples.filter(F.col(ts).isNotNull() & F.col(key).isNotNull())
             .withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", delay))
    order = F.struct(F.unix_micros("_t").alias("us"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(seq)])
    rows = timed.select(F.col(key).alias("_k"), "_t", order.alias("_s"), F.col(value).cast("double").alias("_v"))
    schema = T.StructType([T.StructField("_k", samples.schema[key].dataType), T.StructField("first_tick", T.LongType()),
                           T.StructField("last_tick", T.LongType()), T.StructField("sample_us", T.LongType()),
                           T.StructField("value", T.DoubleType())])
    runs = rows.groupBy("_k").transformWithState(HoldSamples(every_seconds * 1_000_000), schema, "Append", "EventTime")
    runs = runs.withColumnRenamed("_k", key).withColumn("step", F.lit(every_seconds * 1_000_000).cast("long"))
    return run_stateful(runs, target, checkpoint, "asof", "append", trigger_every)


def held_ticks(spark: SparkSession, target: str, key: str = "metric") -> DataFrame:
    """(key, tick, sample_ts, value): the ticks of a ``stream_asof`` table."""
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return read_batches(spark, target).select(
        key, F.explode(F.sequence("first_tick", "last_tick", "step")).alias("_tick"), "sample_us", "value").select(
        key, at("_tick").alias("tick"), at("sample_us").alias("sample_ts"), "value")


def stream_fallback(readings: DataFrame, target: str, checkpoint: str, deadline: str, poll: str = "poll",
                    priority: str = "priority", a: str = "usd", b: str = "eur", seq: tuple = (),
                    last_priority: int | None = None, trigger_every: str | None = None):
    """Ordered source fallback with a deadline (W7): one row per poll, as ``source_fallback``.

    Rows are readings of a source for a poll (``priority`` null: the poll began, no source
    answered yet); of several readings of a source the first by ``seq`` counts. A
    timer per poll (``Fallback``) fires once event time is ``deadline`` past it and emits the
    pair of the first source that has both values, or (0.0, 0.0) with ok = 0. The order of
    arrival within the deadline does not matter; later readings are ignored.
    State: the polls still open. Polls without a time are ignored.
    """
    timed = (readings.filter(F.col(poll).isNotNull()).withColumn("_t", F.col(poll).cast("timestamp"))
             .withWatermark("_t", deadline))
    complete = F.col(a).isNotNull() & F.col(b).isNotNull()
    if last_priority is not None:
        complete &= (F.col(priority) != last_priority) | ((F.col(a) != 0) & (F.col(b) != 0))
    order = F.struct(*[F.col(c).alias(f"s{i}") for i, c in enumerate(seq)], F.lit(0).alias("_"))
    rows = timed.select(F.unix_micros("_t").alias("_k"), "_t", F.col(priority).cast("int").alias("p"), order.alias("_s"),
                        F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"),
                        F.coalesce(complete, F.lit(False)).alias("whole"))
    found = rows.groupBy("_k").transformWithState(
        Fallback(), "_k long, source int, a double, b double, ok int", "Append", "EventTime")
    found = found.select(F.timestamp_micros("_k").cast(readings.schema[poll].dataType).alias(poll), "source", F.col("a").alias(a),
                         F.col("b").alias(b), "ok")
    return run_stateful(found, target, checkpoint, "fallback", "append", trigger_every)


def stream_retained(samples: DataFrame, target: str, checkpoint: str, keep: str = "7 days", ts: str = "ts",
                    trigger_every: str | None = None):
    """A store of samples that frees what has expired (W8): read it with ``read_retained``.

    Every batch goes into folders by day and batch number, whole days outside ``keep`` of
    the newest one are removed with their files (``retain_stored``). A replayed batch
    replaces its own folders.
    """
    spark = samples.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        write_dated(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), target, ts, ["batch_id"])
        retain_stored(spark, target, keep)

    return run_available(samples.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint),
                         f"retained_{uuid.uuid4().hex[:8]}", trigger_every)


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new (target, checkpoint) pair below the shared checkpoint folder."""
    run = f"{name}-{uuid.uuid4().hex}"
    return scratch_path(spark, "streams", run, "table"), scratch_path(spark, "streams", run, "checkpoint")

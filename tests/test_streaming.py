"""Streaming forms over several micro-batches equal their batch forms."""

import datetime as dt
import os
import random

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from conftest import SF_SMALL, rows
from roundhouse.operators import changes as C
from roundhouse.plans import adapters as A
from roundhouse.streaming import streams as ST
from roundhouse.streaming import tables as TB


@pytest.fixture(scope="module")
def split_events(tmp_path_factory):
    """The events table cut by time into three files -> three micro-batches."""
    folder = tmp_path_factory.mktemp("events_split")
    t = pq.read_table(f"{SF_SMALL}/events.parquet").sort_by("ts")
    n = t.num_rows
    for i, (a, b) in enumerate([(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)]):
        pq.write_table(t.slice(a, b - a), str(folder / f"events_{i}.parquet"))
    return str(folder), t


def test_stream_apply_changes_three_batches(spark, split_events):
    folder, _ = split_events
    state_t, ckpt = ST.fresh_paths(spark, "t_state")
    stream = A.change_log_rows(ST.event_stream(spark, folder, files_per_batch=1))
    ST.stream_apply_changes(stream, "id", ("ts", "seq"), "op", "v", state_t, ckpt, out="kills")
    assert TB.committed(spark, state_t) == (None, [0, 1, 2])
    state = ST.latest_versions(spark, state_t, ["id"]).filter("present").select("id", "kills")
    batch = spark.read.parquet(f"{folder}/events_*.parquet")
    want = C.apply_changes(A.change_log_rows(batch), key="id", seq=("ts", "seq"), out="kills")
    assert sorted(rows(state)) == sorted(rows(want))


def test_stream_insert_ignore_first_batch_wins(spark, split_events):
    folder, table = split_events
    target, ckpt = ST.fresh_paths(spark, "t_ins")
    cols = ["user_id", "event_type", "ts", "event_id", "value"]
    ST.stream_insert_ignore(ST.event_stream(spark, folder, files_per_batch=1), ["user_id", "event_type"],
                            cols, target, ckpt)
    got = ST.latest_versions(spark, target, ["user_id", "event_type"])
    # files are cut by time, so first arrival == earliest event of each key
    batch = spark.read.parquet(f"{folder}/events_*.parquet")
    from roundhouse.operators.etl import dedupe_by_key
    want = dedupe_by_key(batch.select(*cols), ["user_id", "event_type"])
    assert sorted(rows(got.select(*cols))) == sorted(rows(want))
    assert got.count() == got.select("user_id", "event_type").distinct().count()


def test_stream_window_counts_three_batches(spark, split_events):
    folder, table = split_events
    target, ckpt = ST.fresh_paths(spark, "t_win")
    stream = ST.event_stream(spark, folder, files_per_batch=1).withColumnRenamed("event_type", "metric")
    ST.stream_window_counts(stream, "1 day", ["metric"], "ts", ["ts", "event_id"], "value", target, ckpt)
    got = ST.latest_versions(spark, target, ["metric", "window_start"])
    assert got.agg({"samples": "sum"}).first()[0] == table.num_rows
    assert got.count() == len(set(zip(table["event_type"].to_pylist(),
                                       pc.strftime(table["ts"], "%Y-%m-%d").to_pylist())))


def test_stream_standings_three_batches(spark, tmp_path):
    from roundhouse.plans.catalog import Tables
    from roundhouse.plans import queries as Q
    folder = tmp_path / "lines"
    folder.mkdir()
    t = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    n = t.num_rows
    for i, (a, b) in enumerate([(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)]):
        pq.write_table(t.slice(a, b - a), str(folder / f"lineitem_{i}.parquet"))
    tabs = Tables(spark, SF_SMALL)
    target, ckpt = ST.fresh_paths(spark, "t_standings")
    lines = ST.event_stream(spark, str(folder), table="lineitem", files_per_batch=1)
    ST.stream_standings(A.results_of_lines(lines, tabs.src), tabs.m, target, ckpt)
    got = sorted(rows(ST.latest_versions(spark, target, ["team"])))
    j = tabs.rc.join(tabs.m.select("match_id", "team_1", "team_2"), "match_id")
    from roundhouse.functions.scalars import side_winner
    batch = (j.select(side_winner("match_winner").alias("team")).filter("team IS NOT NULL")
             .groupBy("team").count())
    assert got == sorted(rows(batch))
    versions = spark.read.option("basePath", target).parquet(f"{target}/batch_id=*")
    assert versions.select("batch_id").distinct().count() == 3


def test_live_standings_pick_up_new_files(spark, tmp_path):
    """The live form: a running query sees files that arrive later."""
    from roundhouse.functions.scalars import side_winner
    from roundhouse.plans.catalog import Tables
    folder = tmp_path / "live"
    folder.mkdir()
    t = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    half = t.num_rows // 2
    pq.write_table(t.slice(0, half), str(folder / "lineitem_0.parquet"))
    tabs = Tables(spark, SF_SMALL)
    target, ckpt = ST.fresh_paths(spark, "t_live")
    lines = ST.event_stream(spark, str(folder), table="lineitem")
    q = ST.stream_standings(A.results_of_lines(lines, tabs.src), tabs.m, target, ckpt,
                            trigger_every="1 second")
    try:
        q.processAllAvailable()
        # arrive atomically: write under a name the source ignores, then rename
        pq.write_table(t.slice(half), str(folder / "_incoming.tmp"))
        os.replace(folder / "_incoming.tmp", folder / "lineitem_1.parquet")
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(rows(ST.latest_versions(spark, target, ["team"])))
    j = tabs.rc.join(tabs.m.select("match_id", "team_1", "team_2"), "match_id")
    batch = (j.select(side_winner("match_winner").alias("team")).filter("team IS NOT NULL")
             .groupBy("team").count())
    assert got == sorted(rows(batch))


def test_event_stream_reads_a_folder_of_part_files(spark, tmp_path):
    from roundhouse.streaming.streams import event_stream, run_available
    spark.range(100).selectExpr("id", "id % 3 AS k").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(5).selectExpr("id", "id AS k").write.parquet(f"{tmp_path}/events_old.parquet")
    seen = []
    run_available(event_stream(spark, str(tmp_path)).writeStream.foreachBatch(
        lambda df, i: seen.append(df.count())).option("checkpointLocation", f"{tmp_path}/c"), "folder_stream")
    assert sum(seen) == 100


def test_stored_keys_are_not_inserted_again(spark, split_events):
    folder, _ = split_events
    events = spark.read.parquet(f"{folder}/events_*.parquet")
    stored = events.filter("user_id % 3 = 0")
    target, ckpt = ST.fresh_paths(spark, "t_stored")
    keys = ["user_id", "event_type"]
    ST.stream_insert_ignore(ST.event_stream(spark, folder, files_per_batch=1), keys, keys + ["ts"],
                            target, ckpt, stored=stored)
    got = ST.latest_versions(spark, target, keys)
    want = events.select(*keys).distinct().join(stored.select(*keys).distinct(), keys, "left_anti")
    assert sorted(rows(got.select(*keys))) == sorted(rows(want))


def put(spark, folder, name, rows, schema):
    """One file of a stream's source, by name (each file is a batch of its own)."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/_{name}")
    part = next(p for p in os.listdir(f"{folder}/_{name}") if p.startswith("part-"))
    os.replace(f"{folder}/_{name}/{part}", f"{folder}/{name}.parquet")


def files(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


LOG = "id long, ts timestamp_ntz, seq int, op string, v int"
AT = dt.datetime(2024, 1, 1)


def log_of(rnd, n, keys=6, days=12):
    ops = ["insert", "update", "update", "update", "delete"]
    return [(rnd.randrange(keys), AT + dt.timedelta(hours=rnd.randrange(24 * days)), i, rnd.choice(ops),
             rnd.choice([None, *range(9)])) for i in range(n)]


def test_change_log_in_any_order_of_arrival(spark, tmp_path):
    """Events late by days, over a restart: after every run the batch answer of what has come."""
    rnd = random.Random(11)
    log = log_of(rnd, 240)
    log += [(9, AT, 1, op, 5) for op in ("delete", "insert", "update")]      # one sequence value
    rnd.shuffle(log)
    target, ckpt = ST.fresh_paths(spark, "t_any")
    seen = []
    for part in range(4):
        rows_ = log[part::4]
        seen += rows_
        put(spark, tmp_path, f"log_{part}", rows_, LOG)
        ST.stream_apply_changes(files(spark, tmp_path, LOG), "id", ("ts", "seq"), "op", "v", target, ckpt, out="n")
        state = ST.latest_versions(spark, target, ["id"]).filter("present").select("id", "n")
        want = C.apply_changes(spark.createDataFrame(seen, LOG), key="id", seq=("ts", "seq"), out="n")
        assert sorted(rows(state), key=repr) == sorted(rows(want), key=repr)


def test_change_log_reads_only_its_batch(spark, tmp_path):
    """Ten days as ten batches: a batch reads its own rows and writes its keys' newest
    bucket, whatever came before; with a horizon the state does not grow with the days."""
    sizes = {}
    for day in range(10):
        at = lambda h: AT + dt.timedelta(days=day, hours=h)
        put(spark, tmp_path, f"log_{day:02}", [
            (0, at(0), 0, "insert", day), (0, at(1), 1, "update", 1), (0, at(2), 2, "update", 2),
            (day, at(3), 3, "insert", 3), (day, at(4), 4, "update", 4), (0, at(5), 5, "insert", 5)], LOG)
    for horizon in (None, "2 days"):
        target, ckpt = ST.fresh_paths(spark, "t_days")
        q = ST.stream_apply_changes(files(spark, tmp_path, LOG), "id", ("ts", "seq"), "op", "v", target, ckpt,
                                    out="n", horizon=horizon)
        done = [p for p in q.recentProgress if p["numInputRows"]]
        assert len(done) == 10 and {p["numInputRows"] for p in done} == {6}
        assert max(p["stateOperators"][0]["numRowsUpdated"] for p in done) <= 6
        state = ST.latest_versions(spark, target, ["id"]).filter("present").select("id", "n")
        want = C.apply_changes(spark.read.parquet(*[f"{tmp_path}/log_{d:02}.parquet" for d in range(10)]), key="id",
                               seq=("ts", "seq"), out="n")
        assert sorted(rows(state)) == sorted(rows(want))
        sizes[horizon] = ST.state_size(q)["rows"]
    assert sizes["2 days"] < sizes[None]


def test_replay_of_a_compacted_batch_keeps_all_rows(spark, tmp_path):
    """The stream restarts before it noted batch 1 as done and hands it over again."""
    t = f"{tmp_path}/t"
    frame = lambda *r: spark.createDataFrame(list(r), "k int, v int")
    write = ST._batch_writer(t)
    write(frame((1, 10), (3, 5)), 0)
    write(frame((2, 20), (3, 6)), 1)
    ST.compact(spark, t, ["k"])
    write(frame((2, 20), (3, 6)), 1)
    assert sorted(rows(ST.latest_versions(spark, t, ["k"]), "k", "v")) == [(1, 10), (2, 20), (3, 6)]
    write(frame((1, 11)), 2)
    assert sorted(rows(ST.latest_versions(spark, t, ["k"]), "k", "v")) == [(1, 11), (2, 20), (3, 6)]
    assert sorted(os.listdir(t)) == ["_commits", "batch_id=2", "compacted=1"]


def test_a_crash_at_any_step_leaves_the_table_readable(spark, tmp_path, monkeypatch):
    """Every file operation of a batch and of a compaction breaks off once; the rows stay."""
    frame = lambda *r: spark.createDataFrame(list(r), "k int, v int")
    mark, remove, crashes = TB.Folder.mark, TB.Folder.remove, 0
    for step in range(20):
        t = f"{tmp_path}/t{step}"
        for i in range(3):
            TB.write_batch(frame((1, i), (10 + i, i)), t, i)
        left = [step]

        def breaks(plain):
            def run(self, name):
                if left[0] == 0:
                    raise OSError("lost")
                left[0] -= 1
                return plain(self, name)
            return run

        monkeypatch.setattr(TB.Folder, "mark", breaks(mark))
        monkeypatch.setattr(TB.Folder, "remove", breaks(remove))
        want, broke = [(1, 2), (10, 0), (11, 1), (12, 2)], False
        try:
            ST.compact(spark, t, ["k"])
            TB.write_batch(frame((1, 3)), t, 3)
            want = [(1, 3), *want[1:]]
        except OSError:
            broke = True
        monkeypatch.setattr(TB.Folder, "mark", mark)
        monkeypatch.setattr(TB.Folder, "remove", remove)
        assert sorted(rows(ST.latest_versions(spark, t, ["k"]), "k", "v")) == want
        TB.write_batch(frame((1, 3)), t, 3)           # the stream hands it over again
        ST.compact(spark, t, ["k"])
        assert sorted(rows(ST.latest_versions(spark, t, ["k"]), "k", "v")) == [(1, 3), (10, 0), (11, 1), (12, 2)]
        crashes += broke
        if not broke:
            break
    assert crashes == 8  # the compaction's marker, its six removals, the batch's marker


def test_a_table_belongs_to_one_checkpoint(spark, split_events):
    folder, _ = split_events
    target, ckpt = ST.fresh_paths(spark, "t_own")
    run = lambda c: ST.stream_window_counts(
        ST.event_stream(spark, folder).withColumnRenamed("event_type", "metric"), "1 day", ["metric"], "ts", ["ts"],
        "value", target, c)
    run(ckpt)
    run(ckpt)
    with pytest.raises(ValueError, match="another checkpoint"):
        run(f"{ckpt}-other")


MATCH = "match_id long, team_1 string, team_2 string, ts timestamp_ntz"
RESULT = "match_id long, match_winner int, ts timestamp_ntz"


@pytest.mark.parametrize("horizon", [None, "2 days"])
def test_live_standings_in_any_order_over_a_restart(spark, tmp_path, horizon):
    """Results before, with and after their match; a match inserted twice counts once."""
    ms, rs = tmp_path / "m", tmp_path / "r"
    ms.mkdir(), rs.mkdir()
    target, ckpt = ST.fresh_paths(spark, "t_live_all")
    at = lambda h: AT + dt.timedelta(hours=h)

    def run():
        ST.stream_standings_live(files(spark, rs, RESULT), files(spark, ms, MATCH), target, ckpt, horizon=horizon)
        return dict(rows(ST.standings(spark, target), "team", "wins"))

    put(spark, ms, "m0", [(1, "A", "B", at(0)), (None, "N", "N", at(0))], MATCH)
    put(spark, rs, "r0", [(1, 1, at(1)), (1, 1, at(1)), (2, 2, at(1)), (None, 1, at(1)), (1, None, at(1))], RESULT)
    assert run() == {"A": 2}
    put(spark, ms, "m1", [(2, "A", "C", at(2)), (1, "X", "Y", at(2))], MATCH)       # match 1 again
    put(spark, rs, "r1", [(1, 2, at(2)), (3, 1, at(2))], RESULT)
    assert run() == {"A": 2, "B": 1, "C": 1}
    put(spark, ms, "m2", [(3, "D", "A", at(3)), (4, "A", "D", at(3))], MATCH)
    ST.compact_standings(spark, target)
    assert run() == {"A": 2, "B": 1, "C": 1, "D": 1}
    put(spark, rs, "r2", [(4, 1, at(4)), (3, 2, at(4))], RESULT)
    assert run() == {"A": 4, "B": 1, "C": 1, "D": 1}


def test_live_standings_state_is_bounded_by_the_horizon(spark, tmp_path):
    ms, rs = tmp_path / "m", tmp_path / "r"
    ms.mkdir(), rs.mkdir()
    for day in range(7):
        at = AT + dt.timedelta(days=3 * day)
        put(spark, ms, f"m{day:02}", [(10 * day + i, "A", "B", at) for i in range(5)], MATCH)
        put(spark, rs, f"r{day:02}", [(10 * day + i, 1, at) for i in range(5)], RESULT)
    held = {}
    for horizon in (None, "1 day"):
        target, ckpt = ST.fresh_paths(spark, "t_live_state")
        q = ST.stream_standings_live(files(spark, rs, RESULT), files(spark, ms, MATCH), target, ckpt, horizon=horizon)
        assert rows(ST.standings(spark, target)) == [("A", 35)]
        held[horizon] = ST.state_size(q)["rows"]
    assert held["1 day"] <= held[None] / 2


def test_live_standings_keep_one_row_per_match_and_winner(spark, tmp_path):
    """The state follows the matches, not their results; undecided results leave none."""
    ms, rs = tmp_path / "m", tmp_path / "r"
    ms.mkdir(), rs.mkdir()
    put(spark, ms, "m0", [(1, "A", "B", AT), (2, None, "C", AT)], MATCH)
    put(spark, rs, "r0", [(1, 1, AT)] * 60 + [(1, 2, AT)] * 30 + [(2, 1, AT), (2, 2, AT), (1, None, AT), (1, 3, AT),
                                                                  (None, 1, AT)] + [(5, None, AT)] * 50, RESULT)
    target, ckpt = ST.fresh_paths(spark, "t_live_rows")
    q = ST.stream_standings_live(files(spark, rs, RESULT), files(spark, ms, MATCH), target, ckpt)
    assert sorted(rows(ST.standings(spark, target), "team", "wins")) == [("A", 60), ("B", 30), ("C", 1)]
    assert ST.state_size(q)["rows"] <= 2 + 2 * (2 + 4)     # keys of matches; rows and counts of both sides


KEYED = "a int, b string, ts timestamp_ntz, v int"


def test_insert_ignore_null_keys_and_stored_keys_in_state(spark, tmp_path):
    put(spark, tmp_path, "f0", [(1, "x", AT, 5), (1, "x", AT, 4), (None, "x", AT, 1), (None, "x", AT, 1), (7, "y", AT, 1)],
        KEYED)
    put(spark, tmp_path, "f1", [(1, "x", AT, 0), (2, "x", AT, 9), (None, "x", AT, 2), (7, "y", AT, 0)], KEYED)
    stored = spark.createDataFrame([(7, "y"), (7, "y"), (8, None)], "a int, b string")
    target, ckpt = ST.fresh_paths(spark, "t_null")
    q = ST.stream_insert_ignore(files(spark, tmp_path, KEYED), ["a", "b"], ["a", "b", "ts", "v"], target, ckpt,
                                stored=stored)
    got = rows(ST.latest_versions(spark, target, ["a", "b"]), "a", "b", "v")
    assert sorted(got, key=repr) == sorted([(1, "x", 4), (2, "x", 9), (None, "x", 1), (None, "x", 1), (None, "x", 2)],
                                           key=repr)
    assert ST.state_size(q)["rows"] == 3                   # 1x, 2x and the stored 7y
    put(spark, tmp_path, "f2", [(7, "y", AT, 3), (2, "x", AT, 1)], KEYED)
    ST.stream_insert_ignore(files(spark, tmp_path, KEYED), ["a", "b"], ["a", "b", "ts", "v"], target, ckpt,
                            stored=stored.limit(0))       # restarted: the state has them
    assert len(rows(ST.latest_versions(spark, target, ["a", "b"]))) == 5


def test_insert_ignore_with_a_horizon_bounds_its_state(spark, tmp_path):
    """Keys seen once a day: only those of the last days are held; the rows are those of the batch form."""
    every = []
    for day in range(10):
        at = AT + dt.timedelta(days=day)
        every += (part := [(day * 10 + i, "k", at + dt.timedelta(hours=h), h) for i in range(5) for h in (5, 3, 4)])
        put(spark, tmp_path, f"f{day}", part, KEYED)
    stored = spark.createDataFrame([(30, "k", AT + dt.timedelta(days=3))], "a int, b string, ts timestamp_ntz")
    target, ckpt = ST.fresh_paths(spark, "t_horizon")
    q = ST.stream_insert_ignore(files(spark, tmp_path, KEYED), ["a", "b"], ["a", "b", "ts", "v"], target, ckpt,
                                stored=stored, horizon="2 days")
    from roundhouse.operators.etl import insert_ignore
    want = insert_ignore(spark.createDataFrame(every, KEYED), None, ["a", "b"]).filter("a <> 30")
    assert sorted(rows(ST.latest_versions(spark, target, ["a", "b"]))) == sorted(rows(want))
    assert ST.state_size(q)["rows"] <= 4 * 5 * 2           # keys of about three days and their timers


SAMPLE = "metric string, ts timestamp_ntz, n int, value double"


def test_held_ticks_equal_the_batch_read_up_to_the_watermark(spark, tmp_path):
    rnd = random.Random(4)
    samples, end = [], {}
    for part in range(4):
        new = [(rnd.choice("ab"), AT + dt.timedelta(seconds=600 * part + rnd.randrange(600)), rnd.randrange(99),
                rnd.random()) for _ in range(25)]
        new += [("c", AT + dt.timedelta(seconds=600 * part), part, float(part))]
        samples += new
        put(spark, tmp_path, f"s{part}", new, SAMPLE)
        end[part] = max(r[1] for r in samples)
    target, ckpt = ST.fresh_paths(spark, "t_asof")
    ST.stream_asof(files(spark, tmp_path, SAMPLE), 15, target, ckpt, seq=("n", "value"), delay="600 seconds")
    got = rows(ST.held_ticks(spark, target), "metric", "tick", "sample_ts", "value")
    from roundhouse.operators.samples import asof_sample
    want = asof_sample(spark.createDataFrame(samples, SAMPLE), 15, seq=("ts", "n", "value"))
    mark = end[3] - dt.timedelta(seconds=600)
    want = [r for r in rows(want, "metric", "tick", "sample_ts", "value") if r[1] <= mark]
    assert sorted(got) == sorted(want) and len(want) > 200


READING = "poll timestamp_ntz, priority int, usd double, eur double, n int"


def test_fallback_with_a_deadline_in_any_order_of_arrival(spark, tmp_path):
    rnd = random.Random(12)
    readings = []
    for i in range(40):
        poll = AT + dt.timedelta(seconds=20 * i)
        for p in (1, 2, 3):
            if rnd.random() < 0.6:
                readings.append((poll, p, rnd.choice([None, 0.0, 1.5]), rnd.choice([None, 0.0, 2.5]), p))
        readings.append((poll, None, None, None, 0))                       # the poll began
    order = [r for i in range(0, len(readings), 12) for r in rnd.sample(readings[i:i + 12], len(readings[i:i + 12]))]
    for part in range(4):
        put(spark, tmp_path, f"r{part}", order[part * len(order) // 4:(part + 1) * len(order) // 4], READING)
    target, ckpt = ST.fresh_paths(spark, "t_fallback")
    q = ST.stream_fallback(files(spark, tmp_path, READING), target, ckpt, "200 seconds", seq=("n",), last_priority=3)
    from roundhouse.operators.samples import source_fallback
    want = source_fallback(spark.createDataFrame(readings, READING).drop("n"), last_priority=3)
    last = AT + dt.timedelta(seconds=20 * 39 - 200)
    cols = ("poll", "source", "usd", "eur", "ok")
    want = [r for r in rows(want, *cols) if r[0] <= last]
    got = rows(TB.read_batches(spark, target), *cols)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[-1] for r in got} == {0, 1} and ST.state_size(q)["rows"] <= 2 * 11   # open polls and their timers


def test_retention_removes_days_without_reading_files(spark, tmp_path):
    from roundhouse.operators.samples import retain_recent
    from roundhouse.sources import dated
    folder = f"{tmp_path}/dated"
    samples = [("m", AT + dt.timedelta(hours=7 * i), i, float(i)) for i in range(80)] + [("none", None, 1, 1.0)]
    df = spark.createDataFrame(samples, SAMPLE)
    dated.write_dated(df, folder)
    want = sorted(rows(retain_recent(df, "7 days")), key=repr)
    assert sorted(rows(dated.read_retained(spark, folder), *df.columns), key=repr) == want
    days = [d for d in os.listdir(folder) if d.startswith("day=2")]
    kept = {}
    for d in days:                                        # no file can be read any more
        for f in os.listdir(f"{folder}/{d}"):
            p = f"{folder}/{d}/{f}"
            kept[p] = open(p, "rb").read()
            with open(p, "wb") as out:
                out.write(b"not a table")
    gone = dated.retain_stored(spark, folder, "7 days")
    assert len(gone) == len(days) - 8 and not any(os.path.exists(f"{folder}/day={d}") for d in gone)
    for p, data in kept.items():
        if os.path.exists(os.path.dirname(p)):
            with open(p, "wb") as out:
                out.write(data)
    assert sorted(rows(dated.read_retained(spark, folder), *df.columns), key=repr) == want
    assert dated.retain_stored(spark, folder, "7 days") == [] == dated.retain_stored(spark, f"{tmp_path}/no", "7 days")


def test_retained_stream_frees_expired_days(spark, tmp_path):
    from roundhouse.operators.samples import retain_recent
    from roundhouse.sources.dated import read_retained
    samples = [("m", AT + dt.timedelta(hours=9 * i), i, float(i)) for i in range(60)]
    for part in range(4):
        put(spark, tmp_path, f"s{part}", samples[15 * part:15 * part + 15], SAMPLE)
    target, ckpt = ST.fresh_paths(spark, "t_retained")
    ST.stream_retained(files(spark, tmp_path, SAMPLE), target, ckpt, "3 days")
    got = read_retained(spark, target, "3 days")
    want = retain_recent(spark.createDataFrame(samples, SAMPLE), "3 days")
    assert sorted(rows(got, "metric", "ts", "n", "value")) == sorted(rows(want))
    assert len([d for d in os.listdir(target.removeprefix("file:")) if d.startswith("day=")]) <= 4

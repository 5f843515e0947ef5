"""Versioned final tables: insert-if-absent loads, idempotent re-runs, partition pruning."""

import contextlib
import io

from pyspark.sql import functions as F

from conftest import SF_SMALL
from roundhouse.plans.load import FinalTables, load_final_tables, read_final


def test_load_is_idempotent_for_keyed_tables(spark, tmp_path):
    folder = str(tmp_path / "final")
    load_final_tables(spark, SF_SMALL, folder, 0)
    counts = {t: read_final(spark, folder, t).count() for t in ("events", "matches", "picks")}
    load_final_tables(spark, SF_SMALL, folder, 1, tables=["events", "matches", "picks"])
    assert {t: read_final(spark, folder, t).count() for t in counts} == counts
    # a replay of version 1 overwrites itself
    load_final_tables(spark, SF_SMALL, folder, 1, tables=["matches"])
    assert read_final(spark, folder, "matches").count() == counts["matches"]
    assert counts["matches"] == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()


def test_event_filter_prunes_partitions(spark, tmp_path):
    folder = str(tmp_path / "final")
    load_final_tables(spark, SF_SMALL, folder, 0, tables=["results"])
    r = FinalTables(spark, folder).r.filter(F.col("event_id") == 2208)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        r.explain("formatted")
    assert "PartitionFilters: [isnotnull(event_id" in buf.getvalue()
    assert r.count() > 0


def test_csv_sources_to_final_tables_to_question(spark, tmp_path):
    """CSV files -> staging -> final tables (insert-if-absent) -> a question."""
    from roundhouse import schemas
    from roundhouse.plans import queries as Q
    from roundhouse.plans.load import staging_from_csv

    def write(name, schema, lines, enc):
        head = ",".join(f.name for f in schema.fields)
        (tmp_path / name).write_bytes(("\n".join([head] + lines) + "\n").encode(enc))

    write("economy.csv", schemas.ECONOMY_STAGE, [
        "1,2208,2016-04-10,Astralis,Envy,3,1,2", "2,2208,2016-04-11,Envy,Fnatic,o,2,",
        "2,2208,2016-04-11,Envy,Fnatic,o,2,"], "latin-1")
    write("picks.csv", schemas.PICKS_STAGE, [
        "1,2208,0,bo3,Nuke,Dust2,Cache,Train,Mirage,Inferno,Overpass,Cobblestone,Season"], "utf-8")
    write("players.csv", schemas.PLAYERS_STAGE, [
        "1,2208,2016-04-10,José,Astralis,Envy,DK,20,10,80.5,70.1,10,1.25"], "latin-1")
    write("results.csv", schemas.RESULTS_STAGE, [
        "1,2208,Nuke,16,9,1,1,1,8,8,7,1,1,2,2,0", "1,2208,Mirage,14,16,2,1,2,7,7,9,7,1,2,1,1",
        "2,2208,Nuke,19,17,1,1,1,9,10,8,7,3,4,1,0"], "utf-8")
    folder = str(tmp_path / "final")
    staged = staging_from_csv(spark, str(tmp_path))
    load_final_tables(spark, None, folder, 0, staged=staged)
    load_final_tables(spark, None, folder, 1, tables=["events", "matches", "picks"], staged=staged)
    f = FinalTables(spark, folder)
    assert f.m.count() == 2 and f.ev.count() == 1
    assert f.p.first()["player_name"] == "José"
    assert sorted(map(tuple, Q.overtime_teams(f.r, f.m, k=None).collect())) == [("Envy", 1), ("Fnatic", 1)]
    assert [r["best_of"] for r in f.m.orderBy("match_id").collect()] == [3, None]
    assert sorted(map(tuple, Q.pistol_rounds(f.e, k=None).collect())) == [
        (2208, "Astralis", 1), (2208, "Envy", 1), (2208, "Fnatic", 2)]  # staged rows count as often as they come
    assert len(f.r.columns) == 16 and len(f.p.columns) == 13


def test_wide_results_answer_like_the_join(spark, tmp_path):
    from roundhouse.plans import queries as Q
    folder = str(tmp_path / "final")
    load_final_tables(spark, SF_SMALL, folder, 0, tables=["events", "matches", "results", "players_raw"])
    f = FinalTables(spark, folder)

    def same(a, b):
        key = lambda r: tuple("" if x is None else str(x) for x in r)
        assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)

    same(Q.winrate_on_map(f.rw, None, None, k=None), Q.winrate_on_map(f.r, f.m, None, k=None))
    same(Q.overtime_teams(f.rw, None, k=None), Q.overtime_teams(f.r, f.m, k=None))
    same(Q.match_wins(f.rw, None, 2235, k=None), Q.match_wins(f.r, f.m, 2235, k=None))
    same(Q.total_rounds(f.rw, None, 2208), Q.total_rounds(f.r, f.m, 2208))
    same(Q.rounds_per_team_day(f.rw, None, 2208), Q.rounds_per_team_day(f.r, f.m, 2208))
    same(Q.players_min_maps(f.p, f.rw, None, 2235, k=None), Q.players_min_maps(f.p, f.r, f.m, 2235, k=None))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        Q.overtime_teams(f.rw, None, k=None).explain()
    assert "Join" not in buf.getvalue()


def test_late_match_completes_its_results(spark, tmp_path):
    from roundhouse.plans.load import WIDE, load_wide_results, read_final
    folder = str(tmp_path)
    match = "match_id long, team_1 string, team_2 string, match_date date, event_id int"
    result = "match_id long, event_id int, map string, result_1 int, result_2 int"
    put = lambda rows, schema, name, v: spark.sql("SELECT 1") and spark.createDataFrame(rows, schema).write.parquet(
        f"{folder}/{name}/version={v}")
    put([(1, "A", "B", None, 7)], match, "matches", 0)
    put([(1, 7, "m", 1, 2), (2, 7, "m", 3, 4)], result, "results", 0)
    load_wide_results(spark, folder, 0)
    put([(2, "C", "D", None, 7)], match, "matches", 1)
    put([(1, 7, "n", 5, 6)], result, "results", 1)
    load_wide_results(spark, folder, 1)
    wide = read_final(spark, folder, WIDE)
    assert sorted((r["match_id"], r["map"]) for r in wide.collect()) == [(1, "m"), (1, "n"), (2, "m")]


def test_declared_key_makes_a_reload_add_nothing(spark, tmp_path):
    folder = str(tmp_path)
    staged = {"results": spark.createDataFrame(
        [(1, 7, "m", 1, 2), (1, 7, "n", 3, 4)], "match_id long, event_id int, map string, result_1 int, result_2 int")}
    for version in (0, 1):
        load_final_tables(spark, None, folder, version, tables=["results"], staged=staged,
                          declared_keys={"results": ["match_id", "map"]})
    assert read_final(spark, folder, "results").count() == 2


def test_unreadable_table_is_no_empty_table(spark, tmp_path):
    import pytest
    (tmp_path / "matches" / "version=0").mkdir(parents=True)
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA|infer"):
        read_final(spark, str(tmp_path), "matches")
    assert read_final(spark, str(tmp_path), "results") is None


def test_waiting_results_over_several_loads(spark, tmp_path):
    """Results before, with and after their match, a version loaded again: each pair once."""
    from roundhouse.plans.load import WAITING, WIDE, load_final_tables, read_final
    folder = str(tmp_path)
    match = "match_id long, event_id int, match_date date, team_1 string, team_2 string"
    result = "match_id long, event_id int, map string, result_1 int, result_2 int"
    loads = [([(99, 7, None, "Q", "R")], [(1, 7, "a", 1, 2), (2, 7, "a", 1, 2)]), ([(1, 7, None, "A", "B")], [(3, 8, "a", 1, 2)]),
             ([(2, 9, None, "C", "D"), (1, 7, None, "X", "Y")], [(1, 7, "b", 3, 4)]), ([(98, 7, None, "Q", "R")], [(2, 7, "b", 5, 6)]),
             ([(3, 8, None, "E", "F")], [(99, 7, "c", 0, 1)])]

    def load(version):
        m, r = loads[version]
        load_final_tables(spark, None, folder, version, tables=["matches", "results"], staged={
            "matches": spark.createDataFrame(m, match), "results": spark.createDataFrame(r, result)})

    for version in range(5):
        load(version)
        if version == 2:
            load(version)
            left = read_final(spark, folder, WAITING).filter("version = 2")
            assert [r["match_id"] for r in left.collect()] == [3]
    wide = sorted((r["match_id"], r["map"], r["team_1"]) for r in read_final(spark, folder, WIDE).collect())
    assert wide == [(1, "a", "A"), (1, "b", "A"), (2, "a", "C"), (2, "b", "C"), (3, "a", "E"), (99, "c", "Q")]
    assert read_final(spark, folder, WAITING).filter("version = 4").count() == 0


def test_results_are_dealt_once_for_all_their_tables(spark, tmp_path, monkeypatch):
    """One deal by event for results, results_wide and results_waiting; the loaded rows are the staged ones."""
    from roundhouse.plans import load
    from roundhouse.sources.tables import TableSource
    dealt = []
    kept = load._by_event
    monkeypatch.setattr(load, "_by_event", lambda df: dealt.append(len(df.columns)) or kept(df))
    folder = str(tmp_path)
    load_final_tables(spark, SF_SMALL, folder, 0, tables=["matches", "results"])
    assert len(dealt) == 2 and dealt[1] < 16       # matches and, narrower than the table, results
    load_final_tables(spark, SF_SMALL, folder, 0, tables=["events", "picks", "players_raw", "economy"])
    for name, frame in load.staging_frames(TableSource(spark, SF_SMALL)).items():
        got = read_final(spark, folder, name).drop("version").select(*frame.columns)
        assert got.exceptAll(frame).isEmpty() and frame.exceptAll(got).isEmpty() and got.count() > 0, name


def test_results_without_match_or_event_are_loaded(spark, tmp_path):
    """Null keys, repeated rows and results that wait for their match, of a bigint event id."""
    from roundhouse.plans.load import WAITING, WIDE
    match = "match_id long, event_id int, match_date date, team_1 string, team_2 string"
    result = "match_id long, event_id long, map string, result_1 int, result_2 int"
    rows = [(1, 7, "a", 1, 2), (1, 7, "a", 1, 2), (None, 7, "b", 1, 2), (2, None, None, None, 2), (1, None, "c", 0, 0)]
    load_final_tables(spark, None, str(tmp_path), 0, tables=["matches", "results"], staged={
        "matches": spark.createDataFrame([(1, 7, None, "A", None), (None, 7, None, "B", "C")], match),
        "results": spark.createDataFrame(rows, result)})
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    read = lambda name: sorted((key(r) for r in read_final(spark, str(tmp_path), name).select(
        "match_id", "event_id", "map", "result_1", "result_2").collect()))
    assert read("results") == sorted(map(key, rows))
    assert read(WIDE) == sorted(key(r) for r in rows if r[0] == 1)
    assert read(WAITING) == sorted(key(r) for r in rows if r[0] != 1)
    wide = read_final(spark, str(tmp_path), WIDE)
    assert wide.columns[:8] == ["match_id", "map", "result_1", "result_2", "team_1", "team_2", "match_date", "version"]


def test_loaded_tables_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Packed files of millions of rows look small to Spark; the driver's memory has no room for the rows."""
    from roundhouse.plans import load
    plans, materialize = [], load.materialize

    def seen(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    matches = spark.createDataFrame([(i, 2200 + i % 3, "a", "b") for i in range(40)] + [(None, 2200, "a", "b")],
                                    "match_id long, event_id int, team_1 string, team_2 string")
    matches = matches.withColumn("match_date", F.lit("2019-01-01").cast("date"))
    results = spark.createDataFrame([(i % 50, 2200 + i % 3, i) for i in range(100)],
                                    "match_id long, event_id int, result_1 int")
    folder = str(tmp_path / "final")
    load.load_increment(matches.filter("match_id < 30 OR match_id IS NULL"), folder, "matches", ["match_id"], 0)
    fresh = load._fresh(matches, folder, "matches", ["match_id"], 1).rows
    plans.append(fresh._jdf.queryExecution().executedPlan().toString())
    assert sorted(r[0] or -1 for r in fresh.select("match_id").collect()) == [-1, *range(30, 40)]
    monkeypatch.setattr(load, "materialize", seen)
    load.load_results(spark, results, folder, None, 0)
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    assert read_final(spark, folder, "results_wide").count() == 60
    assert read_final(spark, folder, "results_waiting").count() == 40


def test_large_dimensions_are_not_broadcast_in_a_load(spark):
    from roundhouse.plans import adapters as A
    from roundhouse.sources.tables import CountedSource
    few, many = CountedSource(spark, SF_SMALL), CountedSource(spark, SF_SMALL, most=10)
    for make in (lambda src: A.match_lines(src), lambda src: A.result_lines(src)):
        plan = make(many)._jdf.queryExecution().executedPlan().toString()
        name = "c_custkey" if make(many).columns[-1] == "c_nationkey" else "p_partkey"
        joins = [x for x in plan.splitlines() if "Join" in x and name in x]
        assert joins and all("SortMergeJoin" in x for x in joins)
        assert make(few).exceptAll(make(many)).isEmpty() and make(many).exceptAll(make(few)).isEmpty()

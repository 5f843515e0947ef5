"""Loaded tables laid out by match: joins on match_id read buckets side by side."""

import contextlib
import io
import re

import pytest

from conftest import SF_SMALL
from roundhouse.plans import queries as Q
from roundhouse.plans.layout import PLACE, MatchTables, buckets_for, cluster_by_match
from roundhouse.plans.load import FinalTables, load_final_tables

KEY = lambda r: tuple("" if x is None else str(x) for x in r)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("final"))
    load_final_tables(spark, SF_SMALL, folder, 0, tables=["matches", "results", "players_raw"])
    cluster_by_match(spark, folder, 4)
    return folder


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def below_joins(df) -> str:
    """The plan from the first join down."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    text = buf.getvalue()
    assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
    return text[re.search(r"SortMergeJoin|ShuffledHashJoin", text).start():]


QUESTIONS = {
    "winrate_on_map": lambda f: Q.winrate_on_map(f.r, f.m, None, k=None),
    "players_min_maps": lambda f: Q.players_min_maps(f.p, f.r, f.m, 2235, 1, k=None),
    "rating_vs_rounds": lambda f: Q.rating_vs_rounds(f.r, f.m, f.p, 2208),
}


@pytest.mark.parametrize("name", QUESTIONS)
def test_no_exchange_below_the_joins_and_same_answer(spark, folder, no_broadcast, name):
    laid, plain = MatchTables(spark, folder), FinalTables(spark, folder)
    plan = below_joins(QUESTIONS[name](laid))
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert "Exchange" in below_joins(QUESTIONS[name](plain))
    got, want = ([tuple(r) for r in QUESTIONS[name](f).collect()] for f in (laid, plain))
    assert sorted(got, key=KEY) == sorted(want, key=KEY) and len(got) > 0


def test_a_broken_snapshot_is_not_used(spark, folder, no_broadcast, monkeypatch):
    from roundhouse.streaming.tables import Folder

    def lost(self, name):
        raise OSError("lost")

    before = MatchTables(spark, folder)
    with monkeypatch.context() as m:
        m.setattr(Folder, "mark", lost)
        with pytest.raises(OSError):
            cluster_by_match(spark, folder, 2)
    assert MatchTables(spark, folder).number == before.number
    number = cluster_by_match(spark, folder, 2)          # the next run takes its place
    after = MatchTables(spark, folder)
    assert (after.number, after.buckets) == (number, 2) == (before.number + 1, 2)
    assert after.r.count() == before.r.count() == FinalTables(spark, folder).r.count()
    with pytest.raises(FileNotFoundError):
        MatchTables(spark, f"{folder}/{PLACE}")


def test_bucket_counts():
    assert [buckets_for(b << 20) for b in (0, 1, 256, 257, 1000, 100 << 20)] == [1, 1, 1, 2, 4, 1 << 19]


def test_few_buckets_are_written_without_a_shuffle(spark, folder, no_broadcast, monkeypatch):
    from roundhouse.plans import layout
    dealt, frame = [], type(spark.range(1))
    kept = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(a) or kept(self, *a))
    cluster_by_match(spark, folder, 4)
    assert not dealt
    laid = MatchTables(spark, folder)
    assert "Exchange" not in below_joins(QUESTIONS["players_min_maps"](laid))
    assert sorted(map(KEY, laid.p.select("match_id", "player_name", "kills").collect())) == sorted(
        map(KEY, FinalTables(spark, folder).p.select("match_id", "player_name", "kills").collect()))
    monkeypatch.setattr(layout, "FILES_PER_TASK", 2)    # many buckets: rows are dealt to them first
    cluster_by_match(spark, folder, 4)
    assert dealt == [(4, "match_id")] * 3

"""Hand-made cases (FIXTURES.md section 2)."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from helpers import matches, players, results
from roundhouse.functions import scalars as X
from roundhouse.operators import changes as C
from roundhouse.operators import etl as E
from roundhouse.operators import report as R
from roundhouse.operators import samples as W
from roundhouse.plans import queries as Q


def test_best_of_cleaning(spark):
    df = spark.createDataFrame([("3",), ("o",), (None,)], "b string")
    assert [r[0] for r in df.select(X.clean_best_of("b")).collect()] == [3, None, None]
    bad = spark.createDataFrame([("x",)], "b string")
    with pytest.raises(Exception):
        bad.select(X.clean_best_of("b")).collect()


def test_insert_ignore_keeps_existing_and_is_idempotent(spark):
    existing = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string")
    once = E.insert_ignore(new, existing, ["k"])
    assert sorted(rows(once)) == [(1, "old"), (2, "a")]
    twice = E.insert_ignore(new, once, ["k"])
    assert sorted(rows(twice)) == sorted(rows(once))


def test_insert_ignore_null_keys_never_conflict(spark):
    existing = spark.createDataFrame([(1, None, "x")], "k int, m string, v string")
    new = spark.createDataFrame([(1, None, "y"), (1, None, "z")], "k int, m string, v string")
    assert len(rows(E.insert_ignore(new, existing, ["k", "m"]))) == 3


def test_insert_without_key_appends(spark):
    existing = spark.createDataFrame([(1,)], "k int")
    assert E.insert_ignore(existing, existing, None).count() == 2


def test_assign_ids_consecutive_after_max(spark):
    new = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    out = E.assign_ids(new, 41, ["k"], id_col="id")
    got = sorted(rows(out, "k", "id"))
    assert got == [(k, 42 + k) for k in range(1000)]


def test_zero_total_rate_is_null_and_sorts_first(spark):
    m = matches(spark, [(1, 1, "2016-01-01", "A", "B"), (2, 1, "2016-01-02", "C", "D")])
    r = results(spark, [(1, 1, "Nuke", 0, 0, 1), (2, 1, "Nuke", 16, 4, 1)])
    top = rows(Q.winrate_on_map(r, m, 1, k=1))
    assert top[0][2] is None and top[0][0] in ("A", "B")
    last = Q.winrate_on_map(r, m, 1, k=None)
    from roundhouse.operators.topk import top_k
    assert rows(top_k(last, "win_rate", 1, ["team", "map"], nulls="last")) == [("C", "Nuke", 80.0)]


def test_kd_ratio_threshold_and_rounding(spark):
    # 21 rows: kills 14 + 20*8 = 174, deaths 0 + 20*5 = 100 -> 1.74; 20 rows drop out (> 20)
    good = [(i, 1, "good", "T", 14 if i == 0 else 8, 0 if i == 0 else 5, "1.00") for i in range(21)]
    few = [(100 + i, 1, "few", "T", 10, 1, "1.00") for i in range(20)]
    out = rows(Q.kd_ratio(players(spark, good + few), 20, k=None))
    assert out == [("good", "T", 1.74, 21)]


def test_mean_rating_rounds_half_up(spark):
    p = players(spark, [(1, 1, "a", "T", 1, 1, "1.00"), (2, 1, "a", "T", 1, 1, "1.01"),
                        (3, 1, "b", "T", 1, 1, None)])
    got = sorted(rows(Q.best_player_by_rating(p, 1, k=None), "player_name", "avg_rating"))
    assert got == [("a", 1.01), ("b", None)]


def test_two_roundings(spark):
    m = matches(spark, [(1, 1, "2016-01-01", "A", "B"), (2, 1, "2016-01-02", "A", "C")])
    r = results(spark, [(1, 1, "Nuke", 1, 2, 2), (2, 1, "Nuke", 2, 1, 1)])
    out = dict(rows(Q.avg_winrate(r, m, 1, k=None), "team", "avg_winrate"))
    assert out["A"] == 50.0 and out["B"] == 66.67 and out["C"] == 33.33


def test_win_twice_counts_once_per_match(spark):
    m = matches(spark, [(1, 1, "2019-03-01", "A", "B")])
    r = results(spark, [(1, 1, "Nuke", 16, 3, 1), (1, 1, "Mirage", 16, 5, 1)])
    assert rows(Q.match_wins(r, m, 1, k=None)) == [("A", 1)]
    assert rows(Q.best_team_of_year(r, m, 2019, k=None)) == [("A", 2)]


def test_fan_out_counts_result_rows(spark):
    m = matches(spark, [(1, 1, "2016-01-01", "A", "B")])
    r = results(spark, [(1, 1, "Nuke", 16, 3, 1), (1, 1, "Mirage", 16, 5, 1), (1, 1, "Inferno", 3, 16, 1)])
    p = players(spark, [(1, 1, "x", "A", 20, 10, "1.20")])
    assert rows(Q.players_min_maps(p, r, m, 1, 1, k=None)) == [("x", "A", 1.2, 3)]


def test_zero_day_present(spark):
    m = matches(spark, [(1, 1, "2019-01-01", "A", "B"), (2, 1, "2019-01-02", "C", "D")])
    r = results(spark, [(1, 1, "Nuke", 16, 3, 1), (2, 1, "Nuke", 16, 5, 1)])
    out = rows(Q.team_rounds_by_day(r, m, "A", 2019))
    assert [x[1] for x in out] == [16, 0]


def test_placeholder_maps(spark):
    m = matches(spark, [(1, 1, "2016-01-01", "A", "B")])
    r = results(spark, [(1, 1, mp, 1, 2, 2) for mp in ("Default", "Unknown", "", None, "Nuke")])
    assert rows(Q.map_distribution(r, m, 1)) == [("Nuke", 1)]
    assert Q.popular_map(r, 1, exclude=Q.PLACEHOLDER_MAPS, k=None).count() == 1
    assert Q.popular_map(r, None, k=None).count() == 5


def test_event_names_and_slug(spark):
    ev = spark.createDataFrame([(1, " ECS "), (2, ""), (3, None), (4, "   "),
                                (5, "  ECS: Season\u20141!! ")], "event_id int, event_name string")
    ids = spark.createDataFrame([(i,) for i in range(1, 7)], "event_id int")
    named = ids.join(ev, "event_id", "left").select("event_id", X.event_name().alias("n"))
    got = dict(rows(named))
    assert got == {1: "ECS", 2: "Event 2", 3: "Event 3", 4: "", 5: "ECS: Season\u20141!!", 6: "Event 6"}
    slugged = dict(rows(named.select("event_id", X.slug("n"))))
    assert slugged[5] == "ECS_Season_1" and slugged[6] == "Event_6"


def test_player_label(spark):
    df = spark.createDataFrame([("p", None), (None, "T"), ("p", "T")], "player_name string, team string")
    assert [r[0] for r in df.select(X.player_label()).collect()] == ["p (\u2014)", None, "p (T)"]


def test_histogram_edges_and_single_value(spark):
    df = spark.createDataFrame([(17,), (59,)], "x int")
    h = rows(R.equal_width_histogram(df, "x", 15), "bin", "n")
    assert len(h) == 15 and h[0] == (1, 1) and h[14] == (15, 1) and sum(n for _, n in h) == 2
    one = spark.createDataFrame([(5,), (5,)], "x int")
    assert rows(R.equal_width_histogram(one, "x", 3), "bin", "n") == [(1, 2), (2, 0), (3, 0)]


def test_change_log_cases(spark):
    log = spark.createDataFrame([
        (1, 1, "insert", 10), (1, 2, "update", 3), (1, 3, "delete", None),
        (2, 1, "insert", 5), (2, 2, "update", 2),
        (3, 1, "update", 9),
        (4, 1, "delete", None), (4, 2, "insert", 7),
    ], "id int, seq int, op string, v int")
    got = sorted(rows(C.apply_changes(log, key="id", seq=("seq",))))
    assert got == [(2, 7), (4, 7)]


def test_source_fallback_cases(spark):
    rd = spark.createDataFrame([
        (1, 1, 450.0, None), (1, 2, 451.0, 490.0),
        (2, 1, None, None),
        (3, 1, None, 1.0), (3, 3, 0.0, 2.0),
    ], "poll int, priority int, usd double, eur double")
    got = sorted(rows(W.source_fallback(rd, last_priority=3)))
    assert got == [(1, 2, 451.0, 490.0, 1), (2, None, 0.0, 0.0, 0), (3, None, 0.0, 0.0, 0)]


def test_linguistic_and_code_point_order(spark):
    teams = ["Virtus.pro", "mousesports", "Envy", "fnatic"]
    m = matches(spark, [(i, 1, "2016-04-10", t, "(bye)") for i, t in enumerate(teams)])
    r = results(spark, [(i, 1, "Nuke", 16, 0, 1) for i in range(4)])
    day = Q.rounds_per_team_day(r, m, 1).filter("team <> '(bye)'")
    assert [x[1] for x in rows(day)] == ["Envy", "fnatic", "mousesports", "Virtus.pro"]
    labels = [x[0] for x in rows(Q.team_labels(day))]
    assert labels == ["ALL", "Envy", "Virtus.pro", "fnatic", "mousesports"]


def test_team_pool_forced_member_and_cap(spark):
    m = matches(spark, [(1, 1, "2016-01-01", "B", ""), (2, 1, "2016-01-01", "A", None)])
    p = players(spark, [(1, 1, "x", "C", 1, 1, "1.00")])
    assert [x[0] for x in rows(Q.team_pool(m, p, p, "FURIA"))] == ["A", "B", "C", "FURIA"]
    assert [x[0] for x in rows(Q.team_pool(m, p, p, "FURIA", cap=1))] == ["A", "FURIA"]


def test_team_pool_keeps_every_team(spark):
    m = spark.range(600).selectExpr("concat('T', id) AS team_1", "'X' AS team_2")
    p = spark.createDataFrame([("Z",)], "team string")
    assert Q.team_pool(m, p, p).count() == 603


def test_mean_rating_keeps_every_digit(spark):
    df = spark.sql("SELECT 1 AS event_id, 'p' AS player_name, 'a' AS team, CAST(v AS DECIMAL(6,3)) AS rating "
                   "FROM VALUES (1.239), (1.234), (1.238) AS t(v)")
    assert rows(Q.best_player_by_rating(df, 1), "avg_rating") == [(1.24,)]


def test_questions_start_no_job(spark):
    from roundhouse.plans.catalog import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    m, r = t.m, t.r
    group = "lazy-question"
    spark.sparkContext.setJobGroup(group, "no job while a question is built")
    Q.winrate_on_map(r, m, 1), Q.match_wins(r, m, 2019), Q.total_rounds(r, m, 1)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")


def test_colour_position(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    pos = dict(rows(R.colour_position(df, "x", digits=6), "x", "position"))
    assert pos == {1.0: 0.0, 2.0: 0.333333, 3.0: 0.533333, 10.0: 1.0}
    anchors = rows(R.column_anchors(df, ["x"]))
    assert anchors == [("x", 1.0, 2.5, 10.0)]


def test_numeric_columns(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 1.0), ("c", 3, None)], "s string, n int, f double")
    assert R.numeric_columns(df) == ["n"]
    late = spark.range(130).selectExpr("CASE WHEN id >= 30 THEN id END AS n")
    assert R.numeric_columns(late) == ["n"]  # leading NULLs do not hide a column


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    assert dict(rows(R.share_of_total(df, "n"), "k", "share")) == {"a": 33.3, "b": 66.7}


def test_exact_quantile_many_rounds(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.integers(0, 50, 3000), rng.normal(100, 30, 2000).round(2)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    for q in (0.5, 0.1, 0.93):
        got = R.exact_quantile(df, "x", q, final_rows=50, accuracy=100)
        assert abs(got - float(np.quantile(vals, q))) < 1e-9


def test_change_log_carries_insert_columns(spark):
    log = spark.createDataFrame([
        (1, 1, "insert", 10, "a", 100), (1, 2, "update", 5, None, None), (1, 3, "insert", 99, "z", 1),
    ], "id int, seq int, op string, v int, name string, score int")
    out = rows(C.apply_changes(log, key="id", seq=("seq",), carry=("name", "score")))
    assert out == [(1, 15, "a", 100)]


def test_event_names_one_row_per_id(spark):
    ev = spark.createDataFrame([(1, "B"), (1, "A"), (2, None)], "event_id int, event_name string")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "event_id int")
    assert sorted(rows(Q.event_names(ids, ev))) == [(1, "A"), (2, "Event 2"), (3, "Event 3")]


def test_quantile_of_mostly_equal_values(spark, monkeypatch):
    """80 % one value: found without sorting, or reading past, its rows."""
    offsets = []
    plain = type(spark.range(1)).offset
    monkeypatch.setattr(type(spark.range(1)), "offset", lambda df, n: (offsets.append(n), plain(df, n))[1])
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") % 5 > 0, 7.0).otherwise(F.col("id") * 1.0).alias("x"))
    values = sorted(7.0 if i % 5 else float(i) for i in range(n))
    for q in (0.0, 0.1, 0.5, 0.8, 0.85, 1.0):
        pos = q * (n - 1)
        k = int(pos)
        want = values[k] + (values[min(k + 1, n - 1)] - values[k]) * (pos - k)
        assert R.exact_quantile(df, "x", q, final_rows=100, accuracy=200) == want
    assert all(o <= 100 for o in offsets)

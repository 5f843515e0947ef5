"""Inputs where one key holds a third of all rows: results stay exact and the
plans combine map-side (no hot group is gathered into one task)."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from conftest import rows
from roundhouse.operators import changes as C
from roundhouse.operators import etl as E
from roundhouse.operators import samples as W
from roundhouse.plans import queries as Q


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def skewed_matches_results(spark, n=3000):
    """Team 'HOT' plays in a third of all matches."""
    base = spark.range(n).select(
        F.col("id").alias("match_id"), F.lit(1).alias("event_id"),
        F.date_add(F.lit("2019-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("match_date"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("T"), (F.col("id") % 7).cast("string"))).alias("team_1"),
        F.concat(F.lit("U"), (F.col("id") % 5).cast("string")).alias("team_2"),
        F.lit(3).alias("best_of"))
    res = spark.range(n * 2).select(
        (F.col("id") % n).alias("match_id"), F.lit(1).alias("event_id"),
        F.when(F.col("id") % 2 == 0, F.lit("Nuke")).otherwise(F.lit("Mirage")).alias("map"),
        (F.col("id") % 17).cast("int").alias("result_1"), (F.col("id") % 13).cast("int").alias("result_2"),
        F.lit(1).alias("map_winner"), (F.col("id") % 2 + 1).cast("int").alias("match_winner"))
    return base, res


def test_hot_team_win_rate_exact(spark):
    m, r = skewed_matches_results(spark)
    got = {(t, mp): v for t, mp, v in rows(Q.winrate_on_map(r, m, 1, k=None))}
    pm, pr = m.toPandas(), r.toPandas()
    j = pr.merge(pm[["match_id", "team_1", "team_2"]], on="match_id")
    want = {}
    for side in (1, 2):
        g = j.assign(team=j[f"team_{side}"], won=j[f"result_{side}"], tot=j.result_1 + j.result_2) \
             .groupby(["team", "map"])[["won", "tot"]].sum()
        for (t, mp), rw in g.iterrows():
            a, b = want.get((t, mp), (0, 0))
            want[(t, mp)] = (a + rw.won, b + rw.tot)
    exact = {k: ((20000 * a + b) // (2 * b)) / 100 for k, (a, b) in want.items()}
    assert got == exact


def test_hot_key_aggregates_combine_map_side(spark):
    m, r = skewed_matches_results(spark)
    for df in (Q.winrate_on_map(r, m, 1, k=None), Q.match_wins(r, m, 1, k=None),
               E.dedupe_by_key(m, ["team_1"])):
        plan = plan_text(df)
        assert re.search(r"partial_(sum|count|min)", plan), plan


def test_hot_key_change_log_without_windows(spark):
    log = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("id"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 11 == 0, F.lit("delete")).when(F.col("id") % 4 == 0, F.lit("insert"))
         .otherwise(F.lit("update")).alias("op"),
        (F.col("id") % 9).cast("int").alias("v"))
    out = C.apply_changes(log, key="id", seq=("seq",), bucket=F.floor(F.col("seq") / 100))
    plan = plan_text(out)
    assert "Window" not in plan
    # rows of the log meet by key and bucket; by key alone only bucket summaries do
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    alone = [d for d in dealt if "_b#" not in d]
    assert len(dealt) > 1 and len(alone) == 1, plan
    control = log.join(log.filter("op = 'delete'").groupBy("id").agg(F.max("seq").alias("last")), "id")
    assert any("_b#" not in d for d in re.findall(r"hashpartitioning\((.*?), \d+\)", plan_text(control))) \
        or "Broadcast" in plan_text(control)
    state = {}
    for k, s, op, v in sorted(rows(log), key=lambda x: x[1]):
        if op == "insert" and k not in state:
            state[k] = v
        elif op == "update" and k in state:
            state[k] += v
        elif op == "delete":
            state.pop(k, None)
    assert sorted(rows(out)) == sorted(state.items())
    whole = C.apply_changes(log, key="id", seq=("seq",))  # one bucket
    assert sorted(rows(whole)) == sorted(state.items())


def test_only_hot_keys_are_dealt_over_buckets(spark):
    """The same state whether no key, one or every key counts as hot; cold keys have one bucket."""
    log = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40).alias("id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % 900).cast("int"))).alias("ts"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 13 == 0, F.lit("delete")).when(F.col("id") % 4 == 0, F.lit("insert"))
         .otherwise(F.lit("update")).alias("op"), (F.col("id") % 9).cast("int").alias("v"))
    want = sorted(rows(C.apply_changes(log, bucket=C.time_bucket(log, "ts"))))
    dealt = {}
    for events in (0, 500, 10**6):
        bucket = C.hot_bucket(log, "id", "ts", events=events)
        dealt[events] = {r[0] for r in rows(log.select("id", bucket.alias("b")).filter("b <> 0").select("id").distinct())}
        assert sorted(rows(C.apply_changes(log, bucket=bucket))) == want
    assert len(dealt[0]) == 40 and dealt[500] == {0} and dealt[10**6] == set()
    assert sorted(rows(C.apply_changes(log))) == want


def test_forward_fill_windows_are_chunked(spark):
    import datetime as dt
    data = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * i), "hot", float(i), i) for i in range(40)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, metric string, value double, event_id int")
    plan = plan_text(W.asof_sample(df, 3600, seq=("ts", "event_id"), chunk_ticks=8))
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan)
    assert windows and any("_chunk" in w for w in windows), plan

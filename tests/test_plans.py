"""Plan shape: filters reach the Parquet scan, one join for the two-sided unpivot,
bounded top-k, pruned read schemas."""

import contextlib
import io
import re

from conftest import SF_SMALL
from roundhouse.plans import catalog


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def q(spark, name):
    return catalog.queries()[name](spark, SF_SMALL)


def scans_of(plan: str, table: str) -> int:
    return len(re.findall(rf"Location: InMemoryFileIndex \[file:[^\]]*/{table}\.parquet\]", plan))


def test_year_filter_reaches_parquet(spark):
    plan = plan_text(q(spark, "most_matches_in_year"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate,1998-01-01", plan)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate,1999-01-01", plan)


def test_two_sided_scans_and_joins_once(spark):
    plan = plan_text(q(spark, "winrate_on_map_groups"))
    assert scans_of(plan, "lineitem") == 1
    assert plan.count("Generate") >= 1
    # lineitem x part x orders (results) and orders x customer x nation x nation (matches),
    # then results x matches: six joins, not twelve as with UNION ALL of two joins
    assert len(re.findall(r"^\(\d+\) \w*Join", plan, flags=re.M)) <= 6


def test_top_k_is_bounded(spark):
    plan = plan_text(q(spark, "kd_ratio"))
    assert "TakeOrderedAndProject" in plan


def test_read_schema_is_pruned(spark):
    plan = plan_text(q(spark, "winrate_on_map"))
    m = re.search(r"lineitem\.parquet\][^\n]*\n(?:[^\n]*\n){0,3}?ReadSchema: (struct<[^>]*>)", plan)
    assert m, plan
    assert set(re.findall(r"(\w+):", m.group(1))) == {"l_orderkey", "l_partkey", "l_quantity"}


def test_fan_out_weighted_not_materialised(spark):
    # players_min_maps joins players with per-match result counts (one row per match)
    plan = plan_text(q(spark, "players_min_maps"))
    assert "HashAggregate" in plan
    assert "partial_count" in plan


def test_change_log_has_no_window(spark):
    plan = plan_text(q(spark, "apply_changes"))
    assert "Window" not in plan


def test_event_questions_read_no_more_than_all_events(spark):
    # one plain join: the event filter adds no second read of any table
    scans = lambda name: len(re.findall(r"Scan parquet", plan_text(q(spark, name)).split("(1)")[0]))
    assert scans("winrate_on_map") <= scans("winrate_on_map_groups")

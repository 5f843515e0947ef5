"""Every registered query against its DuckDB twin on the smallest tables (driver style)."""

import pytest

import __spark_entry__ as entry_mod
from conftest import SF_SMALL
from oracle_check import compare

QUERIES = entry_mod.queries()
ORACLE = entry_mod.oracle_sql()


def test_every_query_has_an_oracle():
    from roundhouse.plans import catalog
    assert set(catalog.queries()) == set(catalog.oracle_sql()) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    ok, msg = compare(df, duck, ORACLE[name])
    assert ok, f"{name}: {msg}"


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["event_id", "team", "map", "win_rate"]


def test_random_pick_repeatable(spark):
    a = QUERIES["random_pick"](spark, SF_SMALL).collect()
    b = QUERIES["random_pick"](spark, SF_SMALL).collect()
    assert len(a) == 1 and a == b


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_column_types_match_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in df.schema.fields}
    dt = {d[0]: str(d[1]) for d in duck.execute(ORACLE[name]).description}
    assert st == dt


def test_session_zone_is_pinned(spark, duck):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    df = QUERIES["asof_sample"](spark, SF_SMALL)
    ok, msg = compare(df, duck, ORACLE["asof_sample"])
    assert ok, msg
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"

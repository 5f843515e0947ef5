"""CSV loads that set bad lines aside, and JSON payloads kept as variants."""

import pytest

from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundhouse.sources.files import TooManyBadLines, payload_variant, read_csv_quarantined

SCHEMA = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("team", T.StringType()),
                       T.StructField("day", T.DateType()), T.StructField("rating", T.DecimalType(4, 2))])
GOOD = ['1,Envy,2016-04-10,1.25', '2,"Ast, ""x""",2016-04-11,0.90', '3,José,2016-04-12,', '4,,,']
BAD = {'5,Envy,2016-04-10': "3 fields instead of 4", '6,Envy,2016-04-10,1.0,9': "5 fields instead of 4",
       'x7,Envy,2016-04-10,1.0': "match_id is no bigint", '8,Envy,2016-13-41,1.0': "day is no date",
       '9,Envy,2016-04-10,much': "rating is no decimal(4,2)", '10,"Envy,2016-04-10,1.0': "unclosed quote",
       'José': "1 fields instead of 4"}


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_good_and_quarantined_rows_are_all_lines(spark, tmp_path, encoding):
    head = "a,b,c,d"
    for name, lines in (("one", GOOD + list(BAD)), ("two", GOOD[:2]), ("three", [])):
        (tmp_path / f"{name}.csv").write_bytes("\n".join([head, *lines, ""]).encode(encoding))
    good, bad = read_csv_quarantined(spark, str(tmp_path), SCHEMA, encoding, max_bad_share=0.6)
    assert good.count() + bad.count() == 2 + len(GOOD) + len(BAD)
    assert {r["line"]: r["reason"] for r in bad.collect()} == BAD
    assert all(r["file"].endswith("/one.csv") for r in bad.collect())
    assert good.schema == SCHEMA
    got = {r["match_id"]: (r["team"], str(r["day"]), str(r["rating"])) for r in good.collect()}
    assert got == {1: ("Envy", "2016-04-10", "1.25"), 2: ('Ast, "x"', "2016-04-11", "0.90"),
                   3: ("José", "2016-04-12", "None"), 4: (None, "None", "None")}


def test_too_many_bad_lines_end_the_load(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\n".join(["h", *GOOD * 10, *BAD]))
    with pytest.raises(TooManyBadLines, match="7 of 47"):
        read_csv_quarantined(spark, str(tmp_path), SCHEMA, max_bad_share=0.1)
    (tmp_path / "x.csv").write_text("h\n")
    good, bad = read_csv_quarantined(spark, str(tmp_path), SCHEMA)
    assert good.count() == bad.count() == 0


def test_load_with_a_broken_line(spark, tmp_path):
    """One broken line in one of the four sources: the load goes on and the line is kept aside."""
    from roundhouse import schemas
    from roundhouse.plans.load import CSV_SOURCES, FinalTables, load_final_tables, staging_from_csv
    lines = {"economy": ["1,2208,2016-04-10,Astralis,Envy,3,1,2", "2,2208,2016-04-11,Envy"],
             "picks": ["1,2208,0,bo3,Nuke,Dust2,Cache,Train,Mirage,Inferno,Overpass,Cobblestone,Season"],
             "players": ["1,2208,2016-04-10,José,Astralis,Envy,DK,20,10,80.5,70.1,10,1.25"],
             "results": ["1,2208,Nuke,16,9,1,1,1,8,8,7,1,1,2,2,0"]}
    for name, (file, enc) in CSV_SOURCES.items():
        head = ",".join(f.name for f in getattr(schemas, f"{name.upper()}_STAGE").fields)
        (tmp_path / file).write_bytes("\n".join([head, *lines[name]]).encode(enc))
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        staging_from_csv(spark, str(tmp_path))["economy"].collect()
    staged = staging_from_csv(spark, str(tmp_path), quarantine=f"{tmp_path}/bad", max_bad_share=0.5)
    load_final_tables(spark, None, f"{tmp_path}/final", 0, staged=staged)
    f = FinalTables(spark, f"{tmp_path}/final")
    assert f.m.count() == f.r.count() == 1 and f.p.first()["player_name"] == "José"
    assert rows(spark.read.parquet(f"{tmp_path}/bad/economy"), "line", "reason") == [
        ("2,2208,2016-04-11,Envy", "4 fields instead of 8")]
    assert spark.read.parquet(f"{tmp_path}/bad/results").count() == 0


def test_variant_payloads(spark):
    texts = ['{"k": 3, "a": {"b": "x"}}', '{"k": "three"}', '{"k": 4', None, "[1, 2]", '{"a": null}', '{"k": 7, "more": 1.5}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, props string")
    out = payload_variant(df, "props", {"k": "int", "b": ("$.a.b", "string")}, defaults={"k": 0}, required=("k",))
    got = {r["id"]: (r["k"], r["b"], r["ok"], r["gone"]) for r in
           out.withColumn("gone", F.col("payload").isNull()).drop("payload").collect()}
    assert got == {0: (3, "x", True, False), 1: (0, None, False, False), 2: (0, None, False, True),
                   3: (0, None, False, True), 4: (0, None, False, False), 5: (0, None, False, False),
                   6: (7, None, True, False)}
    again = out.select("id", F.try_variant_get("payload", "$.more", "double").alias("more")).filter("more IS NOT NULL")
    assert rows(again) == [(6, 1.5)]


def test_variant_equals_typed_payloads(spark):
    from conftest import SF_SMALL
    from roundhouse.sources.files import payload_fields
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "props")
    typed = payload_fields(ev, "props", "k INT", defaults={"k": 0}, required=("k",))
    variant = payload_variant(ev, "props", {"k": "int"}, defaults={"k": 0}, required=("k",)).drop("payload")
    assert sorted(rows(typed, "event_id", "k", "ok")) == sorted(rows(variant, "event_id", "k", "ok"))

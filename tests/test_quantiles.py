"""Quantiles of many columns and groups by sketch and count, against numpy; their number of jobs."""

import uuid

import numpy as np
import pytest

from roundhouse.operators.quantiles import column_quantiles
from roundhouse.operators.report import column_anchors

NAN = float("nan")


def want(rows, columns, qs):
    out = {}
    for g in {r[0] for r in rows}:
        for i, c in enumerate(columns, 1):
            v = np.array([r[i] for r in rows if r[0] == g and r[i] is not None], dtype=float)
            if len(v):
                s = np.sort(v)                       # NaN last
                pos = [q * (len(s) - 1) for q in qs]
                vals = [s[int(p)] if p == int(p) else s[int(p)] + (s[int(p) + 1] - s[int(p)]) * (p - int(p)) for p in pos]
                out[(g, c)] = (len(v), *vals)
    return out


def got(df):
    return {(r["g"], r["column"]): (r["n"], *r["quantiles"]) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-12, nan_ok=True), k


@pytest.mark.parametrize("options", [{}, {"k": 64, "final_rows": 20}])
def test_quantiles_of_groups_and_columns(spark, options):
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("a", 900), ("b", 3), (None, 41), ("one", 1), ("hot", 1500)):
        for i in range(n):
            rows.append((g, float(rng.normal()), int(rng.integers(0, 4)), None if g == "b" else float(i),
                         7.5 if rng.random() < 0.9 else float(rng.integers(0, 99)), NAN if i % 5 == 0 else float(i)))
    columns = ["x", "few", "gaps", "same", "holes"]
    df = spark.createDataFrame(rows, "g string, x double, few int, gaps double, same double, holes double").repartition(7)
    qs = (0.0, 0.25, 0.5, 0.99, 1.0)
    same(got(column_quantiles(df, columns, qs, ("g",), **options)), want(rows, columns, qs))


def test_too_small_a_sketch_is_refused(spark):
    with pytest.raises(ValueError):
        column_quantiles(spark.range(3), ["id"], k=8)


def test_no_rows_and_no_values(spark):
    df = spark.createDataFrame([("a", None)], "g string, x double")
    assert column_quantiles(df, ["x"], by=("g",)).count() == 0
    assert column_quantiles(df.limit(0), ["x"]).count() == 0
    assert [tuple(r) for r in column_anchors(df, ["x"]).collect()] == [("x", None, None, None)]


def test_jobs_do_not_grow_with_the_columns(spark):
    df = spark.range(5000).selectExpr(*[f"(id * {7 + i}) % {101 + i} AS c{i}" for i in range(24)])
    jobs = {}
    sc = spark.sparkContext
    for n in (1, 24):
        group = uuid.uuid4().hex
        sc.setJobGroup(group, "anchors")
        rows = column_anchors(df, [f"c{i}" for i in range(n)]).collect()
        jobs[n] = len(sc.statusTracker().getJobIdsForGroup(group))
        assert len(rows) == n
        sc.setJobGroup("", "")
    assert jobs[24] <= jobs[1] + 2

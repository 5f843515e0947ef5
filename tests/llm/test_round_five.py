"""What the review of round four found in the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from roundhouse.llm import neardup
from roundhouse.llm.common import Written


def test_vectors_are_stored_once_and_not_dealt_per_pair_of_tiles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 16))
    v[40:80] = v[5] + 0.03 * rng.normal(size=(40, 16))  # a group over several tiles
    v[200:230] = v[9]                                   # equal vectors
    df = spark.createDataFrame([(i, [float(z) for z in v[i]]) for i in range(300)], "vec_id long, embedding array<double>")
    plans, held, put = {}, {}, Written.put

    def seen(self, frame, name, *rest):
        plans[name] = frame._jdf.queryExecution().optimizedPlan().toString(), \
            frame._jdf.queryExecution().executedPlan().toString()
        out = put(self, frame, name, *rest)
        if "packed" in out.columns:
            held[name] = out.agg(F.sum(F.length("packed"))).first()[0]
        return out

    monkeypatch.setattr(Written, "put", seen)
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df, chunk=16, cell_rows=20).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = u @ u.T >= neardup.THRESHOLD
    assert [got[i]["n_links"] for i in range(300)] == [int(n) - 1 for n in link.sum(axis=1)]
    assert {got[i]["component_id"] for i in range(40, 80)} == {5} and {got[i]["component_id"] for i in range(200, 230)} == {9}
    bytes_each = 16 * 8
    assert max(held.values()) == held["vectors"] == 300 * bytes_each
    assert held["tiles"] == (300 - 30) * bytes_each  # each different vector once
    logical, physical = plans["found"]
    assert "Exchange" not in physical and "Generate" not in logical

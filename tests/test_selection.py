"""Order statistics against sorted lists."""

from __future__ import annotations

import random

import pytest

from clipweave.operators import selection


@pytest.mark.parametrize("held", [1, 5, 1000])
def test_nearest_ranks(spark, held):
    rnd = random.Random(held)
    makers = {"flat": lambda: rnd.random(), "one": lambda: 4.0, "few": lambda: rnd.choice([1.0, 2.0, -7.0]), "wide": lambda: rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 308), None: lambda: rnd.gauss(0, 1), "nan": lambda: rnd.choice([float("nan"), 3.0])}
    rows = [(k, f()) for k, f in makers.items() for _ in range(rnd.randint(60, 130))] + [("nulls", None), ("single", 2.5), ("flat", None)]
    q = {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.k: r for r in selection.nearest_ranks(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", q, held).collect()}
    assert "nulls" not in got
    for k in [*makers, "single"]:
        ordered = sorted(v for key, v in rows if key == k and v is not None and v == v)
        assert got[k].n == len(ordered)
        assert all(got[k][name] == ordered[round((len(ordered) - 1) * x)] for name, x in q.items())
    assert selection.nearest_ranks(spark.createDataFrame([], "k string, v double"), ["k"], "v", q).count() == 0


def test_frames_and_slices(spark):
    frames = lambda x: spark.createDataFrame(x, "rec string, frame int, time double, prob double")
    got = {r.rec: r for r in selection.compare_frames(frames([("a", 0, 0.0, 0.4), ("a", 1, 0.1, 0.6), ("b", 0, 0.0, 0.1)]), frames([("a", 0, 0.0, 0.5), ("a", 1, 0.2, 0.7), ("a", 2, 0.3, 0.7), ("c", 0, 0.0, 0.2)]), "rec").collect()}
    assert (got["a"].frames, got["a"].max, got["a"].p50, got["a"].changed, got["a"].unmatched, got["a"].moved) == (2, 0.1, 0.1, 1, 1, 1)
    assert (got["b"].frames, got["b"].max, got["b"].unmatched, got["c"].unmatched) == (0, 0.0, 1, 1)
    slices = spark.createDataFrame([(1, "r", 5, None), (2, "r", 4, '{"order_index": 0}'), (3, "r", 1, '{"order_index": 2, "is_superseded": false}'), (4, "r", 0, '{"is_superseded": true}'), (5, "q", 9, "{"), (6, "none", 0, None)], "id int, recording string, created_at int, metadata string")
    listed = selection.project_slices(slices, spark.createDataFrame([("r", "p"), ("q", "p")], "recording string, project string")).orderBy("place").collect()
    assert [(r.id, r.place) for r in listed] == [(5, 1), (2, 2), (1, 3), (3, 4)]

"""Schedules of many small buffers, and of those that go on over batches."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clipweave.operators import slicer


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


def test_buffers_in_one_pass(spark, small_batches):
    rng = np.random.default_rng(5)
    rows = []
    for k, n in enumerate([1, 40, 2, 3, 1, 7, 9, 1, 12]):
        for i in range(n):
            start = float(rng.integers(0, 30))
            end = start + float(rng.integers(3, 15))
            rows.append((None if k == 3 else f"r{k // 2}", k % 2, f"s{i}", f"e{i}", start, end, float(rng.integers(1, 10))))
    schema = "rec string, buf int, start_id string, end_id string, start double, end double, weight double"
    plan = slicer.schedule_clips(spark.createDataFrame(rows, schema), ["rec", "buf"])
    assert "FlatMapGroups" not in plan._jdf.queryExecution().executedPlan().toString()  # a frame of its own for each buffer
    clips = plan.collect()
    want = set()
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[4], r[5], r[2], r[3]))
        want |= {own[i] for i in slicer.schedule(*(np.array([r[c] for r in own]) for c in (4, 5, 6)))}
    assert {tuple(r) for r in clips} == want and len(clips) == len(want)
    used = slicer.used_cutpoints(spark.createDataFrame(clips, schema), ["rec", "buf"]).collect()
    ends = {(*r[:2], r[c], r[c + 2]) for r in want for c in (2, 3)}
    assert {tuple(r) for r in used} == ends and len(used) == len(ends)


def test_pairs_find_cuts_once(spark):
    cuts = spark.range(40).select(F.lit("r").alias("rec"), F.col("id").alias("cut_id"), F.row_number().over(Window.orderBy("id")).cast("double").alias("time"))
    pairs = slicer.legal_pairs(cuts, ["rec"])
    assert "Window" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == sum(3 <= b - a <= 15 for a in range(40) for b in range(40))

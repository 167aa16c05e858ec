"""Values that lie on a rounding's half or on a threshold: the engines must agree on them too."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from clipweave.functions import numeric
from clipweave.operators import refine
from clipweave.plans import catalogue
from tests.compare import duck, rows


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Events whose microseconds are odd multiples of 300, so that all frames' centers end in a half at the seventh place."""
    rnd, path = random.Random(4), tmp_path_factory.mktemp("tied")
    first = dt.datetime(2024, 1, 1)
    events = [(k, first + dt.timedelta(days=rnd.randrange(2), microseconds=300 * (2 * rnd.randrange(144_000_000) + 1)), k % 12, rnd.randrange(60000) / 100) for k in range(900)]
    c = duckdb.connect()
    c.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, value DOUBLE)")
    c.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", events)
    c.execute(f"COPY (SELECT *, 'view' AS event_type FROM e) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["cutpoints_detect", "cutpoints_dedupe", "buffer_cutpoints", "energy_regions", "cut_window_text", "cut_candidates", "region_candidates"])
def test_events_on_the_half(spark, tied, name):
    got, want = catalogue.QUERIES[name](spark, tied).toPandas(), duck(tied).execute(catalogue.ORACLE_SQL[name]).df()
    assert len(want) and rows(got) == rows(want)


def test_scaled_and_fused(spark):
    rnd = random.Random(3)
    x = [300 * (2 * rnd.randrange(144_000_000) + 1) / 6e8 for _ in range(3000)] + [-0.0000005, 0.5, 1e300]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x[:-1]], "x double").select(numeric.scaled(F.col("x"), 6)).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [x[:-1]]).fetchall()]
    abc = [(rnd.random(), rnd.random(), rnd.choice([0.0, 1.0, rnd.random()])) for _ in range(3000)]
    from fractions import Fraction

    got = [r[0] for r in spark.createDataFrame(abc, "a double, b double, c double").select(numeric.fused(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [float(Fraction(a) * Fraction(b) + Fraction(c)) for a, b, c in abc]


def test_edge_at_the_ratio(spark):
    # Each clip's edge has 0.65 of its mean, which the division of doubles takes for more.
    sizes = [19, 23, 38, 46, 76, 87, 92, 127]
    assert all(round(0.13 * k, 2) / round(0.2 * k, 2) > 0.65 for k in sizes)
    clips = [(k, 0, 0.0, 2.0, None, None, False, 2.0) for k in sizes]
    frames = [(k, at, round(x * k, 2)) for k in sizes for at, x in ((0.0, 0.13), (1.0, 0.34), (2.0, 0.13))]
    c = spark.createDataFrame(clips, "rec int, clip int, start double, end double, safe_start double, safe_end double, breath boolean, total double")
    got = refine.refine(c, spark.createDataFrame(frames, "rec int, at double, level double"), ["rec"]).collect()
    assert len(got) == 8 and {r.flags for r in got} == {""}

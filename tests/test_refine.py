"""Window means and clip refinement against plain statements of their rules."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from clipweave.operators import curves, refine
from clipweave.operators.ordering import running_sums


def plain_mean(lo, hi, frames):
    if not frames or hi <= lo:
        return 0.0
    inside = [level for at, level in frames if lo <= at <= hi]
    if inside:
        return sum(inside) / len(inside)
    return min(frames, key=lambda f: (abs(f[0] - (lo + hi) / 2), f[0]))[1]


def plain_snap(lo, hi, frames):
    if hi <= lo:
        return lo
    inside = [f for f in frames if lo <= f[0] <= hi]
    if not inside:
        return (lo + hi) / 2
    low = min(level for _, level in inside)
    return min((f for f in inside if f[1] <= max(low * 1.15, low + 1e-6)), key=lambda f: abs(f[0] - (lo + hi) / 2))[0]


def plain_refine(clips, total, frames):
    bounds = [[c["start"], c["end"], False, False] for c in clips]
    for k in range(len(clips) - 1):
        a, b = clips[k], clips[k + 1]
        lo, hi = (a["safe_start"], a["safe_end"]) if a["safe_start"] is not None else (a["end"] + 0.045, b["start"] - 0.035)
        bounds[k][1] = bounds[k + 1][0] = plain_snap(lo, hi, frames)
        bounds[k][3] = bounds[k + 1][2] = bool(a["breath"])
    out = []
    for c, (t0, t1, b0, b1) in zip(clips, bounds, strict=True):
        es, ee, m = plain_mean(t0, min(t0 + 0.025, total), frames), plain_mean(max(0.0, t1 - 0.025), t1, frames), plain_mean(t0, t1, frames)
        flags = []
        if m > 0:
            flags += [f"high_start_edge_energy_{es / m:.2f}"] * (es / m > 0.65) + [f"high_end_edge_energy_{ee / m:.2f}"] * (ee / m > 0.65)
        before, after, length = max(0.0, c["start"] - t0), max(0.0, t1 - c["end"]), max(0.0, t1 - t0)
        flags += [f"leading_silence_{before:.2f}s"] * (before > 0.65) + [f"trailing_silence_{after:.2f}s"] * (after > 0.65)
        if length > 0:
            speech = max(0.0, min(1.0, (c["end"] - c["start"]) / length))
            flags += [f"low_speech_ratio_{speech:.2f}"] * (speech < 0.72)
        out.append((c["clip"], pytest.approx(t0), pytest.approx(t1), b0, b1, pytest.approx(es), pytest.approx(ee), pytest.approx(m), [f.rsplit("_", 1)[0] for f in flags]))
    return out


def test_means_and_refinement(spark):
    rnd = random.Random(2)
    clips, frames = [], []
    for rec in ("a", "b", "c"):
        at = 0.3
        for k in range(rnd.choice([1, 9])):
            end = at + rnd.uniform(0.4, 3)
            bounded = rnd.random() < 0.5
            nxt = end + rnd.choice([0.0, 0.05, 0.4, 2.5])
            clips.append((rec, k, at, end, end + 0.045 if bounded else None, nxt - 0.035 if bounded else None, rnd.random() < 0.4, 60.0))
            at = nxt
        if rec != "c":  # a recording without frames
            frames += [(rec, round(0.07 * k, 4), rnd.choice([0.01, 0.2, rnd.random()])) for k in range(500)]
    c = spark.createDataFrame(clips, "rec string, clip int, start double, end double, safe_start double, safe_end double, breath boolean, total double")
    f = spark.createDataFrame(frames, "rec string, at double, level double").repartition(3)
    got = {}
    for r in refine.refine(c, f, ["rec"]).orderBy("rec", "clip").collect():
        flags = [x.rsplit("_", 1)[0] for x in r.flags.split(" | ")] if r.flags else []
        got.setdefault(r.rec, []).append((r.clip, r.training_start, r.training_end, r.breath_at_start, r.breath_at_end, r.edge_start, r.edge_end, r.mean_level, flags))
    names = ["rec", "clip", "start", "end", "safe_start", "safe_end", "breath"]
    for rec in got:
        assert got[rec] == plain_refine([dict(zip(names, x, strict=False)) for x in clips if x[0] == rec], 60.0, [x[1:] for x in frames if x[0] == rec])


def test_window_means_over_any_partitions(spark):
    rnd = random.Random(5)
    frames = [(k % 2, 1.0 * (k // 2) if k < 60 else rnd.uniform(0, 90), rnd.random()) for k in range(300)]
    windows = [(k % 3, k, lo := rnd.uniform(-5, 95), lo + rnd.choice([0.0, -1.0, 0.001, 0.5, 40.0])) for k in range(200)] + [(0, 900, 1.0, 2.0)]
    w = spark.createDataFrame(windows, "k int, id int, w_start double, w_end double").repartition(4)
    got = refine.window_means(w, spark.createDataFrame(frames, "k int, at double, level double").repartition(5), ["k"], "id").collect()
    assert len(got) == len(windows)
    want = {i: plain_mean(lo, hi, [f[1:] for f in frames if f[0] == k]) for k, i, lo, hi in windows}
    assert all(r.mean == pytest.approx(want[r.id]) for r in got)
    assert refine.window_means(w.limit(0), spark.createDataFrame([], "k int, at double, level double"), ["k"], "id").count() == 0


def test_running_sums_in_one_pass(spark):
    d = spark.createDataFrame([(k, float(k % 5)) for k in range(100)], "k int, v double").repartition(7)
    got = sorted((r.k, r.n, r.s) for r in running_sums(d, ["k"], {"n": F.lit(1).cast("long"), "s": F.col("v")}).collect())
    assert got == [(k, k + 1, float(sum(j % 5 for j in range(k + 1)))) for k in range(100)]


def test_bootstrap_is_a_resample(spark):
    # Of units whose difference is known: each draws as many units as there are, with replacement, and the interval holds the difference of all rows.
    rnd = random.Random(6)
    rows = [(f"u{u}", int(y), rnd.gauss(y, 1), rnd.gauss(0.2 * y, 1)) for u in range(30) for y in (0, 1) for _ in range(6)]
    d = spark.createDataFrame(rows, "unit string, y int, a double, b double")
    drawn = curves.resampled(d.select("unit").distinct(), "unit", 200).groupBy("replicate").agg(F.sum("w").alias("n"), F.count("*").alias("units")).collect()
    assert len(drawn) == 200 and all(r.n == 30 for r in drawn) and 15 < sum(r.units for r in drawn) / 200 < 23
    auc = lambda c: sum((p[c] > q[c]) + 0.5 * (p[c] == q[c]) for p in rows for q in rows if p[1] and not q[1]) / (180 * 180)
    got = curves.interval(curves.bootstrap(d, "unit", "y", ("a", "b"), 200)).first()
    assert got.replicates == 200 and got.low < auc(2) - auc(3) < got.high and got.high - got.low < 0.3
    assert curves.bootstrap(d, "unit", "y", ("a", "b"), 5).orderBy("replicate").collect() == curves.bootstrap(d.repartition(9), "unit", "y", ("a", "b"), 5).orderBy("replicate").collect()


def test_planned_clips_share_their_boundaries(spark, sf_dir):
    from clipweave.plans import catalogue

    groups = {}
    for r in catalogue.QUERIES["planned_clips"](spark, sf_dir).collect():
        groups.setdefault((r.conv_id, r.turn), []).append(r)
    assert any(len(g) > 2 for g in groups.values())
    for g in groups.values():
        g.sort(key=lambda r: r.clip)
        assert [r.clip for r in g] == list(range(len(g)))
        assert g[0].training_start == g[0].start and g[-1].training_end == g[-1].end
        for a, b in zip(g, g[1:], strict=False):
            assert a.training_end == b.training_start and a.end <= b.start
            # The shared moment lies in the guarded gap, if there is one.
            assert a.training_end == pytest.approx(a.end + 0.045) or a.end + 0.045 - 1e-9 <= a.training_end <= b.start - 0.035 + 1e-9


@pytest.fixture
def planned(spark, monkeypatch):
    """Names and plans of the tables that refinement writes, where Spark may broadcast whatever it takes for small."""
    plans, write = [], refine.written

    def noted(df, name="table"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(refine, "written", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield plans, noted
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_frames_stay_off_the_driver(spark, sf_dir, planned):
    # Frames are many times the texts that they are made of, by which Spark judges their size.
    from clipweave.plans import catalogue

    assert catalogue.QUERIES["acoustic_boundaries"](spark, sf_dir).count()
    met = [plan for name, plan in planned[0] if name == "beside"]
    assert met and all("SortMergeJoin" in plan and "Broadcast" not in plan for plan in met)


def test_gaps_of_the_planner_stay_off_the_driver(spark, sf_dir, planned, monkeypatch):
    from clipweave.plans import catalogue, planner

    monkeypatch.setattr(planner, "written", planned[1])
    assert catalogue.QUERIES["planned_clips"](spark, sf_dir).count()
    plans = {}
    for name, plan in planned[0]:
        plans.setdefault(name, []).append(plan)
    assert {"scored_gaps", "scored_words", "planned", "beside"} <= set(plans)
    assert all("BroadcastHashJoin" not in plan for name in ("scored_gaps", "scored_words", "beside") for plan in plans[name])
    assert all(plan.count("BroadcastHashJoin") <= 1 for plan in plans["planned"])  # the turns' lengths

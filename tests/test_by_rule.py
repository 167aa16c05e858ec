"""Queries that SQL doesn't state, against plain statements of their rules, on the smallest tables."""

from __future__ import annotations

import itertools

import pytest

from clipweave.operators import intervals as iv
from clipweave.operators import review, slicer, state, vectors
from clipweave.plans import catalogue, slicer as plans
from clipweave.plans.intervals import words


def by_key(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


@pytest.fixture(scope="module")
def pairs(spark, sf_dir):
    p = slicer.legal_pairs(plans.cutpoints(spark, sf_dir), ["user_id", "day"]).collect()
    return by_key(p, "user_id", "day")


def test_schedule(spark, sf_dir, pairs):
    got = by_key(catalogue.QUERIES["schedule_wis"](spark, sf_dir).collect(), "user_id", "day")
    used = by_key(catalogue.QUERIES["schedule_used_cutpoints"](spark, sf_dir).collect(), "user_id", "day")
    assert got.keys() == pairs.keys() == used.keys()
    for k, clips in got.items():
        rows = sorted(pairs[k], key=lambda r: r.end)
        best = [0.0]
        for r in rows:
            best.append(max(best[-1], r.weight + max(b for b, e in zip(best, [float("-inf"), *[x.end for x in rows]]) if e <= r.start + 1e-12)))  # noqa: B905
        assert sum(c.weight for c in clips) == pytest.approx(best[-1])
        ordered = sorted(clips, key=lambda c: c.start)
        assert all(a.end <= b.start + 1e-9 for a, b in itertools.pairwise(ordered)) and {c.start_id for c in clips} <= {r.start_id for r in rows}
        assert {r.cut_id for r in used[k]} == {c.start_id for c in clips} | {c.end_id for c in clips}


def test_suppression(spark, sf_dir, pairs):
    got = by_key(catalogue.QUERIES["nms_greedy"](spark, sf_dir).collect(), "user_id", "day")
    for k, rows in pairs.items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.weight, r.start, f"{r.start_id}/{r.end_id}")):
            shared = lambda o: max(0.0, min(r.end, o.end) - max(r.start, o.start)) / max(min(r.end - r.start, o.end - o.start), 0.001)  # noqa: B023, E731
            if all(shared(o) < 0.5 for o in kept):
                kept.append(r)
        assert {r.pair for r in got[k]} == {f"{r.start_id}/{r.end_id}" for r in kept}


def test_short_clips(spark, sf_dir):
    got = by_key(catalogue.QUERIES["short_clips_merged"](spark, sf_dir).collect(), "conv_id", "turn")
    for k, w in by_key(words(spark, sf_dir).collect(), "conv_id", "turn").items():
        clips = [[min(x.start for x in g), max(x.end for x in g), 1] for g in by_key([{"k": r.pos // 5, **r.asDict()} for r in w], "k").values() for g in [[type(w[0])(**{n: d[n] for n in d if n != "k"}) for d in g]]]
        clips.sort()
        i = 0
        while i < len(clips) and len(clips) > 1:
            if clips[i][1] - clips[i][0] >= 2.0:
                i += 1
                continue
            length = lambda n: clips[n][1] - clips[n][0]
            if i == 0 or i == len(clips) - 1:
                j = 1 if i == 0 else i - 1
            else:  # the two lengths count, not what lies between the clips
                j = i - 1 if abs(length(i - 1) + length(i) - 7.0) <= abs(length(i + 1) + length(i) - 7.0) else i + 1
            a, b = sorted((i, j))
            clips[a : b + 1] = [[clips[a][0], max(clips[a][1], clips[b][1]), clips[a][2] + clips[b][2]]]
            i = a
        assert sorted((r.start, r.end, r.parts) for r in got[k]) == [tuple(c) for c in clips]


def test_greedy_groups_by_rule(spark, sf_dir):
    got = by_key(catalogue.QUERIES["greedy_group"](spark, sf_dir).collect(), "conv_id", "turn")
    for k, w in by_key(plans.said(spark, sf_dir).collect(), "conv_id", "turn").items():
        w.sort(key=lambda r: (r.start, r.end, r.pos))
        strength = {}
        for i, (a, b) in enumerate(itertools.pairwise(w)):
            gap = (b.start - 0.035) - (a.end + 0.045)
            if gap >= 0.12 and a.acoustic >= 0.35:
                strength[i] = (0.35 * min(gap / 0.24, 1.0) + 0.65 * a.acoustic, gap)
        clips, i = [], 0
        while i < len(w):
            under, over = [], None
            for j in sorted(x for x in strength if x >= i):
                d = w[j].end - w[i].start
                if d > 15.0:
                    over = j
                    break
                if d >= 2.0:
                    score = 0.55 * (1 - min(abs(d - 7) / 5, 1)) + 0.45 * strength[j][0] - (0.35 * min((d - 10) / 5, 1) if d > 10 else 0)
                    under.append((score, *strength[j], -j))
            last = -max(under)[-1] if under else over if over is not None else len(w) - 1
            clips.append((i, last))
            i = last + 1
        assert [(r.first, r.last) for r in sorted(got[k], key=lambda r: r.clip)] == clips


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(3, 0), (90, 91)], "parent long, child long")
    roots = spark.createDataFrame([(0,)], "node long")
    assert {(r.node, r.depth) for r in state.closure(edges, roots).collect()} == {(k, k) for k in range(41)}
    with pytest.raises(ValueError):
        state.closure(edges, roots, max_depth=3)
    assert state.closure(edges, roots.where("false")).count() == 0


def test_stream_job_states(spark, sf_dir):
    got = by_key(catalogue.QUERIES["stream_job_states"](spark, sf_dir).collect(), "job_id")
    events = by_key(spark.read.parquet(f"{sf_dir}/events.parquet").collect(), "user_id")
    assert got.keys() == events.keys()
    for k, rows in events.items():
        status, beats, last = "pending", 0, None
        for r in sorted(rows, key=lambda r: r.ts):
            if r.event_type == "signup" and status == "pending":
                status = "running"
            elif r.event_type == "purchase" and status == "running":
                status = "done"
            elif r.event_type not in ("signup", "purchase") and status == "running":
                if (r.ts - last).total_seconds() >= 86_400:
                    status = "failed"
                else:
                    beats += 1
            last = r.ts
        assert any((r.status, r.beats) in ((status, beats), ("failed" if status == "running" else status, beats)) for r in got[k])


def test_points_in_and_window_mean_edges(spark):
    frames = spark.createDataFrame([("a", float(t), float(t % 7)) for t in range(0, 100, 3)] + [("b", 5.0, 2.0)], "k string, at double, level double")
    windows = spark.createDataFrame([(1, "a", 0.0, 10.0), (2, "a", 1.0, 2.0), (3, "a", 500.0, 600.0), (4, "b", -9.0, -8.0), (5, "c", 0.0, 1.0), (6, "a", 50.0, 40.0)], "id int, k string, w_start double, w_end double")
    for bucket in (1.0, 7.0, 1000.0):
        got = {r.id: r.mean_level for r in review.window_mean(windows, frames, ["k"], "id", bucket).collect()}
        assert got == {1: (0 + 3 + 6 + 2) / 4, 2: 0.0, 3: 99 % 7, 4: 2.0, 5: 0.0, 6: 45 % 7}
        inside = iv.points_in(frames, windows.select("id", "k", "w_start", "w_end"), ["k"], "at", "w_start", "w_end", bucket, (windows.w_start <= frames.at) & (frames.at <= windows.w_end))
        assert sorted((r.id, r.at) for r in inside.collect()) == [(1, 0.0), (1, 3.0), (1, 6.0), (1, 9.0)]


def test_broadcast_check(spark):
    with pytest.raises(ValueError):
        vectors.checked(spark.range(11), most=10)
    assert vectors.checked(spark.range(10), most=10).count() == 10

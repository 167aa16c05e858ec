"""Operators on small hand-worked tables."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipweave.operators import curves, density, export, ordering, qc, scoring, signal, slicer, state, vectors
from clipweave.operators import intervals as iv
from clipweave.operators.candidates import suppress


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_gate_cases(spark):
    s = "clip_id string, match double, check double, calibrated boolean, missing boolean, override string, duration double, reason_codes array<string>"
    rows = [("c1", 87.0, 74.0, True, False, None, 1.0, None), ("c2", 52.0, 82.0, True, False, None, 2.0, None), ("c3", 91.0, 43.0, True, False, None, 4.0, ["contains_oov"]), ("c4", None, None, None, False, None, 8.0, None), ("c5", 99.0, 99.0, True, True, "force_keep", 16.0, None), ("c6", 99.0, 99.0, False, False, "force_keep", 32.0, None)]
    d = {r.clip_id: r for r in qc.decide(table(spark, rows, s), 85, 70).collect()}
    assert [d[k].status for k in sorted(d)] == ["accepted", "rejected", "rejected", "rejected", "rejected", "accepted"]
    assert d["c3"].reasons == ["contains_oov", "speaker_below_threshold"] and d["c4"].failed == ["missing_transcript_score", "missing_speaker_score"] and d["c6"].failed == ["speaker_score_uncalibrated"]
    r = qc.summarise(qc.decide(table(spark, rows, s), 85, 70), 85, 70).first()
    assert (r.accepted, r.rejected, r.failed_both, r.failed_transcript, r.failed_speaker, r.force_kept) == (2, 4, 1, 1, 1, 1)


def test_unique_or_fail(spark):
    good = table(spark, [(1,), (2,)], "id int")
    assert qc.unique_or_fail(good, "id").count() == 2
    with pytest.raises(Exception, match="repeats"):
        qc.unique_or_fail(good.unionByName(good), "id").collect()


def test_row_numbers_and_sums(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    out, n = ordering.with_row_number(df, ["k"])
    assert n == 1000 and out.where("row_number <> k + 1").count() == 0
    assert ordering.running_sum(df, ["k"], F.lit(1), "s").where("s <> k + 1").count() == 0
    empty, n = ordering.with_row_number(df.where("k < 0"), ["k"])
    assert n == 0 and empty.count() == 0


def merged(spans, gap=0.0):
    out = []
    for s, e in sorted(x for x in spans if x[0] < x[1]):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap", [0.0, 2.0])
def test_union_against_loop(spark, gap):
    rnd = random.Random(4)
    rows = [(k, float(s), float(s + rnd.randint(0, 6))) for k in (1, 2) for s in [rnd.randint(0, 90) for _ in range(30)]]
    got = iv.union(table(spark, rows, "k int, start double, end double"), ["k"], gap=gap).collect()
    for k in (1, 2):
        assert sorted((r.start, r.end) for r in got if r.k == k) == merged([(s, e) for kk, s, e in rows if kk == k], gap)


def test_intruded_gap_blocks_merge(spark):
    t = table(spark, [("r", 0.0, 2.0), ("r", 3.0, 4.0), ("r", 6.0, 7.0)], "k string, start double, end double")
    o = table(spark, [("r", 4.5, 5.0)], "k string, start double, end double")
    got = sorted((r.start, r.end, r.parts, r.blocked) for r in iv.merge_unless_intruded(t, o, ["k"], 2.0).collect())
    assert got == [(0.0, 4.0, 2, 0), (6.0, 7.0, 1, 1)]


def test_bucketed_range_join_equals_plain(spark):
    rnd = random.Random(1)
    make = lambda p: table(spark, [(i % 2, i, float(s), float(s + rnd.randint(1, 40))) for i, s in enumerate(rnd.choices(range(200), k=60))], f"k int, {p} int, {p}s double, {p}e double")
    a, b = make("a"), make("b")
    plain = sorted((x.a, y.b) for x in a.collect() for y in b.collect() if x.k == y.k and x["as"] < y.be and y.bs < x.ae)
    assert plain and plain == sorted((r.a, r.b) for r in iv.range_join(a, b, ["k"], "as", "ae", "bs", "be", bucket=16.0).collect())


def test_windows(spark):
    d = table(spark, [(1, 2.0), (2, 7.2)], "id int, seconds double")
    assert sorted((r.id, r.window_start, r.window_end) for r in iv.sliding_windows(d, "seconds", 3.0, 2.0).collect()) == [(1, 0.0, 2.0), (2, 0.0, 3.0), (2, 2.0, 5.0), (2, 4.0, 7.0)]
    assert [r.chunk for r in iv.fixed_chunks(d.where("id = 2"), "seconds", 3.0).collect()] == [0, 1]
    r = table(spark, [(0.0, 10.0)], "start double, end double")
    assert sorted(x.window_start for x in iv.candidate_windows(r, 4.0, 0.75).collect()) == [0.0, 3.0, 6.0]


def test_valley_of_frames(spark):
    rows = []
    for i in range(200):
        c = 0.1 + 0.032 * i
        quiet = 3.9 <= c <= 4.2
        rows.append(("r", "b", i, c, c - 0.016, c + 0.016, 0.04 if quiet else 0.92, -55.0 if quiet else -18.0))
    f = table(spark, rows, "rec string, buf string, pos int, center double, start double, end double, prob double, rms double")
    cuts = slicer.detect_cutpoints(f, ["rec", "buf"]).collect()
    assert len(cuts) == 1 and abs(cuts[0].time - 4.05) <= 0.08


def test_pairs_and_schedule(spark):
    cuts = table(spark, [("r", "b", f"c{i}", t) for i, t in enumerate([1.0, 3.5, 9.0, 17.5])], "rec string, buf string, cut_id string, time double")
    legal = {(r.start, r.end) for r in slicer.legal_pairs(cuts, ["rec", "buf"]).collect()}
    assert (1.0, 9.0) in legal and (1.0, 3.5) not in legal and (1.0, 17.5) not in legal
    cuts = table(spark, [("r", "b", f"c{i}", t) for i, t in enumerate([0.5, 8.5, 15.0])], "rec string, buf string, cut_id string, time double")
    got = [(r.start, r.end) for r in slicer.schedule_clips(slicer.legal_pairs(cuts, ["rec", "buf"]), ["rec", "buf"]).collect()]
    assert (0.5, 8.5) in got


def test_schedule_is_heaviest():
    rnd = random.Random(2)
    for _ in range(60):
        n = rnd.randint(1, 9)
        s = np.array([rnd.randint(0, 20) for _ in range(n)], float)
        e = s + np.array([rnd.randint(1, 8) for _ in range(n)], float)
        w = np.array([rnd.randint(1, 9) for _ in range(n)], float)
        best = max(sum(w[i] for i in c) for k in range(n + 1) for c in itertools.combinations(range(n), k) if all(e[i] <= s[j] or e[j] <= s[i] for i, j in itertools.combinations(c, 2)))
        got = slicer.schedule(s, e, w)
        assert w[got].sum() == best and all(e[i] <= s[j] or e[j] <= s[i] for i, j in itertools.combinations(got, 2))


def test_suppression(spark):
    d = table(spark, [("r", "a", 0.0, 4.0, 0.9), ("r", "b", 1.0, 5.0, 0.8), ("r", "c", 4.5, 8.0, 0.7)], "k string, id string, start double, end double, score double")
    assert sorted(r.id for r in suppress(d, ["k"], "score", "id", 0.5).collect()) == ["a", "c"]


def test_clamped_words(spark):
    d = table(spark, [(1, "alpha", 0.0, 0.5), (1, "beta", 0.49, 1.0), (1, "gamma", 1.2, 1.2)], "k int, word string, start double, end double")
    got = [(r.word, r.start) for r in slicer.keep_order_clamp(d, ["k"]).orderBy("pos").collect()]
    assert got == [("alpha", 0.0), ("beta", 0.5)]


@pytest.mark.parametrize(("seconds", "want"), [(6, 1.0), (7, 1.0), (9, 1.0), (4, 0.84), (11, 0.92), (0, 0.52), (40, 0.0)])
def test_duration_preference(spark, seconds, want):
    assert spark.range(1).select(scoring.duration_preference(F.lit(float(seconds)))).first()[0] == pytest.approx(want)


def test_reference_quality_golden(spark):
    d = table(spark, [(0.8, 0.6, 8.0, 80.0, 0.5)], "mean_similarity double, p10_similarity double, seconds double, transcript_score double, position_preference double")
    assert scoring.reference_quality(d).first().reference_quality_score == pytest.approx(73.5)


def test_curves(spark):
    d = table(spark, [(95.0, 1.0), (86.0, 2.0), (None, 4.0), (100.0, 8.0)], "m double, w double")
    h = {r.bin: r.n for r in curves.histogram(d, "m", 20).collect()}
    assert len(h) == 20 and h[19] == 2 and h[17] == 1 and sum(h.values()) == 3
    y = {r.threshold: (r.clips, r.seconds) for r in curves.yield_curve(d, "m", "w").collect()}
    assert y == {0.0: (3, 11.0), 86.0: (3, 11.0), 95.0: (2, 9.0), 100.0: (1, 8.0)}


def test_one_class_has_no_auc(spark):
    d = table(spark, [("a", 1, 0.5), ("a", 1, 0.7), ("b", 1, 0.5), ("b", 0, 0.5)], "g string, y int, s double")
    got = {r.g: (r.auc, r.ap) for r in curves.ranking_metrics(d, "y", "s", ["g"]).collect()}
    assert got == {"a": (None, None), "b": (0.5, 0.5)}


def test_export_and_index(spark):
    m = table(spark, [("a", 1, 100, 200, 16000), ("b", 1, 100, 200, 8000), ("c", 9, 0, 5, None), ("d", 1, 100, 200, 44100), ("e", 1, 5, 5, 44100)], "clip_id string, source_id int, start_sample bigint, end_sample bigint, coordinate_rate int")
    d = table(spark, [(c, "accepted") for c in "abce"], "clip_id string, status string")
    s, v = table(spark, [(1, 44100, 1000)], "source_id int, sample_rate int, num_samples bigint"), table(spark, [(1, 16000)], "source_id int, analysis_rate int")
    got = {r.clip_id: (r.reason, r.native_start) for r in export.export_clips(m, d, s, v).collect()}
    assert got["a"] == (None, 276) and got["b"][0] == "invalid_candidate_sample_coordinates" and got["c"][0] == "missing_source_or_analysis_variant" and got["d"][0] == "missing_dataset_qc_clip" and got["e"][0] == "empty_native_span"


def test_edits(spark):
    op = "struct<kind:string,start_sample:bigint,end_sample:bigint,duration_samples:bigint>"
    ops = [("delete_range", 1, 3, None), ("insert_silence", 1, None, 2)]
    d = table(spark, [([1.0, 2.0, 3.0, 4.0], ops)], f"x array<double>, ops array<{op}>")
    r = d.select(state.apply_edits(F.col("x"), F.col("ops")).alias("x"), state.timeline_length(F.lit(4).cast("bigint"), F.col("ops")).alias("n"), state.edits_valid(F.lit(4).cast("bigint"), F.lit(16000), F.col("ops")).alias("ok"), state.edits_valid(F.lit(2).cast("bigint"), F.lit(16000), F.col("ops")).alias("bad")).first()
    assert (r.x, r.n, r.ok, r.bad) == ([1.0, 0.0, 0.0, 4.0], 4, True, False)


def test_edit_log(spark):
    e = table(spark, [("c", 1, 0, "accepted", None), ("c", 2, 0, "rejected", None), ("c", 3, 1, None, "new")], "clip string, n int, expected_version bigint, review_status string, transcript string")
    r = state.fold_edits(e, "clip", "n").first()
    assert (r.version, r.status, r.transcript, r.refused) == (2, "unresolved", "new", 1)


def test_outliers_and_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, (np.eye(4)[i % 2] + rng.normal(0, 0.02, 4)).tolist()) for i in range(40)] + [(0, 99, [-1.0, -1.0, 1.0, 1.0])]
    d = table(spark, rows, "k int, id int, v array<double>")
    low = min(vectors.leave_one_out(d, ["k"], "v", 4).collect(), key=lambda r: r.loo_similarity)
    assert low.id == 99
    labels = {r.id: r.cluster for r in density.density_clusters(d, "id", "v", 5).collect()}
    assert labels[99] == -1 and labels[0] != labels[1] and {labels[i] for i in range(0, 40, 2)} == {labels[0]}


def test_signal(spark):
    x = [float(np.sin(2 * np.pi * 200 * i / 8000)) for i in range(800)]
    r = table(spark, [(x, [0.5] * 10)], "x array<double>, c array<double>").select(
        signal.pitch("x", F.lit(8000.0)).alias("p"), signal.spectral_centroid("x", F.lit(8000.0)).alias("f"), signal.rms(F.col("x")).alias("l"), F.size(signal.resample("x", F.lit(8000.0), F.lit(4000.0))).alias("n"),
        signal.correlation(F.col("c"), F.col("c")).alias("k"), signal.choose_channel(F.col("x"), F.transform("x", lambda v: v * 0.0)).alias("ch"),
    ).first()
    assert r.p == pytest.approx(200, rel=0.03) and r.f == pytest.approx(200, rel=0.05) and r.l == pytest.approx(0.7071, abs=1e-3) and r.n == 400 and r.k == 1.0 and r.ch == "left"


def test_signature(spark):
    x = [float(0.5 * np.sin(2 * np.pi * 200 * i / 8000)) for i in range(4000)]
    r = table(spark, [(x, [0.0] * 2000, [])], "x array<double>, z array<double>, e array<double>").select(signal.signature(F.col("x"), 8000).alias("s"), signal.signature(F.col("z"), 8000).alias("z"), signal.signature(F.col("e"), 8000).alias("e"), signal.spectral_flatness("x").alias("f")).first()
    assert len(r.s) == 28 and r.s[0] == pytest.approx(0.3536, abs=1e-3) and r.s[4] == pytest.approx(0.5) and r.s[3] == pytest.approx(0.05, abs=2e-3)
    assert r.s[7] == pytest.approx(200, rel=0.05) and r.f < 0.1 and set(r.z) == {0.0} and set(r.e) == {0.0}

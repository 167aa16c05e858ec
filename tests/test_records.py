"""Artifact rows at their edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clipweave.operators import records


def test_missing_partners_are_errors(spark):
    segments = spark.createDataFrame([("a", 0, 5)], "source_audio_id string, start_sample long, end_sample long")
    with pytest.raises(Exception, match="no path"):
        records.single_speaker_regions(segments, spark.createDataFrame([], "source_audio_id string, path string")).collect()
    clips = spark.createDataFrame([(1, 1, 2)], "clip_id int, start_cut int, end_cut int")
    cuts = spark.createDataFrame([(1, 1.0, 0.5, 1.5, -40.0, 0.1, 3.0)], "cut_id int, time_sec double, interval_start_sec double, interval_end_sec double, rms double, vad double, score double")
    with pytest.raises(Exception, match="cut is missing"):
        records.edge_features(clips, cuts).collect()


def test_selection_follows_what_is_there(spark):
    regions = spark.createDataFrame([("r", "speaker_1"), ("r", "speaker_0"), ("q", "speaker_0")], "run string, speaker_id string")
    previous = spark.createDataFrame([("r", " speaker_1 ", ""), ("q", "speaker_9", "user"), ("gone", "speaker_0", "user")], "run string, target string, source string")
    got = {r.run: (r.selected, r.target, r.source, r.available, r.reasons) for r in records.carried_selections(regions, previous).collect()}
    assert got["r"] == (True, "speaker_1", "user", ["speaker_0", "speaker_1"], [])
    assert got["q"] == (False, None, "pending_user_selection", ["speaker_0"], ["speaker_selection_required"])
    assert got["gone"][0] is False and got["gone"][3] == []


def test_trims(spark):
    asked = [(None, None), (1.0, None), (float("nan"), 2.0), (2.0, 2.0), (-1e-7, 3.0), (-1.0, 3.0), (1.0 - 1e-7, 3.0), (0.5, 3.0), (1.0, 9.0), (1.0, 10.0 + 1e-7), (2.0, 4.0)]
    d = spark.createDataFrame([(k, *a) for k, a in enumerate(asked)], "k int, s double, e double")
    got = [tuple(r.t) for r in d.select("k", records.trim_bounds(F.lit(1.0), F.lit(5.0), F.lit(10.0), F.col("s"), F.col("e")).alias("t")).orderBy("k").collect()]
    problems = [None, "trim_needs_both_bounds", "trim_not_finite", "trim_not_positive", "trim_outside_candidate", "trim_outside_source", None, "trim_outside_candidate", "trim_outside_candidate", "trim_outside_candidate", None]
    assert [g[2] for g in got] == problems
    assert got[0][:2] == (1.0, 5.0) and got[6][:2] == (1.0, 3.0) and got[10][:2] == (2.0, 4.0)


def test_empty_tables_give_empty_results(spark):
    assert records.channel_modes(spark.createDataFrame([], "at int, source_audio_id string, kind string, recipe string")).collect() == []
    none = spark.createDataFrame([], "run int, no_speech_prob double")
    assert [tuple(r) for r in records.metadata_gaps(spark.createDataFrame([(1,)], "run int"), none, none.withColumnRenamed("no_speech_prob", "probability")).collect()] == [(1, ["no_speech_prob"])]

"""Readers, sinks and streams on files of their own."""

from __future__ import annotations

import json
import wave

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipweave.sources import readers, sinks
from clipweave.streaming import jobs

CLIP = T.StructType([T.StructField("clip_id", T.StringType()), T.StructField("score", T.DoubleType())])


def test_clip_documents(spark, tmp_path):
    rows = [{"clip_id": "a", "score": 1.0}, {"clip_id": "b", "score": None}]
    for name, content in (("bare", rows), ("wrapped", {"schema_version": 1, "clips": rows})):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
        assert sorted(r.clip_id for r in readers.clips(spark, str(tmp_path / f"{name}.json"), CLIP).collect()) == ["a", "b"]
    (tmp_path / "new.json").write_text(json.dumps({"schema_version": 2, "clips": rows}))
    with pytest.raises(Exception, match="unknown schema_version"):
        readers.clips(spark, str(tmp_path / "new.json"), CLIP).collect()


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"clip_id": "a", "score": 1}\n\n{"clip_id": "b"}\n')
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), CLIP).count() == 2
    (tmp_path / "y.jsonl").write_text('{"clip_id": "a"}\nnot json\n')
    with pytest.raises(Exception, match="[Mm]alformed"):
        readers.json_lines(spark, str(tmp_path / "y.jsonl"), CLIP).collect()
    assert [r.bad_line for r in readers.json_lines_checked(spark, str(tmp_path / "y.jsonl"), CLIP).collect() if r.bad_line] == ["not json"]


def test_wav_headers(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 4 * 4000)
    r = readers.wav_headers(spark, str(tmp_path / "*.wav")).first()
    assert (r.sample_rate, r.channels, r.bits, r.frames, r.duration_sec) == (8000, 2, 16, 4000, 0.5)


def test_publish_replaces_whole(spark, tmp_path):
    target = str(tmp_path / "t")
    sinks.publish(spark.range(3), target)
    sinks.publish(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5
    with pytest.raises(ValueError, match="not published"):
        sinks.publish(spark.range(1), target, problems=spark.range(1))
    assert spark.read.parquet(target).count() == 5


def test_export_files(spark, tmp_path):
    d = spark.createDataFrame([("a", None), ("b", "late"), ("c", "late")], "clip_id string, reason string")
    sinks.write_export(d, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/accepted")).count() == 1
    assert spark.read.json(str(tmp_path / "out/summary")).first().clips == 2
    sinks.write_csv(d, str(tmp_path / "csv"))
    assert readers.csv_rows(spark, str(tmp_path / "csv")).count() == 3
    assert sinks.clear_downstream(spark, str(tmp_path / "out"), "decided", ["decided", "accepted", "audit"]) == ["accepted", "audit"]


def test_stream_of_jobs(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "claim"), (1, "2024-01-01 00:00:30", "heartbeat"), (1, "2024-01-01 00:00:50", "done"), (2, "2024-01-01 00:00:00", "claim"), (2, "2024-01-01 00:10:00", "heartbeat")]
    d = spark.createDataFrame(rows, "job_id long, at string, kind string").select("job_id", F.to_timestamp("at").alias("ts"), "kind")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = jobs.events(spark, str(tmp_path / "in"), d.schema)
    got = {r.job_id: (r.status, r.beats) for r in jobs.run_to_table(jobs.job_states(s, 60_000), str(tmp_path / "cp"), str(tmp_path / "out"), "update").collect()}
    assert got == {1: ("done", 1), 2: ("failed", 0)}


def test_stream_sessions_match_batch(spark, tmp_path):
    d = spark.range(40).select((F.col("id") % 3).alias("k"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=(F.col("id") * F.col("id")).cast("int"))).alias("ts"))
    d.write.parquet(str(tmp_path / "in"))
    s = jobs.sessions(jobs.events(spark, str(tmp_path / "in"), d.schema), "k", "ts", "30 minutes", "0 seconds")
    got = {(r.k, r.start, r.events) for r in jobs.run_to_table(s, str(tmp_path / "cp"), str(tmp_path / "out")).collect()}
    want = {(r.k, r.start, r.events) for r in d.groupBy("k", F.session_window("ts", "30 minutes").alias("s")).agg(F.count(F.lit(1)).alias("events")).select("k", "s.start", "events").collect()}
    assert got and got <= want


def test_canonical_rows_and_staged_problems(spark):
    from clipweave.operators.export import canonical_rows
    from clipweave.operators.policy import same_rows, union_tables
    from clipweave.sources.sinks import staged_problems

    rows = spark.createDataFrame([("a.wav", "one", 1.23456), ("b.wav", None, None)], "audio_path string, text string, duration double")
    assert [tuple(r) for r in canonical_rows(rows, "d1").orderBy("audio").collect()] == [("a.wav", "one", 1.235, "d1"), ("b.wav", None, None, "d1")]
    staged = spark.createDataFrame([(1, "x", "x"), (1, "y", "y"), (2, "x", "z"), (3, None, None)], "id int, h1 string, h2 string")
    assert sorted((r.id, r.problem) for r in staged_problems(staged, "id", ("h1", "h2")).collect()) == [("1", "repeated id"), ("2", "hashes disagree")]
    assert same_rows(staged, staged).count() == 0 and same_rows(staged, staged.limit(3).union(staged.limit(1))).count() >= 1
    both = union_tables({"b": rows, "a": rows.select("text")}).orderBy("config", "text").collect()
    assert [(r.config, r.audio_path, r.text) for r in both] == [("a", None, None), ("a", None, "one"), ("b", "b.wav", None), ("b", "a.wav", "one")]

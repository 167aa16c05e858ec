"""Review state: event-sourced edits, heads, staleness, jobs and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.operators.written import scratch

#: Fixed value: the stages of a run, in order.
STAGES = ["source_audio", "audio_variants", "diarization", "buffers", "candidate_review_clips", "transcript_qc", "speaker_purity", "native_export"]


def fold_edits(events: DataFrame, key: str, order: str) -> DataFrame:
    """The state after all accepted patches: an event counts only if it expects the version that is there; content changes take acceptance back.

    events: key, order, expected_version, review_status, transcript. A clip's events are folded as an array: each depends on the one before.
    """
    log = F.array_sort(F.collect_list(F.struct(order, "expected_version", "review_status", "transcript")))
    zero = F.expr("named_struct('version', 0L, 'status', 'unresolved', 'transcript', cast(null as string), 'refused', 0L)")

    def step(s: Column, e: Column) -> Column:
        fits = e["expected_version"] == s["version"]
        changed = e["transcript"].isNotNull() & ~e["transcript"].eqNullSafe(s["transcript"])
        status = F.when(e["review_status"].isNotNull(), e["review_status"]).when(changed & (s["status"] == "accepted"), "unresolved").otherwise(s["status"])
        ok = F.struct((s["version"] + 1).alias("version"), status.alias("status"), F.coalesce(e["transcript"], s["transcript"]).alias("transcript"), s["refused"].alias("refused"))
        no = F.struct(s["version"].alias("version"), s["status"].alias("status"), s["transcript"].alias("transcript"), (s["refused"] + 1).alias("refused"))
        return F.when(fits, ok).otherwise(no)

    return events.groupBy(key).agg(F.aggregate(log, zero, step).alias("s")).select(key, "s.*")


def heads(commits: DataFrame, item: str) -> DataFrame:
    """Per item the newest commit, its parent (undo) and whether there is one. commits: item, commit_id, parent_id, created."""
    newest = commits.groupBy(item).agg(F.max_by(F.struct("commit_id", "parent_id"), F.struct("created", "commit_id")).alias("h"))
    return newest.select(item, F.col("h.commit_id").alias("head"), F.col("h.parent_id").alias("undo_to"), F.col("h.parent_id").isNotNull().alias("can_undo"))


def redo_targets(commits: DataFrame, current: DataFrame, item: str) -> DataFrame:
    """Per item the newest child of its current commit. current: item, head."""
    kids = commits.select(F.col(item), F.col("parent_id").alias("head"), "commit_id", "created").where("head IS NOT NULL")
    best = kids.groupBy(item, "head").agg(F.max_by("commit_id", F.struct("created", "commit_id")).alias("redo_to"))
    return current.join(best, [item, "head"], "left")


def timeline_length(length: Column, ops: Column) -> Column:
    """A clip's length after its edits: ops are structs of kind, start_sample, end_sample, duration_samples."""
    return F.aggregate(ops, length, lambda n, o: F.when(o["kind"] == "delete_range", n - (o["end_sample"] - o["start_sample"])).otherwise(n + o["duration_samples"]))


def edits_valid(length: Column, rate: Column, ops: Column, most_extra_sec: float = 10.0) -> Column:
    """Whether every edit fits the length that the earlier ones leave, never empties the clip and adds ten seconds at most."""
    most = length + (rate * most_extra_sec).cast("bigint")

    def step(s: Column, o: Column) -> Column:
        inside = F.when(o["kind"] == "delete_range", (o["start_sample"] >= 0) & (o["end_sample"] > o["start_sample"]) & (o["end_sample"] <= s["n"])).otherwise(
            (o["start_sample"] >= 0) & (o["start_sample"] <= s["n"]) & (o["duration_samples"] > 0)
        )
        n = F.when(o["kind"] == "delete_range", s["n"] - (o["end_sample"] - o["start_sample"])).otherwise(s["n"] + o["duration_samples"])
        return F.struct(n.alias("n"), (s["ok"] & F.coalesce(inside, F.lit(False)) & (n > 0) & (n <= most)).alias("ok"))

    return F.aggregate(ops, F.struct(length.alias("n"), F.lit(True).alias("ok")), step, lambda s: s["ok"])


def apply_edits(samples: Column, ops: Column) -> Column:
    """Samples with ranges deleted and silence inserted, in order."""

    def step(a: Column, o: Column) -> Column:
        cut = F.concat(F.slice(a, F.lit(1), o["start_sample"].cast("int")), F.slice(a, (o["end_sample"] + 1).cast("int"), F.greatest(F.size(a) - o["end_sample"].cast("int"), F.lit(0))))
        at = o["start_sample"].cast("int")
        longer = F.concat(F.slice(a, F.lit(1), at), F.array_repeat(F.lit(0.0), o["duration_samples"].cast("int")), F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0))))
        return F.when(o["kind"] == "delete_range", cut).otherwise(longer)

    return F.aggregate(ops, samples, step)


def stage_rank(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)


def completed_through(stage: Column, stop_after: Column) -> Column:
    """Whether a run's stage has reached the one it stops after."""
    return (stage_rank(stage) > 0) & (stage_rank(stage) >= stage_rank(stop_after))


def stale_acceptance(status: Column, content: Column, accepted: Column) -> Column:
    """An accepted clip whose content changed since is unresolved."""
    return F.when((status == "accepted") & ~content.eqNullSafe(accepted), "unresolved").otherwise(status)


def processing_state(active: Column, latest_failed: Column, alignment: Column, transcript: Column) -> Column:
    """A recording's state: its active job, else a failed one, else what its artifacts say."""
    return (
        F.when(active == "source_transcription", "transcribing").when(active == "source_alignment", "aligning").when(F.coalesce(latest_failed, F.lit(False)), "failed")
        .when(alignment == "stale", "alignment_stale").when(alignment == "ok", "aligned").when(transcript.isin("ok", "patched"), "transcribed").otherwise("idle")
    )


#: Failures by stage, the texts of which one is in the message (any message, if none), and the reason code. The first that fits counts.
FAILURES = [
    ("audio_variants", ["ffmpeg"], "audio_variant_materialization_failed"),
    ("diarization", ["silero vad dependencies are unavailable"], "missing_silero_vad_dependency"),
    ("diarization", ["pyannote.audio is unavailable"], "missing_pyannote_dependency"),
    ("diarization", ["local model path is missing", "snapshot is missing", "snapshot is incomplete", "failed to load"], "missing_diarization_model"),
    ("diarization", [], "diarization_failed"),
    ("buffers", [], "processing_buffer_build_failed"),
    ("candidate_review_clips", [], "candidate_review_clip_assembly_failed"),
    ("transcript_qc", ["asr dependencies are unavailable"], "missing_asr_dependency"),
    ("transcript_qc", ["asr model load timed out"], "asr_model_load_timeout"),
    ("transcript_qc", ["asr transcription timed out"], "asr_transcription_timeout"),
    ("transcript_qc", ["hub", "snapshot", "model"], "asr_model_unavailable"),
    ("transcript_qc", [], "transcript_qc_failed"),
    ("speaker_purity", [], "speaker_purity_failed"),
    ("native_export", [], "native_export_failed"),
]


def failure_code(stage: Column, message: Column) -> Column:
    """The reason code of a failed stage, whatever the case of its message."""
    out = F.lit("dataset_worker_failed")
    for name, texts, code in reversed(FAILURES):
        fits = stage == name
        if texts:
            fits &= F.coalesce(F.lower(message), F.lit("")).rlike("|".join(t.replace(".", "[.]") for t in texts))
        out = F.when(fits, code).otherwise(out)
    return out


def reference_time(heartbeat: Column, started: Column, created: Column) -> Column:
    return F.coalesce(heartbeat, started, created)


def stale_jobs(jobs: DataFrame, now: Column, after_sec: float = 60.0) -> DataFrame:
    """Running jobs whose last sign of life is that old. jobs: status, heartbeat, started, created."""
    last = reference_time(F.col("heartbeat"), F.col("started"), F.col("created"))
    return jobs.where("status = 'running'").where(F.unix_micros(now) - F.unix_micros(last) >= int(after_sec * 1e6))


def next_job(jobs: DataFrame, queue: list[str]) -> DataFrame:
    """Per queue the pending job to claim: the oldest, ties by id."""
    return jobs.where("status = 'pending'").groupBy(*queue).agg(F.min_by("job_id", F.struct("created", "job_id")).alias("job_id"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All nodes under the roots: node, depth. edges: parent, child.

    One join per level, of the newest nodes only, down to the deepest. Levels are written to one table in the shared folder, so a level's plan doesn't hold the ones before it.
    With ``max_depth`` a deeper graph is an error.
    """
    spark, path, depth = edges.sparkSession, scratch(edges.sparkSession, "closure"), 0
    edges = edges.select("parent", "child")
    kind = roots.schema["node"].dataType.simpleString()
    read = lambda level: spark.read.schema(f"node {kind}").parquet(f"{path}/depth={level}")
    roots.select("node").distinct().write.parquet(f"{path}/depth=0")
    while not read(depth).isEmpty():
        if max_depth is not None and depth >= max_depth:
            deeper = edges.join(read(depth).withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).join(spark.read.schema(f"node {kind}, depth int").parquet(path), "node", "left_anti")
            if not deeper.isEmpty():
                raise ValueError(f"the graph is deeper than {max_depth} levels")
            break
        found = edges.join(read(depth).withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        seen = spark.read.schema(f"node {kind}, depth int").parquet(path)
        found.join(seen, "node", "left_anti").write.parquet(f"{path}/depth={depth + 1}")
        depth += 1
    return spark.read.schema(f"node {kind}, depth int").parquet(path)


def chunks_complete(chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    """Per upload whether all its chunks are there once: a repeat with the same hash is nothing new, with another a conflict."""
    per = chunks.groupBy("upload_id", "index").agg(F.count_distinct("sha256").alias("hashes"))
    got = per.groupBy("upload_id").agg(F.count(F.lit(1)).alias("received"), F.sum((F.col("hashes") > 1).cast("bigint")).alias("conflicts"))
    out = uploads.join(got, "upload_id", "left").withColumn("received", F.coalesce("received", F.lit(0))).withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    return out.withColumn("complete", (F.col("received") == F.col("total_chunks")) & (F.col("conflicts") == 0))

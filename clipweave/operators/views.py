"""Read models of the review tool: what a clip, a recording in the queue and a slice show, and the guards around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions.text import content_hash
from clipweave.operators.state import processing_state

#: Review states, source jobs and their open states, the colour of a tag that names none.
STATUSES = ["unresolved", "accepted", "rejected"]
SOURCE_JOBS, OPEN_JOBS = ["source_transcription", "source_alignment"], ["pending", "running"]
TAG_COLOUR = "#FFFFFF"
#: The labels of known finding codes.
FINDINGS = {
    "clip_contains_oov": "clip contains OOV",
    "clip_contains_symbol_hazard": "clip contains symbol hazard",
    "clip_contains_numeric_token": "clip contains numeric token",
    "transcript_requires_review": "transcript requires review",
    "word_near_trusted_edge": "word near trusted edge",
    "contains_currency_symbol": "contains currency symbol",
    "contains_numeric_token": "contains numeric token",
    "contains_oov": "contains OOV",
}


def findings(codes: Column) -> Column:
    """Reason codes as structs of code and label; blank and null ones go, an unknown one's label has spaces for its underscores."""
    known = F.create_map(*[F.lit(x) for kv in FINDINGS.items() for x in kv])
    there = F.filter(F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))
    return F.transform(there, lambda c: F.struct(c.alias("code"), F.coalesce(F.element_at(known, c), F.regexp_replace(c, "_", " ")).alias("label")))


def effective_revision(source_sha: Column, n_ops: Column, revision: Column, render_status: Column) -> Column:
    """The audio that is heard: an edit's revision once it has operations and is rendered, else the source."""
    ready = F.coalesce((n_ops > 0) & (render_status == "ready") & revision.isNotNull(), F.lit(False))
    return F.when(ready, revision).otherwise(source_sha)


def render_applies(revision: Column, expected_revision: Column, source: Column, expected_source: Column, manifest: Column, expected_manifest: Column) -> Column:
    """Whether a late render may be applied: revision, source and manifest are all what they were; nothing that is missing equals anything."""
    return F.coalesce((revision == expected_revision) & (source == expected_source) & (manifest == expected_manifest), F.lit(False))


def current_subsets(subsets: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """Threshold subsets made for their run's present manifest, as numbers; one with a threshold that is missing or out of 0 to 100 is an error.

    subsets: run, candidate_manifest_sha256, transcript_match_min, speaker_check_min; runs: run, manifest_sha256.
    """
    here = subsets.join(runs, run).where(F.col("candidate_manifest_sha256") == F.col("manifest_sha256"))
    for c in ("transcript_match_min", "speaker_check_min"):
        v = F.expr(f"try_cast({c} AS double)")
        here = here.withColumn(c, F.when(F.coalesce(v.between(0, 100), F.lit(False)), v).otherwise(F.raise_error(F.lit(f"{c} must be a number between 0 and 100"))))
    return here.select(run, "candidate_manifest_sha256", "transcript_match_min", "speaker_check_min")


def clip_views(manifest: DataFrame, entries: DataFrame, transcripts: DataFrame, speakers: DataFrame, references: DataFrame) -> DataFrame:
    """What each clip of the manifest shows.

    manifest: clip_id, audio_path, transcript, audio_sha; entries: clip_id, clip_version, review_status, transcript_override, accepted_content_hash, n_ops, audio_revision,
    render_status; transcripts: clip_id, whisper_text, transcript_match; speakers: clip_id, speaker_check; references: clip_id, reference_quality. The transcript is the override, else the
    manifest's, else the recognised one. An acceptance of other content is stale. Reference quality is that of the source audio and shown for it alone.
    """
    c = manifest.withColumnRenamed("transcript", "manifest_text")
    for other in (entries, transcripts, speakers, references):
        c = c.join(other, "clip_id", "left")
    own = F.coalesce("transcript_override", "manifest_text", F.lit(""))
    heard = F.coalesce("whisper_text", F.lit(""))
    edited = F.coalesce((F.col("n_ops") > 0) & F.col("audio_revision").isNotNull(), F.lit(False))
    hashed = content_hash(own, F.when(edited, F.col("audio_revision")).otherwise(F.col("audio_sha")))
    status = F.when(F.col("review_status").isin(STATUSES), F.col("review_status")).otherwise("unresolved")
    stale = (status == "accepted") & ~hashed.eqNullSafe(F.col("accepted_content_hash"))
    revision = effective_revision(F.col("audio_sha"), F.col("n_ops"), F.col("audio_revision"), F.col("render_status"))
    return c.select(
        "clip_id", F.nullif(F.coalesce("audio_path", F.lit("")), F.lit("")).alias("path"), F.coalesce("clip_version", F.lit(0)).alias("clip_version"),
        F.when(stale, "unresolved").otherwise(status).alias("review_status"), F.when(own != "", own).otherwise(heard).alias("transcript"),
        F.when(F.coalesce("manifest_text", F.lit("")) != "", F.col("manifest_text")).otherwise(heard).alias("original_transcript"), hashed.alias("content_hash"), stale.alias("acceptance_stale"),
        revision.alias("audio_revision"), "transcript_match", "speaker_check", F.when(revision == F.col("audio_sha"), F.col("reference_quality")).alias("reference_quality"),
    )


def recording_queue(recordings: DataFrame, jobs: DataFrame, artifacts: DataFrame, slices: DataFrame) -> DataFrame:
    """Recordings with their newest open source job, a state from jobs and artifacts, and how many slices they have.

    recordings: recording_id, ...; jobs: recording_id, job_id, kind, status, created; artifacts: recording_id, alignment_status, transcript_status; slices: recording_id.
    """
    source = jobs.where(F.col("kind").isin(SOURCE_JOBS))
    newest = lambda cond: F.max_by(F.when(cond, F.struct("job_id", "kind", "status")), F.when(cond, F.struct("created", "job_id")))
    per = source.groupBy("recording_id").agg(newest(F.col("status").isin(OPEN_JOBS)).alias("active"), newest(F.lit(True)).alias("newest"))
    counted = slices.groupBy("recording_id").agg(F.count(F.lit(1)).alias("slice_count"))
    r = recordings.join(per, "recording_id", "left").join(artifacts, "recording_id", "left").join(counted, "recording_id", "left")
    state = processing_state(F.col("active.kind"), F.col("newest.status") == "failed", F.col("alignment_status"), F.col("transcript_status"))
    return r.select(*recordings.columns, F.col("active.job_id").alias("active_job"), state.alias("processing_state"), F.coalesce("slice_count", F.lit(0)).alias("slice_count"))


def slice_summaries(slices: DataFrame, transcripts: DataFrame, tags: DataFrame, links: DataFrame, variants: DataFrame, commits: DataFrame) -> DataFrame:
    """Slices with transcript, tags, the active variant's length in seconds and whether their active commit has a parent (undo) or a child (redo).

    slices: slice_id, active_variant_id, active_commit_id; transcripts: slice_id, transcript; tags: tag_id, name; links: slice_id, tag_id; variants: slice_id, variant_id, sample_rate,
    num_samples; commits: slice_id, commit_id, parent_id. Tags are in order of their lower-cased names.
    """
    named = links.join(tags, "tag_id").groupBy("slice_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("low"), "tag_id", "name"))), lambda t: t["name"]).alias("tags"))
    active = variants.select("slice_id", F.col("variant_id").alias("active_variant_id"), "sample_rate", "num_samples")
    seconds = F.when((F.col("sample_rate") > 0) & (F.col("num_samples") >= 0), F.round(F.col("num_samples") / F.col("sample_rate"), 6)).otherwise(0.0)
    at = commits.select("slice_id", F.col("commit_id").alias("active_commit_id"), F.col("parent_id").isNotNull().alias("can_undo"))
    children = commits.where("parent_id IS NOT NULL").select("slice_id", F.col("parent_id").alias("active_commit_id"), F.lit(True).alias("can_redo")).distinct()
    s = slices.join(transcripts, "slice_id", "left").join(named, "slice_id", "left").join(active, ["slice_id", "active_variant_id"], "left").join(at, ["slice_id", "active_commit_id"], "left").join(children, ["slice_id", "active_commit_id"], "left")
    none = F.array().cast("array<string>")
    return s.select("slice_id", "transcript", F.coalesce("tags", none).alias("tags"), seconds.alias("duration_seconds"), F.coalesce("can_undo", F.lit(False)).alias("can_undo"), F.coalesce("can_redo", F.lit(False)).alias("can_redo"))


def replace_tags(tags: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tags and links after slices' tags are replaced: (tag_id, name, color) and (slice_id, tag_id).

    tags: tag_id, name, color; wanted: slice_id, at (order of saving), name, color. Names are trimmed and compared without case, blank ones go. A known tag keeps its id and name and takes the
    colour saved last; a new one takes its name from the first save, and its id from the lower-cased name.
    """
    name = F.trim(F.coalesce("name", F.lit("")))
    w = wanted.select("slice_id", "at", name.alias("name"), F.coalesce(F.nullif("color", F.lit("")), F.lit(TAG_COLOUR)).alias("new_color"), F.lower(name).alias("low")).where("name <> ''")
    saved = w.groupBy("low").agg(F.min_by("name", "at").alias("new_name"), F.max_by("new_color", "at").alias("new_color"))
    both = tags.withColumn("low", F.lower("name")).join(saved, "low", "full")
    both = both.select("low", F.coalesce("tag_id", F.concat(F.lit("tag-"), F.substring(F.sha2("low", 256), 1, 16))).alias("tag_id"), F.coalesce("name", "new_name").alias("name"), F.coalesce("new_color", "color").alias("color"))
    return both.drop("low"), w.select("slice_id", "low").distinct().join(both, "low").select("slice_id", "tag_id")


def prepared_recordings(recordings: DataFrame, group: str) -> DataFrame:
    """Derived recordings whose recipe, a JSON text, names that output group. recordings: recording_id, parent_id, recipe. A recipe that isn't JSON names none."""
    return recordings.where(F.col("parent_id").isNotNull() & (F.get_json_object("recipe", "$.output_group_id") == group))


def should_export_variant(score: Column, variant: Column, bucket: Column, category: Column, delta: Column, blind_at: Column | float) -> Column:
    """Whether a trial's variant is exported: a scored baseline, a flagged bucket, a replacement or blend that still scores high, or a blend that hardly moved the score."""
    small = F.when((delta.isNull()) | (delta == 0), 1.0).otherwise(delta) < 0.03
    any_ = (variant == "baseline") | bucket.isin("contaminated", "suspicious", "failed") | ((score >= blind_at) & category.isin("blend", "replace")) | ((category == "blend") & small)
    return score.isNotNull() & F.coalesce(any_, F.lit(False))

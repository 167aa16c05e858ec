"""Export: which clips go out, why the others don't, and the artifact index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions.arrays import reasons
from clipweave.functions.numeric import rescale_samples


def native_bounds(start: Column, end: Column, coordinate_rate: Column, source_rate: Column, analysis_rate: Column) -> tuple[Column, Column, Column]:
    """A clip's samples at its source's rate, and whether its coordinates are of a known rate."""
    known = (coordinate_rate == source_rate) | (coordinate_rate == analysis_rate)
    at = lambda x: F.when(coordinate_rate == source_rate, x).when(known, rescale_samples(x, coordinate_rate, source_rate))
    return at(start), at(end), F.coalesce(known, F.lit(False))


def cascade(rows: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """``rows`` with the first rule that rejects each, null where none does."""
    reason = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        reason = F.when(condition, name).otherwise(reason)
    return rows.withColumn("reason", reason)


def export_clips(manifest: DataFrame, decisions: DataFrame, sources: DataFrame, variants: DataFrame) -> DataFrame:
    """Every clip of the manifest with native_start, native_end and the reason it is not exported, if any.

    manifest: clip_id, source_id, start_sample, end_sample, coordinate_rate; decisions: clip_id, status; sources: source_id, sample_rate, num_samples;
    variants: source_id, analysis_rate. Left joins; the first rule that holds gives the reason.
    """
    j = manifest.join(decisions, "clip_id", "left").join(sources, "source_id", "left").join(variants, "source_id", "left")
    start, end, known = native_bounds(F.col("start_sample"), F.col("end_sample"), F.coalesce("coordinate_rate", "sample_rate"), F.col("sample_rate"), F.col("analysis_rate"))
    inside = lambda x: F.when(F.col("num_samples").isNotNull(), F.greatest(F.lit(0), F.least(F.col("num_samples"), x)))
    j = j.withColumn("_known", known).withColumn("native_start", inside(start)).withColumn("native_end", inside(end))
    rules = [
        (F.col("status").isNull(), "missing_dataset_qc_clip"),
        (F.col("status") != "accepted", "dataset_qc_status_not_accepted"),
        (F.col("sample_rate").isNull() | F.col("analysis_rate").isNull(), "missing_source_or_analysis_variant"),
        (~F.col("_known") | F.col("start_sample").isNull() | F.col("end_sample").isNull(), "invalid_candidate_sample_coordinates"),
        (F.col("native_end") <= F.col("native_start"), "empty_native_span"),
    ]
    return cascade(j, rules).drop("_known")


def accepted(exported: DataFrame) -> DataFrame:
    return exported.where(F.col("reason").isNull())


def rejected(exported: DataFrame) -> DataFrame:
    return exported.where(F.col("reason").isNotNull())


def blockers(rows: DataFrame) -> DataFrame:
    """``rows`` (status, transcript, audio_ready, expected_hash, audio_hash, edited, render_status) with the sorted codes that keep each out of a snapshot."""
    codes = reasons(
        (F.col("edited") & (F.coalesce("render_status", F.lit("")) != "ready"), "edited_audio_not_rendered"), (F.coalesce("audio_hash", F.lit("")) != F.coalesce("expected_hash", F.lit("")), "audio_hash_mismatch"),
        (F.trim(F.coalesce("transcript", F.lit(""))) == "", "empty_transcript"), (~F.col("audio_ready"), "missing_audio"), (F.col("status") != "accepted", "not_accepted"),
    )
    return rows.withColumn("blockers", F.array_sort(codes))


def snapshot_preview(blocked: DataFrame) -> DataFrame:
    """One row: what a snapshot would hold, whether it may be made (all or nothing), and what blocks it."""
    ok = F.size("blockers") == 0
    return blocked.where("status = 'accepted'").agg(
        F.count(F.lit(1)).alias("accepted"), F.sum(ok.cast("bigint")).alias("exportable"), F.round(F.sum(F.when(ok, F.col("duration"))), 6).alias("seconds"),
        F.min(ok).alias("allowed"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("blockers")))), "|").alias("codes"),
    )


def merge_index(existing: DataFrame, seen: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """What an upsert with deletion of the missing does to each key: insert, update, keep or delete, with the new values."""
    old = existing.select(*keys, F.struct(*values).alias("_old"))
    new = seen.select(*keys, F.struct(*values).alias("_new"))
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull(), "insert").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    return old.join(new, keys, "full").withColumn("action", action).select(*keys, "action", *[F.col("_new")[v].alias(v) for v in values])


def canonical_rows(rows: DataFrame, dataset: str) -> DataFrame:
    """audio, text, duration (3 places) and dataset_id of canonical rows."""
    return rows.select(F.col("audio_path").alias("audio"), "text", F.bround("duration", 3).alias("duration"), F.lit(dataset).alias("dataset_id"))

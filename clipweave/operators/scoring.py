"""Scores of reference candidates and purity of clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions.arrays import reasons
from clipweave.functions.numeric import clamp, clamped_percent, nearest_rank, rounded


def duration_preference(seconds: Column) -> Column:
    """1 from 6 to 9 seconds, falling off on both sides."""
    return clamp(1 - 0.08 * F.greatest(F.lit(0.0), 6 - seconds) - 0.04 * F.greatest(F.lit(0.0), seconds - 9), 0, 1)


def reference_quality(rows: DataFrame) -> DataFrame:
    """``rows`` (mean_similarity, p10_similarity, seconds, transcript_score, position_preference) with representativeness, duration_preference,
    transcript_confidence, reference_quality_score (null when a part is missing) and reason_codes."""
    rep = clamp(0.7 * F.col("mean_similarity") + 0.3 * F.col("p10_similarity"), 0, 1)
    conf = F.when(F.col("transcript_score").between(0, 100), F.col("transcript_score") / 100)
    out = rows.withColumns({"representativeness": rep, "duration_preference": duration_preference(F.col("seconds")), "transcript_confidence": conf})
    score = 75 * F.col("representativeness") + 5 * F.col("duration_preference") + 10 * F.col("position_preference") + 10 * F.col("transcript_confidence")
    missing = reasons((F.col("representativeness").isNull(), "missing_similarity_statistics"), (F.col("duration_preference").isNull(), "missing_duration"), (F.col("transcript_confidence").isNull(), "missing_transcript_confidence"))
    return out.withColumn("reference_quality_score", clamp(score, 0, 100)).withColumn("reason_codes", missing)


def risk_flags(total: Column, start: Column, end: Column, transcript: Column) -> Column:
    """What may be wrong with a candidate: at an edge of its recording, without transcript."""
    return reasons(
        (start <= 0.05, "starts_at_recording_edge"), (end >= F.greatest(total - 0.05, F.lit(0.0)), "ends_at_recording_edge"),
        (F.coalesce(transcript, F.lit("")) == "", "missing_transcript_context"),
    )


def default_scores(total: Column, start: Column, end: Column, transcript: Column) -> dict[str, Column]:
    """Prior scores of a candidate by length, place and context, to 4 places."""
    flags = risk_flags(total, start, end, transcript)
    length = F.greatest(end - start, F.lit(0.001))
    center = start + length / 2
    middle = F.when(total > 0, total / 2).otherwise(center)
    away = F.abs(center - middle) / F.greatest(total / 2, F.lit(1.0))
    edges = F.size(F.filter(flags, lambda f: f.contains("edge")))
    context = F.coalesce(transcript, F.lit("")) != ""
    base = 0.7 + F.when(context, 0.16).otherwise(0.0) + (0.1 - F.abs(length - 4.5) * 0.02) - away * 0.1 - 0.06 * edges - F.when(context, 0.0).otherwise(0.08)
    zero, fine = rounded(base - 0.02 * length, 4), rounded(base + 0.015 * length, 4)
    return {"zero_shot": zero, "finetune": fine, "both": rounded((zero + fine) / 2, 4)}


def clip_similarity(windows: DataFrame, key: str, similarity: str = "similarity", scorable: Column | None = None) -> DataFrame:
    """Per clip the least, mean and nearest-rank tenth similarity of its scorable windows, the worst window, and how many were scored and skipped.

    A clip's windows are bounded by its length. windows: key, window, similarity.
    """
    ok = F.col(similarity).isNotNull() if scorable is None else scorable & F.col(similarity).isNotNull()
    w = windows.withColumn("_s", F.when(ok, F.col(similarity)))
    return w.groupBy(key).agg(
        F.min("_s").alias("min_similarity"), F.avg("_s").alias("mean_similarity"), nearest_rank(F.collect_list("_s"), 0.10).alias("p10_similarity"),
        F.min_by("window", F.when(F.col("_s").isNotNull(), F.struct("_s", "window"))).alias("worst_window"),
        F.count("_s").alias("scored"), (F.count(F.lit(1)) - F.count("_s")).alias("skipped"),
    ).withColumn("score", clamped_percent(F.col("p10_similarity")))

"""Quality gates over scored clips: readiness, thresholds, manual overrides, reasons and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.functions.arrays import reasons, sorted_union

ACCEPTED, REJECTED = "accepted", "rejected"


def threshold_status(match: Column, check: Column, match_min: float, check_min: float, calibrated: Column | None = None, missing: Column | None = None) -> Column:
    """Accepted where both scores reach their thresholds, the second is calibrated and the audio is there; null scores reject."""
    passed = (match >= match_min) & (check >= check_min)
    if calibrated is not None:
        passed &= F.coalesce(calibrated, F.lit(True))
    if missing is not None:
        passed &= ~F.coalesce(missing, F.lit(False))
    return F.when(F.coalesce(passed, F.lit(False)), ACCEPTED).otherwise(REJECTED)


def failed_checks(match: Column, check: Column, match_min: float, check_min: float, calibrated: Column | None = None, missing: Column | None = None) -> Column:
    """The checks that fail, in a fixed order."""
    cases = [(F.coalesce(missing, F.lit(False)), "audio_missing")] if missing is not None else []
    cases += [(match.isNull(), "missing_transcript_score"), (match < match_min, "transcript_below_threshold")]
    cases += [(check.isNull(), "missing_speaker_score"), (check < check_min, "speaker_below_threshold")]
    if calibrated is not None:
        cases.append((check.isNotNull() & ~F.coalesce(calibrated, F.lit(True)), "speaker_score_uncalibrated"))
    return reasons(*cases)


def final_status(status: Column, override: Column, hard_failed: Column) -> Column:
    """A hard failure rejects; then force_keep, force_reject, and else the thresholds decide."""
    return F.when(F.coalesce(hard_failed, F.lit(False)), REJECTED).when(override == "force_keep", ACCEPTED).when(override == "force_reject", REJECTED).otherwise(status)


def preview_status(match: Column, check: Column, match_min: float, check_min: float, override: Column | None = None) -> Column:
    """The preview's gate: a null score is below every threshold; calibration isn't asked for."""
    low = F.lit(float("-inf"))
    status = F.when((F.coalesce(match, low) >= match_min) & (F.coalesce(check, low) >= check_min), ACCEPTED).otherwise(REJECTED)
    return status if override is None else F.when(override == "force_keep", ACCEPTED).when(override == "force_reject", REJECTED).otherwise(status)


def join_scores(clips: DataFrame, transcript: DataFrame, speaker: DataFrame, overrides: DataFrame, key: str = "clip_id") -> DataFrame:
    """Clips with what the three sides say of them; a clip that a side lacks gets nulls."""
    return clips.join(transcript, key, "left").join(speaker, key, "left").join(overrides, key, "left")


def decide(scored: DataFrame, match_min: float, check_min: float) -> DataFrame:
    """``scored`` (match, check, calibrated, missing, override, reason_codes) with threshold_status, status, failed and reasons."""
    m, c, cal, gone = (F.col(x) for x in ("match", "check", "calibrated", "missing"))
    out = scored.withColumn("threshold_status", threshold_status(m, c, match_min, check_min, cal, gone))
    out = out.withColumn("failed", failed_checks(m, c, match_min, check_min, cal, gone))
    return out.withColumn("status", final_status(F.col("threshold_status"), F.col("override"), gone)).withColumn("reasons", sorted_union(F.col("reason_codes"), F.col("failed")))


def summarise(decided: DataFrame, match_min: float, check_min: float) -> DataFrame:
    """One row: clips and seconds by status, overrides that took effect, and failures by score alone, in exclusive classes."""
    low_m = F.coalesce(F.col("match") < match_min, F.lit(True))
    low_c = F.coalesce(F.col("check") < check_min, F.lit(True))
    kept = F.col("status") == ACCEPTED
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    secs = lambda c: F.round(F.sum(F.when(c, F.col("duration")).otherwise(0.0)), 6)
    return decided.agg(
        n(kept).alias("accepted"), n(~kept).alias("rejected"), secs(kept).alias("accepted_sec"), secs(~kept).alias("rejected_sec"),
        n(low_m & low_c).alias("failed_both"), n(low_m & ~low_c).alias("failed_transcript"), n(~low_m & low_c).alias("failed_speaker"),
        n((F.col("override") == "force_keep") & kept).alias("force_kept"), n(F.col("override") == "force_reject").alias("force_rejected"),
    )


def reason_counts(rows: DataFrame, column: str = "reasons") -> DataFrame:
    """How many rows have each reason."""
    return rows.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def margins(match: Column, check: Column, match_min: float, check_min: float) -> dict[str, Column]:
    """How far both scores are from their thresholds, each and combined."""
    a, b = match - match_min, check - check_min
    return {"match_margin": a, "check_margin": b, "least_margin": F.least(a, b), "most_margin": F.greatest(a, b)}


def riskiest(kept: DataFrame, by: str, n: int, id_col: str = "clip_id") -> DataFrame:
    """The ``n`` kept clips with the least margin, ties by id. A top-k: Spark keeps n rows per task, never all."""
    return kept.orderBy(F.col(by).asc_nulls_last(), id_col).limit(n)


def evenly_spread(rows: DataFrame, order: list[str], k: int, draw: Column) -> DataFrame:
    """Of ``k`` equal slices of the rows in order, the row of each with the least ``draw``. Slices come from ranks of range-partitioned rows."""
    from clipweave.operators.ordering import with_row_number

    ranked, total = with_row_number(rows, order)
    slice_of = F.floor((F.col("row_number") - 1) * min(k, max(total, 1)) / F.lit(max(total, 1)))
    cols = F.struct(*rows.columns)
    return ranked.groupBy(slice_of.alias("slice")).agg(F.min_by(cols, F.struct(draw.alias("d"), F.col("row_number"))).alias("r")).select("slice", "r.*")


def sorted_clips(rows: DataFrame, metric: str, descending: bool, order: str) -> DataFrame:
    """By a metric, nulls last in either direction, ties by ``order``."""
    c = F.col(metric)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), order)


def search(rows: DataFrame, text: str | None, columns: list[str], **allowed: list) -> DataFrame:
    """Rows with ``text`` in one of the columns, whatever its case, and allowed values; an empty filter is none."""
    if text:
        found = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(text.lower()) for c in columns]
        hit = found[0]
        for f in found[1:]:
            hit |= f
        rows = rows.where(hit)
    for column, values in allowed.items():
        if values:
            rows = rows.where(F.col(column).isin(values))
    return rows


def unique_or_fail(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, failing the job when a key repeats or is blank; the check runs with the query, in the aggregation it needs."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    bad = F.when(blank, F.raise_error(F.lit(f"{key} is blank"))).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))))
    return counted.where(F.coalesce(bad.cast("boolean"), F.lit(True))).drop("_n")


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Of rows with one key, the last by position."""
    cols = F.struct(*rows.columns)
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(cols, position).alias("_r")).select("_r.*")


def not_ready(required: DataFrame, present: DataFrame, key: str = "artifact") -> DataFrame:
    """The required artifacts that aren't there."""
    return required.join(present, key, "left_anti")

"""Rows of run artifacts: speech regions from turns, speaker selections, channel modes, cut features, and the checks that rows go through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions.arrays import reasons, sorted_union
from clipweave.functions.numeric import to_samples, to_seconds
from clipweave.functions.text import speaker_id

#: How close a trim bound is brought to a limit, in seconds, and relatively.
TRIM_NEAR, TRIM_RELATIVE = 1e-6, 1e-9
#: Durations aimed at by mode of a reference run, in seconds.
TARGET_DURATIONS = {"zero_shot": [3.0, 4.5, 6.0], "finetune": [2.5, 4.0, 5.0]}


def _required(value: Column, what: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(what))).otherwise(value)


def _region(speaker: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("-", speaker, "source_audio_id", start, end)


def turn_regions(turns: DataFrame, rate: int) -> DataFrame:
    """Turns (source_audio_id, label, start_sec, end_sec) as regions. Turns that are empty, in seconds or in samples, or have a null bound, go."""
    start, end = to_samples(F.col("start_sec"), rate), to_samples(F.col("end_sec"), rate)
    t = turns.where(F.col("end_sec") > F.col("start_sec")).select("source_audio_id", speaker_id(F.col("label")).alias("speaker_id"), start.alias("start_sample"), end.alias("end_sample"))
    t = t.where("end_sample > start_sample")
    return t.select(_region(F.col("speaker_id"), F.col("start_sample"), F.col("end_sample")).alias("id"), *t.columns, to_seconds(F.col("start_sample"), rate).alias("start_sec"), to_seconds(F.col("end_sample"), rate).alias("end_sec"))


def single_speaker_regions(segments: DataFrame, variants: DataFrame) -> DataFrame:
    """Voice segments (source_audio_id, start_sample, end_sample) as regions of speaker_0, with their recording's path. variants: source_audio_id, path. A recording without a path is an error."""
    who = F.lit("speaker_0")
    s = segments.join(variants.select("source_audio_id", "path"), "source_audio_id", "left")
    return s.select(_region(who, F.col("start_sample"), F.col("end_sample")).alias("id"), "source_audio_id", _required(F.col("path"), "a segment's recording has no path").alias("analysis_audio_path"), who.alias("speaker_id"), "start_sample", "end_sample")


def carried_selections(regions: DataFrame, previous: DataFrame) -> DataFrame:
    """A run's selected speaker, which is the previous one if it is still there. regions: run, speaker_id; previous: run, target, source."""
    there = regions.select("run", "speaker_id").distinct()
    available = there.groupBy("run").agg(F.array_sort(F.collect_list("speaker_id")).alias("available"))
    p = previous.select("run", F.trim("target").alias("target"), "source")
    hits = p.join(there.withColumnRenamed("speaker_id", "target"), ["run", "target"]).select("run", "target", F.coalesce(F.nullif("source", F.lit("")), F.lit("user")).alias("source"))
    runs = available.join(p.select("run"), "run", "full").join(hits, "run", "left")
    selected = F.col("target").isNotNull()
    return runs.select(
        "run", selected.alias("selected"), "target", F.coalesce("source", F.lit("pending_user_selection")).alias("source"), F.coalesce("available", F.array().cast("array<string>")).alias("available"),
        reasons((~selected, "speaker_selection_required")).alias("reasons"),
    )


def known_choices(choices: DataFrame, samples: DataFrame, regions: DataFrame) -> DataFrame:
    """Choices (run, speaker_id) with whether the speaker is among the run's samples or regions (run, speaker_id)."""
    there = samples.select("run", "speaker_id").unionByName(regions.select("run", "speaker_id")).distinct().withColumn("known", F.lit(True))
    return choices.join(there, ["run", "speaker_id"], "left").select(*choices.columns, F.coalesce("known", F.lit(False)).alias("known"))


def channel_modes(variants: DataFrame) -> DataFrame:
    """Per recording the channel mode in the recipe, a JSON text, of its last analysis variant; downmix where none is stated. variants: at (their order), source_audio_id, kind, recipe."""
    mode = F.coalesce(F.nullif(F.get_json_object("recipe", "$.channel_mode"), F.lit("")), F.lit("downmix"))
    v = variants.where("kind = 'analysis_audio'").select(F.coalesce("source_audio_id", F.lit("")).alias("source_audio_id"), "at", mode.alias("mode"))
    return v.groupBy("source_audio_id").agg(F.max_by("mode", "at").alias("channel_mode"))


def metadata_gaps(runs: DataFrame, segments: DataFrame, words: DataFrame) -> DataFrame:
    """Which recognition metadata a run lacks anywhere. runs: run; segments: run, no_speech_prob; words: run, probability. A run without segments lacks the first."""
    s = segments.groupBy("run").agg(F.bool_or(F.col("no_speech_prob").isNull()).alias("silent"))
    w = words.groupBy("run").agg(F.bool_or(F.col("probability").isNull()).alias("unsure"))
    r = runs.select("run").distinct().join(s, "run", "left").join(w, "run", "left")
    return r.select("run", reasons((F.coalesce("silent", F.lit(True)), "no_speech_prob"), (F.coalesce("unsure", F.lit(False)), "word_probability")).alias("gaps"))


def timing_valid(start: Column, end: Column) -> Column:
    """Whether a span that has both bounds doesn't end before it starts."""
    return F.coalesce(end >= start, F.lit(True))


def first_stated(rows: DataFrame, key: str, field: str, order: str) -> DataFrame:
    """Per key the first value of a field, in an order, that isn't blank, trimmed; null if all are."""
    value = F.nullif(F.trim(field), F.lit(""))
    return rows.groupBy(key).agg(F.min_by(value, F.when(value.isNotNull(), F.col(order))).alias(field))


def edge_features(clips: DataFrame, cuts: DataFrame) -> DataFrame:
    """Clips (clip_id, start_cut, end_cut, ...) with the features of both of their cuts, which must be there.

    cuts: cut_id, time_sec, interval_start_sec, interval_end_sec, rms, vad, score.
    """
    names = [c for c in cuts.columns if c != "cut_id"]
    side = lambda s: cuts.select(F.col("cut_id").alias(f"{s}_cut"), *[F.col(c).alias(f"{s}_{c}") for c in names], F.lit(True).alias(f"_{s}"))
    c = clips.join(side("start"), "start_cut", "left").join(side("end"), "end_cut", "left")
    quiet = lambda x: F.round(F.greatest(F.lit(0.0), x), 6)
    there = _required(F.col("_start") & F.col("_end"), "a clip's cut is missing")
    return c.where(there).select(
        *clips.columns, *[f"{s}_{f}" for f in ("rms", "vad", "score") for s in ("start", "end")],
        quiet(F.col("start_time_sec") - F.col("start_interval_start_sec")).alias("quiet_before_start"), quiet(F.col("end_interval_end_sec") - F.col("end_time_sec")).alias("quiet_after_end"),
    )


def purity_reasons(score: Column, codes: Column) -> Column:
    """Sorted distinct reason codes; a row without score or codes gets one of its own."""
    own = sorted_union(codes)
    return F.when((F.size(own) == 0) & score.isNull(), F.array(F.lit("missing_speaker_qc"))).otherwise(own)


def current_text(modified: Column, original: Column) -> Column:
    """The modified text unless it is blank, else the original one, else empty."""
    return F.coalesce(F.when(F.trim(modified) != "", modified), original, F.lit(""))


def non_problematic(inside: list[Column]) -> Column:
    """Whether none of the flags, texts as written to CSV, says anything but ``False``."""
    clean = F.lit(True)
    for flag in inside:
        clean = clean & F.coalesce(flag == "False", F.lit(False))
    return clean


def trim_bounds(candidate_start: Column, candidate_end: Column, length: Column, start: Column, end: Column) -> Column:
    """Struct of start, end and problem: asked-for bounds within a candidate and its recording, or the candidate's own if none are asked for. Bounds that miss a limit narrowly are brought to it."""
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(TRIM_NEAR), TRIM_RELATIVE * F.greatest(F.abs(a), F.abs(b)))
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    low = F.when((start < 0) & near(start, F.lit(0.0)), 0.0).otherwise(start)
    high = F.when((end > length) & near(end, length), length).otherwise(end)
    off_source = (low < 0) | (high > length) | (low > length) | (high < 0)
    first = F.when((low < candidate_start) & near(low, candidate_start), candidate_start).otherwise(low)
    last = F.when((high > candidate_end) & near(high, candidate_end), candidate_end).otherwise(high)
    none = start.isNull() & end.isNull()
    problem = (
        F.when(none, F.lit(None)).when(start.isNull() | end.isNull(), "trim_needs_both_bounds").when(~(finite(start) & finite(end)), "trim_not_finite").when(end <= start, "trim_not_positive")
        .when(off_source, "trim_outside_source").when((first < candidate_start) | (last > candidate_end), "trim_outside_candidate")
    )
    return F.struct(F.when(none, candidate_start).when(problem.isNull(), first).alias("start"), F.when(none, candidate_end).when(problem.isNull(), last).alias("end"), problem.alias("problem"))


def target_durations(wanted: Column, mode: Column) -> Column:
    """Sorted distinct durations of at least a second, to 2 places; the mode's own where none is left."""
    fine = F.filter(wanted, lambda d: d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")) & (d >= 1.0))
    own = F.array_sort(F.array_distinct(F.transform(fine, lambda d: F.round(d, 2))))
    of = lambda m: F.array(*[F.lit(d) for d in TARGET_DURATIONS[m]])
    return F.when(F.size(F.coalesce(own, F.array().cast("array<double>"))) > 0, own).when(mode == "finetune", of("finetune")).otherwise(of("zero_shot"))


def acceptance_problem(n_ops: Column, render: Column, revision: Column, rendered: Column, cached: Column) -> Column:
    """Why an edited clip can't be accepted, or null. rendered, cached: the hashes of the stated rendering and of the file that is there."""
    return (
        F.when(F.coalesce(n_ops, F.lit(0)) == 0, F.lit(None)).when(render == "failed", "render_failed").when(~render.eqNullSafe(F.lit("ready")), "unrendered")
        .when(revision.isNull() | rendered.isNull(), "no_revision").when(cached.isNull(), "cache_missing").when(cached != rendered, "cache_mismatch")
    )


def anchor_problem(asset_project: Column, project: Column, status: Column, space: Column, expected: Column, current: Column) -> Column:
    """Why a reference asset can't anchor a run, or null. One that is missing, stale or failed is embedded anew, in the current space."""
    again = status.isin("missing", "stale", "failed")
    return (
        F.when(~asset_project.eqNullSafe(project), "foreign_project").when(again & (expected != current), "space_mismatch").when(again, F.lit(None))
        .when(~status.eqNullSafe(F.lit("ready")), "not_ready").when(~space.eqNullSafe(expected), "space_mismatch")
    )

"""Text and score column functions: tokens, hazards, transcript scores, hashes and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipweave.functions.arrays import reasons

#: Symbols that are read aloud in more than one way, and those of money.
DANGER_SYMBOLS = "$%@#*+=&€£¥©™^_"
CURRENCY_SYMBOLS = "$€£¥"
#: Fixed values of the transcript score: per feature mean, scale and weight, and the intercept.
MEANS, SCALES, WEIGHTS, INTERCEPT = (75.864291, 91.250489), (18.577465, 10.974781), (-0.482025, -0.422582), -3.165108


def one_of(chars: str) -> str:
    """A pattern for one of the characters."""
    return "[" + "".join(f"\\{c}" if c in "^$*+]\\-&" else c for c in chars) + "]"


def lexical_token(token: Column) -> Column:
    """A token without punctuation at its ends, apostrophes aside; null if nothing in it is a letter or digit."""
    bare = F.regexp_replace(token, r"(?U)^[^\w']+|[^\w']+$", "")
    return F.when(bare.rlike(r"(?U)[\p{L}\p{N}]"), bare)


def probability_scale(values: Column) -> Column:
    """unit, percent, mixed, empty or invalid, for an array of probabilities."""
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))) | (v < 0) | (v > 100))
    unit = F.forall(values, lambda v: v <= 1)
    percent = F.forall(values, lambda v: (v > 1) | (v == 0))
    return F.when(F.size(values) == 0, "empty").when(bad, "invalid").when(unit, "unit").when(percent, "percent").otherwise("mixed")


def percent_probabilities(values: Column) -> Column:
    """Probabilities as percentages where their scale is known, else null."""
    scale = probability_scale(values)
    return F.when(scale == "unit", F.transform(values, lambda v: v * 100)).when(scale == "percent", values)


def two_smallest(values: Column) -> tuple[Column, Column, Column]:
    """The smallest value, the next (or the same, of one), and their gap, to 4 places."""
    ordered = F.array_sort(values)
    m1 = F.get(ordered, F.lit(0))
    m2 = F.coalesce(F.get(ordered, F.lit(1)), m1)
    return F.round(m1, 4), F.round(m2, 4), F.round(m2 - m1, 4)


def transcript_score(m1: Column, m2: Column) -> tuple[Column, Column]:
    """The probability that a transcript is harmful, to 8 places, and the match score in percent, to 4."""
    logit = F.lit(INTERCEPT) + WEIGHTS[0] * ((m1 - MEANS[0]) / SCALES[0]) + WEIGHTS[1] * ((m2 - MEANS[1]) / SCALES[1])
    p = 1 / (1 + F.exp(-logit))
    return F.round(p, 8), F.round((1 - p) * 100, 4)


def hazards(text: Column) -> Column:
    """Sorted reason codes for digits and symbols."""
    codes = reasons(
        (text.rlike(one_of(CURRENCY_SYMBOLS)), "contains_currency_symbol"),
        (text.rlike(one_of(DANGER_SYMBOLS)), "contains_danger_symbol"),
        (text.rlike("[0-9]"), "contains_numeric_token"),
        (text.contains("%"), "contains_percent_symbol"),
    )
    return codes


def score_bucket(score: Column) -> Column:
    return F.when(score.isNull(), "failed").when(score >= 85, "accepted").when(score >= 70, "review").otherwise("rejected")


def bucket_hint(score: Column) -> Column:
    return F.when(score.isNull(), "unscored").when(score >= 85, "pass").when(score >= 70, "review").otherwise("fail")


def review_policy(n_lexical: Column, score: Column, silent_segments: Column, hazard_codes: Column, low: float = 85.0) -> tuple[Column, Column]:
    """Whether a transcript needs review, and the sorted reasons."""
    required = (n_lexical <= 0) | silent_segments | (F.size(hazard_codes) > 0) | score.isNull()
    codes = reasons((n_lexical <= 0, "no_lexical_words"), (silent_segments, "high_no_speech_segment"), (score < low, "low_transcript_match"))
    return required, F.array_sort(F.array_distinct(F.concat(codes, hazard_codes)))


def compare_words(text: Column) -> Column:
    """Lower-cased words: punctuation becomes space, apostrophes and hyphens stay inside words."""
    spaced = F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, "\n", " "))), r"(?U)[^\w\s'-]", " ")
    stripped = F.transform(F.split(spaced, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"(?U)^[^\w]+|[^\w]+$", ""))
    return F.filter(stripped, lambda w: w != "")


def word_difference(reference: Column, hypothesis: Column) -> Column:
    """identical, word_order, extra, missing or content, for two word arrays."""
    a, b = F.array_sort(reference), F.array_sort(hypothesis)
    less, more = F.size(F.array_except(reference, hypothesis)) == 0, F.size(F.array_except(hypothesis, reference)) == 0
    return (
        F.when(reference == hypothesis, "identical").when(a == b, "word_order")
        .when(less & (F.size(hypothesis) > F.size(reference)), "extra").when(more & (F.size(reference) > F.size(hypothesis)), "missing").otherwise("content")
    )


def trailing_punctuation(token: Column) -> tuple[Column, Column]:
    """A token in two: before its trailing stops, and those."""
    tail = F.regexp_extract(token, r"[.,;:?!]*$", 0)
    return token.substr(F.lit(1), F.length(token) - F.length(tail)), tail


def paused_token(token: Column, gap: Column, comma: float = 0.3, tiny: float = 0.05) -> Column:
    """A token whose trailing stops go where the next word follows at once, and that gets a comma before a pause. ``gap`` is null at the end."""
    base, tail = trailing_punctuation(token)
    g = F.greatest(gap, F.lit(0.0))
    return F.concat(base, F.when(gap.isNull(), tail).when((tail != "") & (g <= tiny), "").when((tail == "") & (g >= comma), ",").otherwise(tail))


def filename_stem(text: Column, fallback: Column, longest: int = 180) -> Column:
    """A transcript as a file name: one space between words, no forbidden characters, at most so long; the fallback if nothing is left."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1F]', " "), r"\s+", " "))
    cut = F.trim(F.substring(clean, 1, longest))
    return F.coalesce(F.when(cut != "", cut), fallback)


def speaker_id(label: Column) -> Column:
    """The trailing number of a label as speaker_n; null without one."""
    n = F.regexp_extract(label, r"(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("speaker_"), n.cast("bigint").cast("string")))


def digest(value: Column) -> Column:
    """A sha256 digest without its prefix; null if it isn't one."""
    bare = F.regexp_replace(value, "^sha256:", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def content_hash(transcript: Column, audio: Column) -> Column:
    return F.sha2(F.concat(F.lit("transcript:"), F.coalesce(transcript, F.lit("")), F.lit("\naudio:"), F.coalesce(audio, F.lit(""))), 256)


def candidate_id(source: Column, start: Column, end: Column, family: Column) -> Column:
    text = F.concat_ws(":", source, F.format_string("%.3f", start), F.format_string("%.3f", end), family)
    return F.concat(F.lit("cand-"), F.substring(F.sha1(text), 1, 16))


def safe_relative_path(path: Column) -> Column:
    """A run-relative path that stays inside its root."""
    p = F.coalesce(path, F.lit(""))
    return (p != "") & (p == F.trim(p)) & ~p.startswith("/") & ~p.contains("\\") & ~p.contains("//") & ~p.rlike(r"(^|/)\.\.?(/|$)") & ~p.rlike(r"[\x00-\x1F]") & ~p.rlike("^[A-Za-z]:") & ~p.endswith("/")

"""Column functions on hand-worked values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clipweave.functions import arrays, numeric, text


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def lit(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_numbers(spark):
    r = one(
        spark, half=numeric.to_samples(F.lit(2.5), 1), nan=numeric.finite(F.lit(float("nan"))), inf=numeric.finite(F.lit(float("-inf"))), clamp=numeric.clamp(F.lit(120.0), 0, 100),
        none=numeric.clamp(F.lit(None).cast("double"), 0, 100), strict=numeric.score_0_100(F.lit(100.5)), frac=numeric.score_from_fraction(F.lit(0.875)), auto=numeric.autoscaled(F.lit(0.9)),
        span=numeric.span_score(F.lit(0.12345)), compact=numeric.format_compact(F.lit(3725.0)), short=numeric.format_compact(F.lit(59.0)), rate=numeric.rescale_samples(F.lit(16000), F.lit(16000.0), F.lit(44100.0)),
    )
    assert (r.half, r.nan, r.inf, r.clamp, r.none, r.strict, r.frac, r.auto) == (2, None, None, 100.0, None, None, 87.5, 90.0)
    assert r.span == pytest.approx(12.345) and (r.compact, r.short, r.rate) == ("1h 2m", "59s", 44100)


def test_percentiles(spark):
    r = one(spark, near=numeric.nearest_rank(lit(1, 2, 3, 10), 0.1), near2=numeric.nearest_rank(lit(*range(11)), 0.25), up=numeric.upper_median(lit(4, 1, 3, 2)), low=numeric.lower_rank(lit(*range(20)), 0.1), empty=numeric.nearest_rank(F.array().cast("array<double>"), 0.5))
    assert (r.near, r.near2, r.up, r.low, r.empty) == (1.0, 2.0, 3.0, 1.0, None)


def test_vectors(spark):
    r = one(spark, unit=arrays.unit(lit(3, 4)), zero=arrays.unit(lit(0, 0)), raw=arrays.unit(lit(0, 0), zeros=False), dot=arrays.dot(lit(1, 2), lit(3, 4)), pad=arrays.padded(lit(1), 3), peak=arrays.peak_normalised(lit(-2, 1)), present=arrays.first_present(F.lit(" "), F.lit("x")))
    assert r.unit == [0.6, 0.8] and r.zero == [0.0, 0.0] and r.raw == [0.0, 0.0] and r.dot == 11.0 and r.pad == [1.0, 0.0, 0.0] and r.peak == [-0.95, 0.475] and r.present == "x"


@pytest.mark.parametrize(("m1", "m2", "p", "score"), [(70.0, 85.0, 0.05884092, 94.1159), (100.0, 100.0, 0.0158556, 98.4144), (80.0, 90.0, 0.03826268, 96.1737)])
def test_transcript_score(spark, m1, m2, p, score):
    a, b = text.transcript_score(F.lit(m1), F.lit(m2))
    r = one(spark, p=a, s=b)
    assert r.p == pytest.approx(p, abs=1e-8) and r.s == pytest.approx(score, abs=1e-4)


def test_scales(spark):
    kinds = {"unit": lit(0.2, 1), "percent": lit(20, 100), "mixed": lit(0.5, 50), "invalid": lit(float("nan")), "empty": F.array().cast("array<double>")}
    r = one(spark, **{k: text.probability_scale(v) for k, v in kinds.items()})
    assert all(r[k] == k for k in kinds)
    m1, m2, gap = text.two_smallest(lit(90, 80, 95))
    assert tuple(one(spark, a=m1, b=m2, c=gap)) == (80.0, 90.0, 10.0)


def test_text(spark):
    r = one(
        spark, token=text.lexical_token(F.lit("«don't!»")), none=text.lexical_token(F.lit("--")), hazards=text.hazards(F.lit("5% of $3")), same=text.word_difference(text.compare_words(F.lit("A b, c")), text.compare_words(F.lit("a B c!"))),
        order=text.word_difference(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"))), pause=text.paused_token(F.lit("so"), F.lit(0.4)), tight=text.paused_token(F.lit("so,"), F.lit(0.01)), end=text.paused_token(F.lit("so."), F.lit(None).cast("double")),
        stem=text.filename_stem(F.lit(' a/b  "c" '), F.lit("id")), blank=text.filename_stem(F.lit("//"), F.lit("id")), speaker=text.speaker_id(F.lit("SPEAKER_007")), nospeaker=text.speaker_id(F.lit("x")),
        digest=text.digest(F.lit("sha256:" + "a" * 64)), bad=text.digest(F.lit("abc")), path=text.safe_relative_path(F.lit("a/b.wav")), up=text.safe_relative_path(F.lit("a/../b")),
    )
    assert (r.token, r.none) == ("don't", None)
    assert r.hazards == ["contains_currency_symbol", "contains_danger_symbol", "contains_numeric_token", "contains_percent_symbol"]
    assert (r.same, r.order, r.pause, r.tight, r.end) == ("identical", "word_order", "so,", "so", "so.")
    assert (r.stem, r.blank, r.speaker, r.nospeaker, r.digest, r.bad, r.path, r.up) == ("a b c", "id", "speaker_7", None, "a" * 64, None, True, False)


@pytest.mark.parametrize("rate", [16000, 32000, 44100, 48000])
def test_seconds_round_as_written_numbers_do(spark, rate):
    got = spark.range(20_001).select("id", numeric.to_seconds(F.col("id"), rate).alias("s")).collect()
    assert all(r.s == round(r.id / rate, 6) for r in got)


def test_rounded_is_correct_rounding(spark):
    rnd = random.Random(3)
    values = [rnd.uniform(-9, 9) for _ in range(300)] + [k / 20000 for k in range(-401, 20001, 37)] + [(a + b) / 2 for a, b in ((0.6505, 0.6506), (0.7031, 0.5982))] + [0.0, 0.5, 1.5, 2.5, 123456.78125]
    for places in (0, 2, 4):
        d = spark.createDataFrame([(v,) for v in values], "v double").select("v", numeric.rounded(F.col("v"), places).alias("r"))
        assert all(r.r == round(r.v, places) for r in d.collect())

"""Transcript and clip operators of the word-aligned planner: patches, short clips, statistics, energy regions and edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.functions.arrays import reasons
from clipweave.operators.intervals import points_in, union, union_length
from clipweave.operators.selection import with_quantiles


def patched_tokens(tokens: Column, patches: Column) -> Column:
    """Tokens with word ranges replaced: patches are structs of first, last (inclusive, from 0) and text, in order of first; one that overlaps the last
    applied is skipped. Folded from left to right over the array of patches."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        before = F.slice(tokens, s["at"] + 1, F.greatest(p["first"] - s["at"], F.lit(0)))
        done = F.struct((p["last"] + 1).alias("at"), F.concat(s["out"], before, F.array(p["text"])).alias("out"))
        return F.when((p["first"] >= s["at"]) & (p["last"] >= p["first"]) & (p["last"] < F.size(tokens)), done).otherwise(s)

    return F.aggregate(F.array_sort(patches), zero, step, lambda s: F.concat(s["out"], F.slice(tokens, s["at"] + 1, F.greatest(F.size(tokens) - s["at"], F.lit(0)))))


def merge_short(clips: DataFrame, keys: list[str], shortest: float = 2.0, target: float = 7.0) -> DataFrame:
    """Clips under ``shortest`` joined to the neighbour with which their two lengths together come nearest to the target, the earlier on ties.

    clips: keys, start, end. A join changes what the next sees, so a recording's clips are walked in order in one task. Returns keys, start, end, parts.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in clips.select(*keys).schema.fields) + ", start double, end double, parts int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = [[s, e, 1] for s, e in pdf.sort_values(["start", "end"])[["start", "end"]].itertuples(index=False)]
        k = 0
        while k < len(spans) and len(spans) > 1:
            s, e, n = spans[k]
            if e - s >= shortest:
                k += 1
                continue
            options = [(abs((spans[j][1] - spans[j][0]) + (e - s) - target), j) for j in (k - 1, k + 1) if 0 <= j < len(spans)]
            j = min(options)[1]
            lo, hi = min(k, j), max(k, j)
            spans[lo : hi + 1] = [[spans[lo][0], max(spans[lo][1], spans[hi][1]), spans[lo][2] + spans[hi][2]]]
            k = lo
        out = pd.DataFrame(spans, columns=["start", "end", "parts"])
        for c in reversed(keys):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return clips.groupBy(*keys).applyInPandas(one, schema)


def slice_statistics(clips: DataFrame, totals: DataFrame, keys: list[str], edges: tuple[float, ...] = (0, 2, 4, 6, 8, 10, 12, 15)) -> DataFrame:
    """Per key: clips, their length, covered share of the total, overlap with the one before, and counts by length in [low, high) buckets."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    length = F.col("end") - F.col("start")
    shared = F.greatest(F.lit(0.0), F.lag("end").over(w) - F.col("start"))
    buckets = [F.sum(F.when((length >= lo) & (length < hi), 1).otherwise(0)).cast("bigint").alias(f"from_{lo:g}") for lo, hi in zip(edges, (*edges[1:], float("inf")), strict=True)]
    per = clips.withColumn("_o", F.coalesce(shared, F.lit(0.0))).groupBy(*keys).agg(F.count(F.lit(1)).alias("clips"), F.sum(length).alias("seconds"), F.sum("_o").alias("overlap"), *buckets)
    covered = union_length(clips, keys).withColumnRenamed("length", "covered")
    return per.join(covered, keys).join(totals, keys).withColumn("coverage", F.try_divide(F.col("covered"), F.col("total")))


def energy_regions(frames: DataFrame, keys: list[str], join_gap: float = 0.18, pad: float = 0.05, least: float = 0.35, rejoin_gap: float = 0.12) -> DataFrame:
    """Regions of speech by level: frames over a threshold from the key's own levels, joined, padded, the short ones dropped, and joined again.

    frames: keys, start, end, level. The threshold is the largest of four statistics of the levels.
    """
    stats = with_quantiles(frames, keys, "level", {"p20": 0.2, "p50": 0.5}).withColumn("top", F.max("level").over(Window.partitionBy(*keys)))
    over = stats.where(F.col("level") >= F.greatest(F.col("p20") * 2.2, F.col("p50") * 0.6, F.col("top") * 0.08, F.lit(0.004)))
    first = union(over, keys, gap=join_gap).withColumn("start", F.greatest(F.col("start") - pad, F.lit(0.0))).withColumn("end", F.col("end") + pad)
    return union(first.where(F.col("end") - F.col("start") >= least).drop("parts"), keys, gap=rejoin_gap)


def window_mean(windows: DataFrame, frames: DataFrame, keys: list[str], id_col: str, bucket: float) -> DataFrame:
    """The mean level of the frames within each closed window, else that of the frame nearest to its middle. windows: keys, id, w_start, w_end; frames: keys, at, level.

    Frames meet windows by time bucket; the nearest frame comes from the last one before and the first one after, in one order of frames and middles.
    """
    within = (F.col("w_start") <= F.col("at")) & (F.col("at") <= F.col("w_end"))
    inside = points_in(frames.select(*keys, "at", "level"), windows.select(*keys, id_col, "w_start", "w_end"), keys, "at", "w_start", "w_end", bucket, within).groupBy(id_col).agg(F.avg("level").alias("inside"))
    middles = windows.join(inside, id_col, "left_anti").select(*keys, ((F.col("w_start") + F.col("w_end")) / 2).alias("at"), F.lit(None).cast("struct<at:double,level:double>").alias("frame"), F.col(id_col))
    both = frames.select(*keys, "at", F.struct(F.col("at").cast("double").alias("at"), F.col("level").cast("double").alias("level")).alias("frame"), F.lit(None).cast(windows.schema[id_col].dataType).alias(id_col)).unionByName(middles)
    in_order = Window.partitionBy(*keys).orderBy("at", F.col("frame").isNull())
    before = F.last("frame", True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("frame", True).over(in_order.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_b", before).withColumn("_a", after).where(F.col("frame").isNull())
    near = near.select(id_col, F.when(F.coalesce(F.col("_a.at") - F.col("at") < F.col("at") - F.col("_b.at"), F.col("_b").isNull()), F.col("_a.level")).otherwise(F.col("_b.level")).alias("near"))
    return windows.join(inside, id_col, "left").join(near, id_col, "left").withColumn("mean_level", F.coalesce("inside", "near", F.lit(0.0))).drop("inside", "near")


def snap(gaps: DataFrame, frames: DataFrame, keys: list[str], id_col: str, bucket: float, slack: float = 1.15) -> DataFrame:
    """Where to cut in each gap: of the frames within ``slack`` of the gap's least level the one nearest to its middle; the middle where there are none.

    gaps: keys, id, g_start, g_end; frames: keys, at, level. Frames meet gaps by time bucket.
    """
    middle = (F.col("g_start") + F.col("g_end")) / 2
    within = (F.col("g_start") <= F.col("at")) & (F.col("at") <= F.col("g_end"))
    in_gap = points_in(frames.select(*keys, "at", "level"), gaps.select(*keys, id_col, "g_start", "g_end"), keys, "at", "g_start", "g_end", bucket, within)
    low = in_gap.groupBy(id_col).agg(F.min("level").alias("low"))
    best = in_gap.join(low, id_col).where(F.col("level") <= F.greatest(F.col("low") * slack, F.col("low") + 1e-6)).groupBy(id_col).agg(F.min_by("at", F.struct(F.abs(F.col("at") - middle).alias("d"), "at")).alias("cut"))
    return gaps.join(best, id_col, "left").withColumn("cut", F.coalesce("cut", middle))


def gap_tripwires(ratio: Column, flatness: Column, pitch: Column, crest: Column, max_ratio: float = 0.25, min_flatness: float = 0.1, max_pitch: float = 0.5, max_crest: float = 6.0) -> Column:
    """The rules that a gap between words breaks, by level, spectrum, pitch and crest."""
    return reasons((ratio > max_ratio, "volume_ratio"), (flatness < min_flatness, "spectral_flatness"), (pitch > max_pitch, "pitch_confidence"), (crest > max_crest, "crest_factor"))


def rule_counts(rows: DataFrame, column: str, rules: list[str]) -> DataFrame:
    """How many rows break each rule, those that none breaks included."""
    named = rows.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return named.join(rows.select(F.explode(column).alias("rule")).groupBy("rule").count(), "rule", "left").select("rule", F.coalesce("count", F.lit(0)).alias("n"))


def reviewer_tags(tags: Column, most: int = 20, longest: int = 48) -> Column:
    """Tags with single spaces, each once whatever its case, in the first spelling; null if there are too many or one is empty or too long."""
    clean = F.transform(tags, lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    zero = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))
    kept = F.aggregate(clean, zero, lambda s, t: F.when(F.array_contains(s["seen"], F.lower(t)), s).otherwise(F.struct(F.concat(s["seen"], F.array(F.lower(t))).alias("seen"), F.concat(s["out"], F.array(t)).alias("out"))), lambda s: s["out"])
    fine = F.forall(clean, lambda t: (t != "") & (F.length(t) <= longest)) & (F.size(kept) <= most)
    return F.when(fine, kept)


#: Number words.
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = ["", "thousand", "million", "billion"]


def integer_words(n: Column) -> Column:
    """A whole number under a trillion in words, from lookups by its groups of three digits."""
    ones, tens = F.array(*[F.lit(w) for w in ONES]), F.array(*[F.lit(w) for w in TENS])
    at = lambda words, k: F.get(words, k.cast("int"))

    def below_thousand(g: Column) -> Column:
        hundred = F.when(g >= 100, F.concat(at(ones, F.floor(g / 100)), F.lit(" hundred")))
        rest = g % 100
        small = F.when(rest == 0, None).when(rest < 20, at(ones, rest)).otherwise(F.concat_ws(" ", at(tens, F.floor(rest / 10)), F.when(rest % 10 > 0, at(ones, rest % 10))))
        return F.concat_ws(" ", hundred, small)

    m = F.abs(n.cast("bigint"))
    parts = []
    for k in range(len(SCALES) - 1, -1, -1):
        g = F.floor(m / 1000**k) % 1000
        parts.append(F.when(g > 0, F.concat_ws(" ", below_thousand(g), F.lit(SCALES[k]) if SCALES[k] else F.lit(None).cast("string"))))
    words = F.concat_ws(" ", F.when(n < 0, "minus"), *parts)
    return F.when(m >= 1000 ** len(SCALES), None).when(m == 0, "zero").otherwise(words)


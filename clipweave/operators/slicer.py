"""From speech frames to clips: quiet islands, their valleys, legal pairs of cuts, and the best schedule of clips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.operators.intervals import islands, points_in
from clipweave.operators.selection import with_quantiles
from clipweave.operators.written import written

EPS = 1e-9
#: A clip's legal length in seconds, with a millisecond of tolerance; lengths within PREFERRED weigh most.
SHORTEST, LONGEST, TOLERANCE, PREFERRED, TARGET = 3.0, 15.0, 0.001, (6.0, 8.0), 8.0


def quiet_score(prob: Column, rms: Column) -> Column:
    """Higher for frames with less speech and less level."""
    return (1 - prob) + F.least(F.greatest(-rms / 100.0, F.lit(0.0)), F.lit(1.0))


def frames_in(frames: DataFrame, buffers: DataFrame, keys: list[str], bucket: float) -> DataFrame:
    """Frames strictly inside the buffers of their recording. buffers: keys, buffer_id, b_start, b_end."""
    return points_in(frames, buffers, keys, "center", "b_start", "b_end", bucket, (F.col("center") > F.col("b_start") + EPS) & (F.col("center") < F.col("b_end") - EPS))


def detect_cutpoints(frames: DataFrame, keys: list[str], prob_below: float = 0.2, rms_over_floor: float = 3.0, quantile: float = 0.10, least: float = 0.040) -> DataFrame:
    """One cut per quiet island of each buffer: its valley.

    frames: keys (recording, buffer), center, start, end, prob, rms, pos. The level's floor is a percentile of the buffer. Numbers count all islands,
    the short ones too.
    """
    quiet = with_quantiles(frames, keys, "rms", {"floor": quantile}).where((F.col("prob") < prob_below) & (F.col("rms") <= F.col("floor") + rms_over_floor))
    runs = islands(quiet, keys, gap=EPS)
    span = Window.partitionBy(*keys, "island")
    runs = runs.withColumn("run_start", F.min("start").over(span)).withColumn("run_end", F.max("end").over(span))
    middle = (F.col("run_start") + F.col("run_end")) / 2
    valley = F.struct("prob", "rms", F.abs(F.col("center") - middle).alias("off"), "pos")
    cuts = runs.groupBy(*keys, "island").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.count(F.lit(1)).alias("n_frames"), F.min_by(F.struct("center", "prob", "rms"), valley).alias("v"))
    cuts = cuts.where(F.col("run_end") - F.col("run_start") >= least - EPS)
    return cuts.select(*keys, F.col("island").alias("run_index"), "run_start", "run_end", "n_frames", F.round("v.center", 6).alias("time"), F.round(quiet_score(F.col("v.prob"), F.col("v.rms")), 6).alias("score"))


def dedupe_cutpoints(cuts: DataFrame, recording: str, buffer: str, id_col: str) -> DataFrame:
    """Of cuts of a recording at one millisecond the best, with what supports it: n_support, mean_score, max_score."""
    ms = F.bround(F.col("time") * 1000, 0).cast("bigint")
    best = F.struct("score", (-F.length(F.col(buffer).cast("string"))).alias("len"), F.col(buffer), F.col(id_col))
    g = cuts.groupBy(F.col(recording), ms.alias("ms")).agg(F.max_by(F.struct(*cuts.columns), best).alias("r"), F.count(F.lit(1)).alias("n_support"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))
    return g.select("r.*", "n_support", "mean_score", "max_score")


def clip_weight(seconds: Column) -> Column:
    """The weight of a clip by length: most from 6 to 8 seconds."""
    low, high = PREFERRED
    longer = 6.5 - F.greatest(F.lit(0.0), seconds - 9.0)
    return F.when(seconds.between(low, high), 10.0 - (TARGET - seconds) * 1.5).when(seconds > high, longer).otherwise(seconds / SHORTEST)


def legal_pairs(cuts: DataFrame, keys: list[str], shortest: float = SHORTEST, longest: float = LONGEST) -> DataFrame:
    """Pairs of cuts of one buffer at a legal distance: keys, start_id, end_id, start, end, seconds, weight.

    A banded join on time buckets of the longest length: a cut meets those of its own and the next bucket only. Cuts are written
    first, else both sides would find them anew.
    """
    cuts = written(cuts.select(*keys, "cut_id", "time"), "cuts")
    a = cuts.select(*keys, F.col("cut_id").alias("start_id"), F.col("time").alias("start"), F.floor(F.col("time") / longest).alias("_b"))
    b = cuts.select(*keys, F.col("cut_id").alias("end_id"), F.col("time").alias("end"), F.floor(F.col("time") / longest).alias("_b"))
    # The longest legal distance plus tolerance reaches at most two buckets on.
    a = a.withColumn("_b", F.explode(F.array(F.col("_b"), F.col("_b") + 1, F.col("_b") + 2)))
    near = (F.col("end") - F.col("start") >= shortest - TOLERANCE) & (F.col("end") - F.col("start") <= longest + TOLERANCE)
    out = a.join(b, [*keys, "_b"]).where(near).drop("_b")
    return out.withColumn("seconds", F.round(F.col("end") - F.col("start"), 6)).withColumn("weight", F.round(clip_weight(F.col("seconds")), 7))


def nearest_target_pairs(cuts: DataFrame, keys: list[str], target: float, shortest: float, longest: float, stride: int = 1) -> DataFrame:
    """From every ``stride``-th cut of a buffer the legal end nearest to the target length, earlier on ties."""
    order = Window.partitionBy(*keys).orderBy("time", "cut_id")
    starts = cuts.withColumn("_n", F.row_number().over(order)).where((F.col("_n") - 1) % stride == 0)
    pairs = legal_pairs(cuts, keys, shortest, longest).join(starts.select(*keys, F.col("cut_id").alias("start_id")), [*keys, "start_id"], "left_semi")
    best = F.struct(F.abs(F.col("seconds") - target).alias("d"), F.col("end"), F.col("end_id"))
    return pairs.groupBy(*keys, "start_id", "start").agg(F.min_by(F.struct("end_id", "end", "seconds"), best).alias("b")).select(*keys, "start_id", "start", "b.*")


def schedule(start: np.ndarray, end: np.ndarray, weight: np.ndarray, max_overlap: float = 0.0) -> np.ndarray:
    """Places, by start, of a heaviest set of intervals that overlap by ``max_overlap`` at most; including wins ties."""
    order = np.lexsort((start, end))
    s, e, w = start[order], end[order], weight[order]
    before = np.searchsorted(e, s + max_overlap + 1e-12, "right")
    before, w = before.tolist(), w.tolist()
    best, take = [0.0], []
    for i in range(len(w)):
        with_it = w[i] + best[min(before[i], i)]
        take.append(with_it >= best[i] - 1e-12)
        best.append(with_it if take[i] else max(with_it, best[i]))
    out, i = [], len(s)
    while i > 0:
        if take[i - 1]:
            out.append(order[i - 1])
            i = min(before[i - 1], i - 1)
        else:
            i -= 1
    return np.array(sorted(out, key=lambda k: (start[k], end[k])), dtype=int)


def schedule_clips(pairs: DataFrame, keys: list[str], max_overlap: float = 0.0) -> DataFrame:
    """The best schedule of each buffer. A buffer is one trusted stretch of a recording, so its candidates fit in a task.

    Most buffers have a few pairs, so a task takes its buffers one after the other from rows in order, not one by one as frames.
    """

    def chosen(rows: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        start, end, weight = (rows.column(c).to_numpy() for c in ("start", "end", "weight"))
        taken = [lo + schedule(start[lo:hi], end[lo:hi], weight[lo:hi], max_overlap) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        yield from rows.take(pa.array(np.concatenate(taken))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = []  # batches of the last buffer so far, which may go on
        key = lambda b, i: [repr(b.column(k)[i].as_py()) for k in keys]
        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
            cuts = (np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1).tolist()
            if open_ and key(open_[-1], open_[-1].num_rows - 1) != key(b, 0):
                yield from chosen(pa.Table.from_batches(open_), [0, sum(x.num_rows for x in open_)])
                open_ = []
            if cuts:
                rows = pa.Table.from_batches([*open_, b.slice(0, cuts[-1])])
                before = rows.num_rows - cuts[-1]
                yield from chosen(rows, [0, *(before + c for c in cuts)])
                open_ = []
            open_.append(b.slice(cuts[-1] if cuts else 0))
        if open_:
            yield from chosen(pa.Table.from_batches(open_), [0, sum(x.num_rows for x in open_)])

    ordered = pairs.repartition(*keys).sortWithinPartitions(*keys, "start", "end", "start_id", "end_id")
    return ordered.mapInArrow(run, pairs.schema)


def schedule_breaks(clips: DataFrame, keys: list[str], max_overlap: float = 0.0) -> DataFrame:
    """Clips that overlap their predecessor by more than allowed; none in a sound schedule."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return clips.withColumn("over", F.lag("end").over(w) - F.col("start")).where(F.col("over") > max_overlap + 1e-9)


def used_cutpoints(clips: DataFrame, keys: list[str]) -> DataFrame:
    """The cuts that a schedule ends or begins at, once each: keys, cut_id, time."""
    ends = F.explode(F.array(F.struct(F.col("start_id").alias("cut_id"), F.col("start").alias("time")), F.struct(F.col("end_id").alias("cut_id"), F.col("end").alias("time"))))
    return clips.select(*keys, ends.alias("c")).select(*keys, "c.*").distinct()


def keep_order_clamp(words: DataFrame, keys: list[str]) -> DataFrame:
    """Aligned words in order, each start moved to the end of the last kept word where it overlaps that by over a millisecond; empty words go.

    What a word becomes depends on the last kept one, so each recording's words are folded as an array.
    """
    ws = F.array_sort(F.collect_list(F.struct("start", "end", "word")))
    zero = F.expr("named_struct('last', cast(null as double), 'out', cast(array() as array<struct<start:double,end:double,word:string>>))")

    def step(s: Column, x: Column) -> Column:
        start = F.when(s["last"].isNotNull() & (x["start"] < s["last"] - 0.001), s["last"]).otherwise(x["start"])
        kept = F.struct(start.alias("start"), x["end"].alias("end"), x["word"].alias("word"))
        return F.when(x["end"] > start, F.struct(x["end"].alias("last"), F.concat(s["out"], F.array(kept)).alias("out"))).otherwise(s)

    return words.groupBy(*keys).agg(F.aggregate(ws, zero, step, lambda s: s["out"]).alias("w")).select(*keys, F.posexplode("w").alias("pos", "x")).select(*keys, "pos", "x.start", "x.end", "x.word")


#: Fixed values of the greedy grouping, in seconds: guards after and before a word, the least and the preferred guarded gap; a clip's target, least, soft most and most length.
GUARD_AFTER, GUARD_BEFORE, LEAST_GAP, PREFERRED_GAP = 0.045, 0.035, 0.12, 0.24
CLIP_TARGET, CLIP_LEAST, CLIP_SOFT, CLIP_MOST = 7.0, 2.0, 10.0, 15.0
#: The acoustic score's share of a boundary's strength and the least it may be; the weights of length, strength and overshoot.
ACOUSTIC_SHARE, LEAST_ACOUSTIC, BY_LENGTH, BY_STRENGTH, BY_OVERSHOOT = 0.65, 0.35, 0.55, 0.45, 0.35


def boundary_candidates(words: DataFrame, keys: list[str], acoustic: str | None = None) -> DataFrame:
    """Words that a clip may end with: those before a long enough guarded gap, with column gap, time (its middle) and strength.

    ``acoustic``: a column of scores of the gaps' quiet, from 0 to 1; candidates below the least are dropped. Without it the score counts as 0.
    """
    return _with_boundaries(words, keys, acoustic).where("strength IS NOT NULL")


def _with_boundaries(words: DataFrame, keys: list[str], acoustic: str | None) -> DataFrame:
    """All ``words`` with gap, time and strength, which are null where no clip may end."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "pos")
    lo, hi = F.col("end") + GUARD_AFTER, F.lead("start").over(w) - GUARD_BEFORE
    score = F.col(acoustic) if acoustic else F.lit(0.0)
    g = words.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("gap", F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    may = F.col("_hi").isNotNull() & (F.col("gap") >= LEAST_GAP)
    if acoustic:
        may &= score >= LEAST_ACOUSTIC
    strength = F.lit(1.0 - ACOUSTIC_SHARE) * F.least(F.col("gap") / PREFERRED_GAP, F.lit(1.0)) + F.lit(ACOUSTIC_SHARE) * score
    return g.withColumns({"time": F.when(may, (F.col("_lo") + F.col("_hi")) / 2), "strength": F.when(may, strength), "gap": F.when(may, F.col("gap"))}).drop("_lo", "_hi")


def clip_ends(start: np.ndarray, end: np.ndarray, strength: np.ndarray, gap: np.ndarray) -> list[tuple[int, int]]:
    """First and last word of each clip of one recording, in order. ``strength`` is NaN where no clip may end."""
    n, out, i = len(start), [], 0
    may = np.flatnonzero(~np.isnan(strength[: n - 1])) if n else np.empty(0, int)
    while i < n:
        best, best_rank, over = None, None, None
        for k in may[np.searchsorted(may, i) :]:
            length = end[k] - start[i]
            if length < CLIP_LEAST:
                continue
            if length > CLIP_MOST:
                over = int(k)
                break
            score = BY_LENGTH * (1.0 - min(abs(length - CLIP_TARGET) / max(CLIP_TARGET - CLIP_LEAST, 0.5), 1.0)) + BY_STRENGTH * strength[k]
            if length > CLIP_SOFT:
                score -= BY_OVERSHOOT * min((length - CLIP_SOFT) / max(CLIP_MOST - CLIP_SOFT, 0.5), 1.0)
            rank = (score, strength[k], gap[k])
            if best_rank is None or rank > best_rank:
                best, best_rank = int(k), rank
        last = best if best is not None else over if over is not None else n - 1
        out.append((i, last))
        i = last + 1
    return out


def greedy_groups(words: DataFrame, keys: list[str], acoustic: str | None = None) -> DataFrame:
    """Chains of words cut greedily: each clip starts after the one before and ends at the boundary that scores best by length and strength, else at
    the first one past the most, else at the recording's end.

    words: keys, pos, start, end. A recording's words are one array in one task, as each cut depends on the last. Returns keys, clip, first, last, start, end.
    """
    marked = _with_boundaries(words, keys, acoustic).select(*keys, "pos", "start", "end", "strength", "gap")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.select(*keys).schema.fields) + ", clip int, first int, last int, start double, end double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end", "pos"], ignore_index=True)
        s, e, strength, gap = (pdf[c].to_numpy(float) for c in ("start", "end", "strength", "gap"))
        res = pd.DataFrame([(k, i, j, s[i], e[j]) for k, (i, j) in enumerate(clip_ends(s, e, strength, gap))], columns=["clip", "first", "last", "start", "end"])
        for k in reversed(keys):
            res.insert(0, k, pdf[k].iloc[0])
        return res

    return marked.groupBy(*keys).applyInPandas(one, schema)


def clip_specs(words: DataFrame, clips: DataFrame, keys: list[str], acoustic: str | None = None, long_over: float = 12.0) -> DataFrame:
    """Each clip's words as one row: keys, clip, transcript, word_count, duration, avg_confidence and flags joined by a spaced pipe.

    words: keys, pos, word, start, end, confidence; pos counts a recording's words in order. clips: as of ``greedy_groups``.
    """
    at_boundary = boundary_candidates(words, keys, acoustic).select(*keys, F.col("pos").alias("last"), F.lit(True).alias("bounded"))
    spans = clips.select(*keys, "clip", F.col("start").alias("c_start"), F.col("end").alias("c_end"), "last", F.explode(F.sequence("first", "last")).alias("pos"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    spec = spans.join(words, [*keys, "pos"]).groupBy(*keys, "clip", "c_start", "c_end", "last").agg(F.trim(text).alias("transcript"), F.count(F.lit(1)).alias("word_count"), F.avg("confidence").alias("avg_confidence"))
    spec = spec.withColumn("duration", F.col("c_end") - F.col("c_start")).join(at_boundary, [*keys, "last"], "left")
    flags = joined_flags(
        F.when(F.col("duration") > long_over, F.format_string("long_%.1fs", "duration")),
        F.when(F.col("bounded").isNull() & (F.col("duration") > CLIP_MOST), F.format_string("no_safe_boundary_%.1fs", "duration")),
        F.when(F.round("avg_confidence", 9) < 0.5, F.format_string("low_confidence_%.2f", "avg_confidence")),
    )
    return spec.select(*keys, "clip", "transcript", "word_count", "duration", "avg_confidence", flags.alias("flags"))


def joined_flags(*flags: Column) -> Column:
    """Flags that are there, each once and in order, joined by a spaced pipe."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*flags))), " | ")

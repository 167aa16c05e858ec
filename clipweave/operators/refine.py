"""Acoustic refinement of planned clips: boundaries that neighbours share, energies at their edges, and what is wrong with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.functions.numeric import clamp
from clipweave.operators.ordering import running_sums
from clipweave.operators.review import snap
from clipweave.operators.slicer import GUARD_AFTER, GUARD_BEFORE, joined_flags
from clipweave.operators.written import written

#: Fixed values, in seconds: the edge that is measured, the context of a boundary, and the most silence before and after; the most an edge may have of a clip's mean, and the least share of speech.
EDGE, CONTEXT, SILENCE = 0.025, 0.080, 0.650
EDGE_RATIO, SPEECH_RATIO = 0.65, 0.72
#: Sums of levels are kept to this decimal type, exactly: a window's sum is a difference of two sums over everything before.
_EXACT = "decimal(38,18)"


def window_means(windows: DataFrame, frames: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """id, mean: the mean level of the frames within each closed window, else that of the frame nearest to its middle (the earlier on ties), 0 for windows without length or frames.

    windows: keys, id, w_start, w_end; frames: keys, at, level. Frames and window ends go in one order of key and time, cut in range partitions, with running sums and
    counts; a window's sum is the difference at its ends. So the work is one sort whatever the windows' lengths, and a long recording is many tasks.
    """
    null = lambda kind: F.lit(None).cast(kind)
    kind = windows.schema[id_col].dataType
    level = F.col("level").cast("double")
    real = windows.where(F.col("w_end") > F.col("w_start"))
    rows = frames.where("level IS NOT NULL AND at IS NOT NULL").select(*keys, F.col("at").cast("double").alias("at"), F.lit(1).alias("side"), level.alias("level"), null(kind).alias(id_col))
    for side, end in ((0, "w_start"), (2, "w_end")):  # an end before the frames of its time, or after them
        rows = rows.unionByName(real.select(*keys, F.col(end).cast("double").alias("at"), F.lit(side).alias("side"), null("double").alias("level"), id_col))
    here = F.col("side") == 1
    summed = running_sums(rows, [*keys, "at", "side"], {"sum": F.when(here, F.col("level").cast(_EXACT)).otherwise(F.lit(0).cast(_EXACT)), "number": F.when(here, 1).otherwise(0).cast("bigint")})
    summed = written(summed, "window_sums")
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    ends = summed.where("side <> 1").groupBy(*keys, id_col).agg(at(0, "sum").alias("s0"), at(2, "sum").alias("s1"), at(0, "number").alias("n0"), at(2, "number").alias("n1"), ((at(0, "at") + at(2, "at")) / 2).alias("middle"))
    full = ends.where("n1 > n0").select(id_col, ((F.col("s1") - F.col("s0")).cast("double") / (F.col("n1") - F.col("n0"))).alias("mean"))
    # Empty windows lie between two frames that follow one another in the order.
    bare = ends.where("n1 = n0").select(*keys, id_col, "middle", F.explode(F.array("n0", F.col("n0") + 1)).alias("number"))
    near = bare.join(summed.where(here).select(*[F.col(k).alias(f"_f_{k}") for k in keys], "number", F.col("at").alias("f_at"), "level"), "number")
    for k in keys:
        near = near.where(F.col(k).eqNullSafe(F.col(f"_f_{k}")))
    near = near.groupBy(id_col).agg(F.min_by("level", F.struct(F.abs(F.col("f_at") - F.col("middle")).alias("d"), "f_at")).alias("mean"))
    return windows.select(id_col).join(full.unionByName(near), id_col, "left").select(id_col, F.coalesce("mean", F.lit(0.0)).alias("mean"))


def _means(rows: DataFrame, frames: DataFrame, keys: list[str], id_col: str, spans: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``rows`` with, for each name, the mean level over its span."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), lo.cast("double").alias("w_start"), hi.cast("double").alias("w_end")) for k, (lo, hi) in spans.items()])).alias("w")
    windows = rows.select(*keys, id_col, each).select(*keys, F.struct(id_col, "w.name").alias("window"), "w.w_start", "w.w_end")
    found = window_means(windows, frames, keys, "window")
    wide = found.groupBy(F.col(f"window.{id_col}").alias(id_col)).agg(*[F.max(F.when(F.col("window.name") == k, F.col("mean"))).alias(k) for k in spans])
    return rows.join(wide, id_col)


def _held(frames: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Frames (keys, at, level) as two arrays, _at and _level, per key and bucket of time: its own and the next bucket's, the last one before and the first one after."""
    f = frames.where("level IS NOT NULL AND at IS NOT NULL").select(*keys, F.struct(F.col("at").cast("double").alias("at"), F.col("level").cast("double").alias("level")).alias("f"))
    held = f.groupBy(*keys, F.floor(F.col("f.at") / F.lit(width)).alias("_b")).agg(F.array_sort(F.collect_list("f")).alias("f"))
    own = Window.partitionBy(*keys).orderBy("_b")
    some = lambda x: F.array_compact(F.array(x))
    held = held.withColumns({"_before": F.lag(F.element_at("f", -1)).over(own), "_next_b": F.lead("_b").over(own), "_next": F.lead("f").over(own), "_third": F.lead(F.get("f", F.lit(0)), 2).over(own)})
    after = F.when(F.col("_next_b") == F.col("_b") + 1, F.concat("_next", some(F.col("_third")))).when(F.col("_next").isNotNull(), F.slice("_next", 1, 1)).otherwise(F.slice("f", 1, 0))
    held = held.select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_b", F.concat(some(F.col("_before")), "f", after).alias("_f"))
    return held.select(*[f"_h_{k}" for k in keys], "_b", F.col("_f.at").alias("_at"), F.col("_f.level").alias("_level"))  # half as large as structs


def _beside(rows: DataFrame, held: DataFrame, keys: list[str], lo: Column, hi: Column, width: float, measure: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What ``measure`` adds to rows from the frames within [lo, hi], the last one before and the first one after, which it finds as array _f; and the rows for which
    a bucket doesn't hold them: longer than one, or in a bucket without frames. Frames never go through the driver: what they were gathered from, or are written as,
    says little of their size, so a broadcast is ruled out."""
    same = F.col("_b") == F.floor(lo / F.lit(width))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    met = rows.join(held.hint("merge"), same, "left").drop("_b", *[f"_h_{k}" for k in keys])
    met = met.withColumn("_f", F.zip_with("_at", "_level", lambda at, level: F.struct(at.alias("at"), level.alias("level")))).drop("_at", "_level")
    within = F.filter("_f", lambda f: (f["at"] >= lo) & (f["at"] <= hi))
    ends = F.array_compact(F.array(F.try_element_at(F.filter("_f", lambda f: f["at"] < lo), F.lit(-1)), F.get(F.filter("_f", lambda f: f["at"] > hi), F.lit(0))))
    met = measure(met.withColumn("_f", F.when(hi - lo <= width, F.concat(within, ends))))
    met = written(met.withColumn("_found", F.col("_f").isNotNull()).drop("_f"), "beside")
    return met.where("_found").drop("_found"), met.where("NOT _found").select(*rows.columns)


def _mean_beside(lo: Column, hi: Column) -> Column:
    """The mean level over a span as in ``window_means``, from the frames in _f."""
    inside = F.filter("_f", lambda f: (f["at"] >= lo) & (f["at"] <= hi))
    total = F.aggregate(inside, F.lit(0).cast(_EXACT), lambda s, f: (s + f["level"].cast(_EXACT)).cast(_EXACT))
    nearest = F.array_min(F.transform("_f", lambda f: F.struct(F.abs(f["at"] - (lo + hi) / 2).alias("d"), f["at"].alias("at"), f["level"].alias("level"))))["level"]
    return F.coalesce(F.when(hi > lo, F.when(F.size(inside) > 0, total.cast("double") / F.size(inside)).otherwise(nearest)), F.lit(0.0))


def _snap_beside(lo: Column, hi: Column, slack: float = 1.15) -> Column:
    """Where to cut in [lo, hi] as in ``snap``, from the frames in _f."""
    inside = F.filter("_f", lambda f: (f["at"] >= lo) & (f["at"] <= hi))
    low = F.array_min(F.transform(inside, lambda f: f["level"]))
    quiet = F.filter(inside, lambda f: f["level"] <= F.greatest(low * slack, low + 1e-6))
    return F.coalesce(F.array_min(F.transform(quiet, lambda f: F.struct(F.abs(f["at"] - (lo + hi) / 2).alias("d"), f["at"].alias("at"))))["at"], (lo + hi) / 2)


def _of(rows: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """The frames of the rows' keys."""
    wanted = rows.select(*[F.col(k).alias(f"_w_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_w_{k}"))
    return frames.join(wanted, same, "left_semi")


def acoustic_boundaries(words: DataFrame, frames: DataFrame, keys: list[str], bucket: float = 10.0) -> DataFrame:
    """For every gap between words with room: its guarded ends, the quiet moment to cut at (time), the score of its quiet (acoustic) and its valley's energy.

    words: keys, pos, start, end. The score is one less the valley's share of the levels beside it. Returns keys, pos (of the word before), g_start, g_end, time, acoustic, valley.
    A gap meets one bucket's frames, which give its cut and its levels at once; long gaps and those far from frames are rare and take the frames in one order.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end", "pos")
    gaps = words.select(*keys, "pos", F.col("start").alias("w0"), F.col("end").alias("w1"), F.lead("start").over(w).alias("n0"), F.lead("end").over(w).alias("n1"))
    gaps = gaps.where("n0 IS NOT NULL").withColumn("g_start", F.col("w1") + GUARD_AFTER).withColumn("g_end", F.col("n0") - GUARD_BEFORE).where("g_end > g_start")
    t = F.col("time")
    spans = {
        "valley": (F.greatest(t - CONTEXT / 2, F.col("w1")), F.least(t + CONTEXT / 2, F.col("n0"))),
        "left": (F.greatest(F.col("w0"), F.col("w1") - CONTEXT), F.col("w1")),
        "right": (F.col("n0"), F.least(F.col("n1"), F.col("n0") + CONTEXT)),
    }
    measure = lambda d: d.withColumn("time", _snap_beside(F.col("g_start"), F.col("g_end"))).withColumns({k: _mean_beside(*span) for k, span in spans.items()})
    got, rest = _beside(gaps, _held(frames, keys, bucket), keys, F.col("w1") - CONTEXT, F.col("n0") + CONTEXT, bucket, measure)
    if not rest.isEmpty():
        few = _of(rest, frames, keys)
        cut = written(snap(rest.withColumn("gap", F.struct(*keys, "pos")), few, keys, "gap", bucket).withColumnRenamed("cut", "time"), "boundaries")
        got = got.unionByName(_means(cut, few, keys, "gap", spans).drop("gap"))
    speech = F.greatest((F.col("left") + F.col("right")) / 2, F.col("valley"))
    score = F.when(speech <= 0, 1.0).otherwise(clamp(1.0 - F.col("valley") / speech, 0, 1))
    return got.select(*keys, "pos", "g_start", "g_end", "time", score.alias("acoustic"), "valley")


def refine(clips: DataFrame, frames: DataFrame, keys: list[str], bucket: float = 20.0) -> DataFrame:
    """Planned clips with the bounds to train on: neighbours share one quiet moment in the gap between them; and flags of loud edges, silence and little speech.

    clips: keys, clip (in order), start, end, total (the recording's length); safe_start, safe_end of the gap after it, null where it is cut without a boundary; breath,
    whether one is heard in that gap. frames: keys, at, level. Returns keys, clip, start, end, training_start, training_end, breath_at_start, breath_at_end, edge_start, edge_end, mean_level, flags.
    """
    w = Window.partitionBy(*keys).orderBy("clip")
    name = F.struct(*keys, "clip")
    rows = clips.withColumn("id", name).withColumn("_next", F.lead("start").over(w))
    rows = written(rows.withColumn("g_start", F.coalesce("safe_start", F.col("end") + GUARD_AFTER)).withColumn("g_end", F.coalesce("safe_end", F.col("_next") - GUARD_BEFORE)), "planned")
    held = written(_held(frames, keys, bucket), "frame_buckets")
    open_ = F.col("_next").isNotNull() & (F.col("g_end") > F.col("g_start"))
    near, rest = _beside(rows.where(open_), held, keys, F.col("g_start"), F.col("g_end"), bucket, lambda d: d.withColumn("_cut", _snap_beside(F.col("g_start"), F.col("g_end"))))
    snapped = near.unionByName(rows.where(~F.coalesce(open_, F.lit(False))).withColumn("_cut", F.lit(None).cast("double")))
    if not rest.isEmpty():
        snapped = snapped.unionByName(snap(rest, _of(rest, frames, keys), keys, "id", bucket).withColumnRenamed("cut", "_cut"))
    cut = snapped.withColumn("_cut", F.when(F.col("_next").isNotNull(), F.coalesce("_cut", "g_start")))
    breath = F.coalesce(F.col("breath"), F.lit(False))
    cut = cut.withColumns({
        "training_start": F.coalesce(F.lag("_cut").over(w), F.col("start")), "training_end": F.coalesce("_cut", "end"),
        "breath_at_end": F.col("_next").isNotNull() & breath, "breath_at_start": F.coalesce(F.lag(breath).over(w), F.lit(False)),
    })
    cut = cut.drop("_cut", "_next", "g_start", "g_end", "safe_start", "safe_end", "breath")
    lo, hi = F.col("training_start"), F.col("training_end")
    spans = {"edge_start": (lo, F.least(lo + EDGE, F.col("total"))), "edge_end": (F.greatest(F.lit(0.0), hi - EDGE), hi), "mean_level": (lo, hi)}
    got, rest = _beside(cut, held, keys, F.least(lo, hi - EDGE), F.greatest(hi, lo + EDGE), bucket, lambda d: d.withColumns({k: _mean_beside(*span) for k, span in spans.items()}))
    if not rest.isEmpty():
        got = got.unionByName(_means(rest, _of(rest, frames, keys), keys, "id", spans))
    length = F.greatest(F.lit(0.0), hi - lo)
    before, after = F.greatest(F.lit(0.0), F.col("start") - lo), F.greatest(F.lit(0.0), hi - F.col("end"))
    speech = clamp((F.col("end") - F.col("start")) / length, 0, 1)
    # To 9 places, so that a ratio at the limit is not over it by the last bits of a mean.
    loud = lambda c: F.round(F.try_divide(F.col(c), F.when(F.col("mean_level") > 0, F.col("mean_level"))), 9)
    flags = joined_flags(
        F.when(loud("edge_start") > EDGE_RATIO, F.format_string("high_start_edge_energy_%.2f", loud("edge_start"))),
        F.when(loud("edge_end") > EDGE_RATIO, F.format_string("high_end_edge_energy_%.2f", loud("edge_end"))),
        F.when(before > SILENCE, F.format_string("leading_silence_%.2fs", before)),
        F.when(after > SILENCE, F.format_string("trailing_silence_%.2fs", after)),
        F.when((length > 0) & (speech < SPEECH_RATIO), F.format_string("low_speech_ratio_%.2f", speech)),
    )
    return got.select(*keys, "clip", "start", "end", "training_start", "training_end", "breath_at_start", "breath_at_end", "edge_start", "edge_end", "mean_level", flags.alias("flags"))

"""Interval algebra over [start, end) columns: unions, gap-aware merging, containment and overlap joins, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.operators.ordering import with_row_number


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Half-open intervals that share a point."""
    return (start_a < end_b) & (start_b < end_a)


def overlap_length(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """The length that two intervals share, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def overlap_ratio(start_a: Column, end_a: Column, start_b: Column, end_b: Column, floor: float = 0.001) -> Column:
    """Shared length over the shorter one, which counts as ``floor`` at least."""
    return overlap_length(start_a, end_a, start_b, end_b) / F.greatest(F.least(end_a - start_a, end_b - start_b), F.lit(floor))


def clamp_to(rows: DataFrame, length: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals cut to [0, length], empty ones dropped; column clipped says which were cut."""
    lo, hi = F.greatest(F.col(start), F.lit(0)), F.least(F.col(end), length)
    return rows.withColumn("clipped", (lo != F.col(start)) | (hi != F.col(end))).withColumn(start, lo).withColumn(end, hi).where(F.col(start) < F.col(end))


def islands(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: float = 0.0, breaks: Column | None = None) -> DataFrame:
    """``rows`` with column island: a new one begins where start is over ``gap`` past all earlier ends, or ``breaks`` holds there.

    One shuffle: the running maximum and the running count use the same partitioning and order.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col(start) > reach + F.lit(gap))
    if breaks is not None:
        new |= F.coalesce(breaks, F.lit(False))
    return rows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def union(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: float = 0.0) -> DataFrame:
    """The union of each key's intervals, those within ``gap`` of each other joined: keys, start, end, parts."""
    merged = islands(rows.where(F.col(start) < F.col(end)), keys, start, end, gap).groupBy(*keys, "island")
    return merged.agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("island")


def union_length(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The total length of each key's union."""
    return union(rows, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("length"))


def merge_unless_intruded(target: DataFrame, others: DataFrame, keys: list[str], bucket: float, start: str = "start", end: str = "end") -> DataFrame:
    """Neighbouring target intervals joined across their gap unless another's interval overlaps it: keys, start, end, parts, blocked.

    The gap before each interval is found by a running maximum; a banded join finds the gaps that are intruded.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = target.withColumn("gap_start", reach).withColumn("gap", F.coalesce(F.col(start) > F.col("gap_start"), F.lit(False)))
    open_gaps = gaps.where("gap").select(*keys, F.col("gap_start").alias("g_start"), F.col(start).alias("g_end")).distinct()
    hit = range_join(open_gaps, others.select(*keys, F.col(start).alias("o_start"), F.col(end).alias("o_end")), keys, "g_start", "g_end", "o_start", "o_end", bucket)
    hit = hit.select(*keys, F.col("g_end").alias(start), F.lit(True).alias("intruded")).distinct()
    marked = gaps.drop("gap_start").join(hit, [*keys, start], "left")
    flag = F.coalesce(F.col("intruded") & F.col("gap"), F.lit(False))
    out = marked.withColumn("_b", flag.cast("int")).withColumn("island", F.sum("_b").over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts"), F.sum("_b").cast("bigint").alias("blocked")).drop("island")


def range_join(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, bucket: float) -> DataFrame:
    """Pairs with equal keys and overlapping intervals.

    Both sides are repeated over the buckets of that width that they touch and a pair is made in the first that both
    touch, so a key with many intervals is spread and the join is an equi-join throughout. Take about the length of the longer side's intervals.
    """
    meets = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    at = lambda c: F.floor(F.col(c) / F.lit(float(bucket)))
    l_all = left.withColumn("_b", F.explode(F.sequence(at(ls), at(le))))
    r_all = right.withColumn("_b", F.explode(F.sequence(at(rs), at(re))))
    first = F.greatest(at(ls), at(rs)) == F.col("_b")
    return l_all.join(r_all, [*keys, "_b"]).where(meets & first).drop("_b")


def points_in(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: float, inside: Column, how: str = "inner") -> DataFrame:
    """Points with the spans of their key that they lie in, as ``inside`` says. Spans are repeated over the buckets of that width that they touch, so the join is an equi-join on key and bucket."""
    place = lambda c: F.floor(F.col(c) / F.lit(float(bucket)))
    s = spans.select(*[F.col(k).alias(f"_s_{k}") for k in keys], *[c for c in spans.columns if c not in keys], F.explode(F.when(F.col(start) <= F.col(end), F.sequence(place(start), place(end)))).alias("_s_b"))
    on = (place(at) == F.col("_s_b")) & inside
    for k in keys:
        on &= F.col(k) == F.col(f"_s_{k}")
    return points.join(s, on, how).drop(*[f"_s_{k}" for k in keys], "_s_b")


def stab(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: float) -> DataFrame:
    """Points strictly inside spans, with the depth: the distance to the nearer end. Points in no span keep nulls."""
    hit = points_in(points, spans, keys, at, start, end, bucket, (F.col(start) < F.col(at)) & (F.col(at) < F.col(end)), "left")
    return hit.withColumn("depth", F.least(F.col(at) - F.col(start), F.col(end) - F.col(at)))


def position_preference(candidates: DataFrame, regions: DataFrame, keys: list[str], id_col: str, full_margin: float, bucket: float) -> DataFrame:
    """How far inside a region each candidate lies, as a share of ``full_margin``: the best of the containing regions, 0 if its key has regions but none
    contains it, 0.5 if its key has none. candidates: start, end; regions: r_start, r_end."""
    known = regions.select(*keys).distinct().withColumn("known", F.lit(True))
    inside = (F.col("r_start") <= F.col("start")) & (F.col("end") <= F.col("r_end"))
    margin = F.least(F.col("start") - F.col("r_start"), F.col("r_end") - F.col("end"))
    best = points_in(candidates, regions.select(*keys, "r_start", "r_end"), keys, "start", "r_start", "r_end", bucket, inside).groupBy(id_col).agg(F.max(margin).alias("margin"))
    out = candidates.join(known, keys, "left").join(best, id_col, "left")
    return out.withColumn("position_preference", F.when(F.col("margin").isNotNull(), F.least(F.lit(1.0), F.col("margin") / F.lit(float(full_margin)))).when(F.col("known"), 0.0).otherwise(0.5)).drop("known", "margin")


def concat_layout(files: DataFrame, keys: list[str], order: str, length: str, gap: float) -> DataFrame:
    """Where each file begins when a key's files are laid end to end with a gap between: offset, offset_end."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col(length) + F.lit(gap)).over(before), F.lit(0.0))
    return files.withColumn("offset", offset).withColumn("offset_end", F.col("offset") + F.col(length))


def remap(regions: DataFrame, layout: DataFrame, keys: list[str], bucket: float) -> DataFrame:
    """Regions of the laid-out timeline cut at file borders and given in each file's own time; what lies in gaps goes."""
    both = range_join(regions, layout, keys, "start", "end", "offset", "offset_end", bucket)
    lo, hi = F.greatest("start", "offset") - F.col("offset"), F.least("end", "offset_end") - F.col("offset")
    return both.withColumn("local_start", lo).withColumn("local_end", hi).where("local_end > local_start")


def fixed_chunks(rows: DataFrame, length: str, size: float, most: int | None = None) -> DataFrame:
    """Whole chunks of a length, the tail dropped: chunk, chunk_start, chunk_end. ``most`` is the operator's own cap on chunks."""
    n = F.floor(F.col(length) / F.lit(float(size))).cast("int")
    n = F.least(n, F.lit(most)) if most else n
    out = rows.withColumn("chunk", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return out.withColumn("chunk_start", F.col("chunk") * F.lit(float(size))).withColumn("chunk_end", (F.col("chunk") + 1) * F.lit(float(size)))


def sliding_windows(rows: DataFrame, length: str, size: float, hop: float) -> DataFrame:
    """Windows of ``size`` every ``hop`` that fit, one padded window where the row is shorter: window, window_start, window_end."""
    fits = F.floor((F.col(length) - F.lit(float(size))) / F.lit(float(hop)) + F.lit(1e-9)).cast("int")
    out = rows.withColumn("window", F.explode(F.when(F.col(length) >= size, F.sequence(F.lit(0), fits)).otherwise(F.array(F.lit(0)))))
    return out.withColumn("window_start", F.col("window") * F.lit(float(hop))).withColumn("window_end", F.least(F.col("window_start") + F.lit(float(size)), F.col(length)))


def candidate_windows(regions: DataFrame, size: float, stride_ratio: float, least_stride: float = 0.25) -> DataFrame:
    """Windows inside regions at a stride of ``size * stride_ratio``, the last flush with the region's end; a shorter region is one window."""
    stride = max(size * stride_ratio, least_stride)
    span = F.col("end") - F.col("start")
    steps = F.sequence(F.lit(0), F.floor((span - F.lit(size)) / F.lit(stride) + F.lit(1e-9)).cast("int"))
    starts = F.array_distinct(F.concat(F.transform(steps, lambda k: F.round(F.col("start") + k * F.lit(stride), 6)), F.array(F.round(F.col("end") - F.lit(size), 6))))
    starts = F.when(span >= size, starts).otherwise(F.array(F.col("start")))
    return regions.withColumn("window_start", F.explode(starts)).withColumn("window_end", F.least(F.round(F.col("window_start") + F.lit(size), 6), F.col("end")))


def gaps(words: DataFrame, keys: list[str], guard_after: float, guard_before: float, least: float, most: float) -> DataFrame:
    """Silences between neighbouring words, less the guards, with lengths in [least, most]: gap_start, gap_end, gap."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    out = words.withColumn("gap_start", F.col("end") + F.lit(guard_after)).withColumn("gap_end", F.lead("start").over(w) - F.lit(guard_before))
    return out.withColumn("gap", F.col("gap_end") - F.col("gap_start")).where(F.col("gap").between(least, most))


def fill_missing_spans(words: DataFrame, keys: list[str], position: str, total: Column) -> DataFrame:
    """Words without times get even shares of the room between their timed neighbours, or the ends."""
    w = Window.partitionBy(*keys).orderBy(position)
    before = F.coalesce(F.last("end", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.coalesce(F.first("start", True).over(w.rowsBetween(1, Window.unboundedFollowing)), total)
    known = F.sum(F.when(F.col("start").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = words.withColumn("_lo", before).withColumn("_hi", after).withColumn("_run", known)
    run = Window.partitionBy(*keys, "_run", F.col("start").isNull()).orderBy(position)
    n, k = F.count(F.lit(1)).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.row_number().over(run)
    step = (F.greatest(F.col("_hi"), F.col("_lo")) - F.col("_lo")) / n
    out = out.withColumn("_s", F.col("_lo") + step * (k - 1)).withColumn("_e", F.col("_lo") + step * k)
    return out.withColumn("filled", F.col("start").isNull()).withColumn("start", F.coalesce("start", "_s")).withColumn("end", F.coalesce("end", "_e")).drop("_lo", "_hi", "_run", "_s", "_e")


def even_spans(words: DataFrame, keys: list[str], position: str, total: Column) -> DataFrame:
    """Each word an even share of the total."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return words.withColumn("start", total * (k - 1) / n).withColumn("end", total * k / n)


def numbered(rows: DataFrame, order: list[str], template: str, name: str = "id", first: int = 1) -> DataFrame:
    """Ids formatted from each row's number in a global order."""
    out, _ = with_row_number(rows, order)
    return out.withColumn(name, F.format_string(template, F.col("row_number") - 1 + first)).drop("row_number")


def longest_run_below(frames: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """The longest consecutive stretch of frames under a threshold, frames meeting end to start: keys, longest."""
    low = frames.where(F.col(value) < threshold)
    return union(low, keys, gap=1e-9).groupBy(*keys).agg(F.max(F.col("end") - F.col("start")).alias("longest"))

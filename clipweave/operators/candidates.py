"""Reference candidates: windows over speech or between cuts, with text and prior scores, less those that overlap better ones, the best of them numbered."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions.arrays import doubles
from clipweave.functions.numeric import scaled
from clipweave.functions.text import candidate_id
from clipweave.operators import intervals as iv
from clipweave.operators.ordering import with_row_number
from clipweave.operators.scoring import default_scores, risk_flags
from clipweave.operators.slicer import nearest_target_pairs
from clipweave.operators.vectors import zscores
from clipweave.operators.written import written

#: A candidate's least length in seconds, the bounds and default of the cap, and of the threshold of shared length.
LEAST_SECONDS = 1.0
CAP_LEAST, CAP, CAP_MOST = 8, 500, 2000
OVERLAP_LEAST, OVERLAP, OVERLAP_MOST = 0.3, 0.6, 0.95
DURATIONS = (3.0, 4.5, 6.0)
_WAITS, _CLEAR, _OUT = 0, 1, 2


class _Spans:
    """Intervals in order of their starts, to be asked what overlaps another one by a share of the shorter length."""

    def __init__(self, longest: float, most: float) -> None:
        self.longest, self.most = longest, most
        self.starts: list[float] = []
        self.ends: list[float] = []

    def add(self, s: float, e: float) -> None:
        k = bisect.bisect(self.starts, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)

    def meet(self, s: float, e: float) -> bool:
        for k in range(bisect.bisect_left(self.starts, s - self.longest), bisect.bisect_right(self.starts, e)):
            a, b = self.starts[k], self.ends[k]
            if max(min(b, e) - max(a, s), 0.0) / max(min(b - a, e - s), 0.001) >= self.most:
                return True
        return False


def _decide(rows: list[tuple], most: float) -> Iterator[tuple]:
    """What one block says of its undecided rows (id, start, end, kept, blocks), the best first: out beside a kept one, clear where all better ones that it meets are out, else they wait.

    A row that only this block touches is kept as soon as it is clear, so a block goes as far as it can in one pass.
    """
    longest = max(e - s for _, s, e, _, _ in rows)
    kept, waiting = _Spans(longest, most), _Spans(longest, most)
    for of, s, e, was_kept, blocks in rows:
        if was_kept:
            kept.add(s, e)
        elif kept.meet(s, e):
            yield of, _OUT
        elif waiting.meet(s, e):
            waiting.add(s, e)
            yield of, _WAITS
        else:
            (kept if blocks == 1 else waiting).add(s, e)
            yield of, _CLEAR


def _by_block(n: int, most: float) -> Callable:
    """Rows (n keys, block, id, start, end, kept, blocks), a block's together and in order, to (keys, id, says). What is held is one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        rows = ((b.schema, row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [str(k) for k in range(n + 2)])

        for key, group in itertools.groupby(rows, key=lambda r: r[1][: n + 1]):
            members = list(group)
            types = [*members[0][0].types[:n], members[0][0].types[n + 1], pa.int32()]
            out.extend((*key[:n], of, says) for of, says in _decide([r[n + 1 :] for _, r in members], most))
            if len(out) >= 10_000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return run


def suppress(rows: DataFrame, keys: list[str], score: str, id_col: str, most: float, block: float = 3600.0) -> DataFrame:
    """Greedy suppression: by falling score (then start, then id) a row is kept unless it shares ``most`` or more of the shorter length with one kept before.

    A row waits for better ones that it shares so much with, and is decided once they are. A task decides what touches one block of a key's time, as far as
    that goes without its neighbours; rows over a border are kept once all blocks that they touch clear them. Further rounds take only blocks with rows that
    wait, so rounds follow how often a chain of such rows crosses borders. ``id_col`` is distinct within a key; keys aren't null.

    A block's rows come together by their hash, not by the columns that the join below has: Spark would drop such a repartition after a join that shuffles, and then
    deal the rows anew, block or not, where it turns that join into a broadcast at run time.
    """
    place = lambda c: F.floor(F.col(c) / F.lit(float(block)))
    kind = rows.schema[id_col].dataType.simpleString()
    state = rows.select(*keys, F.col(id_col).alias("_id"), F.col("start").cast("double").alias("_s"), F.col("end").cast("double").alias("_e"), F.col(score).cast("double").alias("_score"), F.lit(False).alias("_kept"))
    state = written(state.withColumn("_at", F.sequence(place("_s"), F.greatest(place("_e"), place("_s")))).withColumn("_blocks", F.size("_at")), "suppress")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields) + f", _id {kind}, _says int"

    first = True
    while True:
        touched = state.withColumn("_block", F.explode("_at"))
        if not first:  # at first all blocks are open
            touched = touched.join(touched.where("NOT _kept").select(*keys, "_block").distinct(), [*keys, "_block"], "left_semi")
        first = False
        block_rows = touched.repartition(F.xxhash64(*keys, "_block")).sortWithinPartitions(*keys, "_block", F.desc("_score"), "_s", "_id")
        says = block_rows.select(*keys, "_block", "_id", "_s", "_e", "_kept", "_blocks").mapInArrow(_by_block(len(keys), most), schema)
        says = says.groupBy(*keys, "_id").agg(F.max("_says").alias("_most"), F.min("_says").alias("_least"))
        told = state.join(says, [*keys, "_id"], "left").where(F.col("_kept") | (F.col("_most") != _OUT))
        state = written(told.withColumn("_kept", F.col("_kept") | (F.col("_least") == _CLEAR)).drop("_most", "_least"), "suppress")
        if state.where("NOT _kept").isEmpty():
            return rows.join(state.select(*keys, F.col("_id").alias(id_col)), [*keys, id_col], "left_semi")


def window_text(windows: DataFrame, words: DataFrame, keys: list[str], id_col: str, bucket: float = 10.0) -> DataFrame:
    """``windows`` (keys, id, start, end) with the words that lie within each, in order: transcript (null without words) and word_count.

    words: keys, start, end, pos, word; and token, where several words are parts of one written token, which is said once. Words come together in buckets of
    time, and a window meets the few buckets it touches, so that rows don't multiply by words.
    """
    place = lambda c: F.floor(F.col(c) / F.lit(float(bucket)))
    token = F.col("token") if "token" in words.columns else F.lit(None)
    held = words.groupBy(*keys, place("start").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("start", "pos", "end", F.col("word").cast("string").alias("word"), token.cast("string").alias("token")))).alias("_w"))
    spans = windows.select(*keys, id_col, F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.sequence(place("start"), F.greatest(place("end"), place("start")))).alias("_b"))
    within = F.filter("_w", lambda w: (w["start"] >= F.col("_s")) & (w["end"] <= F.col("_e")))
    met = spans.join(held, [*keys, "_b"]).groupBy(*keys, id_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_b", within.alias("w")))), lambda b: b["w"])).alias("_w"))
    said = F.filter("_w", lambda w, i: (i == 0) | w["token"].isNull() | (w["token"] == "") | ~w["token"].eqNullSafe(F.get("_w", i - 1)["token"]))
    text = F.trim(F.array_join(F.transform(said, lambda w: w["word"]), " "))
    met = met.select(*keys, id_col, F.when(text != "", text).alias("transcript"), F.size("_w").cast("long").alias("word_count"))
    return windows.join(met, [*keys, id_col], "left").withColumn("word_count", F.coalesce("word_count", F.lit(0)).cast("long"))


def cut_gaps(cuts: DataFrame, buffers: DataFrame, words: DataFrame) -> DataFrame:
    """The gaps that accepted cuts stand in, between their two words, in the recording's time; cuts whose buffer or words are missing and empty gaps go.

    cuts: gap_id, buffer, gap_start, gap_end (samples in the buffer), left_id, right_id; buffers: buffer, recording, rate, base; words: word_id, word, start, end (samples).
    """
    side = lambda name: words.select(F.col("word_id").alias(f"{name}_id"), F.col("word").alias(f"{name}_word"), F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"))
    out = cuts.join(buffers, "buffer").where(F.col("gap_end") > F.col("gap_start")).join(side("left"), "left_id").join(side("right"), "right_id")
    lo, hi = F.col("base") + F.col("gap_start"), F.col("base") + F.col("gap_end")
    seconds = lambda c: F.round(c / F.col("rate"), 6)
    return out.select("gap_id", "buffer", "recording", lo.alias("start"), hi.alias("end"), seconds(lo).alias("start_seconds"), seconds(hi).alias("end_seconds"), "left_word", "right_word", "left_start", "left_end", "right_start", "right_end")


def cut_windows(cuts: DataFrame, keys: list[str], durations: Sequence[float] = DURATIONS, stride: int = 2) -> DataFrame:
    """For each target length, from every ``stride``-th cut of a buffer the window to the cut nearest to it: keys, target, start_id, end_id, start, end."""
    least = min(durations)
    most = max(max(durations) + 2.0, least + 1.0)
    each = [nearest_target_pairs(cuts, keys, d, least, most, stride).select(*keys, F.lit(float(d)).alias("target"), "start_id", "end_id", "start", "end") for d in durations]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def scored(windows: DataFrame, recordings: DataFrame, family: Column) -> DataFrame:
    """``windows`` (recording, start, end, transcript) of at least a second, with candidate_id, duration, risk_flags and the prior scores. recordings: recording, total."""
    out = windows.withColumn("start", scaled(F.col("start"), 3)).withColumn("end", scaled(F.col("end"), 3)).where(F.col("end") - F.col("start") >= LEAST_SECONDS).join(recordings, "recording")
    args = (F.col("total"), F.col("start"), F.col("end"), F.col("transcript"))
    out = out.withColumn("candidate_id", candidate_id(F.col("recording").cast("string"), F.col("start"), F.col("end"), family)).withColumn("duration", F.round(F.col("end") - F.col("start"), 3))
    return out.withColumns({"risk_flags": risk_flags(*args), **default_scores(*args)}).drop("total")


def numbered_best(candidates: DataFrame, score: str, cap: int | None = None) -> DataFrame:
    """The ``cap`` best candidates, with embedding_index: their place by falling score, recording, start and id, from 0."""
    most = max(CAP_LEAST, min(int(cap or CAP), CAP_MOST))
    order = ["_order", "recording", "start", "candidate_id"]
    best = candidates.withColumn("_order", -F.col(score)).orderBy(*order).limit(most)
    out, _ = with_row_number(best, order)
    return out.withColumn("embedding_index", (F.col("row_number") - 1).cast("int")).drop("_order", "row_number")


def region_candidates(recordings: DataFrame, regions: DataFrame, durations: Sequence[float] = DURATIONS, stride_ratio: float = 0.5, most: float = 0.82, cap: int | None = None, block: float = 3600.0) -> DataFrame:
    """Candidates from windows over speech regions (recording, start, end); a recording (recording, total) without regions is one itself."""
    bare = recordings.join(regions.select("recording").distinct(), "recording", "left_anti").select("recording", F.lit(0.0).alias("start"), scaled(F.col("total"), 3).alias("end"))
    spans = regions.select("recording", "start", "end").unionByName(bare).where("end > start")
    windows = None
    for d in durations:
        each = iv.candidate_windows(spans, float(d), max(0.2, min(stride_ratio, 0.9))).select("recording", F.lit(f"{d:.2f}").alias("family"), scaled(F.col("window_start"), 3).alias("start"), scaled(F.col("window_end"), 3).alias("end")).distinct()
        windows = each if windows is None else windows.unionByName(each)
    found = written(scored(windows.withColumn("transcript", F.lit(None).cast("string")), recordings, F.col("family")), "candidates")
    return numbered_best(suppress(found, ["recording"], "both", "candidate_id", most, block), "both", cap)


def cut_candidates(windows: DataFrame, recordings: DataFrame, dims: int, overlap: float | None = None, cap: int | None = None, block: float = 3600.0, labels: DataFrame | None = None) -> DataFrame:
    """Candidates from windows between cuts (recording, start, end, start_id, end_id, transcript, features); those whose sound is near to the mean of all gain up to 0.15.

    Features are standardised over all windows, so their mean is zero; windows that are one candidate count each. ``labels`` (candidate_id, mood_cluster, display) name clusters of the candidates; without them the columns are left out.
    """
    found = written(scored(windows, recordings, F.concat_ws(":", "start_id", "end_id")), "candidates")
    z = zscores(found, "features", dims)
    distance = F.sqrt(F.aggregate(F.col("z"), F.lit(0.0), lambda s, x: s + x * x))
    # To 9 places, so that equal windows aren't ordered by what the order of their frames' sums left behind.
    found = written(z.withColumn("adjusted", scaled(F.col("both") + F.greatest(F.lit(0.0), 0.15 - distance * 0.03), 9)).drop("z").dropDuplicates(["recording", "candidate_id"]), "candidates")
    threshold = max(OVERLAP_LEAST, min(float(overlap or OVERLAP), OVERLAP_MOST))
    kept = suppress(found, ["recording"], "adjusted", "candidate_id", threshold, block)
    if labels is not None:
        kept = kept.join(labels, "candidate_id", "left").withColumn("display", F.coalesce("display", F.lit("unknown")))
        kept = kept.withColumn("risk_flags", F.array_distinct(F.concat("risk_flags", F.array(F.concat(F.lit("cluster_"), "display"))))).drop("display")
    unit_length = F.sqrt(F.aggregate(doubles(F.col("features")), F.lit(0.0), lambda s, x: s + x * x))
    return numbered_best(kept, "adjusted", cap).withColumn("embedding", F.transform(doubles(F.col("features")), lambda x: F.try_divide(x, unit_length))).drop("features")

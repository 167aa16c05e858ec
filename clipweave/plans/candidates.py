"""Candidate queries: a recording is a user, whose days of 144 s follow one another on one clock; frames and words are made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions.numeric import scaled
from clipweave.operators import candidates as cd
from clipweave.operators import intervals as iv
from clipweave.operators import slicer
from clipweave.plans.intervals import WORDS_SQL, words
from clipweave.plans.registry import query
from clipweave.plans.slicer import FRAMES_SQL, cutpoints, frames, greedy_sql


def _rounded_sql(x: str) -> str:
    """A double to four places by its exact value, half to even."""
    v = f"printf('%.25f', {x})::DECIMAL(38, 25)"
    return f"(CASE WHEN ({v} - 0.00005) % 0.0002 = 0 THEN {v} - 0.00005 ELSE round({v}, 4) END)::DOUBLE"


#: Frames on a user's clock, speech where the probability reaches 0.4, and each user's length.
_CLOCK_SQL = f"""{FRAMES_SQL},
    cl AS (SELECT user_id AS recording, pos, round((day - (SELECT min(day) FROM frames)) * 144.0 + start, 6)::DOUBLE AS start, round((day - (SELECT min(day) FROM frames)) * 144.0 + "end", 6)::DOUBLE AS "end", prob, rms FROM frames),
    rec AS (SELECT recording, round(max("end") + 1.0, 3)::DOUBLE AS total FROM cl GROUP BY recording)
"""
_SCORES_SQL = f"""
    fg AS (SELECT c.*, total, CASE WHEN start <= 0.05 THEN 1 ELSE 0 END + CASE WHEN "end" >= greatest(total - 0.05, 0.0) THEN 1 ELSE 0 END AS edges, coalesce(transcript, '') <> '' AS ctx,
                  greatest("end" - start, 0.001::DOUBLE) AS len FROM cw c JOIN rec USING (recording) WHERE "end" - start >= 1.0),
    ba AS (SELECT *, 0.7::DOUBLE + CASE WHEN ctx THEN 0.16::DOUBLE ELSE 0.0::DOUBLE END + (0.1::DOUBLE - abs(len - 4.5::DOUBLE) * 0.02::DOUBLE)
                     - abs(start + len / 2 - CASE WHEN total > 0 THEN total / 2 ELSE start + len / 2 END) / greatest(total / 2, 1.0::DOUBLE) * 0.1::DOUBLE - 0.06::DOUBLE * edges - CASE WHEN ctx THEN 0.0::DOUBLE ELSE 0.08::DOUBLE END AS base FROM fg),
    sc AS (SELECT *, {_rounded_sql("base - 0.02::DOUBLE * len")} AS zero_shot, {_rounded_sql("base + 0.015::DOUBLE * len")} AS finetune,
                  'cand-' || substr(sha1(recording || ':' || printf('%.3f', start) || ':' || printf('%.3f', "end") || ':' || family), 1, 16) AS candidate_id FROM ba),
    cand AS (SELECT *, {_rounded_sql("(zero_shot + finetune) / 2")} AS both_score FROM sc)
"""


def clock(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Frames (recording, pos, start, end, prob, rms) on each user's clock, and recordings (recording, total)."""
    f = frames(spark, sf_dir)
    first = f.agg(F.min("day").alias("first"))
    at = lambda c: scaled((F.col("day") - F.col("first")) * F.lit(144.0) + F.col(c), 6).alias(c)
    f = f.join(F.broadcast(first)).select(F.col("user_id").alias("recording"), "pos", at("start"), at("end"), "prob", "rms")
    return f, f.groupBy("recording").agg(scaled(F.max("end") + 1.0, 3).alias("total"))


def spoken(f: DataFrame) -> DataFrame:
    """Words, one per frame: recording, pos, word, start, end."""
    start = F.round(F.col("start") + 1.0, 6)
    return f.select("recording", "pos", F.concat(F.lit("w"), "pos").alias("word"), start.alias("start"), F.round(start + 0.2 + (F.col("pos") % 7) * F.lit(0.3), 6).alias("end"))


@query(
    f"""WITH RECURSIVE {_CLOCK_SQL}, sp AS (SELECT recording, start, "end" FROM cl WHERE prob >= 0.4),
    mx AS (SELECT *, max("end") OVER (PARTITION BY recording ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
    isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM mx),
    reg AS (SELECT recording, min(start) AS start, max("end") AS "end" FROM isl GROUP BY recording, k UNION ALL SELECT recording, 0.0, total FROM rec WHERE recording NOT IN (SELECT recording FROM sp)),
    wn AS (SELECT recording, start AS r, "end" AS e, d, greatest(d * 0.5, 0.25)::DOUBLE AS st, unnest(CASE WHEN "end" - start >= d THEN list_distinct(list_append(
               [round(start + x * greatest(d * 0.5, 0.25)::DOUBLE, 6) FOR x IN range(0, floor(("end" - start - d) / greatest(d * 0.5, 0.25)::DOUBLE + 1e-9)::BIGINT + 1)], round("end" - d, 6))) ELSE [start] END) AS s
           FROM reg, (VALUES (3.0::DOUBLE), (4.5::DOUBLE), (6.0::DOUBLE)) t(d) WHERE "end" > start),
    cw AS (SELECT DISTINCT recording, printf('%.2f', d) AS family, round(s, 3) AS start, round(least(round(s + d, 6), e), 3) AS "end", NULL::VARCHAR AS transcript FROM wn),
    {_SCORES_SQL}, {greedy_sql("cand", "recording", "both_score", "candidate_id", 0.82)},
    top AS (SELECT *, row_number() OVER (ORDER BY both_score DESC, recording, start, candidate_id) AS n FROM kept)
    SELECT recording, candidate_id, start, "end", zero_shot, finetune, both_score, (n - 1)::INT AS embedding_index FROM top WHERE n <= 2000"""
)
def region_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, recordings = clock(spark, sf_dir)
    regions = iv.union(f.where("prob >= 0.4"), ["recording"], gap=0.5).select("recording", "start", "end")
    out = cd.region_candidates(recordings, regions, cap=cd.CAP_MOST, block=300.0)  # the operator's own cap
    return out.select("recording", "candidate_id", "start", "end", "zero_shot", "finetune", F.col("both").alias("both_score"), "embedding_index")


#: Cuts as detected per user and day, on the user's clock, and the windows between them for each target length.
def _cut_windows_sql() -> str:
    from clipweave.plans.slicer import CUTS_SQL

    return f"""{CUTS_SQL.strip()},
    cl AS (SELECT user_id AS recording, pos, round((day - (SELECT min(day) FROM frames)) * 144.0 + start, 6)::DOUBLE AS start, round((day - (SELECT min(day) FROM frames)) * 144.0 + "end", 6)::DOUBLE AS "end", prob, rms FROM frames),
    rec AS (SELECT recording, round(max("end") + 1.0, 3)::DOUBLE AS total FROM cl GROUP BY recording),
    ct AS (SELECT user_id AS recording, cut_id, round((day - (SELECT min(day) FROM frames)) * 144.0 + time, 6)::DOUBLE AS time FROM cuts),
    cp AS (SELECT a.recording, a.cut_id AS start_id, b.cut_id AS end_id, a.time AS start, b.time AS "end", round(b.time - a.time, 6) AS seconds, a.n FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY time, cut_id) AS n FROM ct) a
           JOIN ct b ON a.recording = b.recording AND b.time - a.time >= 3.0 - 0.001 AND b.time - a.time <= 8.0 + 0.001 WHERE (a.n - 1) % 2 = 0),
    tw AS (SELECT recording, target, start_id, end_id, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY recording, target, start_id ORDER BY abs(seconds - target), "end", end_id) AS k FROM cp, (VALUES (3.0::DOUBLE), (4.5::DOUBLE), (6.0::DOUBLE)) t(target)) WHERE k = 1),
    wd AS (SELECT recording, pos, 'w' || pos AS word, round(start + 1.0, 6) AS start, round(round(start + 1.0, 6) + 0.2 + (pos % 7) * 0.3, 6)::DOUBLE AS "end" FROM cl),
    tx AS (SELECT t.recording, target, start_id, string_agg(w.word, ' ' ORDER BY w.start, w.pos) AS transcript, count(*) AS word_count FROM tw t JOIN wd w ON w.recording = t.recording AND w.start >= t.start AND w."end" <= t."end" GROUP BY 1, 2, 3)"""


def cut_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows between cuts with their text; frames; recordings."""
    f, recordings = clock(spark, sf_dir)
    c = cutpoints(spark, sf_dir)
    first = frames(spark, sf_dir).agg(F.min("day").alias("first"))
    c = c.join(F.broadcast(first)).select(F.col("user_id").alias("recording"), "cut_id", F.round((F.col("day") - F.col("first")) * F.lit(144.0) + F.col("time"), 6).alias("time"))
    w = cd.cut_windows(c, ["recording"]).withColumn("window", F.concat_ws("/", "start_id", F.format_string("%.1f", "target")))
    return cd.window_text(w, spoken(f), ["recording"], "window"), f, recordings


@query(f"WITH {_cut_windows_sql()} SELECT t.recording, t.target, t.start_id, t.end_id, t.start, t.\"end\", tx.transcript, coalesce(tx.word_count, 0) AS word_count FROM tw t LEFT JOIN tx USING (recording, target, start_id)")
def cut_window_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_windows(spark, sf_dir)[0].select("recording", "target", "start_id", "end_id", "start", "end", "transcript", "word_count")


#: What the windows' sound is taken for: mean and spread of level and probability over the frames that begin within.
_FEATURES_SQL = """
    ft AS (SELECT t.recording, target, start_id, coalesce(avg(rms), 0.0) AS f1, coalesce(max(rms) - min(rms), 0.0) AS f2, coalesce(avg(prob), 0.0) AS f3, coalesce(max(prob) - min(prob), 0.0) AS f4
           FROM tw t LEFT JOIN cl f ON f.recording = t.recording AND f.start >= t.start AND f.start <= t."end" GROUP BY 1, 2, 3),
    cw AS (SELECT t.recording, t.target, start_id || ':' || end_id AS family, round(start, 3) AS start, round("end", 3) AS "end", transcript, f1, f2, f3, f4 FROM tw t LEFT JOIN tx USING (recording, target, start_id) JOIN ft USING (recording, target, start_id))
"""


@query(
    f"""WITH RECURSIVE {_cut_windows_sql()}, {_FEATURES_SQL}, {_SCORES_SQL},
    st AS (SELECT avg(f1) m1, avg(f2) m2, avg(f3) m3, avg(f4) m4, CASE WHEN stddev_pop(f1) < 1e-12 THEN 1.0::DOUBLE ELSE stddev_pop(f1) END AS s1, CASE WHEN stddev_pop(f2) < 1e-12 THEN 1.0::DOUBLE ELSE stddev_pop(f2) END AS s2, CASE WHEN stddev_pop(f3) < 1e-12 THEN 1.0::DOUBLE ELSE stddev_pop(f3) END AS s3, CASE WHEN stddev_pop(f4) < 1e-12 THEN 1.0::DOUBLE ELSE stddev_pop(f4) END AS s4 FROM cand),
    ad AS (SELECT DISTINCT recording, candidate_id, start, "end", transcript, round(both_score + greatest(0.0, 0.15 - 0.03 * sqrt(((f1 - m1) / s1) ** 2 + ((f2 - m2) / s2) ** 2 + ((f3 - m3) / s3) ** 2 + ((f4 - m4) / s4) ** 2)), 9) AS adjusted FROM cand, st),
    {greedy_sql("ad", "recording", "adjusted", "candidate_id", 0.6)},
    top AS (SELECT *, row_number() OVER (ORDER BY adjusted DESC, recording, start, candidate_id) AS n FROM kept)
    SELECT recording, candidate_id, start, "end", transcript, round(adjusted, 6) AS adjusted, (n - 1)::INT AS embedding_index FROM top WHERE n <= 2000"""
)
def cut_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, f, recordings = cut_windows(spark, sf_dir)
    inside = (F.col("at") >= F.col("w_start")) & (F.col("at") <= F.col("w_end"))
    met = iv.points_in(f.select("recording", F.col("start").alias("at"), "rms", "prob"), w.select("recording", "window", F.col("start").alias("w_start"), F.col("end").alias("w_end")), ["recording"], "at", "w_start", "w_end", 10.0, inside)
    spread = lambda c: F.max(c) - F.min(c)
    sound = met.groupBy("recording", "window").agg(F.array(F.avg("rms"), spread("rms"), F.avg("prob"), spread("prob")).alias("features"))
    w = w.join(sound, ["recording", "window"], "left").withColumn("features", F.coalesce("features", F.array(*[F.lit(0.0)] * 4)))
    out = cd.cut_candidates(w.drop("target", "window"), recordings, 4, cap=cd.CAP_MOST, block=300.0)
    return out.select("recording", "candidate_id", "start", "end", "transcript", scaled(F.col("adjusted"), 6).alias("adjusted"), "embedding_index")


@query(
    f"""WITH {WORDS_SQL}, s AS (SELECT *, lead(pos) OVER w AS next, lead(word) OVER w AS right_word, lead(start) OVER w AS right_start, lead("end") OVER w AS right_end FROM words WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
    n AS (SELECT conv_id, turn, pos, word, next, right_word, round_even(start * 16000, 0)::BIGINT AS ls, round_even("end" * 16000, 0)::BIGINT AS le, round_even(right_start * 16000, 0)::BIGINT AS rs, round_even(right_end * 16000, 0)::BIGINT AS re FROM s WHERE next IS NOT NULL)
    SELECT conv_id || '-' || turn || '-' || pos AS gap_id, conv_id * 1000 + le AS start, conv_id * 1000 + rs AS "end", round((conv_id * 1000 + le) / 16000.0::DOUBLE, 6) AS start_seconds, word AS left_word, right_word, conv_id * 1000 + ls AS left_start, conv_id * 1000 + re AS right_end
    FROM n WHERE rs > le AND turn % 5 <> 4"""
)
def cut_gap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut in the gap after every word; every fifth turn has no buffer."""
    w = words(spark, sf_dir)
    buffer = F.concat_ws("-", "conv_id", "turn")
    name = lambda pos: F.concat_ws("-", "conv_id", "turn", pos)
    sample = lambda c: F.bround(F.col(c) * 16000, 0).cast("long")
    after = iv.Window.partitionBy("conv_id", "turn").orderBy("pos")
    cuts = w.select(name("pos").alias("gap_id"), buffer.alias("buffer"), sample("end").alias("gap_start"), F.lead(sample("start")).over(after).alias("gap_end"), name("pos").alias("left_id"), name(F.lead("pos").over(after)).alias("right_id"))
    buffers = w.select("conv_id", "turn").distinct().where("turn % 5 <> 4").select(buffer.alias("buffer"), F.col("conv_id").alias("recording"), F.lit(16000).alias("rate"), (F.col("conv_id") * 1000).alias("base"))
    said = w.select(name("pos").alias("word_id"), "word", (F.col("conv_id") * 1000 + sample("start")).alias("start"), (F.col("conv_id") * 1000 + sample("end")).alias("end"))
    return cd.cut_gaps(cuts, buffers, said).select("gap_id", "start", "end", "start_seconds", "left_word", "right_word", "left_start", "right_end")

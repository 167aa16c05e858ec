"""Slicer queries: frames are made of events, a recording is a user and a buffer one of their days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions.numeric import scaled
from clipweave.operators import intervals as iv
from clipweave.operators import slicer
from clipweave.operators.candidates import suppress
from clipweave.plans.intervals import WORDS_SQL, words
from clipweave.plans.registry import query, table

#: An event is a frame of ten minutes on a clock that runs 600 times slower, so that a day is 144 s; frames overlap by half.
FRAMES_SQL = """
    fr AS (SELECT event_id AS pos, user_id, (epoch_us(ts) // 86400000000) AS day, round((epoch_us(ts) % 86400000000) / 600000000.0, 6)::DOUBLE AS center,
                  (event_id * 37 % 101) / 100.0::DOUBLE AS prob, -value / 5.0::DOUBLE AS rms FROM events),
    frames AS (SELECT *, center - 1.5 AS start, center + 1.5 AS "end" FROM fr)
"""
CUTS_SQL = f"""{FRAMES_SQL},
    fl AS (SELECT user_id, day, quantile_cont(rms, 0.10) AS floor FROM frames GROUP BY user_id, day),
    q AS (SELECT f.* FROM frames f JOIN fl USING (user_id, day) WHERE prob < 0.6 AND rms <= floor + 15.0),
    mx AS (SELECT *, max("end") OVER (PARTITION BY user_id, day ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
    isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run_index FROM mx),
    sp AS (SELECT *, min(start) OVER (PARTITION BY user_id, day, run_index) AS run_start, max("end") OVER (PARTITION BY user_id, day, run_index) AS run_end FROM isl),
    v AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, run_index ORDER BY prob, rms, abs(center - (run_start + run_end) / 2), pos) AS k, count(*) OVER (PARTITION BY user_id, day, run_index) AS n_frames FROM sp),
    cuts AS (SELECT user_id, day, CAST(run_index AS BIGINT) AS run_index, run_start, run_end, n_frames, round(center, 6) AS time,
                    round((1 - prob) + least(greatest(-rms / 100.0, 0.0), 1.0), 6) AS score, user_id || '-' || day || '-' || CAST(run_index AS BIGINT) AS cut_id FROM v WHERE k = 1 AND run_end - run_start >= 0.040 - 1e-9)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, user_id, day, center, prob, rms, start, end."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    center = scaled((us % 86_400_000_000) / F.lit(600_000_000.0), 6)
    f = e.select(F.col("event_id").alias("pos"), "user_id", F.floor(us / 86_400_000_000).alias("day"), center.alias("center"), ((F.col("event_id") * 37 % 101) / F.lit(100.0)).alias("prob"), (-F.col("value") / 5.0).alias("rms"))
    return f.withColumn("start", F.col("center") - 1.5).withColumn("end", F.col("center") + 1.5)


def cutpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = slicer.detect_cutpoints(frames(spark, sf_dir), ["user_id", "day"], prob_below=0.6, rms_over_floor=15.0)
    return cuts.withColumn("cut_id", F.concat_ws("-", "user_id", "day", "run_index"))


@query(f"WITH {CUTS_SQL} SELECT user_id, day, run_index, round(run_start, 6) AS run_start, round(run_end, 6) AS run_end, n_frames, time, score FROM cuts")
def cutpoints_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutpoints(spark, sf_dir).select("user_id", "day", F.col("run_index").cast("bigint").alias("run_index"), F.round("run_start", 6).alias("run_start"), F.round("run_end", 6).alias("run_end"), "n_frames", "time", "score")


@query(
    f"""WITH {CUTS_SQL}, d AS (SELECT user_id % 10 AS recording, user_id AS buffer, cut_id, time, score, round_even(time * 1000, 0)::BIGINT // 2000 AS slot FROM cuts),
    g AS (SELECT *, row_number() OVER (PARTITION BY recording, slot ORDER BY score DESC, length(CAST(buffer AS VARCHAR)), buffer DESC, cut_id DESC) AS k,
                 count(*) OVER (PARTITION BY recording, slot) AS n_support, round(sum(score) OVER (PARTITION BY recording, slot), 5) AS sum_score, max(score) OVER (PARTITION BY recording, slot) AS max_score FROM d)
    SELECT recording, cut_id, time, score, n_support, sum_score, max_score FROM g WHERE k = 1"""
)
def cutpoints_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Times are put on a grid of two seconds first, so that cuts of different buffers meet.
    c = cutpoints(spark, sf_dir).select((F.col("user_id") % 10).alias("recording"), F.col("user_id").alias("buffer"), "cut_id", F.col("time").alias("true_time"), "score")
    c = c.withColumn("time", F.floor(F.bround(F.col("true_time") * 1000, 0) / 2000) * 2.0)
    out = slicer.dedupe_cutpoints(c, "recording", "buffer", "cut_id")
    return out.select("recording", "cut_id", F.col("true_time").alias("time"), "score", "n_support", F.round(F.col("mean_score") * F.col("n_support"), 5).alias("sum_score"), "max_score")


_PAIRS = """
    pr AS (SELECT a.user_id, a.day, a.cut_id AS start_id, b.cut_id AS end_id, a.time AS start, b.time AS "end", round(b.time - a.time, 6) AS seconds
           FROM cuts a JOIN cuts b ON a.user_id = b.user_id AND a.day = b.day AND b.time - a.time >= 3.0 - 0.001 AND b.time - a.time <= 15.0 + 0.001)
"""


@query(
    f"""WITH {CUTS_SQL}, {_PAIRS} SELECT user_id, day, start_id, end_id, seconds,
    round(CASE WHEN seconds BETWEEN 6 AND 8 THEN 10.0::DOUBLE - (8.0 - seconds) * 1.5 WHEN seconds > 8 THEN 6.5::DOUBLE - greatest(0.0, seconds - 9.0) ELSE seconds / 3.0::DOUBLE END, 7) AS weight FROM pr"""
)
def legal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicer.legal_pairs(cutpoints(spark, sf_dir), ["user_id", "day"]).select("user_id", "day", "start_id", "end_id", "seconds", "weight")


@query(
    f"""WITH {CUTS_SQL}, {_PAIRS}, st AS (SELECT user_id, day, cut_id, row_number() OVER (PARTITION BY user_id, day ORDER BY time, cut_id) AS n FROM cuts),
    r AS (SELECT pr.*, row_number() OVER (PARTITION BY pr.user_id, pr.day, start_id ORDER BY abs(seconds - 7), "end", end_id) AS k FROM pr JOIN st ON st.user_id = pr.user_id AND st.day = pr.day AND st.cut_id = pr.start_id WHERE (n - 1) % 2 = 0)
    SELECT user_id, day, start_id, end_id, seconds FROM r WHERE k = 1"""
)
def pair_nearest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicer.nearest_target_pairs(cutpoints(spark, sf_dir), ["user_id", "day"], 7.0, 3.0, 15.0, stride=2).select("user_id", "day", "start_id", "end_id", "seconds")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicer.schedule_clips(slicer.legal_pairs(cutpoints(spark, sf_dir), ["user_id", "day"]), ["user_id", "day"])


@query(
    # The heaviest schedule's weight per buffer, by recursion over the candidates in order of their ends.
    f"""WITH RECURSIVE {CUTS_SQL}, {_PAIRS},
    w AS (SELECT *, round(CASE WHEN seconds BETWEEN 6 AND 8 THEN 10.0::DOUBLE - (8.0 - seconds) * 1.5 WHEN seconds > 8 THEN 6.5::DOUBLE - greatest(0.0, seconds - 9.0) ELSE seconds / 3.0::DOUBLE END, 7) AS weight,
                 row_number() OVER (PARTITION BY user_id, day ORDER BY "end", start, start_id, end_id) AS i FROM pr),
    p AS (SELECT a.user_id, a.day, a.i, a.weight, (SELECT count(*) FROM w b WHERE b.user_id = a.user_id AND b.day = a.day AND b."end" <= a.start + 1e-12) AS before FROM w a),
    dp AS (SELECT user_id, day, 0::BIGINT AS i, [0.0::DOUBLE] AS best FROM (SELECT DISTINCT user_id, day FROM w)
           UNION ALL SELECT dp.user_id, dp.day, p.i, list_append(dp.best, greatest(dp.best[p.i], p.weight + dp.best[p.before + 1])) FROM dp JOIN p ON p.user_id = dp.user_id AND p.day = dp.day AND p.i = dp.i + 1)
    SELECT user_id, day, round(max(best[i + 1]), 7) AS weight FROM dp GROUP BY user_id, day"""
)
def schedule_best_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(spark, sf_dir).groupBy("user_id", "day").agg(F.round(F.sum("weight"), 7).alias("weight"))


@query()
def schedule_wis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(spark, sf_dir).select("user_id", "day", "start_id", "end_id", "start", "end", "seconds", "weight")


@query("SELECT 0::BIGINT AS breaks")
def schedule_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No clip of a schedule overlaps its predecessor."""
    return slicer.schedule_breaks(schedule(spark, sf_dir), ["user_id", "day"]).agg(F.count(F.lit(1)).alias("breaks"))


@query()
def schedule_used_cutpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicer.used_cutpoints(schedule(spark, sf_dir), ["user_id", "day"]).select("user_id", "day", "cut_id", "time")


def greedy_sql(rows: str, key: str, score: str, id_col: str, most: float) -> str:
    """SQL tables that suppress the rows of a table greedily, one recursion step per rank: kept (key, i)."""
    return f"""gr AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, start, {id_col}) AS i FROM {rows}),
    gk AS (SELECT {key}, 0::BIGINT AS i, []::STRUCT(s DOUBLE, e DOUBLE)[] AS kept, FALSE AS took FROM (SELECT DISTINCT {key} FROM {rows})
           UNION ALL SELECT {", ".join(f"gr.{k.strip()}" for k in key.split(","))}, gr.i, CASE WHEN fits THEN list_append(gk.kept, {{'s': gr.start, 'e': gr."end"}}) ELSE gk.kept END, fits
           FROM gk JOIN gr ON {" AND ".join(f"gr.{k.strip()} = gk.{k.strip()}" for k in key.split(","))} AND gr.i = gk.i + 1,
           LATERAL (SELECT len(list_filter(gk.kept, lambda x: greatest(least(x.e, gr."end") - greatest(x.s, gr.start), 0.0::DOUBLE) / greatest(least(x.e - x.s, gr."end" - gr.start), 0.001::DOUBLE) >= {most})) = 0 AS fits) f),
    kept AS (SELECT gr.* FROM gr JOIN gk USING ({key}, i) WHERE took)"""


@query(
    f"""WITH RECURSIVE {CUTS_SQL}, {_PAIRS},
    np AS (SELECT *, start_id || '/' || end_id AS pair, round(CASE WHEN seconds BETWEEN 6 AND 8 THEN 10.0::DOUBLE - (8.0 - seconds) * 1.5 WHEN seconds > 8 THEN 6.5::DOUBLE - greatest(0.0, seconds - 9.0) ELSE seconds / 3.0::DOUBLE END, 7) AS weight FROM pr),
    {greedy_sql("np", "user_id, day", "weight", "pair", 0.5)} SELECT user_id, day, pair, start, "end", weight FROM kept"""
)
def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = slicer.legal_pairs(cutpoints(spark, sf_dir), ["user_id", "day"]).withColumn("pair", F.concat_ws("/", "start_id", "end_id"))
    return suppress(p.select("user_id", "day", "pair", "start", "end", "weight"), ["user_id", "day"], "weight", "pair", 0.5)


#: Words with an acoustic score of the gap after them and a confidence; and the boundaries among them.
_SAID_SQL = f"""{WORDS_SQL},
    said AS (SELECT *, ((pos * 37 + turn) % 101) / 100.0::DOUBLE AS acoustic, ((pos * 13 + conv_id) % 100) / 100.0::DOUBLE AS confidence, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY conv_id, turn) AS n,
                    (lead(start) OVER w - 0.035::DOUBLE) - ("end" + 0.045::DOUBLE) AS room FROM words WINDOW w AS (PARTITION BY conv_id, turn ORDER BY start, "end", pos)),
    bd AS (SELECT conv_id, turn, pos, idx, "end" AS e, room AS gap, 0.35::DOUBLE * least(room / 0.24::DOUBLE, 1.0::DOUBLE) + 0.65::DOUBLE * acoustic AS strength FROM said WHERE room >= 0.12 AND acoustic >= 0.35)"""


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    acoustic, confidence = ((F.col("pos") * 37 + F.col("turn")) % 101) / F.lit(100.0), ((F.col("pos") * 13 + F.col("conv_id")) % 100) / F.lit(100.0)
    return words(spark, sf_dir).withColumn("acoustic", acoustic).withColumn("confidence", confidence)


@query(f"WITH {_SAID_SQL} SELECT conv_id, turn, pos, round(gap, 6) AS gap, round(strength, 6) AS strength FROM bd")
def boundary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = slicer.boundary_candidates(said(spark, sf_dir), ["conv_id", "turn"], "acoustic")
    return b.select("conv_id", "turn", "pos", F.round("gap", 6).alias("gap"), F.round("strength", 6).alias("strength"))


#: From every word: the boundaries of a legal length, the first one past the most, the best by score, then strength, gap and place; then the chain of clips from the first word on.
_CLIPS_SQL = f"""{_SAID_SQL},
    cd AS (SELECT s.conv_id, s.turn, s.idx AS i, b.idx AS j, b.e - s.start AS d, b.strength, b.gap FROM said s JOIN bd b ON b.conv_id = s.conv_id AND b.turn = s.turn AND b.idx >= s.idx AND b.e - s.start >= 2.0),
    ov AS (SELECT conv_id, turn, i, min(j) AS past FROM cd WHERE d > 15.0 GROUP BY 1, 2, 3),
    un AS (SELECT cd.*, 0.55::DOUBLE * (1.0::DOUBLE - least(abs(d - 7.0::DOUBLE) / 5.0::DOUBLE, 1.0::DOUBLE)) + 0.45::DOUBLE * strength - CASE WHEN d > 10.0 THEN 0.35::DOUBLE * least((d - 10.0::DOUBLE) / 5.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS score
           FROM cd LEFT JOIN ov USING (conv_id, turn, i) WHERE d <= 15.0 AND (past IS NULL OR j < past)),
    be AS (SELECT conv_id, turn, i, j FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, i ORDER BY score DESC, strength DESC, gap DESC, j) AS k FROM un) WHERE k = 1),
    nx AS (SELECT s.conv_id, s.turn, s.idx AS i, coalesce(be.j, ov.past, s.n - 1) AS j FROM said s LEFT JOIN be ON be.conv_id = s.conv_id AND be.turn = s.turn AND be.i = s.idx LEFT JOIN ov ON ov.conv_id = s.conv_id AND ov.turn = s.turn AND ov.i = s.idx),
    ch AS (SELECT conv_id, turn, 0 AS clip, i, j FROM nx WHERE i = 0 UNION ALL SELECT nx.conv_id, nx.turn, ch.clip + 1, nx.i, nx.j FROM ch JOIN nx ON nx.conv_id = ch.conv_id AND nx.turn = ch.turn AND nx.i = ch.j + 1)"""


@query(f"""WITH RECURSIVE {_CLIPS_SQL} SELECT ch.conv_id, ch.turn, clip::INT AS clip, i::INT AS first, j::INT AS last, a.start, b."end" FROM ch JOIN said a ON a.conv_id = ch.conv_id AND a.turn = ch.turn AND a.idx = i JOIN said b ON b.conv_id = ch.conv_id AND b.turn = ch.turn AND b.idx = j""")
def greedy_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicer.greedy_groups(said(spark, sf_dir), ["conv_id", "turn"], "acoustic")


@query(
    f"""WITH RECURSIVE {_CLIPS_SQL}, sp AS (SELECT ch.conv_id, ch.turn, clip, any_value(bd.pos) IS NULL AS bare, trim(string_agg(word, ' ' ORDER BY s.idx)) AS transcript, count(*) AS word_count, max(s."end") FILTER (s.idx = j) - min(s.start) FILTER (s.idx = i) AS duration, avg(confidence) AS c
        FROM ch JOIN said s ON s.conv_id = ch.conv_id AND s.turn = ch.turn AND s.idx BETWEEN i AND j LEFT JOIN bd ON bd.conv_id = ch.conv_id AND bd.turn = ch.turn AND bd.idx = j GROUP BY 1, 2, 3)
    SELECT conv_id, turn, clip::INT AS clip, md5(transcript) AS digest, word_count, round(duration, 6) AS duration, round(c, 6) AS avg_confidence, array_to_string([x FOR x IN [CASE WHEN duration > 12.0 THEN 'long' END, CASE WHEN bare AND duration > 15.0 THEN 'no_safe_boundary' END, CASE WHEN round(c, 9) < 0.5 THEN 'low_confidence' END] IF x IS NOT NULL], ' | ') AS flags FROM sp"""
)
def clip_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = said(spark, sf_dir)
    s = slicer.clip_specs(w, slicer.greedy_groups(w, ["conv_id", "turn"], "acoustic"), ["conv_id", "turn"], "acoustic")
    bare = F.regexp_replace("flags", "_[0-9.]+s?( |$)", "$1")  # without the numbers, which the engines round each in their way
    return s.select("conv_id", "turn", "clip", F.md5("transcript").alias("digest"), "word_count", F.round("duration", 6).alias("duration"), F.round("avg_confidence", 6).alias("avg_confidence"), bare.alias("flags"))


@query(
    f"""WITH {FRAMES_SQL}, low AS (SELECT * FROM frames WHERE prob < 0.5),
    m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY day * 1000 + start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT user_id, pos, day * 1000 + start AS start, day * 1000 + "end" AS "end", day FROM low)),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT user_id, pos, start, "end" FROM m)))
    SELECT user_id, round(max(len), 6) AS longest FROM (SELECT user_id, isl, max("end") - min(start) AS len FROM i GROUP BY user_id, isl) GROUP BY user_id"""
)
def longest_quiet_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    f = f.withColumn("start", F.col("day") * 1000 + F.col("start")).withColumn("end", F.col("day") * 1000 + F.col("end"))
    return iv.longest_run_below(f, ["user_id"], "prob", 0.5).select("user_id", F.round("longest", 6).alias("longest"))


@query(
    f"""WITH RECURSIVE {WORDS_SQL}, m AS (SELECT conv_id, turn, word, CASE WHEN pos % 4 = 1 THEN greatest(start - 0.1::DOUBLE, 0.0::DOUBLE) ELSE start END AS start, "end" FROM words),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY start, "end", word) AS i FROM m),
    f AS (SELECT conv_id, turn, i, word, start AS s, "end" AS e, "end" > start AS kept, CASE WHEN "end" > start THEN "end" END AS last FROM o WHERE i = 1
          UNION ALL SELECT o.conv_id, o.turn, o.i, o.word, c.s, o."end", o."end" > c.s, CASE WHEN o."end" > c.s THEN o."end" ELSE f.last END
          FROM f JOIN o ON o.conv_id = f.conv_id AND o.turn = f.turn AND o.i = f.i + 1, LATERAL (SELECT CASE WHEN f.last IS NOT NULL AND o.start < f.last - 0.001::DOUBLE THEN f.last ELSE o.start END AS s) c)
    SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INT AS pos, s AS start, e AS "end", word FROM f WHERE kept"""
)
def words_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every fourth word is made to begin before the last one ends.
    w = words(spark, sf_dir).withColumn("start", F.when(F.col("pos") % 4 == 1, F.greatest(F.col("start") - 0.1, F.lit(0.0))).otherwise(F.col("start")))
    return slicer.keep_order_clamp(w, ["conv_id", "turn"])


@query(
    f"""WITH {FRAMES_SQL} SELECT user_id, day, quantile_cont(rms, 0.1) AS p10, min(rms) AS min_rms, round(avg(rms), 6) AS mean_rms, min(prob) AS min_prob, round(avg(prob), 6) AS mean_prob FROM frames GROUP BY user_id, day"""
)
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("user_id", "day").agg(F.percentile("rms", F.lit(0.1)).alias("p10"), F.min("rms").alias("min_rms"), F.round(F.avg("rms"), 6).alias("mean_rms"), F.min("prob").alias("min_prob"), F.round(F.avg("prob"), 6).alias("mean_prob"))

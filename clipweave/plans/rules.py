"""Queries of rules over single rows and of orders: review policy, scorable windows, native bounds, best clips, and cuts that begin with frames and buffers apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions import text as tx
from clipweave.operators import export, policy, signal, slicer
from clipweave.plans.registry import query, table
from clipweave.plans.slicer import FRAMES_SQL, frames


@query(
    """WITH e AS (SELECT 'c' || event_id AS clip_id, (event_id * 37 % 101) / 100.0::DOUBLE AS a, (event_id * 53 % 89) / 100.0::DOUBLE AS b, value AS speech, abs(value - 7.0::DOUBLE) AS penalty FROM events),
    s AS (SELECT *, row_number() OVER (ORDER BY greatest(a, b), a + b, speech DESC NULLS LAST, clip_id) AS k FROM e), d AS (SELECT *, row_number() OVER (ORDER BY penalty NULLS FIRST, speech DESC NULLS LAST, clip_id) AS k FROM e)
    SELECT 'safety' AS rule, clip_id FROM s WHERE k <= 100 UNION ALL SELECT 'duration', clip_id FROM d WHERE k <= 100"""
)
def best_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best clips by each of two orders."""
    k = F.col("event_id")
    c = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), k).alias("clip_id"), ((k * 37 % 101) / F.lit(100.0)).alias("start_risk"), ((k * 53 % 89) / F.lit(100.0)).alias("end_risk"), F.col("value").alias("retained_speech_sec"), F.abs(F.col("value") - 7.0).alias("duration_penalty"))
    return policy.safety_first(c, 100).select(F.lit("safety").alias("rule"), "clip_id").unionByName(policy.duration_first(c, 100).select(F.lit("duration").alias("rule"), "clip_id"))


@query(
    """WITH d AS (SELECT doc_id, len(string_split(text, ' ')) - 5 AS n, CASE WHEN n_chars % 11 = 0 THEN NULL ELSE (n_chars % 101)::DOUBLE END AS score, n_chars % 7 = 0 AS silent, CASE WHEN n_chars % 3 = 0 THEN [lang, source] ELSE []::VARCHAR[] END AS h FROM documents)
    SELECT doc_id, n <= 0 OR silent OR len(h) > 0 OR score IS NULL AS required, array_to_string(list_sort(list_distinct(list_concat(h, [x FOR x IN [CASE WHEN n <= 0 THEN 'no_lexical_words' END, CASE WHEN silent THEN 'high_no_speech_segment' END, CASE WHEN score < 85 THEN 'low_transcript_match' END] IF x IS NOT NULL]))), '|') AS reasons FROM d"""
)
def review_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("n_chars")
    hazards = F.when(c % 3 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    required, reasons = tx.review_policy(F.size(F.split("text", " ", -1)) - 5, F.when(c % 11 != 0, (c % 101).cast("double")), c % 7 == 0, hazards)
    return table(spark, sf_dir, "documents").select("doc_id", required.alias("required"), F.array_join(reasons, "|").alias("reasons"))


@query(
    """WITH e AS (SELECT vec_id, [abs(x::DOUBLE) FOR x IN embedding] AS l FROM embeddings), s AS (SELECT vec_id, l, CASE WHEN len(l) > 0 THEN len([x FOR x IN l IF x < 0.05]) / len(l)::DOUBLE ELSE 1.0 END AS silent, list_avg(l) AS level FROM e)
    SELECT vec_id, round(silent, 9) AS silent, silent < 0.70 AND level >= 0.02 AS scorable FROM s"""
)
def scorable_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", levels.alias("l"))
    e = e.withColumn("silent", signal.silent_fraction(F.col("l"), 0.05)).withColumn("level", F.aggregate("l", F.lit(0.0), lambda s, x: s + x) / F.size("l"))
    return e.select("vec_id", F.round("silent", 9).alias("silent"), signal.scorable(F.col("level"), F.col("silent")).alias("scorable"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, (l_quantity * 1600)::BIGINT AS s, (l_quantity * 1600 + l_partkey)::BIGINT AS e, CASE l_linenumber % 3 WHEN 0 THEN 44100 WHEN 1 THEN 16000 ELSE 8000 END AS rate FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE rate WHEN 44100 THEN s WHEN 16000 THEN round_even(s * 2.75625::DOUBLE, 0)::BIGINT END AS native_start, CASE rate WHEN 44100 THEN e WHEN 16000 THEN round_even(e * 2.75625::DOUBLE, 0)::BIGINT END AS native_end, rate <> 8000 AS known FROM l"""
)
def native_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips whose coordinates are of the source's rate, the analysis rate, or an unknown one."""
    n = F.col("l_linenumber") % 3
    s = (F.col("l_quantity") * 1600).cast("long")
    rate = F.when(n == 0, 44100).when(n == 1, 16000).otherwise(8000)
    start, end, known = export.native_bounds(s, (F.col("l_quantity") * 1600 + F.col("l_partkey")).cast("long"), rate, F.lit(44100), F.lit(16000))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("native_start"), end.alias("native_end"), known.alias("known"))


@query(
    f"""WITH {FRAMES_SQL}, bu AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 70.0::DOUBLE), (1, 71.0::DOUBLE, 140.0::DOUBLE)) t(buffer_id, b0, b1)),
    fb AS (SELECT f.*, buffer_id FROM frames f JOIN bu ON center > b0 + 1e-9 AND center < b1 - 1e-9),
    fl AS (SELECT user_id, day, buffer_id, quantile_cont(rms, 0.10) AS floor FROM fb GROUP BY 1, 2, 3),
    q AS (SELECT f.* FROM fb f JOIN fl USING (user_id, day, buffer_id) WHERE prob < 0.6 AND rms <= floor + 15.0),
    mx AS (SELECT *, max("end") OVER (PARTITION BY user_id, day, buffer_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
    isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day, buffer_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run_index FROM mx),
    sp AS (SELECT *, min(start) OVER w AS run_start, max("end") OVER w AS run_end FROM isl WINDOW w AS (PARTITION BY user_id, day, buffer_id, run_index)),
    v AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, buffer_id, run_index ORDER BY prob, rms, abs(center - (run_start + run_end) / 2), pos) AS k, count(*) OVER (PARTITION BY user_id, day, buffer_id, run_index) AS n_frames FROM sp)
    SELECT user_id, day, buffer_id, run_index::BIGINT AS run_index, n_frames, round(center, 6) AS time, round((1 - prob) + least(greatest(-rms / 100.0, 0.0), 1.0), 6) AS score FROM v WHERE k = 1 AND run_end - run_start >= 0.040 - 1e-9"""
)
def buffer_cutpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames meet the two buffers of their day, and each buffer is cut by its own floor."""
    f = frames(spark, sf_dir)
    spans = F.explode(F.array(*[F.struct(F.lit(k).alias("buffer_id"), F.lit(a).alias("b_start"), F.lit(b).alias("b_end")) for k, a, b in ((0, 0.0, 70.0), (1, 71.0, 140.0))])).alias("b")
    buffers = f.select("user_id", "day").distinct().select("user_id", "day", spans).select("user_id", "day", "b.*")
    inside = slicer.frames_in(f, buffers, ["user_id", "day"], 70.0)
    out = slicer.detect_cutpoints(inside, ["user_id", "day", "buffer_id"], prob_below=0.6, rms_over_floor=15.0)
    return out.select("user_id", "day", "buffer_id", F.col("run_index").cast("bigint").alias("run_index"), "n_frames", "time", "score")

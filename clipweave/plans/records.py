"""Queries of artifact rows: line items are turns or segments, customers recordings or cuts, nations runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.operators import records
from clipweave.plans.registry import query, table


@query(
    """WITH t AS (SELECT 'o' || l_orderkey AS source_audio_id, 'speaker_' || l_linenumber AS speaker_id, l_partkey / 1000.0::DOUBLE AS s, l_partkey / 1000.0::DOUBLE + (l_quantity - 5) / 100000.0::DOUBLE AS e FROM lineitem),
    r AS (SELECT source_audio_id, speaker_id, round_even(s * 8000, 0)::BIGINT AS start_sample, round_even(e * 8000, 0)::BIGINT AS end_sample FROM t WHERE e > s)
    SELECT concat_ws('-', speaker_id, source_audio_id, start_sample, end_sample) AS id, *, round(start_sample / 8000.0::DOUBLE, 6) AS start_sec, round(end_sample / 8000.0::DOUBLE, 6) AS end_sec FROM r WHERE end_sample > start_sample"""
)
def turn_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") / F.lit(1000.0)
    t = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source_audio_id"), F.concat(F.lit("SPEAKER_0"), "l_linenumber").alias("label"), start.alias("start_sec"), (start + (F.col("l_quantity") - 5) / 100000.0).alias("end_sec"))
    return records.turn_regions(t, 8000)


@query(
    """SELECT concat_ws('-', 'speaker_0', 'c' || o_custkey, o_orderkey, o_orderkey + 100) AS id, 'c' || o_custkey AS source_audio_id, 'audio/' || c_custkey AS analysis_audio_path, 'speaker_0' AS speaker_id, o_orderkey AS start_sample, o_orderkey + 100 AS end_sample
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
)
def single_speaker_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source_audio_id"), F.col("o_orderkey").alias("start_sample"), (F.col("o_orderkey") + 100).alias("end_sample"))
    variants = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source_audio_id"), F.concat(F.lit("audio/"), "c_custkey").alias("path"))
    return records.single_speaker_regions(segments, variants)


def _speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run"), F.concat(F.lit("speaker_"), F.col("c_custkey") % 5).alias("speaker_id"), "c_custkey")


@query(
    """WITH r AS (SELECT DISTINCT c_nationkey AS run, 'speaker_' || c_custkey % 5 AS sp FROM customer), a AS (SELECT run, string_agg(sp, ',' ORDER BY sp) AS available FROM r GROUP BY run),
    p AS (SELECT n_nationkey AS run, 'speaker_' || n_nationkey % 7 AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'auto' END AS source FROM nation WHERE n_nationkey % 3 > 0)
    SELECT coalesce(a.run, p.run) AS run, r.sp IS NOT NULL AS selected, r.sp AS target, CASE WHEN r.sp IS NULL THEN 'pending_user_selection' ELSE coalesce(p.source, 'user') END AS source, coalesce(available, '') AS available,
           CASE WHEN r.sp IS NULL THEN 'speaker_selection_required' ELSE '' END AS reasons FROM a FULL JOIN p ON a.run = p.run LEFT JOIN r ON r.run = p.run AND r.sp = p.target"""
)
def carried_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    previous = table(spark, sf_dir, "nation").where(n % 3 > 0).select(n.alias("run"), F.concat(F.lit(" speaker_"), n % 7).alias("target"), F.when(n % 2 == 0, "auto").alias("source"))
    found = records.carried_selections(_speakers(spark, sf_dir), previous)
    return found.withColumn("available", F.array_join("available", ",")).withColumn("reasons", F.array_join("reasons", ","))


@query("WITH r AS (SELECT DISTINCT c_nationkey AS run, 'speaker_' || c_custkey % 5 AS sp FROM customer) SELECT n_nationkey AS run, 'speaker_' || n_nationkey % 7 AS speaker_id, r.sp IS NOT NULL AS known FROM nation LEFT JOIN r ON r.run = n_nationkey AND r.sp = 'speaker_' || n_nationkey % 7")
def known_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = _speakers(spark, sf_dir), F.col("n_nationkey")
    choices = table(spark, sf_dir, "nation").select(n.alias("run"), F.concat(F.lit("speaker_"), n % 7).alias("speaker_id"))
    return records.known_choices(choices, s.where("c_custkey % 2 = 0"), s.where("c_custkey % 2 = 1"))


@query("SELECT 's' || doc_id % 50 AS source_audio_id, arg_max(CASE WHEN doc_id % 4 = 2 THEN 'left' ELSE 'downmix' END, doc_id) AS channel_mode FROM documents WHERE doc_id % 3 = 0 GROUP BY 1")
def channel_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    recipe = F.when(k % 4 == 1, "{}").when(k % 4 == 2, '{"channel_mode": "left"}').when(k % 4 == 3, "broken")
    return records.channel_modes(table(spark, sf_dir, "documents").select(k.alias("at"), F.concat(F.lit("s"), k % 50).alias("source_audio_id"), F.when(k % 3 == 0, "analysis_audio").otherwise("source").alias("kind"), recipe.alias("recipe")))


@query(
    """WITH s AS (SELECT l_orderkey AS run, bool_or(l_partkey % 10 = 0) AS silent, bool_or(l_suppkey % 4 = 0) AS unsure FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
    SELECT o_orderkey AS run, concat_ws(',', CASE WHEN coalesce(silent, true) THEN 'no_speech_prob' END, CASE WHEN unsure THEN 'word_probability' END) AS gaps FROM orders LEFT JOIN s ON run = o_orderkey"""
)
def metadata_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'")
    segments = heard.select(F.col("l_orderkey").alias("run"), F.when(F.col("l_partkey") % 10 != 0, 0.1).alias("no_speech_prob"))
    words = heard.select(F.col("l_orderkey").alias("run"), F.when(F.col("l_suppkey") % 4 != 0, 0.9).alias("probability"))
    return records.metadata_gaps(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run")), segments, words).withColumn("gaps", F.array_join("gaps", ","))


@query("SELECT source, arg_min('m' || doc_id % 5, doc_id) FILTER (WHERE doc_id % 3 = 2) AS method FROM documents GROUP BY source")
def first_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return records.first_stated(table(spark, sf_dir, "documents").select("source", k, F.when(k % 3 == 0, "  ").when(k % 3 == 2, F.concat(F.lit(" m"), k % 5, F.lit(" "))).alias("method")), "source", "method", "doc_id")


_CUT = """SELECT c_custkey AS cut_id, c_custkey::DOUBLE AS t, c_custkey - (c_custkey % 7 - 2) / 10.0::DOUBLE AS a, c_custkey + (c_custkey % 5) / 10.0::DOUBLE AS z, c_acctbal AS rms, (c_custkey % 11) / 10.0::DOUBLE AS vad, (c_custkey % 101)::DOUBLE AS score FROM customer"""


@query(
    f"""WITH c AS ({_CUT}) SELECT o_orderkey AS clip_id, o_custkey AS start_cut, o_orderkey % 100 + 1 AS end_cut, s.rms AS start_rms, e.rms AS end_rms, s.vad AS start_vad, e.vad AS end_vad, s.score AS start_score, e.score AS end_score,
    round(greatest(0.0, s.t - s.a), 6) AS quiet_before_start, round(greatest(0.0, e.z - e.t), 6) AS quiet_after_end FROM orders JOIN c s ON s.cut_id = o_custkey JOIN c e ON e.cut_id = o_orderkey % 100 + 1"""
)
def edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cuts = table(spark, sf_dir, "customer").select(
        k.alias("cut_id"), k.cast("double").alias("time_sec"), (k - (k % 7 - 2) / F.lit(10.0)).alias("interval_start_sec"), (k + (k % 5) / F.lit(10.0)).alias("interval_end_sec"), F.col("c_acctbal").alias("rms"),
        ((k % 11) / F.lit(10.0)).alias("vad"), (k % 101).cast("double").alias("score"),
    )
    clips = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id"), F.col("o_custkey").alias("start_cut"), (F.col("o_orderkey") % 100 + 1).alias("end_cut"))
    return records.edge_features(clips, cuts)


@query(
    """WITH d AS (SELECT doc_id, doc_id % 6 AS k, (doc_id % 7)::DOUBLE AS c FROM documents)
    SELECT doc_id, CASE WHEN k = 0 OR k = 2 THEN c END AS start_seconds, CASE WHEN k = 0 OR k = 2 THEN c + 5 END AS end_seconds,
           CASE WHEN k = 1 THEN 'trim_needs_both_bounds' WHEN k = 3 THEN 'trim_not_positive' WHEN k = 5 OR (k = 4 AND c = 0) THEN 'trim_outside_source' WHEN k = 4 THEN 'trim_outside_candidate' END AS problem FROM d"""
)
def trim_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("doc_id") % 6, (F.col("doc_id") % 7).cast("double")
    start = F.when(k == 2, c - 5e-7).when(k == 3, c + 1).when(k == 4, c - 1).when(k == 5, c + 0.5)
    end = F.when(k == 1, 3.0).when(k == 2, c + 5 + 5e-7).when(k == 3, c + 1).when(k == 4, c + 5).when(k == 5, c + 8)
    t = records.trim_bounds(c, c + 5, c + 6, start, end)
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.col("t.start").alias("start_seconds"), F.col("t.end").alias("end_seconds"), F.col("t.problem").alias("problem"))


@query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'zero_shot' WHEN 1 THEN 'finetune' END AS mode, CASE WHEN doc_id % 4 > 0 THEN list_sort(list_distinct([x FOR x IN [(doc_id % 5)::DOUBLE, 0.5, doc_id % 2 * 2.25, 'inf'::DOUBLE] IF x >= 1 AND x < 1e300])) END AS w FROM documents)
    SELECT doc_id, list_aggregate(t, 'string_agg', ',') AS durations FROM (SELECT doc_id, CASE WHEN len(w) > 0 THEN w WHEN mode = 'finetune' THEN [2.5::DOUBLE, 4.0, 5.0] ELSE [3.0::DOUBLE, 4.5, 6.0] END AS t FROM d)"""
)
def target_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    wanted = F.when(k % 4 > 0, F.array((k % 5).cast("double"), F.lit(0.5), k % 2 * F.lit(2.25), F.lit(float("inf")), F.lit(None).cast("double")))
    t = records.target_durations(wanted, F.when(k % 3 == 0, "zero_shot").when(k % 3 == 1, "finetune"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(t.cast("array<string>"), ",").alias("durations"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a,b' WHEN doc_id % 3 = 0 THEN 'missing_speaker_qc' ELSE '' END AS purity, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN 'new' ELSE '' END AS transcript, doc_id % 5 > 1 AND doc_id % 7 <> 0 AS clean,
    CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'render_failed' WHEN 2 THEN 'unrendered' WHEN 3 THEN 'no_revision' WHEN 4 THEN 'cache_missing' WHEN 5 THEN 'cache_mismatch' END AS acceptance,
    CASE WHEN doc_id % 5 = 0 THEN 'foreign_project' WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'space_mismatch' END WHEN doc_id % 4 = 1 THEN 'not_ready' WHEN doc_id % 3 = 1 THEN 'space_mismatch' END AS anchor, NOT (doc_id % 6 = 0 AND doc_id % 4 > 0) AS timed FROM documents"""
)
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    s = lambda n: F.lit(n)
    codes = F.when(k % 4 == 0, F.array(s("b"), s("a"), s("b")))
    flags = [F.when(k % 5 == 0, "True").when(k % 5 > 1, "False"), F.when(k % 7 == 0, "True").otherwise("False")]
    render = F.when(k % 7 == 1, "failed").when(k % 7 != 2, "ready")
    acceptance = records.acceptance_problem(F.when(k % 7 > 0, k % 7), render, F.when(k % 7 != 3, "r"), s("h"), F.when(k % 7 == 5, "g").when(k % 7 == 6, "h"))
    anchor = records.anchor_problem(F.when(k % 5 > 0, "p"), s("p"), F.when(k % 4 == 0, "stale").when(k % 4 == 1, "queued").otherwise("ready"), F.when(k % 3 == 1, "old").otherwise(F.when(k % 3 == 0, "next").otherwise("now")), F.when(k % 3 == 0, "next").otherwise("now"), s("now"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(records.purity_reasons(F.when(k % 3 > 0, 1.0), codes), ",").alias("purity"), records.current_text(F.when(k % 3 == 0, " ").when(k % 3 == 1, "new"), F.when(k % 3 == 0, F.col("lang"))).alias("transcript"),
        records.non_problematic(flags).alias("clean"), acceptance.alias("acceptance"), anchor.alias("anchor"), records.timing_valid(k % 6, F.when(k % 4 > 0, F.when(k % 6 == 0, -1).otherwise(9))).alias("timed"),
    )

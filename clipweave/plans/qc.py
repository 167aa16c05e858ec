"""Gate queries over the documents table: clips are documents, scores are arithmetic on labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions.arrays import reasons
from clipweave.operators import curves, qc
from clipweave.operators.ordering import with_row_number
from clipweave.plans.registry import query, table

MATCH_MIN, CHECK_MIN = 85.0, 70.0

SCORED_SQL = """
    scored AS (
        SELECT d.doc_id AS clip_id, d.n_chars / 100.0::DOUBLE AS duration, d.source, d.lang,
               CASE WHEN l.quality IS NOT NULL AND d.doc_id % 13 <> 0 THEN (60 + (d.doc_id * 7) % 41)::DOUBLE END AS match,
               CASE WHEN l.quality IS NOT NULL AND d.doc_id % 17 <> 0 THEN (55 + (d.doc_id * 11) % 46 - 10 * l.toxic)::DOUBLE END AS "check",
               CASE WHEN l.quality IS NOT NULL THEN d.doc_id % 19 <> 0 END AS calibrated,
               d.doc_id % 23 = 0 AS missing,
               CASE WHEN l.toxic = 1 THEN 'force_reject' WHEN l.quality = 1 AND d.doc_id % 11 = 0 THEN 'force_keep' END AS override
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    decided AS (
        SELECT *, CASE WHEN coalesce(match >= 85 AND "check" >= 70 AND coalesce(calibrated, true) AND NOT missing, false) THEN 'accepted' ELSE 'rejected' END AS threshold_status
        FROM scored),
    final AS (
        SELECT *, CASE WHEN missing THEN 'rejected' WHEN override = 'force_keep' THEN 'accepted' WHEN override = 'force_reject' THEN 'rejected' ELSE threshold_status END AS status,
               array_to_string(list_filter_null, '|') AS reasons
        FROM (SELECT *, list_sort(list_distinct([x FOR x IN [CASE WHEN missing THEN 'audio_missing' END, CASE WHEN match IS NULL THEN 'missing_transcript_score' END,
                  CASE WHEN match < 85 THEN 'transcript_below_threshold' END, CASE WHEN "check" IS NULL THEN 'missing_speaker_score' END,
                  CASE WHEN "check" < 70 THEN 'speaker_below_threshold' END, CASE WHEN "check" IS NOT NULL AND NOT coalesce(calibrated, true) THEN 'speaker_score_uncalibrated' END,
                  CASE WHEN lang = 'de' THEN 'contains_oov' END] IF x IS NOT NULL])) AS list_filter_null FROM decided))
"""


def scored_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, duration, source, lang, match, check, calibrated, missing, override, reason_codes."""
    clips = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), (F.col("n_chars") / 100.0).alias("duration"), "source", "lang")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "clip_id")
    k = F.col("clip_id")
    transcript = labels.where(k % 13 != 0).select("clip_id", (60 + (k * 7) % 41).cast("double").alias("match"))
    speaker = labels.select("clip_id", F.when(k % 17 != 0, (55 + (k * 11) % 46 - 10 * F.col("toxic")).cast("double")).alias("check"), (k % 19 != 0).alias("calibrated"))
    override = F.when(F.col("toxic") == 1, "force_reject").when((F.col("quality") == 1) & (k % 11 == 0), "force_keep")
    joined = qc.join_scores(clips, transcript, speaker, labels.select("clip_id", override.alias("override")))
    return joined.withColumn("missing", k % 23 == 0).withColumn("reason_codes", reasons((F.col("lang") == "de", "contains_oov")))


def decided_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.decide(scored_clips(spark, sf_dir), MATCH_MIN, CHECK_MIN)


@query(f"WITH {SCORED_SQL} SELECT clip_id, match, \"check\", threshold_status, status, override, reasons FROM final")
def qc_finalize_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided_clips(spark, sf_dir).select("clip_id", "match", "check", "threshold_status", "status", "override", F.array_join("reasons", "|").alias("reasons"))


_N = "CAST(count(*) FILTER ({}) AS BIGINT)"


@query(
    f"""WITH {SCORED_SQL}, c AS (SELECT *, coalesce(match < 85, true) AS lm, coalesce("check" < 70, true) AS lc FROM final)
    SELECT {_N.format("status = 'accepted'")} AS accepted, {_N.format("status = 'rejected'")} AS rejected,
           round(coalesce(sum(duration) FILTER (status = 'accepted'), 0), 6) AS accepted_sec, round(coalesce(sum(duration) FILTER (status = 'rejected'), 0), 6) AS rejected_sec,
           {_N.format("lm AND lc")} AS failed_both, {_N.format("lm AND NOT lc")} AS failed_transcript, {_N.format("NOT lm AND lc")} AS failed_speaker,
           {_N.format("override = 'force_keep' AND status = 'accepted'")} AS force_kept, {_N.format("override = 'force_reject'")} AS force_rejected FROM c"""
)
def qc_finalize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.summarise(decided_clips(spark, sf_dir), MATCH_MIN, CHECK_MIN)


@query(f"WITH {SCORED_SQL} SELECT r AS reason, count(*) AS n FROM (SELECT unnest(list_filter_null) AS r FROM final) GROUP BY r")
def qc_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.reason_counts(decided_clips(spark, sf_dir))


@query(
    f"""WITH {SCORED_SQL} SELECT clip_id, CASE WHEN coalesce(match >= 85, false) AND coalesce("check" >= 70, false) THEN 'accepted' ELSE 'rejected' END AS preview,
        CASE WHEN override = 'force_keep' THEN 'accepted' WHEN override = 'force_reject' THEN 'rejected'
             WHEN coalesce(match >= 85, false) AND coalesce("check" >= 70, false) THEN 'accepted' ELSE 'rejected' END AS final_preview FROM scored"""
)
def qc_preview_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_clips(spark, sf_dir)
    m, c = F.col("match"), F.col("check")
    return s.select("clip_id", qc.preview_status(m, c, MATCH_MIN, CHECK_MIN).alias("preview"), qc.preview_status(m, c, MATCH_MIN, CHECK_MIN, F.col("override")).alias("final_preview"))


@query(
    f"""WITH {SCORED_SQL}, b AS (SELECT least(floor(least(greatest(match, 0), 100) / 5), 19)::INT AS bin FROM scored WHERE match IS NOT NULL)
    SELECT r.bin, r.bin * 5.0::DOUBLE AS low, (r.bin + 1) * 5.0::DOUBLE AS high, count(b.bin) AS n FROM (SELECT unnest(range(20))::INT AS bin) r LEFT JOIN b ON r.bin = b.bin GROUP BY r.bin"""
)
def qc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.histogram(scored_clips(spark, sf_dir), "match", 20)


@query(
    f"""WITH {SCORED_SQL}, s AS (SELECT least(greatest(match, 0), 100) AS x, duration FROM scored WHERE match IS NOT NULL),
    t AS (SELECT DISTINCT x AS threshold FROM s UNION SELECT 0.0 UNION SELECT 100.0)
    SELECT threshold, count(s.x) AS clips, round(coalesce(sum(s.duration), 0), 6) AS seconds FROM t LEFT JOIN s ON s.x >= t.threshold GROUP BY threshold"""
)
def qc_yield_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.yield_curve(scored_clips(spark, sf_dir), "match", "duration")


@query(f"WITH {SCORED_SQL} SELECT count(*) FILTER (match IS NULL) AS unscored_match, count(*) FILTER (\"check\" IS NULL) AS unscored_check FROM scored")
def qc_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_clips(spark, sf_dir)
    return s.agg(curves.unscored("match").alias("unscored_match"), curves.unscored("check").alias("unscored_check"))


@query(
    f"""WITH {SCORED_SQL} SELECT clip_id, match - 85 AS match_margin, "check" - 70 AS check_margin, least(match - 85, "check" - 70) AS least_margin, greatest(match - 85, "check" - 70) AS most_margin
    FROM final WHERE status = 'accepted' ORDER BY least(match - 85, "check" - 70) NULLS LAST, clip_id LIMIT 25"""
)
def qc_riskiest_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = decided_clips(spark, sf_dir).where("status = 'accepted'")
    m = qc.margins(F.col("match"), F.col("check"), MATCH_MIN, CHECK_MIN)
    return qc.riskiest(kept.select("clip_id", *[c.alias(k) for k, c in m.items()]), "least_margin", 25)


@query(f"WITH {SCORED_SQL} SELECT clip_id, \"check\", row_number() OVER (ORDER BY \"check\" DESC NULLS LAST, clip_id) AS place FROM scored")
def clip_sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The place of each clip in the order that sorted_clips gives: unscored ones last.
    s = scored_clips(spark, sf_dir).select("clip_id", "check", F.col("check").isNull().alias("last"), (-F.col("check")).alias("falling"))
    return with_row_number(s, ["last", "falling", "clip_id"], "place")[0].select("clip_id", "check", "place")


@query("SELECT doc_id AS clip_id, source, lang FROM documents WHERE (contains(lower(text), 'tion') OR contains(lower(source), 'tion')) AND lang IN ('en', 'fr')")
def clip_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "clip_id")
    return qc.search(docs, "TION", ["text", "source"], lang=["en", "fr"]).select("clip_id", "source", "lang")


@query(
    f"""WITH {SCORED_SQL}, k AS (SELECT clip_id, (clip_id * 31) % 97 AS draw, row_number() OVER (ORDER BY clip_id) AS rn, count(*) OVER () AS n FROM final WHERE status = 'accepted'),
    s AS (SELECT *, floor((rn - 1) * least(10, n) / n)::BIGINT AS slice FROM k)
    SELECT slice, clip_id FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY draw, rn) AS first FROM s) WHERE first = 1"""
)
def qc_evenly_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = decided_clips(spark, sf_dir).where("status = 'accepted'").select("clip_id", ((F.col("clip_id") * 31) % 97).alias("draw"))
    return qc.evenly_spread(kept, ["clip_id"], 10, F.col("draw")).select("slice", "clip_id")


@query(
    """WITH o AS (SELECT doc_id AS clip_id, 1 AS priority, 'manual' AS origin FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 2, 'clip' FROM labels WHERE doc_id % 3 = 0)
    SELECT clip_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY priority DESC) AS k FROM o) WHERE k = 1"""
)
def qc_override_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("clip_id"), "quality")
    early = labels.where("quality = 1").select("clip_id", F.lit(1).alias("priority"), F.lit("manual").alias("origin"))
    late = labels.where("clip_id % 3 = 0").select("clip_id", F.lit(2).alias("priority"), F.lit("clip").alias("origin"))
    return qc.last_wins(early.unionByName(late), "clip_id", "priority").select("clip_id", "origin")

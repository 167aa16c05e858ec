"""Text, scoring and transcript queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipweave.functions import numeric, text
from clipweave.functions.arrays import first_present
from clipweave.operators import scoring
from clipweave.plans.intervals import WORDS_SQL, words
from clipweave.plans.registry import query, table

#: Word probabilities of a document: one per word, from its place; the fourth of the documents whose id ends in 7 are on the unit scale.
PROBS_SQL = """
    pw AS (SELECT doc_id, [((i * 7 + doc_id) % 100)::DOUBLE / CASE WHEN doc_id % 10 = 7 THEN 100.0 ELSE 1.0 END FOR i IN range(len(string_split(text, ' ')))] AS p FROM documents)
"""


def _probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = F.size(F.split("text", " ", -1))
    p = F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((i * 7 + F.col("doc_id")) % 100).cast("double") / F.when(F.col("doc_id") % 10 == 7, 100.0).otherwise(1.0))
    return d.select("doc_id", p.alias("p"))


@query(
    f"""WITH {PROBS_SQL}, s AS (SELECT doc_id, CASE WHEN len([v FOR v IN p IF v > 1]) = 0 THEN 'unit' WHEN len([v FOR v IN p IF v <= 1 AND v <> 0]) = 0 THEN 'percent' ELSE 'mixed' END AS scale, p FROM pw),
    q AS (SELECT doc_id, scale, list_sort(CASE WHEN scale = 'unit' THEN [v * 100 FOR v IN p] WHEN scale = 'percent' THEN p END) AS o FROM s),
    m AS (SELECT doc_id, scale, round(o[1], 4) AS m1, round(coalesce(o[2], o[1]), 4) AS m2, round(coalesce(o[2], o[1]) - o[1], 4) AS gap FROM q),
    l AS (SELECT *, 1 / (1 + exp(-(-3.165108::DOUBLE + -0.482025::DOUBLE * ((m1 - 75.864291::DOUBLE) / 18.577465::DOUBLE) + -0.422582::DOUBLE * ((m2 - 91.250489::DOUBLE) / 10.974781::DOUBLE)))) AS p FROM m)
    SELECT doc_id, scale, m1, m2, gap, round(round(p, 8), 6) AS harmful, round((1 - p) * 100, 4) AS match,
           CASE WHEN p IS NULL THEN 'failed' WHEN round((1 - p) * 100, 4) >= 85 THEN 'accepted' WHEN round((1 - p) * 100, 4) >= 70 THEN 'review' ELSE 'rejected' END AS bucket,
           CASE WHEN p IS NULL THEN 'unscored' WHEN round((1 - p) * 100, 4) >= 85 THEN 'pass' WHEN round((1 - p) * 100, 4) >= 70 THEN 'review' ELSE 'fail' END AS hint FROM l"""
)
def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _probs(spark, sf_dir).select("doc_id", text.probability_scale(F.col("p")).alias("scale"), text.percent_probabilities(F.col("p")).alias("p"))
    m1, m2, gap = text.two_smallest(F.col("p"))
    m = p.select("doc_id", "scale", m1.alias("m1"), m2.alias("m2"), gap.alias("gap"))
    harmful, match = text.transcript_score(F.col("m1"), F.col("m2"))
    return m.withColumn("harmful", F.round(harmful, 6)).withColumn("match", match).withColumn("bucket", text.score_bucket(F.col("match"))).withColumn("hint", text.bucket_hint(F.col("match")))


@query(
    r"""SELECT doc_id, array_to_string([x FOR x IN [CASE WHEN regexp_matches(text, '[$€£¥]') THEN 'contains_currency_symbol' END, CASE WHEN regexp_matches(text, '[$%@#*+=&€£¥©™^_]') THEN 'contains_danger_symbol' END,
        CASE WHEN regexp_matches(text, '[0-9]') THEN 'contains_numeric_token' END, CASE WHEN contains(text, '%') THEN 'contains_percent_symbol' END] IF x IS NOT NULL], '|') AS hazards FROM documents"""
)
def hazard_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.hazards(F.col("text")), "|").alias("hazards"))


@query(
    r"""SELECT w.token, regexp_replace(w.token, '^[^\p{L}\p{N}_'']+|[^\p{L}\p{N}_'']+$', '', 'g') AS bare, count(*) AS n
    FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS token FROM documents) w
    WHERE regexp_matches(regexp_replace(w.token, '^[^\p{L}\p{N}_'']+|[^\p{L}\p{N}_'']+$', '', 'g'), '[\p{L}\p{N}]') GROUP BY 1, 2"""
)
def lexical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    w = d.select(F.explode(F.split(F.regexp_replace("text", "\n", " "), " ", -1)).alias("token")).groupBy("token").count()
    return w.select("token", text.lexical_token(F.col("token")).alias("bare"), F.col("count").alias("n")).where("bare IS NOT NULL")


@query(
    f"""WITH {WORDS_SQL}, k AS (SELECT *, lag(pos // 2) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS before FROM words)
    SELECT conv_id, turn, string_agg(word, ' ' ORDER BY pos) AS transcript FROM k WHERE before IS NULL OR before <> pos // 2 GROUP BY conv_id, turn"""
)
def transcript_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens joined, of consecutive ones with one raw token (here: two words each) the first."""
    raw = F.floor(F.col("pos") / 2)
    w = words(spark, sf_dir).withColumn("before", F.lag(raw).over(Window.partitionBy("conv_id", "turn").orderBy("pos")))
    kept = w.where(F.col("before").isNull() | (F.col("before") != raw))
    return kept.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("transcript"))


@query(
    f"""WITH {WORDS_SQL}, g AS (SELECT *, lead(start) OVER (PARTITION BY conv_id, turn ORDER BY pos) - "end" AS gap FROM words),
    t AS (SELECT *, regexp_extract(word, '[.,;:?!]*$') AS tail, left(word, length(word) - length(regexp_extract(word, '[.,;:?!]*$'))) AS base FROM g),
    r AS (SELECT conv_id, turn, pos, base || CASE WHEN gap IS NULL THEN tail WHEN tail <> '' AND greatest(gap, 0) <= 0.05 THEN '' WHEN tail = '' AND greatest(gap, 0) >= 0.3 THEN ',' ELSE tail END AS token FROM t)
    SELECT conv_id, turn, string_agg(token, ' ' ORDER BY pos) AS transcript FROM r WHERE token <> '' GROUP BY conv_id, turn"""
)
def pause_faithful_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.lead("start").over(Window.partitionBy("conv_id", "turn").orderBy("pos")) - F.col("end")
    t = words(spark, sf_dir).withColumn("gap", gap).withColumn("token", text.paused_token(F.col("word"), F.col("gap"))).where("token <> ''")
    return t.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("transcript"))


@query(
    r"""WITH a AS (SELECT item_id, [x FOR x IN string_split_regex(trim(lower(text)), '[^a-z0-9''-]+') IF x <> ''] AS w FROM (SELECT item_id, regexp_replace(text, '[^\x00-\x7f]', '', 'g') AS text FROM benchmark)),
    b AS (SELECT item_id, w, CASE item_id % 5 WHEN 0 THEN w WHEN 1 THEN list_reverse(w) WHEN 2 THEN list_append(w, 'zzz') WHEN 3 THEN w[1:len(w) - 1] ELSE list_append(w[2:], 'zzz') END AS h FROM a),
    e AS (SELECT item_id, w, h, len([x FOR x IN w IF NOT list_contains(h, x)]) AS gone, len([x FOR x IN h IF NOT list_contains(w, x)]) AS came FROM b)
    SELECT item_id, CASE WHEN w = h THEN 'identical' WHEN list_sort(w) = list_sort(h) THEN 'word_order' WHEN gone = 0 AND len(h) > len(w) THEN 'extra' WHEN came = 0 AND len(w) > len(h) THEN 'missing' ELSE 'content' END AS kind FROM e"""
)
def word_compare_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7f]", "")
    w = table(spark, sf_dir, "benchmark").select("item_id", text.compare_words(ascii_).alias("w"))
    last = F.array(F.lit("zzz"))
    h = (
        F.when(F.col("item_id") % 5 == 0, F.col("w")).when(F.col("item_id") % 5 == 1, F.reverse("w")).when(F.col("item_id") % 5 == 2, F.concat("w", last))
        .when(F.col("item_id") % 5 == 3, F.slice("w", F.lit(1), F.size("w") - 1)).otherwise(F.concat(F.slice("w", F.lit(2), F.size("w")), last))
    )
    return w.select("item_id", text.word_difference(F.col("w"), h).alias("kind"))


@query(
    r"""SELECT page_id, coalesce(nullif(trim(left(trim(regexp_replace(regexp_replace(html, '[<>:"/\\|?*\x00-\x1F]', ' ', 'g'), '\s+', ' ', 'g')), 180)), ''), page_id::VARCHAR) AS stem FROM pages"""
)
def filename_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.filename_stem(F.col("html"), F.col("page_id").cast("string")).alias("stem"))


@query("SELECT doc_id, sha256('transcript:' || text || chr(10) || 'audio:' || source) AS content_hash, 'cand-' || left(sha1(format('{}:{:.3f}:{:.3f}:{}', source, doc_id / 8.0, doc_id / 8.0 + 4.0, lang)), 16) AS candidate_id FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = F.col("doc_id") / F.lit(8.0)
    return d.select("doc_id", text.content_hash(F.col("text"), F.col("source")).alias("content_hash"), text.candidate_id(F.col("source"), at, at + 4.0, F.col("lang")).alias("candidate_id"))


@query(
    """SELECT doc_id, CASE WHEN v BETWEEN 0 AND 100 THEN v END AS strict, CASE WHEN v BETWEEN 0 AND 1 THEN v * 100 END AS fraction, CASE WHEN v <= 1 THEN v * 100 ELSE v END AS autoscaled, least(greatest(v, 0), 100) AS clamped,
       CASE WHEN regexp_matches(source, '[0-9]+$') THEN 'speaker_' || regexp_extract(source, '[0-9]+$')::BIGINT END AS speaker FROM (SELECT *, ((doc_id * 5) % 137 - 8) / 1.0::DOUBLE AS v FROM documents)"""
)
def score_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ((F.col("doc_id") * 5) % 137 - 8).cast("double")
    return table(spark, sf_dir, "documents").select(
        "doc_id", numeric.score_0_100(v).alias("strict"), numeric.score_from_fraction(v).alias("fraction"), numeric.autoscaled(v).alias("autoscaled"),
        numeric.clamp(v, 0, 100).alias("clamped"), text.speaker_id(F.col("source")).alias("speaker"),
    )


@query(
    """WITH r AS (SELECT d.doc_id, 0.5 + (d.doc_id % 50) / 100.0::DOUBLE AS mean, CASE WHEN d.doc_id % 9 <> 0 THEN 0.4 + (d.doc_id % 40) / 100.0::DOUBLE END AS p10, n_chars / 100.0::DOUBLE AS sec,
                      CASE WHEN l.quality IS NOT NULL THEN (d.doc_id % 101)::DOUBLE END AS tc, (d.doc_id % 5) / 4.0::DOUBLE AS pos FROM documents d LEFT JOIN labels l USING (doc_id)),
    q AS (SELECT *, CASE WHEN p10 IS NOT NULL THEN least(greatest(0.7 * mean + 0.3 * p10, 0), 1) END AS rep, least(greatest(1 - 0.08 * greatest(0, 6 - sec) - 0.04 * greatest(0, sec - 9), 0), 1) AS dp FROM r)
    SELECT doc_id, round(75 * rep + 5 * dp + 10 * pos + 10 * (tc / 100), 6) AS score, round(rep, 6) AS representativeness, round(dp, 6)::DOUBLE AS duration_preference,
           array_to_string([x FOR x IN [CASE WHEN rep IS NULL THEN 'missing_similarity_statistics' END, CASE WHEN tc IS NULL THEN 'missing_transcript_confidence' END] IF x IS NOT NULL], '|') AS reasons FROM q"""
)
def reference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = d.select(
        "doc_id", (0.5 + (k % 50) / F.lit(100.0)).alias("mean_similarity"), F.when(k % 9 != 0, 0.4 + (k % 40) / F.lit(100.0)).alias("p10_similarity"), (F.col("n_chars") / F.lit(100.0)).alias("seconds"),
        F.when(F.col("quality").isNotNull(), (k % 101).cast("double")).alias("transcript_score"), ((k % 5) / F.lit(4.0)).alias("position_preference"),
    )
    q = scoring.reference_quality(rows)
    return q.select("doc_id", F.round("reference_quality_score", 6).alias("score"), F.round("representativeness", 6).alias("representativeness"), F.round("duration_preference", 6).alias("duration_preference"), F.array_join("reason_codes", "|").alias("reasons"))


@query(
    """WITH c AS (SELECT doc_id, 60.0::DOUBLE AS total, (doc_id % 56)::DOUBLE AS s, (doc_id % 56 + 4)::DOUBLE AS e, doc_id % 7 <> 0 AS ctx FROM documents),
    f AS (SELECT *, CASE WHEN s <= 0.05 THEN 1 ELSE 0 END + CASE WHEN e >= 59.95 THEN 1 ELSE 0 END AS edges, abs(s + 2 - 30) / 30 AS away FROM c),
    b AS (SELECT *, 0.7::DOUBLE + CASE WHEN ctx THEN 0.16 ELSE 0.0 END + (0.1 - abs(4 - 4.5) * 0.02) - away * 0.1 - 0.06 * edges - CASE WHEN ctx THEN 0.0 ELSE 0.08 END AS base FROM f)
    SELECT doc_id, round(base - 0.08, 4) AS zero_shot, round(base + 0.06, 4) AS finetune FROM b"""
)
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("doc_id") % 56).cast("double")
    scores = scoring.default_scores(F.lit(60.0), s, s + 4.0, F.when(F.col("doc_id") % 7 != 0, F.lit("words")).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", scores["zero_shot"].alias("zero_shot"), scores["finetune"].alias("finetune"))


@query(
    """WITH w AS (SELECT doc_id, unnest(range(1 + doc_id % 30)) AS k FROM documents), s AS (SELECT doc_id, k, ((doc_id * 13 + k * 29) % 101) / 100.0::DOUBLE AS sim FROM w), t AS (SELECT doc_id, k, CASE WHEN (doc_id + k) % 6 <> 0 THEN sim END AS sim FROM s),
    o AS (SELECT doc_id, list_sort(list(sim) FILTER (sim IS NOT NULL)) AS o, min(sim) AS mn, round(avg(sim), 6) AS mean, count(sim) AS scored, count(*) - count(sim) AS skipped FROM t GROUP BY doc_id)
    SELECT doc_id, mn AS min_similarity, mean AS mean_similarity, o[round_even(0.1 * (len(o) - 1), 0)::INT + 1] AS p10_similarity, scored, skipped FROM o"""
)
def clip_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 30)).alias("window"))
    w = w.withColumn("similarity", ((F.col("doc_id") * 13 + F.col("window") * 29) % 101) / F.lit(100.0))
    out = scoring.clip_similarity(w, "doc_id", scorable=(F.col("doc_id") + F.col("window")) % 6 != 0)
    return out.select("doc_id", "min_similarity", F.round("mean_similarity", 6).alias("mean_similarity"), "p10_similarity", "scored", "skipped")


@query("SELECT doc_id, coalesce(CASE WHEN trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END) <> '' THEN CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END END, source) AS present FROM documents")
def first_present_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", first_present(a, F.col("source")).alias("present"))

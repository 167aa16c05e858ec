"""Queries of the word-aligned planner's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.operators import intervals as iv
from clipweave.operators import review
from clipweave.plans.intervals import WORDS_SQL, words
from clipweave.plans.registry import query, table
from clipweave.plans.slicer import FRAMES_SQL, frames


@query(
    """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), l AS (SELECT *, len(w) AS n FROM t),
    r AS (SELECT doc_id, CASE WHEN n > 8 THEN list_concat(w[1:2], ['<first>'], w[5:5], ['<second>'], w[8:n]) ELSE w END AS out FROM l) SELECT doc_id, len(out)::INT AS n, md5(array_to_string(out, ' ')) AS digest FROM r"""
)
def transcript_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three patches of which the second overlaps the first and is skipped; none for short texts."""
    p = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"), F.lit(t).alias("text")) for a, b, t in ((2, 3, "<first>"), (3, 5, "<skipped>"), (5, 6, "<second>"))])
    w = F.split("text", " ", -1)
    d = table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).withColumn("p", F.when(F.size("w") > 8, p).otherwise(F.slice(p, 1, 0)))
    out = d.select("doc_id", review.patched_tokens(F.col("w"), F.col("p")).alias("out"))
    return out.select("doc_id", F.size("out").alias("n"), F.md5(F.array_join("out", " ")).alias("digest"))


@query(
    # One step per state of a recording: spans as lists; the first short one joins the neighbour that the rule names.
    f"""WITH RECURSIVE {WORDS_SQL}, g AS (SELECT conv_id, turn, pos // 5 AS k, min(start) AS s, max("end") AS e FROM words GROUP BY 1, 2, 3),
    st AS (SELECT conv_id, turn, list({{'s': s, 'e': e, 'n': 1}} ORDER BY s, e) AS c FROM g GROUP BY 1, 2
           UNION ALL SELECT conv_id, turn, list_concat(c[:a - 1], [{{'s': c[a].s, 'e': greatest(c[a].e, c[a + 1].e), 'n': c[a].n + c[a + 1].n}}], c[a + 2:])
           FROM (SELECT *, CASE WHEN i = 1 THEN 1 WHEN i = len(c) THEN i - 1 WHEN abs((c[i - 1].e - c[i - 1].s) + (c[i].e - c[i].s) - 7.0::DOUBLE) <= abs((c[i + 1].e - c[i + 1].s) + (c[i].e - c[i].s) - 7.0::DOUBLE) THEN i - 1 ELSE i END AS a
                 FROM (SELECT *, list_position([x.e - x.s < 2.0 FOR x IN c], TRUE) AS i FROM st) WHERE i IS NOT NULL AND i > 0 AND len(c) > 1)),
    f AS (SELECT conv_id, turn, arg_min(c, len(c)) AS c FROM st GROUP BY 1, 2), u AS (SELECT conv_id, turn, unnest(c) AS x FROM f)
    SELECT conv_id, turn, x.s AS start, x.e AS "end", x.n::INT AS parts FROM u"""
)
def short_clips_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).groupBy("conv_id", "turn", F.floor(F.col("pos") / 5).alias("k")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return review.merge_short(w, ["conv_id", "turn"])


@query(
    f"""WITH {WORDS_SQL}, c AS (SELECT conv_id, turn, pos // 20 AS k, min(start) AS start, max("end") + 0.1 AS "end" FROM words GROUP BY 1, 2, 3), t AS (SELECT conv_id, turn, max("end") AS total FROM words GROUP BY 1, 2),
    o AS (SELECT *, greatest(0, lag("end") OVER (PARTITION BY conv_id, turn ORDER BY start, "end") - start) AS shared FROM c),
    m AS (SELECT *, max("end") OVER (PARTITION BY conv_id, turn ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c), v AS (SELECT conv_id, turn, sum("end" - greatest(start, coalesce(reach, start))) AS covered FROM m WHERE "end" > coalesce(reach, start) GROUP BY 1, 2)
    SELECT conv_id, turn, count(*) AS clips, round(sum("end" - start), 5) AS seconds, round(sum(coalesce(shared, 0)), 5) AS overlap, count(*) FILTER ("end" - start >= 6 AND "end" - start < 8) AS from_6, round(any_value(covered) / any_value(total), 5) AS coverage FROM o JOIN t USING (conv_id, turn) JOIN v USING (conv_id, turn) GROUP BY conv_id, turn"""
)
def slice_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    clips = w.groupBy("conv_id", "turn", F.floor(F.col("pos") / 20).alias("k")).agg(F.min("start").alias("start"), (F.max("end") + 0.1).alias("end"))
    s = review.slice_statistics(clips, w.groupBy("conv_id", "turn").agg(F.max("end").alias("total")), ["conv_id", "turn"])
    return s.select("conv_id", "turn", "clips", F.round("seconds", 5).alias("seconds"), F.round("overlap", 5).alias("overlap"), "from_6", F.round("coverage", 5).alias("coverage"))


_LEVELS = f"""{FRAMES_SQL}, lv AS (SELECT user_id, day, pos, start, "end", center AS moment, 1 - prob AS level FROM frames)"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("user_id", "day", "pos", "start", "end", F.col("center").alias("at"), (1 - F.col("prob")).alias("level"))


def _island(source: str, gap: float, out: str) -> str:
    """SQL that joins a table's spans across gaps, per user and day."""
    return f"""{out}m AS (SELECT *, max("end") OVER (PARTITION BY user_id, day ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
    {out}i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM {out}m),
    {out} AS (SELECT user_id, day, min(start) AS start, max("end") AS "end" FROM {out}i GROUP BY user_id, day, k)"""


@query(
    f"""WITH {_LEVELS}, st AS (SELECT user_id, day, greatest(quantile_cont(level, 0.2) * 2.2, quantile_cont(level, 0.5) * 0.6, max(level) * 0.08, 0.004) AS floor FROM lv GROUP BY user_id, day), ov AS (SELECT lv.* FROM lv JOIN st USING (user_id, day) WHERE level >= floor),
    {_island("ov", 0.18, "f1")}, pd AS (SELECT user_id, day, greatest(start - 0.05, 0) AS start, "end" + 0.05 AS "end" FROM f1), ln AS (SELECT * FROM pd WHERE "end" - start >= 0.35), {_island("ln", 0.12, "f2")}
    SELECT user_id, day, round(start, 6) AS start, round("end", 6) AS "end" FROM f2"""
)
def energy_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = review.energy_regions(_levels(spark, sf_dir), ["user_id", "day"])
    return r.select("user_id", "day", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


_WINDOWS = """w AS (SELECT pos, user_id, day, moment + 1 AS w_start, moment + 1 + (pos % 7) * 5 AS w_end FROM lv)"""


@query(
    f"""WITH {_LEVELS}, {_WINDOWS}, i AS (SELECT w.pos, avg(level) AS m FROM w JOIN lv ON lv.user_id = w.user_id AND lv.day = w.day AND lv.moment >= w_start AND lv.moment <= w_end GROUP BY w.pos),
    n AS (SELECT w.pos, arg_min(level, abs(lv.moment - (w_start + w_end) / 2) * 1e6 + lv.moment / 1e6) AS m FROM w JOIN lv ON lv.user_id = w.user_id AND lv.day = w.day WHERE w.pos NOT IN (SELECT pos FROM i) GROUP BY w.pos)
    SELECT w.pos, round(coalesce(i.m, n.m, 0), 6) AS mean_level FROM w LEFT JOIN i USING (pos) LEFT JOIN n USING (pos)"""
)
def window_mean_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = _levels(spark, sf_dir)
    w = lv.select("pos", "user_id", "day", (F.col("at") + 1).alias("w_start"), (F.col("at") + 1 + (F.col("pos") % 7) * 5).alias("w_end"))
    return review.window_mean(w, lv.select("user_id", "day", "at", "level"), ["user_id", "day"], "pos", 20.0).select("pos", F.round("mean_level", 6).alias("mean_level"))


@query(
    f"""WITH {_LEVELS}, g AS (SELECT pos, user_id, day, moment - 20 AS g_start, moment + 31 AS g_end FROM lv), x AS (SELECT g.pos, g_start, g_end, lv.moment, lv.level, min(level) OVER (PARTITION BY g.pos) AS low FROM g JOIN lv ON lv.user_id = g.user_id AND lv.day = g.day AND lv.moment >= g_start AND lv.moment <= g_end)
    SELECT pos, round(moment, 6) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY abs(moment - (g_start + g_end) / 2), moment) AS k FROM x WHERE level <= greatest(low * 1.15::DOUBLE, low + 1e-6)) WHERE k = 1"""
)
def boundary_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = _levels(spark, sf_dir)
    g = lv.select("pos", "user_id", "day", (F.col("at") - 20).alias("g_start"), (F.col("at") + 31).alias("g_end"))
    return review.snap(g, lv.select("user_id", "day", "at", "level"), ["user_id", "day"], "pos", 20.0).select("pos", F.round("cut", 6).alias("cut"))


@query(
    """SELECT rule, sum(n)::BIGINT AS n FROM (SELECT 'volume_ratio' AS rule, count(*) FILTER ((event_id % 40) / 100.0 > 0.25) AS n FROM events UNION ALL SELECT 'spectral_flatness', count(*) FILTER ((event_id % 30) / 100.0 < 0.1) FROM events
    UNION ALL SELECT 'pitch_confidence', count(*) FILTER ((event_id % 45) / 100.0 > 0.5) FROM events UNION ALL SELECT 'crest_factor', count(*) FILTER (event_id % 9 > 6) FROM events) GROUP BY rule"""
)
def gap_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(review.gap_tripwires((k % 40) / F.lit(100.0), (k % 30) / F.lit(100.0), (k % 45) / F.lit(100.0), (k % 9).cast("double")).alias("failed"))
    return review.rule_counts(e, "failed", ["volume_ratio", "spectral_flatness", "pitch_confidence", "crest_factor"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a b|' || lang ELSE 'a b' END AS tags FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 5 = 0")
def reviewer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    tags = F.when(k % 5 == 0, F.array(F.lit("x"), F.lit(" "))).when(k % 3 == 0, F.array(F.lit(" a  b"), F.lit("A B"), F.col("lang"))).otherwise(F.array(F.lit("a b"), F.lit("A b ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(review.reviewer_tags(tags), "|").alias("tags"))


@query("SELECT n, words FROM (VALUES (0, 'zero'), (7, 'seven'), (13, 'thirteen'), (40, 'forty'), (99, 'ninety nine'), (100, 'one hundred'), (512, 'five hundred twelve'), (1000, 'one thousand'), (70019, 'seventy thousand nineteen'), (1000001, 'one million one'), (-21, 'minus twenty one')) t(n, words)")
def integer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.createDataFrame([(k,) for k in (0, 7, 13, 40, 99, 100, 512, 1000, 70019, 1000001, -21)], "n int")
    return n.select("n", review.integer_words(F.col("n")).alias("words"))


@query(
    f"""WITH {WORDS_SQL} SELECT conv_id, turn, pos, round(t.total * (pos) / n, 9) AS start, round(t.total * (pos + 1) / n, 9) AS "end" FROM words JOIN (SELECT conv_id, turn, max("end") AS total, count(*) AS n FROM words GROUP BY 1, 2) t USING (conv_id, turn)"""
)
def even_word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    w = w.withColumn("total", F.max("end").over(iv.Window.partitionBy("conv_id", "turn")))
    return iv.even_spans(w, ["conv_id", "turn"], "pos", F.col("total")).select("conv_id", "turn", "pos", F.round("start", 9).alias("start"), F.round("end", 9).alias("end"))

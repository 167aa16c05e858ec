"""The word-aligned planner from words and levels to refined clips. A turn is a recording; each of its characters is a frame of a tenth of a second, as loud as its code says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.operators import refine as rf
from clipweave.operators import slicer
from clipweave.operators.written import written
from clipweave.plans.intervals import WORDS_SQL, words
from clipweave.plans.registry import query, table

KEYS = ["conv_id", "turn"]
_FRAMES_SQL = f"""{WORDS_SQL},
    fr AS (SELECT conv_id, turn, round((i - 1) * 0.1, 6)::DOUBLE AS moment, CASE WHEN c = ' ' THEN 0.02::DOUBLE ELSE (10 + (ascii(c) % 29) + i % 7) / 50.0::DOUBLE END AS level
           FROM (SELECT conv_id, turn, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM conversations WHERE text <> '') t)"""
_BOUNDARY_SQL = f"""{_FRAMES_SQL},
    gw AS (SELECT conv_id, turn, pos, start AS w0, "end" AS w1, lead(start) OVER w AS n0, lead("end") OVER w AS n1 FROM words WINDOW w AS (PARTITION BY conv_id, turn ORDER BY start, "end", pos)),
    ga AS (SELECT *, w1 + 0.045::DOUBLE AS g0, n0 - 0.035::DOUBLE AS g1 FROM gw WHERE n0 IS NOT NULL AND n0 - 0.035::DOUBLE > w1 + 0.045::DOUBLE),
    gf AS (SELECT ga.conv_id, ga.turn, ga.pos, g0, g1, moment, level, min(level) OVER (PARTITION BY ga.conv_id, ga.turn, ga.pos) AS low FROM ga JOIN fr ON fr.conv_id = ga.conv_id AND fr.turn = ga.turn AND moment >= g0 AND moment <= g1),
    gc AS (SELECT conv_id, turn, pos, moment AS cut FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY abs(moment - (g0 + g1) / 2), moment) AS k FROM gf WHERE level <= greatest(low * 1.15::DOUBLE, low + 1e-6)) WHERE k = 1),
    gt AS (SELECT ga.*, coalesce(cut, (g0 + g1) / 2) AS time FROM ga LEFT JOIN gc USING (conv_id, turn, pos)),
    sp AS (SELECT conv_id, turn, pos, 'valley' AS name, greatest(time - 0.04::DOUBLE, w1) AS a, least(time + 0.04::DOUBLE, n0) AS b FROM gt UNION ALL SELECT conv_id, turn, pos, 'left', greatest(w0, w1 - 0.08::DOUBLE), w1 FROM gt UNION ALL SELECT conv_id, turn, pos, 'right', n0, least(n1, n0 + 0.08::DOUBLE) FROM gt),
    si AS (SELECT sp.conv_id, sp.turn, pos, name, avg(level) AS m FROM sp JOIN fr ON fr.conv_id = sp.conv_id AND fr.turn = sp.turn AND moment >= a AND moment <= b WHERE b > a GROUP BY 1, 2, 3, 4),
    sn AS (SELECT sp.conv_id, sp.turn, pos, name, arg_min(level, [abs(moment - (a + b) / 2), moment]) AS m FROM sp JOIN fr ON fr.conv_id = sp.conv_id AND fr.turn = sp.turn WHERE b > a GROUP BY 1, 2, 3, 4),
    sm AS (SELECT conv_id, turn, pos, max(m) FILTER (name = 'valley') AS valley, max(m) FILTER (name = 'left') AS l, max(m) FILTER (name = 'right') AS r FROM (SELECT sp.conv_id, sp.turn, sp.pos, sp.name, coalesce(si.m, sn.m, 0) AS m FROM sp LEFT JOIN si USING (conv_id, turn, pos, name) LEFT JOIN sn USING (conv_id, turn, pos, name)) GROUP BY 1, 2, 3),
    bo AS (SELECT gt.*, valley, CASE WHEN greatest((l + r) / 2, valley) <= 0 THEN 1.0::DOUBLE ELSE greatest(0, least(1, 1 - valley / greatest((l + r) / 2, valley))) END AS acoustic FROM gt JOIN sm USING (conv_id, turn, pos))"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, at, level."""
    c = table(spark, sf_dir, "conversations").where("text <> ''").select(*KEYS, "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEYS)  # as words are
    c = c.select(*KEYS, F.posexplode(F.split("text", "")).alias("i", "c"))
    loud = (10 + F.ascii("c") % 29 + (F.col("i") + 1) % 7) / F.lit(50.0)
    return c.select(*KEYS, F.round(F.col("i") * F.lit(0.1), 6).alias("at"), F.when(F.col("c") == " ", 0.02).otherwise(loud).alias("level"))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rf.acoustic_boundaries(words(spark, sf_dir), levels(spark, sf_dir), KEYS)


@query(f"WITH {_BOUNDARY_SQL} SELECT conv_id, turn, pos, round(time, 6) AS time, round(acoustic, 6) AS acoustic, round(valley, 6) AS valley FROM bo")
def acoustic_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries(spark, sf_dir).select(*KEYS, "pos", F.round("time", 6).alias("time"), F.round("acoustic", 6).alias("acoustic"), F.round("valley", 6).alias("valley"))


def fixed_clips(w: DataFrame, every: int = 12) -> DataFrame:
    """Clips of so many words each, on the guarded gaps between them; every third clip is cut without a boundary, every fourth gap has a breath."""
    from pyspark.sql import Window

    clip = F.floor(F.col("pos") / every).cast("int")
    c = w.groupBy(*KEYS, clip.alias("clip")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    after = Window.partitionBy(*KEYS).orderBy("clip")
    bounded = F.col("clip") % 3 != 2
    c = c.withColumn("safe_start", F.when(bounded, F.col("end") + 0.045)).withColumn("safe_end", F.when(bounded, F.lead("start").over(after) - 0.035))
    return c.withColumn("breath", F.col("clip") % 4 == 1).withColumn("total", F.max("end").over(Window.partitionBy(*KEYS)))


@query(
    f"""WITH {_FRAMES_SQL}, c AS (SELECT conv_id, turn, (pos // 12)::INT AS clip, min(start) AS s, max("end") AS e FROM words GROUP BY 1, 2, 3),
    n AS (SELECT *, lead(s) OVER w AS nx, max(e) OVER (PARTITION BY conv_id, turn) AS total FROM c WINDOW w AS (PARTITION BY conv_id, turn ORDER BY clip)),
    g AS (SELECT *, e + 0.045::DOUBLE AS g0, nx - 0.035::DOUBLE AS g1 FROM n),
    f AS (SELECT g.conv_id, g.turn, g.clip, g0, g1, moment, level, min(level) OVER (PARTITION BY g.conv_id, g.turn, g.clip) AS low FROM g JOIN fr ON fr.conv_id = g.conv_id AND fr.turn = g.turn AND moment >= g0 AND moment <= g1 WHERE g1 > g0),
    k AS (SELECT conv_id, turn, clip, moment FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, clip ORDER BY abs(moment - (g0 + g1) / 2), moment) AS k FROM f WHERE level <= greatest(low * 1.15::DOUBLE, low + 1e-6)) WHERE k = 1),
    h AS (SELECT g.*, CASE WHEN nx IS NOT NULL THEN CASE WHEN g1 <= g0 THEN g0 ELSE coalesce(moment, (g0 + g1) / 2) END END AS cut FROM g LEFT JOIN k USING (conv_id, turn, clip)),
    t AS (SELECT *, coalesce(lag(cut) OVER w, s) AS t0, coalesce(cut, e) AS t1, coalesce(lag(clip) OVER w % 4 = 1, FALSE) AS b0, nx IS NOT NULL AND clip % 4 = 1 AS b1 FROM h WINDOW w AS (PARTITION BY conv_id, turn ORDER BY clip)),
    sp AS (SELECT conv_id, turn, clip, 's' AS name, t0 AS a, least(t0 + 0.025::DOUBLE, total) AS b FROM t UNION ALL SELECT conv_id, turn, clip, 'e', greatest(0, t1 - 0.025::DOUBLE), t1 FROM t UNION ALL SELECT conv_id, turn, clip, 'm', t0, t1 FROM t),
    si AS (SELECT sp.conv_id, sp.turn, clip, name, avg(level) AS m FROM sp JOIN fr ON fr.conv_id = sp.conv_id AND fr.turn = sp.turn AND moment >= a AND moment <= b WHERE b > a GROUP BY 1, 2, 3, 4),
    sn AS (SELECT sp.conv_id, sp.turn, clip, name, arg_min(level, [abs(moment - (a + b) / 2), moment]) AS m FROM sp JOIN fr ON fr.conv_id = sp.conv_id AND fr.turn = sp.turn WHERE b > a GROUP BY 1, 2, 3, 4),
    sm AS (SELECT conv_id, turn, clip, max(m) FILTER (name = 's') AS es, max(m) FILTER (name = 'e') AS ee, max(m) FILTER (name = 'm') AS em FROM (SELECT sp.conv_id, sp.turn, sp.clip, sp.name, coalesce(si.m, sn.m, 0) AS m FROM sp LEFT JOIN si USING (conv_id, turn, clip, name) LEFT JOIN sn USING (conv_id, turn, clip, name)) GROUP BY 1, 2, 3)
    SELECT conv_id, turn, clip, round(t0, 6) AS training_start, round(t1, 6) AS training_end, b0 AS breath_at_start, b1 AS breath_at_end, round(es, 6) AS edge_start, round(ee, 6) AS edge_end, round(em, 6) AS mean_level,
           array_to_string([x FOR x IN [CASE WHEN em > 0 AND round(es / em, 9) > 0.65 THEN 'high_start_edge_energy' END, CASE WHEN em > 0 AND round(ee / em, 9) > 0.65 THEN 'high_end_edge_energy' END, CASE WHEN s - t0 > 0.65 THEN 'leading_silence' END, CASE WHEN t1 - e > 0.65 THEN 'trailing_silence' END,
                            CASE WHEN t1 > t0 AND greatest(0, least(1, (e - s) / (t1 - t0))) < 0.72 THEN 'low_speech_ratio' END] IF x IS NOT NULL], ' | ') AS flags FROM t JOIN sm USING (conv_id, turn, clip)"""
)
def clips_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rf.refine(fixed_clips(words(spark, sf_dir)), levels(spark, sf_dir), KEYS)
    bare = F.regexp_replace("flags", "_[0-9.]+s?( |$)", "$1")
    return out.select(*KEYS, "clip", *[F.round(c, 6).alias(c) for c in ("training_start", "training_end")], "breath_at_start", "breath_at_end", *[F.round(c, 6).alias(c) for c in ("edge_start", "edge_end", "mean_level")], bare.alias("flags"))


@query()
def planned_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole planner: words and levels to boundaries scored by their quiet, greedy clips, and their refined bounds."""
    w, f = words(spark, sf_dir), levels(spark, sf_dir)
    b = written(rf.acoustic_boundaries(w, f, KEYS), "scored_gaps")
    # Gaps are as many as words: they don't go through the driver, however small they are as written.
    scored = w.select(*KEYS, "pos", "start", "end").join(b.select(*KEYS, "pos", "acoustic").hint("merge"), [*KEYS, "pos"], "left").withColumn("acoustic", F.coalesce("acoustic", F.lit(0.0)))
    scored = written(scored, "scored_words")
    clips = slicer.greedy_groups(scored, KEYS, "acoustic")
    safe = slicer.boundary_candidates(scored, KEYS, "acoustic").select(*KEYS, F.col("pos").alias("last")).join(b.select(*KEYS, F.col("pos").alias("last"), F.col("g_start").alias("safe_start"), F.col("g_end").alias("safe_end")).hint("merge"), [*KEYS, "last"])
    total = f.groupBy(*KEYS).agg(F.max("at").alias("total"))
    planned = clips.join(safe.hint("merge"), [*KEYS, "last"], "left").join(total, KEYS).withColumn("breath", F.lit(False))
    return rf.refine(planned, f, KEYS).select(*KEYS, "clip", "start", "end", "training_start", "training_end", "mean_level", "flags")

"""Interval queries over the events table: a user is a recording, an event a region of a speaker; 'view' is the target speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions.numeric import rescale_samples, to_samples, to_seconds
from clipweave.operators import intervals as iv
from clipweave.plans.registry import query, table

REGIONS_SQL = """
    regions AS (SELECT event_id, user_id, event_type AS speaker, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS start,
                       (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE + 3600.0::DOUBLE * (1 + event_id % 24) AS "end" FROM events)
"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, speaker, start, end in seconds since the first day."""
    e = table(spark, sf_dir, "events")
    zero = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - zero) / F.lit(1000000.0)
    return e.select("event_id", "user_id", F.col("event_type").alias("speaker"), start.alias("start"), (start + 3600.0 * (1 + F.col("event_id") % 24)).alias("end"))


_UNION = """
    m AS (SELECT *, max("end") OVER (PARTITION BY {k} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM regions),
    f AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
    u AS (SELECT {k}, min(start) AS start, max("end") AS "end", count(*) AS parts FROM f GROUP BY {k}, island)
"""


@query(f"WITH {REGIONS_SQL}, {_UNION.format(k='user_id, speaker')} SELECT user_id, speaker, round(start, 6) AS start, round(\"end\", 6) AS \"end\", parts FROM u")
def region_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = iv.union(regions(spark, sf_dir), ["user_id", "speaker"])
    return u.select("user_id", "speaker", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "parts")


@query(f"WITH {REGIONS_SQL}, {_UNION.format(k='user_id')} SELECT user_id, round(sum(\"end\" - start), 4) AS length FROM u GROUP BY user_id")
def union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.union_length(regions(spark, sf_dir), ["user_id"]).select("user_id", F.round("length", 4).alias("length"))


@query(
    f"""WITH {REGIONS_SQL}, t AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM regions WHERE speaker = 'view'),
    g AS (SELECT *, CASE WHEN start > reach AND EXISTS (SELECT 1 FROM regions o WHERE o.user_id = t.user_id AND o.speaker <> 'view' AND o.start < t.start AND t.reach < o."end") THEN 1 ELSE 0 END AS b FROM t),
    i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM g)
    SELECT user_id, round(min(start), 6) AS start, round(max("end"), 6) AS "end", count(*) AS parts, CAST(sum(b) AS BIGINT) AS blocked FROM i GROUP BY user_id, island"""
)
def region_merge_intrusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    out = iv.merge_unless_intruded(r.where("speaker = 'view'").select("user_id", "start", "end"), r.where("speaker <> 'view'"), ["user_id"], 86400.0)
    return out.select("user_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "parts", "blocked")


@query(f"WITH {REGIONS_SQL} SELECT user_id, count(*) AS kept, CAST(sum(CASE WHEN \"end\" > 1500000 THEN 1 ELSE 0 END) AS BIGINT) AS clipped, round(sum(least(\"end\", 1500000) - start), 4) AS seconds FROM regions WHERE start < least(\"end\", 1500000) GROUP BY user_id")
def region_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = iv.clamp_to(regions(spark, sf_dir), F.lit(1500000.0))
    return c.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("clipped").cast("bigint")).alias("clipped"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("seconds"))


_FILES = "files AS (SELECT p_partkey % 50 AS project, p_partkey AS file, p_size * 10.0::DOUBLE AS seconds FROM part)"
_LAYOUT = "layout AS (SELECT *, coalesce(sum(seconds + 1.5) OVER (PARTITION BY project ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS \"offset\" FROM files)"


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("project"), F.col("p_partkey").alias("file"), (F.col("p_size") * F.lit(10.0)).alias("seconds"))
    return iv.concat_layout(files, ["project"], "file", "seconds", 1.5)


@query(f"WITH {_FILES}, {_LAYOUT} SELECT project, file, round(\"offset\", 6) AS \"offset\", round(\"offset\" + seconds, 6) AS offset_end FROM layout")
def concat_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layout(spark, sf_dir).select("project", "file", F.round("offset", 6).alias("offset"), F.round("offset_end", 6).alias("offset_end"))


@query(
    f"""WITH {_FILES}, {_LAYOUT}, r AS (SELECT s_suppkey AS region, s_suppkey % 50 AS project, (s_suppkey * 37 % 1000)::DOUBLE AS s, (s_suppkey * 37 % 1000 + 400)::DOUBLE AS e FROM supplier)
    SELECT region, file, round(greatest(s, "offset") - "offset", 6) AS local_start, round(least(e, "offset" + seconds) - "offset", 6) AS local_end
    FROM r JOIN layout USING (project) WHERE s < "offset" + seconds AND "offset" < e AND least(e, "offset" + seconds) > greatest(s, "offset")"""
)
def concat_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select(k.alias("region"), (k % 50).alias("project"), (k * 37 % 1000).cast("double").alias("start"), (k * 37 % 1000 + 400).cast("double").alias("end"))
    out = iv.remap(r, _layout(spark, sf_dir), ["project"], 86400.0)
    return out.select("region", "file", F.round("local_start", 6).alias("local_start"), F.round("local_end", 6).alias("local_end"))


_CAND = """cand AS (SELECT event_id, user_id, start + 600 AS start, start + 1800 AS "end" FROM regions)"""


@query(
    f"""WITH {REGIONS_SQL}, {_CAND}, reg AS (SELECT user_id, start AS r_start, "end" AS r_end FROM regions WHERE speaker = 'view'),
    b AS (SELECT event_id, max(least(c.start - r_start, r_end - c."end")) AS margin FROM cand c JOIN reg USING (user_id) WHERE r_start <= c.start AND c."end" <= r_end GROUP BY event_id)
    SELECT c.event_id, round(CASE WHEN margin IS NOT NULL THEN least(1.0, margin / 7200.0) WHEN c.user_id IN (SELECT user_id FROM reg) THEN 0.0 ELSE 0.5 END, 6)::DOUBLE AS position_preference
    FROM cand c LEFT JOIN b USING (event_id)"""
)
def position_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    cand = r.select("event_id", "user_id", (F.col("start") + 600).alias("start"), (F.col("start") + 1800).alias("end"))
    reg = r.where("speaker = 'view'").select("user_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return iv.position_preference(cand, reg, ["user_id"], "event_id", 7200.0, 86400.0).select("event_id", F.round("position_preference", 6).alias("position_preference"))


@query("SELECT doc_id, k AS chunk, k * 3.0::DOUBLE AS chunk_start, (k + 1) * 3.0::DOUBLE AS chunk_end FROM (SELECT doc_id, unnest(range(least(floor(n_chars / 100.0 / 3.0), 20)::BIGINT))::INT AS k FROM documents)")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 100.0).alias("seconds"))
    return iv.fixed_chunks(rows, "seconds", 3.0, 20).drop("seconds")


@query(
    """WITH d AS (SELECT doc_id, n_chars / 100.0::DOUBLE AS seconds FROM documents),
    w AS (SELECT *, unnest(range(CASE WHEN seconds >= 3.0 THEN floor((seconds - 3.0) / 0.5 + 1e-9)::BIGINT + 1 ELSE 1 END))::INT AS k FROM d)
    SELECT doc_id, k AS "window", k * 0.5::DOUBLE AS window_start, round(least(k * 0.5 + 3.0, seconds), 6) AS window_end FROM w"""
)
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / F.lit(100.0)).alias("seconds"))
    return iv.sliding_windows(rows, "seconds", 3.0, 0.5).select("doc_id", "window", "window_start", F.round("window_end", 6).alias("window_end"))


@query(
    """WITH d AS (SELECT doc_id, 0.5::DOUBLE AS start, 0.5 + n_chars / 100.0::DOUBLE AS "end" FROM documents),
    s AS (SELECT doc_id, start, "end", unnest(CASE WHEN "end" - start >= 6 THEN list_distinct([round(start + k * 3.0, 6) FOR k IN range(floor(("end" - start - 6) / 3.0 + 1e-9)::BIGINT + 1)] || [round("end" - 6, 6)]) ELSE [start] END) AS ws FROM d)
    SELECT doc_id, ws AS window_start, round(least(round(ws + 6, 6), "end"), 6) AS window_end FROM s"""
)
def candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0.5).alias("start"), (0.5 + F.col("n_chars") / F.lit(100.0)).alias("end"))
    return iv.candidate_windows(d, 6.0, 0.5).select("doc_id", "window_start", F.round("window_end", 6).alias("window_end"))


#: Words of the conversations table: each takes 0.2 s and 0.01 s per letter, with a longer pause after each seventh.
WORDS_SQL = """
    w0 AS (SELECT conv_id, turn, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word, generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) - 1 AS pos FROM conversations),
    w1 AS (SELECT *, 0.2 + 0.01 * length(word) AS dur, CASE WHEN (pos + turn) % 7 = 6 THEN 0.6 ELSE 0.02 END AS pause FROM w0),
    words AS (SELECT conv_id, turn, pos, word, round(coalesce(sum(dur + pause) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE, 6) AS start, round((dur + coalesce(sum(dur + pause) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))::DOUBLE, 6) AS "end" FROM w1)
"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, pos, word, start, end."""
    # Texts are dealt by turn before they become words, so that windows over a turn's words need no shuffle; by a number, as texts are small beside their words.
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")
    c = c.select("conv_id", "turn", F.posexplode(F.split(F.regexp_replace("text", "\n", " "), " ", -1)).alias("pos", "word"))
    dur = F.lit(0.2) + F.lit(0.01) * F.length("word")
    c = c.withColumn("dur", dur).withColumn("step", dur + F.when((F.col("pos") + F.col("turn")) % 7 == 6, 0.6).otherwise(0.02))
    before = F.coalesce(F.sum("step").over(iv.Window.partitionBy("conv_id", "turn").orderBy("pos").rowsBetween(iv.Window.unboundedPreceding, -1)), F.lit(0.0))
    return c.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "word", F.round(before, 6).alias("start"), F.round(before + F.col("dur"), 6).alias("end"))


@query(
    f"""WITH {WORDS_SQL}, g AS (SELECT *, "end" + 0.045 AS gap_start, lead(start) OVER (PARTITION BY conv_id, turn ORDER BY start, "end") - 0.035 AS gap_end FROM words)
    SELECT conv_id, turn, pos, round(gap_start, 6) AS gap_start, round(gap_end, 6) AS gap_end, round(gap_end - gap_start, 6) AS gap FROM g WHERE gap_end - gap_start BETWEEN 0.04 AND 1.2"""
)
def word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = iv.gaps(words(spark, sf_dir), ["conv_id", "turn"], 0.045, 0.035, 0.04, 1.2)
    return g.select("conv_id", "turn", "pos", *[F.round(c, 6).alias(c) for c in ("gap_start", "gap_end", "gap")])


@query(
    f"""WITH {WORDS_SQL}, m AS (SELECT conv_id, turn, pos, CASE WHEN pos % 5 <> 3 THEN start END AS s, CASE WHEN pos % 5 <> 3 THEN "end" END AS e, max("end") OVER (PARTITION BY conv_id, turn) AS total FROM words),
    n AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY conv_id, turn ORDER BY pos), 0.0) AS lo, coalesce(lead(s) OVER (PARTITION BY conv_id, turn ORDER BY pos), total) AS hi FROM m)
    SELECT conv_id, turn, pos, s IS NULL AS filled, round(coalesce(s, lo), 6) AS start, round(coalesce(e, lo + (greatest(hi, lo) - lo)), 6) AS "end" FROM n"""
)
def words_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    total = F.max("end").over(iv.Window.partitionBy("conv_id", "turn"))
    w = w.withColumn("total", total)
    for c in ("start", "end"):
        w = w.withColumn(c, F.when(F.col("pos") % 5 != 3, F.col(c)))
    out = iv.fill_missing_spans(w, ["conv_id", "turn"], "pos", F.col("total"))
    return out.select("conv_id", "turn", "pos", "filled", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    """SELECT doc_id, round_even(n_chars / 100.0 * 16000, 0)::BIGINT AS samples, round(round_even(n_chars / 100.0 * 16000, 0) / 16000.0, 6)::DOUBLE AS seconds,
       round_even(n_chars * (44100.0 / 16000.0), 0)::BIGINT AS native FROM documents"""
)
def coordinate_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    s = to_samples(F.col("n_chars") / F.lit(100.0), 16000)
    return d.select("doc_id", s.alias("samples"), to_seconds(s, F.lit(16000.0)).alias("seconds"), rescale_samples(F.col("n_chars"), F.lit(16000.0), F.lit(44100.0)).alias("native"))


@query(
    f"""WITH {REGIONS_SQL}, cuts AS (SELECT event_id, user_id, start + 1234 AS t FROM regions), sp AS (SELECT user_id, event_id AS span_id, start, "end" FROM regions WHERE speaker = 'click')
    SELECT c.event_id, s.span_id, round(least(c.t - s.start, s."end" - c.t), 6) AS depth FROM cuts c LEFT JOIN sp s ON c.user_id = s.user_id AND s.start < c.t AND c.t < s."end" """
)
def cut_stab_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    cuts = r.select("event_id", "user_id", (F.col("start") + 1234).alias("t"))
    spans = r.where("speaker = 'click'").select("user_id", F.col("event_id").alias("span_id"), "start", "end")
    return iv.stab(cuts, spans, ["user_id"], "t", "start", "end", 86400.0).select("event_id", "span_id", F.round("depth", 6).alias("depth"))


@query(
    f"""WITH {REGIONS_SQL} SELECT a.event_id, b.event_id AS other_id, round(least(a."end", b."end") - greatest(a.start, b.start), 6) AS shared
    FROM regions a JOIN regions b ON a.user_id = b.user_id AND a.start < b."end" AND b.start < a."end" WHERE a.speaker = 'view' AND b.speaker = 'purchase'"""
)
def region_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    a = r.where("speaker = 'view'").select("user_id", "event_id", "start", "end")
    b = r.where("speaker = 'purchase'").select("user_id", F.col("event_id").alias("other_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    out = iv.range_join(a, b, ["user_id"], "start", "end", "o_start", "o_end", bucket=86400.0)
    return out.select("event_id", "other_id", F.round(iv.overlap_length(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end")), 6).alias("shared"))


@query("""SELECT format('buffer_{:06d}', row_number() OVER (ORDER BY source, doc_id)) AS buffer_id, doc_id FROM documents WHERE n_chars > 500""")
def buffer_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("n_chars > 500").select("source", "doc_id")
    return iv.numbered(d, ["source", "doc_id"], "buffer_%06d", "buffer_id").select("buffer_id", "doc_id")

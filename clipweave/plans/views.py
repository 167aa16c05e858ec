"""Queries of the review tool's read models: a document is a clip, a customer a recording and their orders its jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions.text import content_hash
from clipweave.operators import views
from clipweave.plans.registry import query, table

_ENTRIES = """e AS (SELECT doc_id AS clip_id, doc_id % 3 AS clip_version, CASE doc_id % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'odd' END AS review_status, CASE WHEN doc_id % 6 = 0 THEN 'said again' END AS transcript_override,
    CASE WHEN doc_id % 10 = 0 THEN sha256('transcript:' || CASE WHEN doc_id % 6 = 0 THEN 'said again' WHEN doc_id % 4 = 0 THEN '' ELSE lang END || chr(10) || 'audio:' || CASE WHEN doc_id % 3 > 0 THEN 'rev' || doc_id ELSE 'src' || doc_id END) ELSE 'x' END AS accepted, doc_id % 3 AS n_ops, 'rev' || doc_id AS rev, CASE WHEN doc_id % 2 = 0 THEN 'ready' ELSE 'queued' END AS render
    FROM documents WHERE doc_id % 7 <> 3)"""


@query(
    f"""WITH {_ENTRIES}, m AS (SELECT doc_id AS clip_id, CASE WHEN doc_id % 9 > 0 THEN source || '/' || doc_id ELSE '' END AS path, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS text, 'src' || doc_id AS sha, doc_id % 3 = 0 AS heard FROM documents),
    v AS (SELECT m.*, e.* EXCLUDE (clip_id), coalesce(transcript_override, text) AS own, CASE WHEN heard THEN 'heard' ELSE '' END AS whisper, CASE WHEN review_status IN ('accepted', 'rejected') THEN review_status ELSE 'unresolved' END AS st,
          sha256('transcript:' || coalesce(transcript_override, text) || chr(10) || 'audio:' || CASE WHEN n_ops > 0 THEN rev ELSE sha END) AS h, CASE WHEN n_ops > 0 AND render = 'ready' THEN rev ELSE sha END AS r FROM m LEFT JOIN e USING (clip_id))
    SELECT clip_id, nullif(path, '') AS path, coalesce(clip_version, 0) AS clip_version, CASE WHEN st = 'accepted' AND h <> accepted THEN 'unresolved' ELSE st END AS review_status, CASE WHEN own <> '' THEN own ELSE whisper END AS transcript, CASE WHEN text <> '' THEN text ELSE whisper END AS original_transcript,
           h AS content_hash, st = 'accepted' AND h <> accepted AS acceptance_stale, r AS audio_revision, CASE WHEN heard THEN (clip_id % 101)::DOUBLE END AS transcript_match, CASE WHEN clip_id % 4 = 0 THEN (clip_id % 97)::DOUBLE END AS speaker_check, CASE WHEN r = sha THEN (clip_id % 77)::DOUBLE END AS reference_quality FROM v"""
)
def clip_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("doc_id"), table(spark, sf_dir, "documents")
    said, sha, rev = F.when(k % 4 == 0, "").otherwise(F.col("lang")), F.concat(F.lit("src"), k), F.concat(F.lit("rev"), k)
    manifest = d.select(k.alias("clip_id"), F.when(k % 9 > 0, F.concat("source", F.lit("/"), k)).otherwise("").alias("audio_path"), said.alias("transcript"), sha.alias("audio_sha"))
    again = F.when(k % 6 == 0, "said again")
    right = content_hash(F.coalesce(again, said), F.when(k % 3 > 0, rev).otherwise(sha))
    entries = d.where(k % 7 != 3).select(
        k.alias("clip_id"), (k % 3).alias("clip_version"), F.when(k % 5 == 0, "accepted").when(k % 5 == 1, "rejected").when(k % 5 == 2, "odd").alias("review_status"), again.alias("transcript_override"),
        F.when(k % 10 == 0, right).otherwise("x").alias("accepted_content_hash"), (k % 3).alias("n_ops"), rev.alias("audio_revision"), F.when(k % 2 == 0, "ready").otherwise("queued").alias("render_status"),
    )
    of = lambda cond, m, name: d.where(cond).select(k.alias("clip_id"), (k % m).cast("double").alias(name))
    return views.clip_views(manifest, entries, of(k % 3 == 0, 101, "transcript_match").withColumn("whisper_text", F.lit("heard")), of(k % 4 == 0, 97, "speaker_check"), of(F.lit(True), 77, "reference_quality"))


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN 'r' || doc_id % 2 END AS a, 'r' || doc_id % 3 AS b FROM documents)
    SELECT doc_id, coalesce(a = b, false) AS applies, CASE WHEN doc_id % 3 > 0 AND doc_id % 2 = 0 AND a IS NOT NULL THEN a ELSE 'src' END AS revision FROM r"""
)
def render_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    a, b = F.when(k % 4 > 0, F.concat(F.lit("r"), k % 2)), F.concat(F.lit("r"), k % 3)
    applies = views.render_applies(a, b, F.lit("s"), F.lit("s"), F.lit("m"), F.lit("m"))
    return table(spark, sf_dir, "documents").select("doc_id", applies.alias("applies"), views.effective_revision(F.lit("src"), k % 3, a, F.when(k % 2 == 0, "ready").otherwise("queued")).alias("revision"))


@query("SELECT n_nationkey AS run, 'm' || n_regionkey AS candidate_manifest_sha256, (n_nationkey * 4)::DOUBLE AS transcript_match_min, (100 - n_nationkey)::DOUBLE AS speaker_check_min FROM nation WHERE n_regionkey = n_nationkey % 4")
def qc_subset_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("run", F.col("n_nationkey"))
    subsets = n.select("run", F.concat(F.lit("m"), "n_regionkey").alias("candidate_manifest_sha256"), (F.col("run") * 4).cast("string").alias("transcript_match_min"), (100 - F.col("run")).alias("speaker_check_min"))
    return views.current_subsets(subsets, n.select("run", F.concat(F.lit("m"), F.col("run") % 4).alias("manifest_sha256")), "run")


@query(
    """WITH j AS (SELECT o_custkey AS id, o_orderkey AS job, CASE o_orderkey % 3 WHEN 0 THEN 'source_transcription' WHEN 1 THEN 'source_alignment' ELSE 'export' END AS kind, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status, o_orderdate AS created FROM orders),
    a AS (SELECT id, arg_max(job, (created, job)) AS job, arg_max(kind, (created, job)) AS kind FROM j WHERE kind <> 'export' AND status = 'running' GROUP BY id), l AS (SELECT id, arg_max(status, (created, job)) AS status FROM j WHERE kind <> 'export' GROUP BY id),
    s AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT c_custkey AS recording_id, a.job AS active_job, CASE WHEN a.kind = 'source_transcription' THEN 'transcribing' WHEN a.kind = 'source_alignment' THEN 'aligning' WHEN l.status = 'failed' THEN 'failed' WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'alignment_stale' WHEN c_custkey % 3 = 0 THEN 'aligned'
           WHEN c_custkey % 3 = 1 THEN 'transcribed' ELSE 'idle' END AS processing_state, coalesce(s.n, 0) AS slice_count FROM customer LEFT JOIN a ON a.id = c_custkey LEFT JOIN l ON l.id = c_custkey LEFT JOIN s ON s.id = c_custkey"""
)
def recording_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, o = F.col("c_custkey"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "source_transcription").when(F.col("o_orderkey") % 3 == 1, "source_alignment").otherwise("export")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "failed").otherwise("completed")
    jobs = o.select(F.col("o_custkey").alias("recording_id"), F.col("o_orderkey").alias("job_id"), kind.alias("kind"), status.alias("status"), F.col("o_orderdate").alias("created"))
    artifacts = c.where(k % 3 < 2).select(k.alias("recording_id"), F.when((k % 3 == 0) & (k % 2 == 0), "stale").when(k % 3 == 0, "ok").alias("alignment_status"), F.lit("ok").alias("transcript_status"))
    return views.recording_queue(c.select(k.alias("recording_id")), jobs, artifacts, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("recording_id")))


@query(
    """WITH s AS (SELECT o_orderkey AS id, o_custkey AS variant, o_orderkey * 10 + o_orderkey % 3 AS head FROM orders),
    c AS (SELECT o_orderkey AS id, o_orderkey * 10 + n AS commit_id, CASE WHEN n > 0 THEN o_orderkey * 10 + n - 1 END AS parent FROM orders, range(3) r(n)), t AS (SELECT n_nationkey AS tag, n_name AS name FROM nation),
    g AS (SELECT l_orderkey AS id, list(name ORDER BY lower(name), tag) AS tags FROM (SELECT DISTINCT l_orderkey, l_suppkey % 30 AS tag FROM lineitem) JOIN t USING (tag) GROUP BY 1)
    SELECT s.id AS slice_id, CASE WHEN s.id % 2 = 0 THEN 'text ' || s.id END AS transcript, coalesce(array_to_string(g.tags, '|'), '') AS tags, CASE WHEN s.id % 5 > 0 AND s.id % 4 > 0 THEN round(s.id * 10 / (s.id % 4 * 8000.0)::DOUBLE, 6) ELSE 0.0 END AS duration_seconds, s.id % 3 > 0 AS can_undo, s.id % 3 < 2 AS can_redo FROM s LEFT JOIN g USING (id)"""
)
def slice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o, li = F.col("o_orderkey"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    slices = o.select(k.alias("slice_id"), F.col("o_custkey").alias("active_variant_id"), (k * 10 + k % 3).alias("active_commit_id"))
    transcripts = o.where(k % 2 == 0).select(k.alias("slice_id"), F.concat(F.lit("text "), k).alias("transcript"))
    tags = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("tag_id"), F.col("n_name").alias("name"))
    links = li.select(F.col("l_orderkey").alias("slice_id"), (F.col("l_suppkey") % 30).alias("tag_id")).distinct()
    variants = o.where(k % 5 > 0).select(k.alias("slice_id"), F.col("o_custkey").alias("variant_id"), (k % 4 * 8000).alias("sample_rate"), (k * 10).alias("num_samples"))
    commits = o.select(k.alias("slice_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")).select("slice_id", (F.col("slice_id") * 10 + F.col("n")).alias("commit_id"), F.when(F.col("n") > 0, F.col("slice_id") * 10 + F.col("n") - 1).alias("parent_id"))
    out = views.slice_summaries(slices, transcripts, tags, links, variants, commits)
    return out.withColumn("tags", F.array_join("tags", "|"))


_TAGS = """w AS (SELECT user_id AS slice_id, event_id AS seq, trim(CASE WHEN event_id % 7 = 0 THEN '  ' WHEN event_id % 2 = 0 THEN upper(event_type) || ' ' ELSE event_type || event_id % 4 END) AS name, CASE WHEN event_id % 3 = 0 THEN '' ELSE '#' || event_id END AS color FROM events),
    s AS (SELECT lower(name) AS low, arg_min(name, seq) AS name, arg_max(coalesce(nullif(color, ''), '#FFFFFF'), seq) AS color FROM w WHERE name <> '' GROUP BY 1), t AS (SELECT DISTINCT lower(event_type) AS low, 'old-' || event_type AS tag_id, event_type AS name, '#000' AS color FROM events),
    b AS (SELECT low, coalesce(t.tag_id, 'tag-' || left(sha256(low), 16)) AS tag_id, coalesce(t.name, s.name) AS name, coalesce(s.color, t.color) AS color FROM t FULL JOIN s USING (low))"""


@query(f"WITH {_TAGS} SELECT tag_id, name, color, (SELECT count(DISTINCT slice_id) FROM w WHERE lower(w.name) = b.low) AS links FROM b")
def tag_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("event_id"), table(spark, sf_dir, "events")
    name = F.when(k % 7 == 0, "  ").when(k % 2 == 0, F.concat(F.upper("event_type"), F.lit(" "))).otherwise(F.concat("event_type", k % 4))
    wanted = e.select(F.col("user_id").alias("slice_id"), k.alias("at"), name.alias("name"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("#"), k)).alias("color"))
    tags, links = views.replace_tags(e.select(F.concat(F.lit("old-"), "event_type").alias("tag_id"), F.col("event_type").alias("name"), F.lit("#000").alias("color")).distinct(), wanted)
    return tags.join(links.groupBy("tag_id").agg(F.count(F.lit(1)).alias("links")), "tag_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))


@query("SELECT o_orderkey AS recording_id, o_custkey AS parent_id FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 4 = 1")
def prepared_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    recipe = F.when(k % 4 == 0, "not json").otherwise(F.format_string('{"output_group_id": "g%d", "x": 1}', k % 4))
    r = table(spark, sf_dir, "orders").select(k.alias("recording_id"), F.when(k % 3 > 0, F.col("o_custkey")).alias("parent_id"), recipe.alias("recipe"))
    return views.prepared_recordings(r, "g1").select("recording_id", "parent_id")


@query(
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 8 > 0 THEN (event_id % 100) / 100.0::DOUBLE END AS score, CASE WHEN event_id % 6 = 0 THEN 'baseline' ELSE 'v' END AS variant, ['clean', 'suspicious', 'good', 'failed', 'fine'][event_id % 5 + 1] AS bucket, ['blend', 'replace', 'keep'][event_id % 3 + 1] AS category,
        CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE (event_id % 50) / 1000.0::DOUBLE END AS delta FROM events)
    SELECT event_id, score IS NOT NULL AND (variant = 'baseline' OR bucket IN ('suspicious', 'failed') OR (score >= 0.8 AND category <> 'keep') OR (category = 'blend' AND coalesce(nullif(delta, 0.0), 1.0) < 0.03)) AS export FROM t"""
)
def export_variant_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    score, delta = F.when(k % 8 > 0, (k % 100) / F.lit(100.0)), F.when(k % 4 == 1, 0.0).when(k % 4 > 1, (k % 50) / F.lit(1000.0))
    out = views.should_export_variant(score, F.when(k % 6 == 0, "baseline").otherwise("v"), pick(["clean", "suspicious", "good", "failed", "fine"]), pick(["blend", "replace", "keep"]), delta, 0.8)
    return table(spark, sf_dir, "events").select("event_id", out.alias("export"))


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'contains_oov=contains OOV|my_own_code=my own code' WHEN 1 THEN 'word_near_trusted_edge=word near trusted edge' ELSE '' END AS findings FROM documents"""
)
def pipeline_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    codes = F.when(k % 3 == 0, F.array(F.lit(" contains_oov "), F.lit("my_own_code"), F.lit(" "))).when(k % 3 == 1, F.array(F.lit("word_near_trusted_edge"), F.lit(None).cast("string")))
    pairs = F.transform(views.findings(codes), lambda f: F.concat(f["code"], F.lit("="), f["label"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(pairs, "|").alias("findings"))

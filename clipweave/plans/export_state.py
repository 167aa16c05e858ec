"""Export, state, job and lineage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipweave.operators import export, state
from clipweave.plans.qc import SCORED_SQL, decided_clips
from clipweave.plans.registry import query, table

_EXPORT = f"""{SCORED_SQL},
    man AS (SELECT f.clip_id, f.status, regexp_extract(f.source, '[0-9]+')::BIGINT AS source_id, f.clip_id * 100 AS s, f.clip_id * 100 + (f.duration * 16000)::BIGINT % 90000 AS e, CASE f.clip_id % 3 WHEN 0 THEN 16000 WHEN 1 THEN 44100 ELSE CASE WHEN f.clip_id % 29 = 2 THEN 8000 ELSE 16000 END END AS rate FROM final f WHERE f.clip_id % 31 <> 0
            UNION ALL SELECT doc_id, NULL, regexp_extract(source, '[0-9]+')::BIGINT, doc_id * 100, doc_id * 100 + (n_chars / 100.0 * 16000)::BIGINT % 90000, CASE doc_id % 3 WHEN 0 THEN 16000 WHEN 1 THEN 44100 ELSE CASE WHEN doc_id % 29 = 2 THEN 8000 ELSE 16000 END END FROM documents WHERE doc_id % 31 = 0),
    src AS (SELECT range AS source_id, 44100 AS sr, 2000000::BIGINT AS num FROM range(18)), var AS (SELECT range AS source_id, 16000 AS ar FROM range(17)),
    j AS (SELECT m.*, sr, num, ar, greatest(0, least(num, CASE WHEN rate = sr THEN s ELSE round_even(s * (44100.0::DOUBLE / 16000.0), 0)::BIGINT END)) AS ns, greatest(0, least(num, CASE WHEN rate = sr THEN e ELSE round_even(e * (44100.0::DOUBLE / 16000.0), 0)::BIGINT END)) AS ne FROM man m LEFT JOIN src USING (source_id) LEFT JOIN var USING (source_id)),
    x AS (SELECT *, CASE WHEN status IS NULL THEN 'missing_dataset_qc_clip' WHEN status <> 'accepted' THEN 'dataset_qc_status_not_accepted' WHEN sr IS NULL OR ar IS NULL THEN 'missing_source_or_analysis_variant'
                         WHEN rate NOT IN (sr, ar) THEN 'invalid_candidate_sample_coordinates' WHEN ne <= ns THEN 'empty_native_span' END AS reason FROM j)
"""


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    rate = F.when(k % 3 == 0, 16000).when(k % 3 == 1, 44100).otherwise(F.when(k % 29 == 2, 8000).otherwise(16000))
    length = F.round(F.col("n_chars") / F.lit(100.0) * 16000).cast("bigint") % 90000
    manifest = d.select(k.alias("clip_id"), F.regexp_extract("source", "[0-9]+", 0).cast("bigint").alias("source_id"), (k * 100).alias("start_sample"), (k * 100 + length).alias("end_sample"), rate.alias("coordinate_rate"))
    decisions = decided_clips(spark, sf_dir).where("clip_id % 31 <> 0").select("clip_id", "status")
    sources = spark.range(18).select(F.col("id").alias("source_id"), F.lit(44100).alias("sample_rate"), F.lit(2_000_000).cast("bigint").alias("num_samples"))
    variants = spark.range(17).select(F.col("id").alias("source_id"), F.lit(16000).alias("analysis_rate"))
    return export.export_clips(manifest, decisions, sources, variants)


@query(f"WITH {_EXPORT} SELECT clip_id, ns AS native_start, ne AS native_end FROM x WHERE reason IS NULL")
def export_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.accepted(_exported(spark, sf_dir)).select("clip_id", "native_start", "native_end")


@query(f"WITH {_EXPORT} SELECT clip_id, reason FROM x WHERE reason IS NOT NULL")
def export_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.rejected(_exported(spark, sf_dir)).select("clip_id", "reason")


@query(
    f"""WITH {SCORED_SQL}, b AS (SELECT clip_id, status, duration, list_sort([x FOR x IN [CASE WHEN clip_id % 6 = 0 AND clip_id % 12 <> 0 THEN 'edited_audio_not_rendered' END, CASE WHEN clip_id % 14 = 0 THEN 'audio_hash_mismatch' END,
        CASE WHEN clip_id % 33 = 0 THEN 'empty_transcript' END, CASE WHEN missing THEN 'missing_audio' END, CASE WHEN status <> 'accepted' THEN 'not_accepted' END] IF x IS NOT NULL]) AS codes FROM final),
    a AS (SELECT * FROM b WHERE status = 'accepted')
    SELECT count(*) AS accepted, count(*) FILTER (len(codes) = 0) AS exportable, round(sum(duration) FILTER (len(codes) = 0), 6) AS seconds, min(len(codes) = 0) AS allowed, (SELECT string_agg(DISTINCT c, '|' ORDER BY c) FROM (SELECT unnest(codes) AS c FROM a)) AS codes FROM a"""
)
def canonical_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("clip_id")
    rows = decided_clips(spark, sf_dir).select(
        "clip_id", "status", "duration", F.when(k % 33 == 0, " ").otherwise("words").alias("transcript"), (~F.col("missing")).alias("audio_ready"), F.lit("h").alias("expected_hash"), F.when(k % 14 == 0, "g").otherwise("h").alias("audio_hash"),
        (k % 6 == 0).alias("edited"), F.when(k % 12 == 0, "ready").otherwise("pending").alias("render_status"),
    )
    return export.snapshot_preview(export.blockers(rows))


@query(
    """WITH o AS (SELECT doc_id AS id, lang, n_chars AS v FROM documents WHERE doc_id % 4 <> 0), n AS (SELECT doc_id AS id, lang, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS v FROM documents WHERE doc_id % 7 <> 0)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'delete' WHEN o.id IS NULL THEN 'insert' WHEN o.v = n.v THEN 'keep' ELSE 'update' END AS action, n.v FROM o FULL JOIN n ON o.id = n.id"""
)
def artifact_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("v"))
    seen = d.where("id % 7 <> 0").withColumn("v", F.when(F.col("id") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return export.merge_index(d.where("id % 4 <> 0"), seen, ["id"], ["lang", "v"]).drop("lang")


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 AND sha256('transcript:' || lang || chr(10) || 'audio:' || source) <> sha256('transcript:' || CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE lang END || chr(10) || 'audio:' || source) THEN 'unresolved' WHEN doc_id % 5 = 0 THEN 'accepted' ELSE 'rejected' END AS status,
       (list_position({state.STAGES}, stage) > 0 AND list_position({state.STAGES}, stage) >= 5) AS done FROM (SELECT *, ({state.STAGES})[doc_id % 8 + 1] AS stage FROM documents)"""
)
def staleness_and_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipweave.functions.text import content_hash

    k = F.col("doc_id")
    old = content_hash(F.when(k % 4 == 0, "x").otherwise(F.col("lang")), F.col("source"))
    stage = F.element_at(F.array(*[F.lit(s) for s in state.STAGES]), (k % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", state.stale_acceptance(F.when(k % 5 == 0, "accepted").otherwise("rejected"), content_hash(F.col("lang"), F.col("source")), old).alias("status"),
        state.completed_through(stage, F.lit("candidate_review_clips")).alias("done"),
    )


@query(
    """WITH RECURSIVE ev AS (SELECT user_id AS clip_id, CASE WHEN event_type = 'view' THEN row_number() OVER w - 1 ELSE event_id % 5 END AS expected, CASE WHEN event_id % 3 = 0 THEN 'accepted' END AS rs, CASE WHEN event_id % 4 = 0 THEN event_type END AS tr,
        row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    f AS (SELECT DISTINCT clip_id, 0::BIGINT AS i, 0::BIGINT AS version, 'unresolved' AS status, NULL::VARCHAR AS transcript, 0::BIGINT AS refused, n FROM ev
          UNION ALL SELECT ev.clip_id, ev.i, CASE WHEN expected = version THEN version + 1 ELSE version END,
              CASE WHEN expected <> version THEN status WHEN rs IS NOT NULL THEN rs WHEN tr IS NOT NULL AND tr IS DISTINCT FROM transcript AND status = 'accepted' THEN 'unresolved' ELSE status END,
              CASE WHEN expected = version THEN coalesce(tr, transcript) ELSE transcript END, CASE WHEN expected = version THEN refused ELSE refused + 1 END, f.n FROM f JOIN ev ON ev.clip_id = f.clip_id AND ev.i = f.i + 1)
    SELECT clip_id, version, status, transcript, refused FROM f WHERE i = n"""
)
def edit_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip_id"), "event_id", F.when(F.col("event_type") == "view", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).otherwise(F.col("event_id") % 5).cast("bigint").alias("expected_version"),
        F.when(F.col("event_id") % 3 == 0, "accepted").alias("review_status"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("transcript"),
    )
    return state.fold_edits(e, "clip_id", "event_id")


_COMMITS = """c AS (SELECT event_id AS commit_id, user_id AS item, ts AS created, CASE WHEN event_id % 4 = 0 THEN lag(event_id, 2) OVER w ELSE lag(event_id) OVER w END AS parent_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query(
    f"""WITH {_COMMITS}, h AS (SELECT item, commit_id AS head, parent_id AS undo_to, parent_id IS NOT NULL AS can_undo FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY created DESC, commit_id DESC) AS k FROM c) WHERE k = 1),
    r AS (SELECT item, parent_id, commit_id AS redo_to FROM (SELECT *, row_number() OVER (PARTITION BY item, parent_id ORDER BY created DESC, commit_id DESC) AS k FROM c WHERE parent_id IS NOT NULL) WHERE k = 1)
    SELECT h.item, head, undo_to, can_undo, redo_to FROM h LEFT JOIN r ON r.item = h.item AND r.parent_id = h.undo_to"""
)
def undo_redo_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    parent = F.when(F.col("event_id") % 4 == 0, F.lag("event_id", 2).over(w)).otherwise(F.lag("event_id").over(w))
    c = table(spark, sf_dir, "events").select(F.col("event_id").alias("commit_id"), F.col("user_id").alias("item"), F.col("ts").alias("created"), parent.alias("parent_id"))
    h = state.heads(c, "item")
    back = h.select("item", F.col("undo_to").alias("head"))
    return h.join(state.redo_targets(c, back, "item").select("item", "redo_to"), "item", "left")


_JOBS = """jobs AS (SELECT event_id AS job_id, user_id, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'pending' ELSE 'done' END AS status, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 30 SECOND END AS heartbeat, CASE WHEN event_id % 5 <> 0 THEN ts END AS started, ts - INTERVAL 1 MINUTE AS created FROM events)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        k.alias("job_id"), "user_id", F.when(k % 3 == 0, "running").when(k % 3 == 1, "pending").otherwise("done").alias("status"), F.when(k % 4 != 0, ts + F.expr("INTERVAL 30 SECOND")).alias("heartbeat"),
        F.when(k % 5 != 0, ts).alias("started"), (ts - F.expr("INTERVAL 1 MINUTE")).alias("created"),
    )


@query(f"WITH {_JOBS} SELECT job_id FROM jobs WHERE status = 'running' AND TIMESTAMP '2024-01-20' - coalesce(heartbeat, started, created) >= INTERVAL 60 SECOND")
def job_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.stale_jobs(_jobs(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("job_id")


@query(f"WITH {_JOBS} SELECT user_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created, job_id) AS k FROM jobs WHERE status = 'pending') WHERE k = 1")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.next_job(_jobs(spark, sf_dir), ["user_id"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT n_name AS tag, lower(n_name) AS name, count(*) AS links FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY lower(n_name)")
def tag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    return n.join(c, n["n_nationkey"] == c["c_nationkey"]).groupBy(F.col("n_name").alias("tag")).agg(F.count(F.lit(1)).alias("links")).withColumn("name", F.lower("tag"))


@query(
    """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
    t AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT child, depth + 1 FROM e JOIN t ON e.parent = t.node) SELECT DISTINCT node, depth::INT AS depth FROM t"""
)
def fk_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, o = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionByName(c.select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child")))
    edges = edges.unionByName(o.select(name("c", "o_custkey").alias("parent"), name("o", "o_orderkey").alias("child")))
    return state.closure(edges, spark.createDataFrame([("r1",)], "node string"))


@query(
    """WITH o AS (SELECT user_id, 20000::BIGINT AS len, list({'kind': CASE WHEN event_id % 2 = 0 THEN 'delete_range' ELSE 'insert_silence' END, 's': event_id % 500, 'e': event_id % 500 + 100, 'd': event_id % 90 + 1} ORDER BY event_id) AS ops FROM events GROUP BY user_id)
    SELECT user_id, (len + list_sum([CASE WHEN x.kind = 'delete_range' THEN -100 ELSE x.d END FOR x IN ops]))::BIGINT AS samples FROM o"""
)
def edited_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    op = F.struct("event_id", F.when(k % 2 == 0, "delete_range").otherwise("insert_silence").alias("kind"), (k % 500).alias("start_sample"), (k % 500 + 100).alias("end_sample"), (k % 90 + 1).alias("duration_samples"))
    ops = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    return ops.select("user_id", state.timeline_length(F.lit(20000).cast("bigint"), F.col("ops")).alias("samples"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'transcribing' WHEN 1 THEN 'failed' WHEN 2 THEN 'alignment_stale' WHEN 3 THEN 'aligned' WHEN 4 THEN 'transcribed' ELSE 'idle' END AS state,
       CASE doc_id % 5 WHEN 0 THEN 'audio_variant_materialization_failed' WHEN 1 THEN 'missing_pyannote_dependency' WHEN 2 THEN 'asr_model_unavailable' WHEN 3 THEN 'processing_buffer_build_failed' ELSE 'dataset_worker_failed' END AS code FROM documents"""
)
def derived_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, j = F.col("doc_id") % 6, F.col("doc_id") % 5
    s = state.processing_state(F.when(k == 0, "source_transcription"), k == 1, F.when(k == 2, "stale").when(k == 3, "ok"), F.when(k == 4, "patched"))
    stage = F.when(j == 0, "audio_variants").when(j == 1, "diarization").when(j == 2, "transcript_qc").when(j == 3, "buffers").otherwise("other")
    message = F.when(j == 0, "FFmpeg gave up").when(j == 1, "pyannote.audio is unavailable").when(j == 2, "no such Model").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("state"), state.failure_code(stage, message).alias("code"))


@query(
    """WITH c AS (SELECT user_id AS upload_id, event_id % 20 AS idx, CASE WHEN event_id % 97 = 0 THEN 'b' ELSE 'a' END AS h FROM events), p AS (SELECT upload_id, idx, count(DISTINCT h) AS k FROM c GROUP BY 1, 2)
    SELECT upload_id, count(*) AS received, count(*) FILTER (k > 1) AS conflicts, count(*) = 20 AND count(*) FILTER (k > 1) = 0 AS complete FROM p GROUP BY upload_id"""
)
def chunks_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    chunks = e.select(F.col("user_id").alias("upload_id"), (F.col("event_id") % 20).alias("index"), F.when(F.col("event_id") % 97 == 0, "b").otherwise("a").alias("sha256"))
    uploads = chunks.select("upload_id").distinct().withColumn("total_chunks", F.lit(20))
    return state.chunks_complete(chunks, uploads).drop("total_chunks")

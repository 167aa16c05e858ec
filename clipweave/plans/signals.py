"""Signal and stream queries: an embedding stands for a clip's samples, the events table for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions.arrays import doubles
from clipweave.operators import signal
from clipweave.operators.written import scratch
from clipweave.plans.registry import query, table
from clipweave.streaming import jobs


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("x"))


_X = "v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS x FROM embeddings)"


@query(
    f"""WITH {_X}, r AS (SELECT vec_id, x, sqrt(list_dot_product(x, x) / 64) AS level FROM v)
    SELECT vec_id, round(level, 6) AS level, round(CASE WHEN level > 1e-6 THEN 20 * log10(level) ELSE -120 END, 6) AS dbfs, round(len([k FOR k IN range(1, 64) IF (x[k] >= 0) <> (x[k + 1] >= 0)]) / 63.0, 6)::DOUBLE AS zcr FROM r"""
)
def signal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    level = signal.rms(F.col("x"))
    return x.select("vec_id", F.round(level, 6).alias("level"), F.round(signal.dbfs(level), 6).alias("dbfs"), F.round(signal.zero_crossing_rate(F.col("x")), 6).alias("zcr"))


@query(f"WITH {_X}, f AS (SELECT vec_id, x, unnest(range(7)) AS k FROM v) SELECT vec_id, k, round(sqrt(list_dot_product(x[k * 8 + 1:k * 8 + 16], x[k * 8 + 1:k * 8 + 16]) / 16), 6) AS level FROM f")
def signal_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).select("vec_id", F.posexplode(signal.frame_levels(F.col("x"), 16, 8)).alias("k", "level")).select("vec_id", F.col("k").cast("bigint").alias("k"), F.round("level", 6).alias("level"))


@query(f"WITH {_X}, b AS (SELECT vec_id, x, unnest(range(10)) AS k FROM v) SELECT vec_id, k, list_max([abs(y) FOR y IN x[k * 6 + least(k, 4) + 1:k * 6 + least(k, 4) + 6 + CASE WHEN k < 4 THEN 1 ELSE 0 END]]) AS peak FROM b")
def waveform_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _x(spark, sf_dir).select("vec_id", F.posexplode(signal.peaks(F.col("x"), 10)).alias("k", "peak")).select("vec_id", F.col("k").cast("bigint").alias("k"), "peak")


@query(f"WITH {_X} SELECT a.vec_id, round(corr(p, q), 6) AS correlation FROM (SELECT vec_id, unnest(x[1:32]) AS p, unnest(x[33:64]) AS q FROM v) a GROUP BY a.vec_id")
def channel_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    return x.select("vec_id", F.round(signal.correlation(F.slice("x", 1, 32), F.slice("x", 33, 32)), 6).alias("correlation"))


@query()
def signal_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    return x.select("vec_id", F.round(signal.spectral_centroid(F.col("x"), F.lit(16000.0)), 6).alias("centroid"), F.round(signal.pitch(F.col("x"), F.lit(4000.0)), 6).alias("pitch"), signal.choose_channel(F.slice("x", 1, 32), F.slice("x", 33, 32)).alias("channel"))


@query()
def acoustic_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """28 values per clip; an embedding's values over and over stand for 0.2 s of samples."""
    x = _x(spark, sf_dir).select("vec_id", F.flatten(F.array_repeat("x", 25)).alias("x"))
    s = x.select("vec_id", signal.signature(F.col("x"), 8000).alias("s"))
    return s.select("vec_id", *[F.round(F.col("s")[k], 6).alias(f"s{k}") for k in range(28)])


@query()
def gap_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir).select("vec_id", F.flatten(F.array_repeat(F.transform("x", lambda v: v * 0.1), 25)).alias("x"))
    return x.select("vec_id", signal.breath(F.col("x"), 8000).alias("breath"), F.size(signal.energised(F.col("x"), 80, 40, F.lit(0.4))).alias("energised"), F.round(signal.spectral_flatness(F.col("x")), 6).alias("flatness"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return jobs.events(spark, sf_dir, schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by gap, in batch: the same expression as on the stream."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.to_timestamp_ntz(F.col("s.start").cast("string")).alias("start"), F.to_timestamp_ntz(F.col("s.end").cast("string")).alias("end"), "events")


@query(
    # A window is final, and so in the table, once the newest event is an hour past its end.
    """WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOUR AS start FROM events, range(2) r(k))
    SELECT event_type, start, start + INTERVAL 1 DAY AS "end", count(*) AS n, round(sum(value), 4) AS total FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2"""
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows over the events as a stream, drained into a table."""
    base = scratch(spark, "stream")
    out = jobs.windowed(_stream(spark, sf_dir), ["event_type"], "ts", "value", "1 day", "12 hours", "1 hour")
    return jobs.run_to_table(out, f"{base}/checkpoint", f"{base}/table").select("event_type", *[F.to_timestamp_ntz(F.col(c).cast("string")).alias(c) for c in ("start", "end")], "n", F.round("total", 4).alias("total"))


@query()
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job states from messages: a user's events are a job's claim, heartbeats and end."""
    base = scratch(spark, "stream")
    kind = F.when(F.col("event_type") == "signup", "claim").when(F.col("event_type") == "purchase", "done").otherwise("heartbeat")
    messages = _stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), "ts", kind.alias("kind"))
    return jobs.run_to_table(jobs.job_states(messages, 86_400_000), f"{base}/checkpoint", f"{base}/table", "update")

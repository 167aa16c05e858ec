"""Comparison of two backends' frames, and the listing of slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.operators import selection
from clipweave.plans.registry import query, table

#: Two backends: the second differs a little, lacks some frames and has moved others.
_TWO_SQL = """a AS (SELECT user_id, event_id AS frame, value AS time, ((event_id * 37) % 101) / 100.0::DOUBLE AS prob FROM events),
    b AS (SELECT user_id, frame, CASE WHEN frame % 50 = 7 THEN time + 1 ELSE time END AS time, greatest(0.0, least(1.0, prob + ((frame * 13) % 21 - 10) / 500.0::DOUBLE))::DOUBLE AS prob FROM a WHERE frame % 97 <> 5)"""


@query(
    f"""WITH {_TWO_SQL}, j AS (SELECT user_id, abs(a.prob - b.prob) AS d, (a.prob >= 0.5) <> (b.prob >= 0.5) AS flip, a.frame IS NULL OR b.frame IS NULL AS missing, coalesce(a.time <> b.time, FALSE) AS moved FROM a FULL JOIN b USING (user_id, frame)),
    g AS (SELECT user_id, list_sort(list(d) FILTER (d IS NOT NULL)) AS o, count(d) AS frames, avg(d) AS mean, count(*) FILTER (flip) AS changed, count(*) FILTER (missing) AS unmatched, count(*) FILTER (moved) AS moved FROM j GROUP BY user_id)
    SELECT user_id, frames, round(o[-1], 9) AS max, round(mean, 9) AS mean, round(o[round_even(0.5 * (frames - 1), 0)::INT + 1], 9) AS p50, round(o[round_even(0.95 * (frames - 1), 0)::INT + 1], 9) AS p95, round(o[round_even(0.99 * (frames - 1), 0)::INT + 1], 9) AS p99, changed, unmatched, moved FROM g"""
)
def frames_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    a = table(spark, sf_dir, "events").select("user_id", k.alias("frame"), F.col("value").alias("time"), ((k * 37) % 101 / F.lit(100.0)).alias("prob"))
    f = F.col("frame")
    b = a.where(f % 97 != 5).withColumn("time", F.when(f % 50 == 7, F.col("time") + 1).otherwise(F.col("time"))).withColumn("prob", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob") + ((f * 13) % 21 - 10) / F.lit(500.0))))
    return selection.compare_frames(a, b, "user_id", held=40)


@query(
    """WITH l AS (SELECT n_nationkey AS project, o_custkey AS recording, o_orderkey AS id, o_orderdate AS created_at, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 5 END AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE NOT (o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0))
    SELECT project, recording, id, row_number() OVER (ORDER BY project, recording, k, created_at, id) AS place FROM l"""
)
def project_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    metadata = F.when(k % 7 != 0, F.to_json(F.struct((k % 11 == 0).alias("is_superseded"), (k % 5).alias("order_index")))).when(k % 2 == 0, "{broken")
    slices = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("recording"), F.col("o_orderdate").alias("created_at"), metadata.alias("metadata"))
    recordings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recording"), F.col("c_nationkey").alias("project"))
    return selection.project_slices(slices, recordings).select("project", "recording", "id", "place")

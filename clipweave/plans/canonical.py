"""Canonical JSON, hashes over it, and stages that are reused by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions import canonical as cj
from clipweave.operators.reuse import StageStore, reuse
from clipweave.operators.written import scratch
from clipweave.plans.registry import query, table


@query(
    """SELECT doc_id, sha256(j) AS digest, length(j) AS n FROM (SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'nested': {'Ratio': n_chars / 8.0::DOUBLE, 'none': NULL, 'parts': [{'a': n_chars, 'b': source}, {'a': n_chars % 7, 'b': NULL}]}, 'odd': doc_id % 2 = 1, 'text': text}) AS j FROM documents)"""
)
def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records whose fields come in another order than JSON has them."""
    part = lambda a, b: F.struct(b.alias("b"), a.cast("long").alias("a"))
    nested = F.struct(F.lit(None).cast("string").alias("none"), F.array(part(F.col("n_chars"), F.col("source")), part(F.col("n_chars") % 7, F.lit(None).cast("string"))).alias("parts"), (F.col("n_chars") / F.lit(8.0)).alias("Ratio"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct("text", (F.col("doc_id") % 2 == 1).alias("odd"), nested.alias("nested"), "lang", "doc_id").alias("r"))
    j = d.select("doc_id", cj.canonical_json(F.col("r"), d.schema["r"].dataType).alias("j"))
    return j.select("doc_id", F.sha2("j", 256).alias("digest"), F.length("j").cast("long").alias("n"))


@query(
    """WITH o AS (SELECT user_id, string_agg(CASE WHEN event_id % 3 = 0 THEN '{"end_sample":' || (event_id % 500 + 100) || ',"kind":"delete_range","start_sample":' || (event_id % 500) || '}'
               ELSE '{"at_sample":' || (event_id % 700) || ',"duration_samples":' || (event_id % 90 + 1) || ',"kind":"insert_silence"}' END, ',' ORDER BY event_id) AS ops FROM events GROUP BY user_id)
    SELECT user_id, sha256('revision-1' || chr(10) || sha256(user_id::VARCHAR) || chr(10) || 'renderer-1' || chr(10) || '{"ops":[' || ops || '],"schema_version":1}') AS revision FROM o"""
)
def revision_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    cut, add = k % 3 == 0, k % 3 != 0
    op = F.struct("event_id", F.when(cut, "delete_range").otherwise("insert_silence").alias("kind"), F.when(cut, k % 500).alias("start_sample"), F.when(cut, k % 500 + 100).alias("end_sample"), F.when(add, k % 700).alias("at_sample"), F.when(add, k % 90 + 1).alias("duration_samples"))
    ops = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(op)), lambda o: o.dropFields("event_id")).alias("ops"))
    return ops.select("user_id", cj.revision_hash(F.sha2(F.col("user_id").cast("string"), 256), F.col("ops"), ops.schema["ops"].dataType, "revision-1", "renderer-1").alias("revision"))


@query(
    """WITH e AS (SELECT user_id, event_type, CASE WHEN user_id % 10 = 3 THEN value + 1 ELSE value END AS value FROM events)
    SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, CASE WHEN user_id % 10 = 3 THEN 'second' ELSE 'first' END AS computed FROM e GROUP BY user_id"""
)
def stage_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage over all users, run again after a tenth of them changed: the others' results are those of the first run."""
    store = StageStore(spark, scratch(spark, "stage_reuse"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")

    def stage(name: str):
        return lambda r: r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("computed", F.lit(name))

    reuse(store, rows, "user_id", stage("first"))
    changed = rows.withColumn("value", F.when(F.col("user_id") % 10 == 3, F.col("value") + 1).otherwise(F.col("value")))
    return reuse(store, changed, "user_id", stage("second"))[0]

"""Embedding queries: a label is a speaker, label 0 the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions.arrays import doubles, unit
from clipweave.operators import vectors as vx
from clipweave.operators.density import density_clusters
from clipweave.plans.registry import query, table

DIMS = 64
_U = """v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings), u AS (SELECT *, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS w FROM v)"""
_C = f"""{_U}, m AS (SELECT label, d, avg(e[d]) AS x FROM v, range(1, {DIMS + 1}) r(d) GROUP BY label, d), ml AS (SELECT label, list(x ORDER BY d) AS m FROM m GROUP BY label), c AS (SELECT label, [x / sqrt(list_dot_product(m, m)) FOR x IN m] AS c FROM ml)"""


def _v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("embedding"))


@query(f"WITH {_C} SELECT label, count(*) AS n, round(any_value(c.c[1]), 6) AS c1, round(any_value(c.c[{DIMS}]), 6) AS c64 FROM v JOIN c USING (label) GROUP BY label")
def vec_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vx.centroids(_v(spark, sf_dir), ["label"], "embedding", DIMS)
    return c.select("label", "n", F.round(F.element_at("centroid", 1), 6).alias("c1"), F.round(F.element_at("centroid", DIMS), 6).alias("c64"))


@query(f"WITH {_C} SELECT a.label AS left_key, b.label AS right_key, round(list_dot_product(a.c, b.c), 6) AS similarity FROM c a CROSS JOIN c b")
def centroid_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = vx.similarity_matrix(vx.centroids(_v(spark, sf_dir), ["label"], "embedding", DIMS), "label")
    return m.select("left_key", "right_key", F.round("similarity", 6).alias("similarity"))


_LOO = f"""{_U}, l AS (SELECT a.vec_id, a.label, avg(list_dot_product(a.w, b.w)) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label)"""


@query(f"WITH {_LOO}, f AS (SELECT label, quantile_cont(s, 0.25) AS floor FROM l GROUP BY label) SELECT vec_id, label, round(s, 6) AS similarity FROM l JOIN f USING (label) WHERE round(s, 9) >= round(floor, 9)")
def vec_guillotine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vx.guillotine(_v(spark, sf_dir), ["label"], "embedding", DIMS).select("vec_id", "label", F.round("loo_similarity", 6).alias("similarity"))


_ANCHOR = """{n} AS (SELECT [x / sqrt(list_dot_product(m, m)) FOR x IN m] AS c FROM (SELECT list(x ORDER BY d) AS m FROM (SELECT d, avg(e[d]) AS x FROM v, range(1, 65) r(d) WHERE {w} GROUP BY d)))"""
_RERANK = f"""{_U}, {_ANCHOR.format(n="p", w="label = 0 AND vec_id % 3 = 0")}, {_ANCHOR.format(n="q", w="label = 1 AND vec_id % 3 = 0")},
    r AS (SELECT vec_id, label, (vec_id % 10) / 100.0::DOUBLE + list_dot_product(w, p.c) - list_dot_product(w, q.c) AS score FROM u, p, q)"""


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _v(spark, sf_dir)
    return vx.rerank(v, "embedding", v.where("label = 0 AND vec_id % 3 = 0"), v.where("label = 1 AND vec_id % 3 = 0"), (F.col("vec_id") % 10) / F.lit(100.0), DIMS)


@query(f"WITH {_RERANK} SELECT vec_id, round(score, 6) AS rerank FROM r")
def vec_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("vec_id", F.round("rerank", 6).alias("rerank"))


@query(f"WITH {_RERANK} SELECT vec_id, round(score, 6) AS rerank FROM r ORDER BY round(score, 6) DESC, vec_id LIMIT 20 OFFSET 5")
def vec_rerank_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("vec_id", F.round("rerank", 6).alias("rerank")).orderBy(F.desc("rerank"), "vec_id").offset(5).limit(20)


@query(
    f"""WITH {_U}, pr AS (SELECT * FROM u WHERE vec_id % 50 = 0), s AS (SELECT a.vec_id AS probe, a.label AS pl, b.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.w, b.w), 9) DESC, b.vec_id) AS k FROM pr a JOIN u b ON a.vec_id <> b.vec_id)
    SELECT probe, round(sum(CASE WHEN label = pl AND k <= 5 THEN 1 ELSE 0 END) / sum(CASE WHEN label = pl THEN 1 ELSE 0 END)::DOUBLE, 6) AS recall_5, round(sum(CASE WHEN label = pl AND k <= 25 THEN 1 ELSE 0 END) / sum(CASE WHEN label = pl THEN 1 ELSE 0 END)::DOUBLE, 6) AS recall_25 FROM s GROUP BY probe"""
)
def vec_topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _v(spark, sf_dir).withColumn("w", unit(F.col("embedding"))).select("vec_id", "label", "w")
    probes = u.where("vec_id % 50 = 0").select(F.col("vec_id").alias("probe"), F.col("label").alias("probe_label"), F.col("w").alias("p"))
    best = vx.nearest(u.select(F.col("vec_id").alias("id"), "w"), probes.select("probe", "p"), 25)
    ranked = best.join(u.select(F.col("vec_id").alias("id"), "label"), "id").join(probes.select("probe", "probe_label"), "probe")
    totals = u.groupBy(F.col("label").alias("probe_label")).agg((F.count(F.lit(1)) - 1).alias("relevant"))  # all of the label but the probe
    return vx.recall_at(ranked.join(totals, "probe_label"), "probe", F.col("label") == F.col("probe_label"), "rank", [5, 25], F.col("relevant"))


@query(f"WITH {_C}, s AS (SELECT u.vec_id, c.label AS hit, round(list_dot_product(u.w, c.c), 9) AS s FROM u CROSS JOIN c WHERE u.label = 0 AND c.label <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, hit DESC) AS k FROM s WHERE s >= 0.05) SELECT vec_id, hit, round(s, 6) AS similarity FROM k WHERE k = 1")
def vec_intruders(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _v(spark, sf_dir)
    cents = vx.centroids(v.where("label <> 0"), ["label"], "embedding", DIMS)
    return vx.best_centroid(v.where("label = 0").drop("label"), "vec_id", "embedding", cents, "label", 0.05).select("vec_id", "hit", F.round("similarity", 6).alias("similarity"))


@query(f"WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings), s AS (SELECT avg(e[1]) AS m1, stddev_pop(e[1]) AS s1, avg(e[{DIMS}]) AS m2, stddev_pop(e[{DIMS}]) AS s2 FROM v) SELECT vec_id, round((e[1] - m1) / s1, 6) AS z1, round((e[{DIMS}] - m2) / s2, 6) AS z64 FROM v, s")
def vec_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vx.zscores(_v(spark, sf_dir), "embedding", DIMS).select("vec_id", F.round(F.element_at("z", 1), 6).alias("z1"), F.round(F.element_at("z", DIMS), 6).alias("z64"))


@query()
def vec_density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vx.display_labels(density_clusters(_v(spark, sf_dir), "vec_id", "embedding"), "cluster")
    return found.select("vec_id", "cluster", "display", vx.risk_flag(F.col("display")).alias("risk_flag"))


@query("SELECT vec_id, d AS display, 'cluster_' || d AS risk_flag FROM (SELECT vec_id, CASE WHEN label % 4 = 3 THEN 'outliers' ELSE '' || dense_rank() OVER (PARTITION BY label % 4 = 3 ORDER BY label) END AS d FROM embeddings)")
def cluster_display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 4 == 3, -1).otherwise(F.col("label")).alias("cluster"))
    return vx.display_labels(v, "cluster").select("vec_id", "display", vx.risk_flag(F.col("display")).alias("risk_flag"))

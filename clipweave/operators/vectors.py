"""Embedding analytics: centroids, outliers, reranking, recall, intruders and standardising."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.functions.arrays import dot, doubles, unit
from clipweave.operators.written import written


def mean_vector(rows: DataFrame, keys: list[str], vector: str, dims: int) -> DataFrame:
    """Per key the element-wise mean, as one aggregate per dimension: partial sums only are shuffled."""
    means = F.array(*[F.avg(F.element_at(vector, d + 1)) for d in range(dims)])
    return rows.groupBy(*keys).agg(means.alias("mean"), F.count(F.lit(1)).alias("n"))


def centroids(rows: DataFrame, keys: list[str], vector: str, dims: int) -> DataFrame:
    """Per key the mean vector at length 1."""
    return mean_vector(rows, keys, vector, dims).withColumn("centroid", unit(F.col("mean"))).drop("mean")


#: Rows that may be broadcast as one per label or cluster.
MOST_LABELS = 100_000


def checked(rows: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """``rows`` for broadcast, written and counted first: more than ``most`` are an error, since what is done with each doesn't fit one task then."""
    rows = written(rows, "checked")
    if (n := rows.count()) > most:
        raise ValueError(f"{n} rows are too many to broadcast; the most is {most}")
    return F.broadcast(rows)


def similarity_matrix(cents: DataFrame, key: str) -> DataFrame:
    """Cosine of each pair of centroids, which are one row per label: ``checked`` few enough to be broadcast. The result has a row per pair by definition."""
    a, b = cents.select(F.col(key).alias("left_key"), F.col("centroid").alias("_a")), cents.select(F.col(key).alias("right_key"), F.col("centroid").alias("_b"))
    return a.join(checked(b)).select("left_key", "right_key", dot(F.col("_a"), F.col("_b")).alias("similarity"))


def leave_one_out(rows: DataFrame, keys: list[str], vector: str, dims: int) -> DataFrame:
    """``rows`` with the mean cosine to the other vectors of the key, null if alone.

    For unit vectors that is (v . sum - 1) / (n - 1): one aggregate and a join in place of all pairs.
    """
    u = rows.withColumn("_u", unit(doubles(F.col(vector))))
    sums = u.groupBy(*keys).agg(F.array(*[F.sum(F.element_at("_u", d + 1)) for d in range(dims)]).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    own = dot(F.col("_u"), F.col("_u"))
    return u.join(sums, keys).withColumn("loo_similarity", F.when(F.col("_n") > 1, (dot(F.col("_u"), F.col("_sum")) - own) / (F.col("_n") - 1))).drop("_u", "_sum", "_n")


def guillotine(rows: DataFrame, keys: list[str], vector: str, dims: int, percentile: float = 0.25) -> DataFrame:
    """Drops each key's outliers: keeps leave-one-out similarities at or over their percentile."""
    scored = leave_one_out(rows, keys, vector, dims)
    floor = scored.groupBy(*keys).agg(F.percentile("loo_similarity", F.lit(percentile)).alias("floor"))
    return scored.join(floor, keys).where((F.round("loo_similarity", 9) >= F.round("floor", 9)) | F.col("floor").isNull())


def rerank(rows: DataFrame, vector: str, positive: DataFrame, negative: DataFrame, base: Column, dims: int) -> DataFrame:
    """``rows`` with base + cos(v, mean of the positive anchors) - cos(v, mean of the negative ones). The means are one row each."""
    pos = centroids(positive, [], vector, dims).select(F.col("centroid").alias("_p"))
    neg = centroids(negative, [], vector, dims).select(F.col("centroid").alias("_q"))
    u = unit(doubles(F.col(vector)))
    return rows.join(F.broadcast(pos)).join(F.broadcast(neg)).withColumn("rerank", base + dot(u, F.col("_p")) - dot(u, F.col("_q"))).drop("_p", "_q")


def recall_at(ranked: DataFrame, probe: str, relevant: Column, rank: str, ks: list[int], total: Column | None = None) -> DataFrame:
    """Per probe the share of its relevant rows within the first k. ``total``: a column with the number of relevant rows, where ``ranked`` holds the first ones only."""
    n = F.sum(F.when(relevant, 1).otherwise(0)) if total is None else F.max(total)
    return ranked.groupBy(probe).agg(*[F.round(F.sum(F.when(relevant & (F.col(rank) <= k), 1).otherwise(0)) / F.nullif(n, F.lit(0)), 6).alias(f"recall_{k}") for k in ks])


def nearest(rows: DataFrame, probes: DataFrame, k: int, block_rows: int = 8192, chunk_rows: int = 4096) -> DataFrame:
    """Per probe its ``k`` most similar rows other than itself, by cosine to 9 places, then id: probe, rank, id, similarity.

    rows: id, w (a unit vector); probes: probe, p. Rows are dealt to blocks and probes to chunks; each pair of them is one matrix product that leaves k rows per probe, so all pairs are scored but
    only k a block and probe are kept for the final rank.
    """
    n, m = rows.count(), probes.count()
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-m // chunk_rows))
    members = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "w")).alias("members"))
    asking = probes.groupBy(F.pmod(F.xxhash64("probe"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("probe", "p")).alias("asking"))
    members = members.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                a, c = (b.column(x)[i].values for x in ("members", "asking"))
                ids, names = a.field(0).to_numpy(zero_copy_only=False), c.field(0).to_numpy(zero_copy_only=False)
                w, p = (x.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) for x in (a, c))
                order = np.argsort(ids, kind="stable")
                ids, w = ids[order], w[order]
                for at in range(0, len(names), 256):
                    s = np.round(p[at : at + 256] @ w.T, 9)
                    s[names[at : at + 256, None] == ids] = -np.inf
                    top = np.argsort(-s, 1, kind="stable")[:, :k]  # ids rise, so ties go to the smaller one
                    score = np.take_along_axis(s, top, 1)
                    who, row = np.repeat(names[at : at + 256], top.shape[1]), top.ravel()
                    fine = np.isfinite(score.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(who[fine]), pa.array(ids[row][fine]), pa.array(score.ravel()[fine])], ["probe", "id", "similarity"])

    hits = members.join(asking, ["block", "chunk"]).select("members", "asking").mapInArrow(run, "probe long, id long, similarity double")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("similarity"), "id")))
    return ranked.where(F.col("rank") <= k)


def best_centroid(rows: DataFrame, id_col: str, vector: str, cents: DataFrame, key: str, at_least: float) -> DataFrame:
    """Rows whose most similar centroid reaches a threshold, with it. Centroids are one row per label, ``checked`` by count."""
    u = rows.withColumn("_u", unit(doubles(F.col(vector))))
    met = u.join(checked(cents.select(F.col(key).alias("hit"), F.col("centroid").alias("_c")))).withColumn("similarity", dot(F.col("_u"), F.col("_c")))
    return met.where(F.col("similarity") >= at_least).groupBy(id_col).agg(F.max_by("hit", F.struct("similarity", "hit")).alias("hit"), F.max("similarity").alias("similarity"))


def zscores(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """``rows`` with every dimension standardised by its population deviation, which counts as 1 under 1e-12. One row of statistics is broadcast."""
    v = doubles(F.col(vector))
    at = lambda d: F.element_at(v, d + 1)
    stats = rows.agg(F.array(*[F.avg(at(d)) for d in range(dims)]).alias("_m"), F.array(*[F.stddev_pop(at(d)) for d in range(dims)]).alias("_s"))
    stats = stats.withColumn("_s", F.transform("_s", lambda s: F.when(s < 1e-12, 1.0).otherwise(s)))
    return rows.join(F.broadcast(stats)).withColumn("z", F.zip_with(F.zip_with(v, "_m", lambda x, m: x - m), "_s", lambda x, s: x / s)).drop("_m", "_s")


def display_labels(rows: DataFrame, cluster: str) -> DataFrame:
    """Cluster numbers for display: -1 is outliers, the others count from 1 in order, as text. One row per cluster is numbered and joined back."""
    numbered = rows.where(F.col(cluster) >= 0).select(cluster).distinct().withColumn("_n", F.row_number().over(Window.orderBy(cluster)))
    return rows.join(checked(numbered), cluster, "left").withColumn("display", F.coalesce(F.col("_n").cast("string"), F.lit("outliers"))).drop("_n")


def risk_flag(display: Column) -> Column:
    """The risk flag of a display label."""
    return F.concat(F.lit("cluster_"), display)

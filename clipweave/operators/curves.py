"""Evaluation analytics: histograms, yield and survival curves, ranking metrics, paired deltas, dominance and bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipweave.functions.numeric import clamp, finite
from clipweave.operators.ordering import running_sums, with_row_number
from clipweave.operators.written import written


def histogram(rows: DataFrame, metric: str, bins: int, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """bin, low, high, n: equal bins, the last inclusive; nulls left out, empty bins kept."""
    width = (high - low) / bins
    x = clamp(F.col(metric), low, high)
    counts = rows.where(x.isNotNull()).select(F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").count()
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("bin") * width + low).alias("low"), ((F.col("bin") + 1) * width + low).alias("high"), F.coalesce("count", F.lit(0)).alias("n"))


def yield_curve(rows: DataFrame, metric: str, weight: str) -> DataFrame:
    """threshold, clips, seconds: what scores at least each distinct clamped score, 0 and 100.

    Rows collapse to distinct scores first; running totals run over those, in range partitions.
    """
    x = clamp(F.col(metric), 0, 100)
    per = rows.select(x.alias("threshold"), F.col(weight).alias("w")).where("threshold IS NOT NULL").groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    ends = rows.sparkSession.createDataFrame([(0.0, 0, 0.0), (100.0, 0, 0.0)], "threshold double, n bigint, w double")
    per = per.unionByName(ends).groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).withColumn("down", -F.col("threshold"))
    out = running_sums(per, ["down"], {"clips": F.col("n"), "seconds": F.col("w")})
    return out.select("threshold", F.col("clips").cast("bigint").alias("clips"), F.round("seconds", 6).alias("seconds"))


def unscored(metric: str) -> Column:
    """How many values are null or not finite."""
    return F.sum(F.when(finite(F.col(metric)).isNull(), 1).otherwise(0)).cast("bigint")


def survival(rows: DataFrame, metric: str, grid: list[float], by: list[str]) -> DataFrame:
    """Per group and threshold of the grid: the share of scored rows at or over it, in percent. One pass, a column per threshold."""
    x = finite(F.col(metric))
    n = F.count(x)
    shares = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.round(100.0 * F.sum(F.when(x >= t, 1).otherwise(0)) / n, 6).alias("percent")) for t in grid])
    return rows.where(x.isNotNull()).groupBy(*by).agg(shares.alias("s")).select(*by, F.explode("s").alias("p")).select(*by, "p.threshold", "p.percent")


def _by_score(rows: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Per group and distinct score: positives and all, with running totals from the highest score down."""
    per = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0) if by else Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("tp", F.sum("pos").over(down)).withColumn("seen", F.sum("n").over(down))


def ranking_metrics(rows: DataFrame, label: str, score: str, by: list[str], recalls: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """Per group: n, prevalence, ROC-AUC by mid-ranks, average precision, and the false-positive rate at the first threshold that reaches each recall.

    Rows collapse to (group, score) counts before the windows. One class alone gives nulls.
    """
    curve = _by_score(rows, label, score, by)
    totals = curve.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("n").alias("all"))
    c = curve.join(totals, by)
    neg, fp = F.col("all") - F.col("p"), F.col("seen") - F.col("tp")
    higher_neg = fp - (F.col("n") - F.col("pos"))
    # A positive beats the negatives below it and half of those beside it.
    wins = F.col("pos") * ((neg - higher_neg - (F.col("n") - F.col("pos"))) + (F.col("n") - F.col("pos")) / 2.0)
    aggs = [F.max("all").alias("n"), F.round(F.max("p") / F.max("all"), 6).alias("prevalence")]
    both = (F.max("p") > 0) & (F.max("p") < F.max("all"))
    aggs.append(F.when(both, F.round(F.sum(wins) / F.try_multiply(F.max("p").cast("double"), F.max(neg).cast("double")), 6)).alias("auc"))
    aggs.append(F.when(both, F.round(F.sum(F.col("tp") / F.col("seen") * F.col("pos")) / F.max("p"), 6)).alias("ap"))
    for r in recalls:
        reached = F.col("tp") >= F.lit(r) * F.col("p")
        aggs.append(F.when(both, F.round(F.min_by(fp / F.nullif(neg, F.lit(0)), F.when(reached, -F.col("s"))), 6)).alias(f"fpr_at_{round(100 * r)}"))
    return c.groupBy(*by).agg(*aggs)


def paired_deltas(rows: DataFrame, group: str, pair: str, metric: str, baseline) -> DataFrame:
    """Each other group's metric less the baseline's, for the pairs that both have."""
    base = rows.where(F.col(group) == baseline).select(pair, F.col(metric).alias("base"))
    return rows.where(F.col(group) != baseline).join(base, pair).select(group, pair, (F.col(metric) - F.col("base")).alias("delta"))


def summarise_deltas(deltas: DataFrame, group: str, tolerance: float = 1e-12) -> DataFrame:
    """Median, mean and counts of wins, losses and ties."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    d = F.col("delta")
    return deltas.groupBy(group).agg(F.round(F.percentile("delta", F.lit(0.5)), 6).alias("median_delta"), F.round(F.avg("delta"), 6).alias("mean_delta"), n(d > tolerance).alias("wins"), n(d < -tolerance).alias("losses"), n(F.abs(d) <= tolerance).alias("ties"))


def pareto(rows: DataFrame, key: str, more: list[str], less: list[str]) -> DataFrame:
    """Rows with the sorted keys that dominate them: no worse in any metric, better in one. ``rows`` is a scorecard: one row per configuration."""
    a, b = rows.alias("a"), rows.alias("b")
    no_worse = [F.col(f"b.{m}") >= F.col(f"a.{m}") for m in more] + [F.col(f"b.{m}") <= F.col(f"a.{m}") for m in less]
    better = [F.col(f"b.{m}") > F.col(f"a.{m}") for m in more] + [F.col(f"b.{m}") < F.col(f"a.{m}") for m in less]
    all_, any_ = no_worse[0], better[0]
    for c in no_worse[1:]:
        all_ &= c
    for c in better[1:]:
        any_ |= c
    met = a.join(b, all_ & any_, "left")
    return met.groupBy(*[F.col(f"a.{c}").alias(c) for c in rows.columns]).agg(F.array_sort(F.collect_list(f"b.{key}")).alias("dominated_by")).withColumn("on_front", F.size("dominated_by") == 0)


def resampled(units: DataFrame, unit: str, replicates: int, seed: int = 17) -> DataFrame:
    """Per replicate as many units as there are, drawn with replacement: replicate, unit, w (how often). A draw is a hash of seed, replicate and place, so reruns agree."""
    numbered, n = with_row_number(units.select(unit), [unit], "_k")
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "replicate", F.pmod("id", F.lit(max(n, 1))))), 1, 8), 16, 10).cast("bigint")
    draws = units.sparkSession.range(replicates * n).withColumn("replicate", F.floor(F.col("id") / max(n, 1))).select("replicate", (F.pmod(pick, F.lit(max(n, 1))) + 1).alias("_k"))
    return draws.groupBy("replicate", "_k").agg(F.count(F.lit(1)).alias("w")).join(numbered, "_k").drop("_k")


def bootstrap(rows: DataFrame, unit: str, label: str, scores: tuple[str, str], replicates: int = 1000, seed: int = 17) -> DataFrame:
    """Per replicate the difference in AUC of two scores over units drawn with replacement (``resampled``); replicates of one class alone go.

    Rows collapse to counts per unit and score, which a replicate weighs by how often it draws the unit, so no row is repeated.
    """
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in (unit, label, *scores)))
    drawn = written(resampled(rows.select(unit).distinct(), unit, replicates, seed), "resampled")

    def auc(score: str) -> DataFrame:
        per = rows.groupBy(unit, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
        per = per.join(drawn, unit).groupBy("replicate", "s").agg(F.sum(F.col("w") * F.col("pos")).alias("pos"), F.sum(F.col("w") * F.col("n")).alias("n"))
        w = Window.partitionBy("replicate").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("neg", F.col("n") - F.col("pos")).withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
        total = per.groupBy("replicate").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
        return total.where("p > 0 AND q > 0").select("replicate", (F.col("wins") / (F.col("p").cast("double") * F.col("q"))).alias(f"auc_{score}"))

    return auc(scores[0]).join(auc(scores[1]), "replicate").select("replicate", (F.col(f"auc_{scores[0]}") - F.col(f"auc_{scores[1]}")).alias("delta"))


def interval(replicates: DataFrame, column: str = "delta", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """A percentile interval over replicates."""
    return replicates.agg(F.count(F.lit(1)).alias("replicates"), F.round(F.percentile(column, F.lit(low)), 6).alias("low"), F.round(F.percentile(column, F.lit(high)), 6).alias("high"))


def grid(spark: SparkSession, low: float, high: float, step: float) -> DataFrame:
    """Thresholds from low to high."""
    n = int(round((high - low) / step))
    return spark.range(n + 1).select((F.col("id") * step + low).alias("threshold"))

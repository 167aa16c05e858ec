"""Evaluation queries: scorecards from lineitem and orders, ranking metrics from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipweave.operators import curves, policy
from clipweave.plans.registry import query, table

_CARDS = """cards AS (SELECT l_returnflag || l_linestatus AS config, l_suppkey % 20 AS speaker, round(avg(l_discount), 6) AS coverage, round(avg(l_tax), 6) AS inside, count(*) AS clips FROM lineitem GROUP BY 1, 2)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """config, speaker, coverage, inside, clips."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("config"), (F.col("l_suppkey") % 20).alias("speaker"))
    return g.agg(F.round(F.avg("l_discount"), 6).alias("coverage"), F.round(F.avg("l_tax"), 6).alias("inside"), F.count(F.lit(1)).alias("clips"))


_DELTA = "d AS (SELECT a.config, a.speaker, a.coverage - b.coverage AS delta FROM cards a JOIN cards b ON b.config = 'NO' AND a.speaker = b.speaker WHERE a.config <> 'NO')"


@query(f"WITH {_CARDS}, {_DELTA} SELECT config, speaker, round(delta, 6) AS delta FROM d")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.paired_deltas(cards(spark, sf_dir), "config", "speaker", "coverage", "NO").select("config", "speaker", F.round("delta", 6).alias("delta"))


@query(
    f"""WITH {_CARDS}, {_DELTA} SELECT config, round(median(delta), 6) AS median_delta, round(sum(delta), 6) AS total_delta, count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (delta < -1e-12) AS losses, count(*) FILTER (abs(delta) <= 1e-12) AS ties FROM d GROUP BY config"""
)
def delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = curves.paired_deltas(cards(spark, sf_dir), "config", "speaker", "coverage", "NO")
    n = d.groupBy("config").agg(F.round(F.sum("delta"), 6).alias("total_delta"))
    return curves.summarise_deltas(d, "config").drop("mean_delta").join(n, "config")


_PARETO = """p AS (SELECT speaker, round(avg(coverage), 6) AS coverage, round(avg(inside), 6) AS inside, CAST(sum(clips) AS BIGINT) AS clips FROM cards GROUP BY speaker)"""


@query(
    f"""WITH {_CARDS}, {_PARETO} SELECT a.speaker, coalesce(string_agg(b.speaker::VARCHAR, '|' ORDER BY b.speaker), '') AS dominated_by, count(b.speaker) = 0 AS on_front FROM p a
    LEFT JOIN p b ON b.coverage >= a.coverage AND b.inside <= a.inside AND b.clips >= a.clips AND (b.coverage > a.coverage OR b.inside < a.inside OR b.clips > a.clips) GROUP BY a.speaker"""
)
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cards(spark, sf_dir).groupBy("speaker").agg(F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("inside"), 6).alias("inside"), F.sum("clips").alias("clips"))
    return curves.pareto(p, "speaker", ["coverage", "clips"], ["inside"]).select("speaker", F.array_join(F.col("dominated_by").cast("array<string>"), "|").alias("dominated_by"), "on_front")


@query(
    """WITH b AS (SELECT 'v' || (l_suppkey % 7) AS variant, l_returnflag AS category, l_quantity AS score, l_discount AS delta FROM lineitem)
    SELECT variant, category, count(*) AS n, min(score) AS least, list_sort(list(score))[len(list(score)) // 2 + 1] AS upper_median, round(100.0 * sum(CASE WHEN score < 20 THEN 1 ELSE 0 END) / count(*), 6)::DOUBLE AS percent_below
    FROM b GROUP BY GROUPING SETS ((variant), (category))"""
)
def battery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per variant and per category, by grouping sets. The upper median is taken from counts per distinct score."""
    b = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("v"), (F.col("l_suppkey") % 7).cast("string")).alias("variant"), F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("score"))
    per = b.groupingSets([[F.col("variant"), F.col("score")], [F.col("category"), F.col("score")]], F.col("variant"), F.col("category"), F.col("score")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("variant", "category").orderBy("score")
    per = per.withColumn("upto", F.sum("c").over(w)).withColumn("all", F.sum("c").over(Window.partitionBy("variant", "category")))
    return per.groupBy("variant", "category").agg(
        F.sum("c").alias("n"), F.min("score").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("score"))).alias("upper_median"),
        F.round(100.0 * F.sum(F.when(F.col("score") < 20, F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("percent_below"),
    )


_RANK = """s AS (SELECT d.lang, l.quality AS y, (d.n_chars % 997)::DOUBLE AS s FROM documents d JOIN labels l USING (doc_id)), t AS (SELECT *, sum(y) OVER (PARTITION BY lang) AS p, count(*) OVER (PARTITION BY lang) AS n FROM s)"""


@query(
    f"""WITH {_RANK}, pr AS (SELECT a.lang, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS auc FROM s a JOIN s b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY a.lang),
    c AS (SELECT lang, s, sum(y) AS pos, count(*) AS m, any_value(p) AS p, any_value(n) AS n FROM t GROUP BY lang, s),
    w AS (SELECT *, sum(pos) OVER d AS tp, sum(m) OVER d AS seen FROM c WINDOW d AS (PARTITION BY lang ORDER BY s DESC)),
    f AS (SELECT lang, max(n) AS n, round(max(p) / max(n)::DOUBLE, 6) AS prevalence, CASE WHEN max(p) > 0 AND max(p) < max(n) THEN round(sum(tp / seen::DOUBLE * pos) / max(p), 6) END AS ap,
                 CASE WHEN max(p) > 0 AND max(p) < max(n) THEN round(arg_max((seen - tp) / nullif(n - p, 0)::DOUBLE, s) FILTER (tp >= 0.5 * p), 6) END AS fpr_at_50, CASE WHEN max(p) > 0 AND max(p) < max(n) THEN round(arg_max((seen - tp) / nullif(n - p, 0)::DOUBLE, s) FILTER (tp >= 0.8 * p), 6) END AS fpr_at_80 FROM w GROUP BY lang)
    SELECT f.lang, n::BIGINT AS n, prevalence, round(auc, 6)::DOUBLE AS auc, ap, fpr_at_50, fpr_at_80 FROM f LEFT JOIN pr USING (lang)"""
)
def auc_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return curves.ranking_metrics(d.select("lang", F.col("quality").alias("y"), (F.col("n_chars") % 997).cast("double").alias("s")), "y", "s", ["lang"])


@query(
    """WITH g AS (SELECT unnest([0, 250, 500, 750, 1000, 2000])::DOUBLE AS threshold), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
    SELECT d.lang, threshold, round(100.0 * sum(CASE WHEN n_chars >= threshold THEN 1 ELSE 0 END) / any_value(n), 6)::DOUBLE AS percent FROM documents d JOIN n USING (lang), g GROUP BY d.lang, threshold"""
)
def survival_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.survival(table(spark, sf_dir, "documents"), "n_chars", [0, 250, 500, 750, 1000, 2000], ["lang"])


_BOOT = """r AS (SELECT d.source AS unit, l.quality AS y, (d.n_chars % 997)::DOUBLE AS a, (d.n_chars % 613)::DOUBLE AS b FROM documents d JOIN labels l USING (doc_id) WHERE d.source IS NOT NULL AND l.quality IS NOT NULL AND d.n_chars IS NOT NULL),
    un AS (SELECT unit, row_number() OVER (ORDER BY unit) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT unit FROM r)),
    dr AS (SELECT replicate, unit, count(*) AS w FROM (SELECT replicate, n, ('0x' || substr(md5('17:' || replicate || ':' || (k - 1)), 1, 8))::BIGINT % n + 1 AS pick FROM range(1000) t(replicate), un) p JOIN un ON un.k = p.pick GROUP BY replicate, unit),
    x AS (SELECT replicate, w, y, a, b FROM r JOIN dr USING (unit)),
    pa AS (SELECT replicate, a AS s, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM x GROUP BY replicate, a), pb AS (SELECT replicate, b AS s, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM x GROUP BY replicate, b),
    wa AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM pa), wb AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM pb),
    aa AS (SELECT replicate, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc FROM wa GROUP BY replicate HAVING sum(pos) > 0 AND sum(neg) > 0), ab AS (SELECT replicate, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc FROM wb GROUP BY replicate HAVING sum(pos) > 0 AND sum(neg) > 0),
    q AS (SELECT replicate, aa.auc - ab.auc AS delta FROM aa JOIN ab USING (replicate))"""


def _bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.select(F.col("source").alias("unit"), F.col("quality").alias("y"), (F.col("n_chars") % 997).cast("double").alias("a"), (F.col("n_chars") % 613).cast("double").alias("b"))
    return curves.bootstrap(rows, "unit", "y", ("a", "b"))


@query(f"WITH {_BOOT} SELECT replicate, round(delta, 6)::DOUBLE AS delta FROM q")
def bootstrap_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bootstrap(spark, sf_dir).select("replicate", F.round("delta", 6).alias("delta"))


@query(f"WITH {_BOOT} SELECT count(*) AS replicates, round(quantile_cont(delta, 0.025), 6)::DOUBLE AS low, round(quantile_cont(delta, 0.975), 6)::DOUBLE AS high FROM q")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.interval(_bootstrap(spark, sf_dir))


_BOUNDS = """
    bd AS (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'end' ELSE 'internal' END AS role, CASE event_id % 4 WHEN 0 THEN 'A_only' WHEN 1 THEN 'D_only' ELSE 'A_and_D' END AS source,
                  (event_id * 7 % 200)::DOUBLE AS quiet_run_ms, (event_id * 11 % 130)::DOUBLE AS quiet_before_ms, (event_id * 13 % 130)::DOUBLE AS quiet_after_ms, -(event_id * 17 % 70)::DOUBLE AS rms_dbfs, (event_id % 25)::DOUBLE AS local_prominence_db,
                  CASE WHEN event_id % 5 <> 0 THEN (event_id * 3 % 100) / 100.0::DOUBLE END AS d_speech_prob, (event_id * 19 % 500)::DOUBLE AS edge, event_id % 6 = 0 AS trusted, (event_id % 10) / 10.0::DOUBLE AS base FROM events),
    b AS (SELECT *, CASE role WHEN 'start' THEN quiet_before_ms WHEN 'end' THEN quiet_after_ms ELSE least(quiet_before_ms, quiet_after_ms) END AS side FROM bd)
"""


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    num = lambda m, n: (k * m % n).cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(k % 3 == 0, "start").when(k % 3 == 1, "end").otherwise("internal").alias("role"), F.when(k % 4 == 0, "A_only").when(k % 4 == 1, "D_only").otherwise("A_and_D").alias("source"),
        num(7, 200).alias("quiet_run_ms"), num(11, 130).alias("quiet_before_ms"), num(13, 130).alias("quiet_after_ms"), (-num(17, 70)).alias("rms_dbfs"), (k % 25).cast("double").alias("local_prominence_db"),
        F.when(k % 5 != 0, num(3, 100) / 100.0).alias("d_speech_prob"), num(19, 500).alias("distance_to_scope_edge_ms"), (k % 6 == 0).alias("trusted_source_edge"), ((k % 10) / F.lit(10.0)).alias("base_score"),
    )


@query(
    f"""WITH {_BOUNDS} SELECT event_id, array_to_string([x FOR x IN [CASE WHEN quiet_run_ms + 1e-9 < 80 THEN 'quiet_run_lt_80ms' END, CASE WHEN side + 1e-9 < 48 THEN 'dangerous_side_quiet_lt_48ms' END, CASE WHEN d_speech_prob >= 0.5 THEN 'D_speech_veto' END,
        CASE WHEN source = 'A_only' AND rms_dbfs > -45 THEN 'A_only_rms_not_strong_enough' END, CASE WHEN NOT trusted AND edge < 120 THEN 'scope_edge_hard_zone' END] IF x IS NOT NULL], '|') AS reasons FROM b"""
)
def policy_quiet_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries(spark, sf_dir).select("event_id", F.array_join(policy.gate_reasons(80, 48, 120, -45), "|").alias("reasons"))


@query(
    f"""WITH {_BOUNDS} SELECT event_id, CASE source WHEN 'A_and_D' THEN 3.0 WHEN 'D_only' THEN 2.0 ELSE 1.0 END::DOUBLE AS rank, round(base - greatest(0, 48 - side) / 48, 6) AS one_sided, round(base - coalesce(greatest(0, d_speech_prob - 0.5), 0), 6) AS d_soft,
        round(CASE WHEN NOT trusted AND edge < 120 THEN base - 0.5 * (1 - edge / 120) ELSE base END, 6) AS edge_soft,
        round(base + least(quiet_run_ms, 250) / 250 + least(quiet_before_ms, 120) / 240 + least(quiet_after_ms, 120) / 240 + greatest(0, -rms_dbfs) / 100 + greatest(0, local_prominence_db) / 20, 6) AS evidence,
        base - CASE WHEN quiet_run_ms < 40 OR side < 24 THEN 1000 ELSE 0 END AS catastrophic, round(greatest(0, 80 - quiet_run_ms) / 80 + greatest(0, 48 - side) / 48 + greatest(0, rms_dbfs + 50) / 50, 6) AS risk, quiet_run_ms >= 120 AND side >= 24 AS high FROM b"""
)
def policy_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    r6 = lambda c: F.round(c, 6)
    return boundaries(spark, sf_dir).select(
        "event_id", policy.consensus_rank().alias("rank"), r6(policy.one_sided_penalty(48)).alias("one_sided"), r6(policy.d_penalty()).alias("d_soft"), r6(policy.edge_penalty(120, 0.5)).alias("edge_soft"),
        r6(policy.quiet_evidence()).alias("evidence"), policy.catastrophic_penalty(40, 24).alias("catastrophic"), r6(policy.boundary_risk()).alias("risk"), policy.high_confidence(120, 24).alias("high"),
    )


@query(f"WITH {_BOUNDS}, k AS (SELECT user_id, max(CASE WHEN source <> 'A_only' THEN 1 ELSE 0 END) AS d, max(CASE WHEN quiet_run_ms >= 190 THEN 1 ELSE 0 END) AS l FROM b GROUP BY user_id) SELECT event_id FROM b JOIN k USING (user_id) WHERE d = 0 OR l = 0 OR source <> 'A_only'")
def policy_d_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.d_primary(boundaries(spark, sf_dir), ["user_id"], F.col("quiet_run_ms") >= 190).select("event_id")


_TIMES = """a AS (SELECT DISTINCT user_id, round_even(t * 1000, 0)::BIGINT AS ms FROM (SELECT user_id, event_id % 40 AS t FROM events WHERE value >= 5.0)), d AS (SELECT DISTINCT user_id, round_even(t * 1000, 0)::BIGINT AS ms FROM (SELECT user_id, event_id % 40 AS t FROM events WHERE value < 5.0 OR value IS NULL))"""


@query(f"WITH {_TIMES} SELECT coalesce(a.user_id, d.user_id) AS user_id, coalesce(a.ms, d.ms) AS ms, CASE WHEN d.ms IS NULL THEN 'A_only' WHEN a.ms IS NULL THEN 'D_only' ELSE 'A_and_D' END AS source FROM a FULL JOIN d ON a.user_id = d.user_id AND a.ms = d.ms")
def hybrid_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "value", (F.col("event_id") % 40).cast("double").alias("t"))
    return policy.hybrid(e.where("value >= 5.0"), e.where("value < 5.0 OR value IS NULL"), ["user_id"], "t")


@query(f"WITH {_TIMES} SELECT 'a' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM d) UNION ALL SELECT 'd', * FROM (SELECT * FROM d EXCEPT SELECT * FROM a)")
def symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "value", (F.col("event_id") % 40 * 1000).alias("ms"))
    return policy.symmetric_difference(e.where("value >= 5.0").select("user_id", "ms"), e.where("value < 5.0 OR value IS NULL").select("user_id", "ms"), ("a", "d"))


@query(
    """WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents), t AS (SELECT *, 'top' AS sample, k AS rank FROM r WHERE k <= 5),
    o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 37) % 101, doc_id) AS j FROM r WHERE k > 5) SELECT source, doc_id, sample, rank FROM t UNION ALL SELECT source, doc_id, 'spread', j FROM o WHERE j <= 5"""
)
def stratified_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    out = policy.strata_samples(d.select("source", "doc_id", "n_chars"), ["source"], F.struct(-F.col("n_chars"), F.col("doc_id")), (F.col("doc_id") * 37) % 101, 5, 5)
    return out.select("source", "doc_id", "sample", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT clip_id, role, moment FROM (SELECT doc_id AS clip_id, 'start' AS role, doc_id::DOUBLE AS moment FROM documents UNION ALL SELECT doc_id, 'end', doc_id + n_chars / 100.0 FROM documents)""")
def clip_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.col("doc_id").cast("double").alias("start"), (F.col("doc_id") + F.col("n_chars") / F.lit(100.0)).alias("end"))
    return d.unpivot(["clip_id"], ["start", "end"], "role", "moment")


@query(
    """WITH r AS (SELECT user_id AS speaker, event_id, ts, value, event_type FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY value DESC, event_id) AS n FROM r)
    SELECT speaker, event_id, value FROM k WHERE n <= 3"""
)
def topn_per_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("speaker"), "event_id", "value")
    n = F.row_number().over(Window.partitionBy("speaker").orderBy(F.desc("value"), "event_id"))
    return e.withColumn("n", n).where("n <= 3").drop("n")


@query("SELECT user_id AS speaker, count(*) AS regions, round(sum(greatest(value, 0)), 4) AS seconds, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS sources FROM events GROUP BY user_id")
def speaker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("speaker"))
    return g.agg(F.count(F.lit(1)).alias("regions"), F.round(F.sum(F.greatest("value", F.lit(0.0))), 4).alias("seconds"), F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("sources"))

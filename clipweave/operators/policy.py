"""Boundary policies: gates, penalties and ranks over boundary evidence.

Evidence columns: role (start, end, internal), source (A_only, D_only, A_and_D), quiet_run_ms, quiet_before_ms, quiet_after_ms, rms_dbfs,
local_prominence_db, d_speech_prob, distance_to_scope_edge_ms, trusted_source_edge, base_score. A gate is a boolean column, a policy a score column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.functions.arrays import reasons

EPS = 1e-9


def _c(name: str) -> Column:
    return F.col(name)


def dangerous_side_ms() -> Column:
    """Quiet on the side where speech would be cut: before a start, after an end, the lesser inside."""
    return F.when(_c("role") == "start", _c("quiet_before_ms")).when(_c("role") == "end", _c("quiet_after_ms")).otherwise(F.least("quiet_before_ms", "quiet_after_ms"))


def min_quiet_run(ms: float) -> Column:
    return _c("quiet_run_ms") + EPS >= ms


def one_sided_gate(ms: float) -> Column:
    return dangerous_side_ms() + EPS >= ms


def one_sided_penalty(ms: float) -> Column:
    return _c("base_score") - F.greatest(F.lit(0.0), ms - dangerous_side_ms()) / max(ms, EPS)


def d_veto(prob: float = 0.5) -> Column:
    """False where the second detector hears speech."""
    return ~F.coalesce(_c("d_speech_prob") >= prob, F.lit(False))


def d_penalty(prob: float = 0.5, weight: float = 1.0) -> Column:
    return _c("base_score") - F.coalesce(F.greatest(F.lit(0.0), _c("d_speech_prob") - prob), F.lit(0.0)) * weight


def a_only_stronger_rms(threshold: float) -> Column:
    return (_c("source") != "A_only") | (_c("rms_dbfs") <= threshold)


def consensus_rank(both: float = 3.0, d_only: float = 2.0, a_only: float = 1.0) -> Column:
    return F.when(_c("source") == "A_and_D", both).when(_c("source") == "D_only", d_only).when(_c("source") == "A_only", a_only).otherwise(_c("base_score"))


def _at_edge(zone_ms: float) -> Column:
    return ~_c("trusted_source_edge") & (_c("distance_to_scope_edge_ms") < zone_ms)


def edge_penalty(zone_ms: float, penalty: float) -> Column:
    near = 1 - _c("distance_to_scope_edge_ms") / max(zone_ms, EPS)
    return F.when(_at_edge(zone_ms), _c("base_score") - penalty * near).otherwise(_c("base_score"))


def edge_zone(zone_ms: float) -> Column:
    return ~_at_edge(zone_ms)


def quiet_evidence() -> Column:
    """A score from quiet around the boundary, low level and prominence."""
    upto = lambda c, most, scale: F.least(_c(c), F.lit(most)) / scale
    return (
        _c("base_score") + upto("quiet_run_ms", 250.0, 250.0) + upto("quiet_before_ms", 120.0, 240.0) + upto("quiet_after_ms", 120.0, 240.0)
        + F.greatest(F.lit(0.0), -_c("rms_dbfs")) / 100.0 + F.greatest(F.lit(0.0), _c("local_prominence_db")) / 20.0
    )


def catastrophic_penalty(run_ms: float, side_ms: float, penalty: float = 1000.0) -> Column:
    bad = (_c("quiet_run_ms") < run_ms) | (dangerous_side_ms() < side_ms)
    return _c("base_score") - F.when(bad, penalty).otherwise(0.0)


def boundary_risk() -> Column:
    risk = lambda x, scale: F.greatest(F.lit(0.0), x) / scale
    return risk(80.0 - _c("quiet_run_ms"), 80.0) + risk(48.0 - dangerous_side_ms(), 48.0) + risk(_c("rms_dbfs") + 50.0, 50.0)


def d_primary(rows: DataFrame, keys: list[str], legal: Column) -> DataFrame:
    """Per key the rows of the second detector if there are any and a legal clip can be formed, else all."""
    has = rows.groupBy(*keys).agg(F.max(F.when(F.col("source") != "A_only", 1).otherwise(0)).alias("_d"), F.max(legal.cast("int")).alias("_l"))
    return rows.join(has, keys).where((F.col("_d") == 0) | (F.col("_l") == 0) | (F.col("source") != "A_only")).drop("_d", "_l")


def high_confidence(run_ms: float, side_ms: float) -> Column:
    """The first of two stages; the rest is the fallback."""
    return (_c("quiet_run_ms") >= run_ms) & (dangerous_side_ms() >= side_ms)


def gate_reasons(run_ms: float, side_ms: float, zone_ms: float, rms: float) -> Column:
    """Why a boundary is refused, in a fixed order."""
    return reasons(
        (~min_quiet_run(run_ms), f"quiet_run_lt_{run_ms:g}ms"), (~one_sided_gate(side_ms), f"dangerous_side_quiet_lt_{side_ms:g}ms"), (~d_veto(), "D_speech_veto"),
        (~a_only_stronger_rms(rms), "A_only_rms_not_strong_enough"), (~edge_zone(zone_ms), "scope_edge_hard_zone"),
    )


def safety_first(clips: DataFrame, n: int) -> DataFrame:
    """Clips by their larger boundary risk, then both, then retained speech, then id."""
    return clips.orderBy(F.greatest("start_risk", "end_risk"), F.col("start_risk") + F.col("end_risk"), F.desc("retained_speech_sec"), "clip_id").limit(n)


def duration_first(clips: DataFrame, n: int) -> DataFrame:
    """Clips by their length's penalty, then retained speech, then id."""
    return clips.orderBy("duration_penalty", F.desc("retained_speech_sec"), "clip_id").limit(n)


def hybrid(a: DataFrame, d: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Two detectors' boundaries met at the millisecond: keys, ms, source (A_only, D_only, A_and_D)."""
    ms = lambda df: df.select(*keys, F.bround(F.col(time) * 1000, 0).cast("bigint").alias("ms")).distinct()
    met = ms(a).withColumn("_a", F.lit(True)).join(ms(d).withColumn("_d", F.lit(True)), [*keys, "ms"], "full")
    return met.select(*keys, "ms", F.when(F.col("_d").isNull(), "A_only").when(F.col("_a").isNull(), "D_only").otherwise("A_and_D").alias("source"))


def symmetric_difference(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Distinct rows of one side that the other lacks, with the side's name."""
    return left.subtract(right).withColumn("side", F.lit(names[0])).unionByName(right.subtract(left).withColumn("side", F.lit(names[1])))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one multiset has more often than the other; none if they are equal."""
    return left.exceptAll(right).unionByName(right.exceptAll(left))


def union_tables(tables: dict[str, DataFrame], name: str = "config") -> DataFrame:
    """All tables, each row with its table's name; missing columns are null."""
    out = None
    for key, df in sorted(tables.items()):
        tagged = df.withColumn(name, F.lit(key))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def strata_samples(rows: DataFrame, keys: list[str], order: Column, draw: Column, top: int, spread: int) -> DataFrame:
    """Per stratum the ``top`` first rows and ``spread`` others by a draw: a sampling operator, by its definition.

    Both are ranks with a limit, which Spark also applies before the shuffle, so a large stratum is cut down where its rows are read.
    """
    cols = [c for c in rows.columns if c not in keys]
    keyed = rows.withColumn("_o", order).withColumn("_d", draw)
    w = Window.partitionBy(*keys).orderBy("_o", *cols)
    ranked = keyed.withColumn("_k", F.row_number().over(w))
    best = ranked.where(F.col("_k") <= top).withColumn("sample", F.lit("top"))
    rest = ranked.where(F.col("_k") > top).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_d", *cols))).where(F.col("_k") <= spread).withColumn("sample", F.lit("spread"))
    return best.unionByName(rest).select(*keys, *cols, "sample", F.col("_k").alias("rank"))

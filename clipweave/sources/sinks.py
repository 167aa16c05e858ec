"""Writers: canonical JSON lines, CSV, append logs, and multi-output exports that replace a target as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.operators.export import accepted, rejected


def sorted_columns(df: DataFrame) -> DataFrame:
    """Columns in order of their names, as canonical JSON has its keys."""
    return df.select(*sorted(df.columns))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with sorted keys; nulls are written as nulls."""
    sorted_columns(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """More lines of an append-only log."""
    write_json_lines(df, path, "append")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, target: str, problems: DataFrame | None = None) -> None:
    """Writes ``df`` beside the target and renames it there once whole; what was there is put back if that fails.

    All or nothing: rows in ``problems`` stop it before anything is written.
    """
    if problems is not None and not problems.isEmpty():
        raise ValueError("not published: " + "; ".join(str(r.asDict()) for r in problems.limit(5).collect()))
    spark = df.sparkSession
    tag = uuid.uuid4().hex[:8]
    staged, old = f"{target}.staged-{tag}", f"{target}.old-{tag}"
    df.write.parquet(staged)
    fs, t = _fs(spark, target)
    new, was = spark._jvm.org.apache.hadoop.fs.Path(staged), spark._jvm.org.apache.hadoop.fs.Path(old)
    had = fs.exists(t)
    if had and not fs.rename(t, was):
        fs.delete(new, True)
        raise OSError(f"{target} can't be replaced")
    if not fs.rename(new, t):
        if had:
            fs.rename(was, t)
        raise OSError(f"{target} can't be written")
    if had:
        fs.delete(was, True)


def write_export(exported: DataFrame, folder: str) -> None:
    """Accepted clips, and the audit of all others with its counts by reason, from one computed table."""
    exported.write.mode("overwrite").parquet(f"{folder}/decided")
    kept = exported.sparkSession.read.parquet(f"{folder}/decided")
    write_json_lines(accepted(kept).drop("reason"), f"{folder}/accepted", "overwrite")
    write_json_lines(rejected(kept), f"{folder}/audit", "overwrite")
    write_json_lines(rejected(kept).groupBy("reason").agg(F.count(F.lit(1)).alias("clips")), f"{folder}/summary", "overwrite")


def staged_problems(staged: DataFrame, key: str, hashes: tuple[str, str]) -> DataFrame:
    """What keeps staged rows from promotion: repeated ids and hashes that disagree."""
    twice = staged.groupBy(key).count().where("count > 1").select(F.col(key).cast("string").alias("id"), F.lit("repeated id").alias("problem"))
    a, b = hashes
    apart = staged.where(~F.col(a).eqNullSafe(F.col(b))).select(F.col(key).cast("string").alias("id"), F.lit("hashes disagree").alias("problem"))
    return twice.unionByName(apart)


def clear_downstream(spark: SparkSession, folder: str, stage: str, order: list[str]) -> list[str]:
    """Deletes the outputs of the stages after ``stage``; returns what was there."""
    gone = []
    for later in order[order.index(stage) + 1 :]:
        fs, p = _fs(spark, f"{folder}/{later}")
        if fs.exists(p):
            fs.delete(p, True)
            gone.append(later)
    return gone

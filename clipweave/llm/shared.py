"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of ``[\x20\x09-\x0D]``, the white space of the text contracts.
WHITE = " \t\n\x0b\x0c\r"
#: A Java pattern for a word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder on a local master only, since no cluster shares one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="clipweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_noted = threading.local()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/clipweave-{uuid.uuid4().hex}/{name}"
    if (paths := getattr(_noted, "paths", None)) is not None:
        paths.append(path)
    return path


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """A list that gets the scratch paths which this thread makes within; for ``release`` when what reads them is written elsewhere."""
    before, _noted.paths = getattr(_noted, "paths", None), []
    try:
        yield _noted.paths
    finally:
        _noted.paths = before


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables. Whatever still reads them fails."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends here, and a lost executor costs no earlier step. ``codec``: for tables of whole texts, one denser than the session's."""
    path = scratch(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``left`` joined to ``right``, which has one row per key, without a hot key: rows of a frequent key are salted, its row of ``right`` is repeated.

    Frequent are keys with over a hundred-thousandth of the rows, so fewer than 100,000 key hashes are broadcast whatever the data. ``by``: columns of ``left`` that salt.
    """
    name = F.xxhash64(*keys).alias("_key")
    most = max(256, left.count() // 100_000)
    hot = materialize(left.groupBy(name).count().where(F.col("count") > most).select("_key", F.ceil(F.col("count") / most).cast("int").alias("_parts")), "frequent")
    if hot.isEmpty():
        return left.join(right, keys)
    parts = F.coalesce("_parts", F.lit(1))
    salted = left.withColumn("_key", name).join(F.broadcast(hot), "_key", "left").withColumn("_salt", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_key", "_parts")
    repeated = right.withColumn("_key", name).join(F.broadcast(hot), "_key", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_key", "_parts")
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once instead of wherever ``body`` mentions it."""
    return F.transform(F.array(value), body)[0]


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) that depends on nothing but ``cols``, so reruns agree."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))

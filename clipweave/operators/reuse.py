"""Results of stages kept by the content of their input: a rerun computes only the keys whose input, settings or stage changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions.canonical import canonical_json
from clipweave.operators.written import written

Stage = Callable[[DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another run published a manifest meanwhile."""


def fingerprints(rows: DataFrame, key: str, settings: str = "") -> DataFrame:
    """key, fingerprint: a hash of each key's rows as a bag, whatever their order and that of their columns, and of ``settings``.

    A row counts by the SHA-256 of its canonical JSON; sums of its two halves and the number of rows are partially aggregated, so a key of any size needs no sorting and no one task.
    Columns are of types that ``canonical_json`` takes; cast others first.
    """
    one = F.sha2(canonical_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), rows.select(*sorted(rows.columns)).schema, ascii=True), 256)
    half = lambda at: F.sum(F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = rows.select(key, one.alias("_h")).groupBy(key).agg(F.count(F.lit(1)).cast("string").alias("n"), half(1).alias("a"), half(16).alias("b"), half(31).alias("c"), half(46).alias("d"))
    return sums.select(key, F.sha2(F.concat_ws(":", F.lit(settings), "n", "a", "b", "c", "d"), 256).alias("fingerprint"))


class StageStore:
    """Results of one stage under a folder that all executors share: data of each run, and numbered manifests (key, fingerprint, run) of which the last one counts."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The number of the last manifest, 0 before the first."""
        fs, p = self._fs(f"{self.folder}/manifests")
        if not fs.exists(p):
            return 0
        return max([0, *(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())])

    def manifest(self) -> DataFrame | None:
        n = self.version()
        return self.spark.read.parquet(f"{self.folder}/manifests/{n:08d}") if n else None

    def publish(self, manifest: DataFrame, after: int) -> None:
        """Makes ``manifest`` the next one after ``after``. It is written whole beside and renamed; where that number is taken, it's a conflict and nothing is published."""
        staged, target = f"{self.folder}/staged-{uuid.uuid4().hex}", f"{self.folder}/manifests/{after + 1:08d}"
        manifest.write.parquet(staged)
        fs, t = self._fs(target)
        fs.mkdirs(t.getParent())
        # The claim is a file that only one run can create.
        if not fs.createNewFile(self._fs(f"{self.folder}/claims-{after + 1:08d}")[1]) or fs.exists(t) or not fs.rename(self._fs(staged)[1], t):
            fs.delete(self._fs(staged)[1], True)
            raise Conflict(f"manifest {after + 1} is there already")

    def results(self) -> DataFrame:
        """The current results of all keys, each from the run that its manifest row names."""
        manifest = self.manifest()
        if manifest is None:
            raise ValueError("no run has been published")
        key = manifest.columns[0]
        runs = [r[0] for r in manifest.select("run").distinct().collect()]  # one per run since the last compaction
        data = self.spark.read.parquet(*[f"{self.folder}/data/{r}" for r in runs]) if runs else None
        return data.join(manifest.select(key, F.col("run").alias("_run")), [key, "_run"], "left_semi").drop("_run")


def reuse(store: StageStore, rows: DataFrame, key: str, stage: Stage, settings: str = "") -> tuple[DataFrame, dict[str, int]]:
    """``stage`` of ``rows``, with what earlier runs left for keys whose rows and ``settings`` are the same; and how many keys were kept, computed and gone.

    ``stage`` maps rows to rows with the column ``key`` and treats keys independently. Changed keys are an anti join of fingerprints; only their rows are read again and only
    their results are written, to a folder of this run's. A key without results is remembered as such. Null keys aren't stages' business and are left out.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    rows = rows.where(F.col(key).isNotNull())
    before, n = store.manifest(), store.version()
    now = written(fingerprints(rows, key, settings), "fingerprints")
    kept = before.join(now, [key, "fingerprint"], "left_semi") if before is not None else None
    changed = written(now.join(kept, key, "left_anti") if kept is not None else now, "changed")
    made = stage(rows.join(changed.select(key), key, "left_semi")).withColumn("_run", F.lit(run))
    entries = changed.withColumn("run", F.lit(run))
    counts = {"computed": changed.count(), "kept": kept.count() if kept is not None else 0}
    counts["gone"] = (before.join(now, key, "left_anti").count() if before is not None else 0)
    if counts["computed"] or counts["gone"] or before is None:
        made.write.parquet(f"{store.folder}/data/{run}")
        store.publish(entries.unionByName(kept) if kept is not None else entries, n)
    return store.results(), counts

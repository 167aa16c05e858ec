"""Global order without one task: row numbers and running sums over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.operators.written import written


def with_row_number(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with each row's number in a total order from 1, and the count of rows.

    Rows are range-partitioned by ``order``; each partition's rows are numbered by a window of its own and shifted by the
    sizes of the partitions before it, which is one number per partition on the driver. Ties within ``order`` are numbered
    arbitrarily, so name a total order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    keyed = written(keyed, "numbered")  # the cut of the ranges is drawn from the data: both uses see one cut
    sizes = {r[0]: r[1] for r in keyed.groupBy("_part").count().collect()}
    shift, total = [], 0
    for p in sorted(sizes):
        shift += [F.lit(p), F.lit(total)]
        total += sizes[p]
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    offset = F.create_map(*shift)[F.col("_part")] if shift else F.lit(0)
    return keyed.withColumn(name, (local + offset).cast("bigint")).drop("_part"), total


def running_sums(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum of its value over the rows up to each, in a total order, as ``with_row_number`` orders them; one pass carries all sums."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).withColumns({f"_v_{k}": v for k, v in values.items()})
    keyed = written(keyed, "summed")
    parts = sorted(keyed.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(k) for k in values]).collect(), key=lambda r: r["_part"])
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for k in values:
        shift, total = [], 0
        for r in parts:
            shift += [F.lit(r["_part"]), F.lit(total).cast(keyed.schema[f"_v_{k}"].dataType)]
            total += r[k] or 0
        out[k] = F.sum(f"_v_{k}").over(before) + (F.create_map(*shift)[F.col("_part")] if shift else F.lit(0))
    return keyed.withColumns(out).drop("_part", *[f"_v_{k}" for k in values])


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, order, {name: value})

"""Exact order statistics of keys of any size, comparison of two backends' frames by them, and the listing of a project's slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipweave.functions.numeric import fused
from clipweave.operators.ordering import with_row_number
from clipweave.operators.written import written

#: Values of a key that are sorted as one array; keys of more are narrowed by counting first.
HELD = 50_000
#: Ranges that a round of counting cuts a range in.
CUTS = 1024


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], held: int = HELD) -> DataFrame:
    """Per key: n, and for each name the value at index round(q * (n - 1)) of the ordered ones, half to even. Nulls and NaN don't count; keys without values are left out.

    A key of up to ``held`` values is one sorted array. In a larger one each quantile has a range of values that it lies in; a round counts the values of equal parts of the range and
    keeps the part that holds the index, until it has few enough values. A key is large with over a hundred-thousandth of all rows too, so under 100,000 keys' ranges are broadcast.
    """
    x = F.col(value).cast("double")
    rows = rows.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    stats = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")), "rank_stats")
    held = max(held, (stats.agg(F.sum("n")).first()[0] or 0) // 100_000)
    index = lambda q: F.bround((F.col("n") - 1) * F.lit(float(q)), 0).cast("long")
    large = F.broadcast(stats.where(F.col("n") > held).select(*[F.col(k).alias(f"_k_{k}") for k in keys]))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    ordered = rows.join(large, same, "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list("_x")).alias("_v")).withColumn("n", F.size("_v").cast("long"))
    out = ordered.select(*keys, "n", *[F.element_at("_v", (index(q) + 1).cast("int")).alias(name) for name, q in quantiles.items()])
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), index(q).alias("at")) for name, q in quantiles.items()])).alias("w")
    open_ = stats.where(F.col("n") > held).select(*keys, "n", "lo", "hi", wanted).select(*keys, "n", "w.name", F.col("w.at").alias("at"), "lo", "hi", F.col("n").alias("inside"))
    if open_.isEmpty():
        return out
    found = None
    while True:
        # ``at``: the index within the range; ``inside``: how many values the range has.
        open_ = written(open_, "rank_ranges")
        small = open_.where((F.col("inside") <= held) | (F.col("lo") == F.col("hi")))
        here = _beside(rows, small.where("lo < hi"), keys).groupBy(*keys, "n", "name", "at").agg(F.array_sort(F.collect_list("_x")).alias("_v"))
        here = here.select(*keys, "n", "name", F.element_at("_v", (F.col("at") + 1).cast("int")).alias("v")).unionByName(small.where("lo = hi").select(*keys, "n", "name", F.col("lo").alias("v")))
        found = here if found is None else found.unionByName(here)
        open_ = open_.where((F.col("inside") > held) & (F.col("lo") < F.col("hi")))
        if open_.isEmpty():
            break
        part = F.least(F.floor((F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * CUTS), F.lit(CUTS - 1)).cast("int")
        counts = _beside(rows, open_, keys).groupBy(*keys, "n", "name", "at", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        parts = counts.groupBy(*keys, "n", "name", "at").agg(F.array_sort(F.collect_list(F.struct("part", "c", "lo", "hi"))).alias("p"))  # CUTS at most
        zero = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("struct<part:int,c:long,lo:double,hi:double>").alias("hit"), F.lit(0).cast("long").alias("skip"))

        def pick(s, p):
            hit = s["hit"].isNull() & (s["before"] + p["c"] > F.col("at"))
            return F.struct((s["before"] + p["c"]).alias("before"), F.when(hit, p).otherwise(s["hit"]).alias("hit"), F.when(hit, s["before"]).otherwise(s["skip"]).alias("skip"))

        picked = parts.withColumn("s", F.aggregate("p", zero, pick))
        open_ = picked.select(*keys, "n", "name", (F.col("at") - F.col("s.skip")).alias("at"), F.col("s.hit.lo").alias("lo"), F.col("s.hit.hi").alias("hi"), F.col("s.hit.c").alias("inside"))
    wide = found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in quantiles])
    return out.unionByName(wide)


def _beside(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the ranges of their key that they lie in."""
    r = F.broadcast(ranges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n", "name", "at", "lo", "hi"))
    inside = (F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi"))
    for k in keys:
        inside &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(r, inside).drop(*[f"_k_{k}" for k in keys])


def with_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """``rows`` with, for each name, the quantile of their key's values between the two neighbours of (n - 1) * q, as low * (1 - d) + high * d with a fused
    multiply-add, so that a threshold made of it is the same to the last bit. Nulls don't count; a key without values has null.

    Windows over one partitioning: a key's rows are sorted, not gathered.
    """
    own = Window.partitionBy(*keys)
    out = rows.withColumn("_k", F.row_number().over(own.orderBy(F.asc_nulls_last(value))) - 1).withColumn("_n", F.count(value).over(own))
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    beside = {f"_{name}_{side}": F.max(F.when(F.col("_k") == place(at(q)), F.col(value).cast("double"))).over(own) for name, q in quantiles.items() for side, place in (("low", F.floor), ("high", F.ceil))}
    out = out.withColumns(beside)
    for name, q in quantiles.items():
        low, high, d = F.col(f"_{name}_low"), F.col(f"_{name}_high"), at(q) - F.floor(at(q))
        out = out.withColumn(name, F.when(d == 0, low).otherwise(fused(low, 1 - d, high * d)))
    return out.drop("_k", "_n", *beside)


def compare_frames(one: DataFrame, two: DataFrame, key: str, threshold: float = 0.5, held: int = HELD) -> DataFrame:
    """Per key: how two backends' frames differ. Frames (key, frame, time, prob) meet by their number.

    frames, max, mean, p50, p95 and p99 of the absolute differences to 9 places (0 without frames), changed decisions at the threshold, and what makes them incomparable: unmatched frames, and moved ones of another time.
    """
    side = lambda d, n: d.select(key, "frame", F.col("time").alias(f"time_{n}"), F.col("prob").alias(f"prob_{n}"))
    both = side(one, 1).join(side(two, 2), [key, "frame"], "full")
    both = written(both.withColumn("d", F.abs(F.col("prob_1") - F.col("prob_2"))), "frame_pairs")
    missing = F.col("time_1").isNull() | F.col("time_2").isNull()
    flips = (F.col("prob_1") >= threshold) != (F.col("prob_2") >= threshold)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    sums = both.groupBy(key).agg(F.count("d").alias("frames"), F.max("d").alias("max"), F.avg("d").alias("mean"), count(flips).alias("changed"), count(missing).alias("unmatched"), count(F.coalesce(F.col("time_1") != F.col("time_2"), F.lit(False))).alias("moved"))
    ranks = nearest_ranks(both, [key], "d", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, held).drop("n")
    out = sums.join(ranks, key, "left")
    return out.select(key, "frames", *[F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("max", "mean", "p50", "p95", "p99")], "changed", "unmatched", "moved")


def project_slices(slices: DataFrame, recordings: DataFrame) -> DataFrame:
    """Slices of each project that aren't superseded, with their place (from 1) by project, recording, order index, time of creation and id.

    slices: id, recording, created_at, metadata (JSON text, which may be null or broken: neither superseded nor ordered); recordings: recording, project.
    """
    flag = F.lower(F.get_json_object("metadata", "$.is_superseded"))
    dropped = F.coalesce(~flag.isin("false", "0", "null", ""), F.lit(False))
    order = F.coalesce(F.get_json_object("metadata", "$.order_index").try_cast("int"), F.lit(0))
    listed = slices.join(recordings, "recording").where(~dropped).withColumn("order_index", order)
    out, _ = with_row_number(listed, ["project", "recording", "order_index", "created_at", "id"], "place")
    return out

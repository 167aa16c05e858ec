"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target is its weighted share of all words, at most ``max_epochs`` times its own size; what a stopped source
leaves is shared again by weight among the others (water filling, in closed form over the list of sources). A document is
due target / source_size copies: the whole part is certain, the fraction is rounded by pivotal steps. A step takes two
documents with fractions p, q and sizes v, w and moves words between them, keeping v*p + w*q, until one fraction is 0 or 1;
which way is drawn so that each expectation is kept. Groups of about ``fan_in`` documents of a source fold to one residual
document each; the residuals form the next level of the tree, until one is left per source. It is drawn together with some
documents kept back, the largest first: what a draw adds or takes, those that follow give or take. So a source misses its target by
about the size of its smallest documents; where its documents are so few and unequal that no choice of them comes near, by what the choice leaves.

Draws are hashes of the ids and the seed: reruns agree. Groups are salted, so a source with a third of all rows is spread
like any other.

Defined results: a null text or one without words has size 0 and takes 0. A null source is a source of its own, last in
order. Rows that repeat a (source, doc_id) are one unit for rounding: all are taken equally often. Empty tables give
empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.llm.shared import WORD, let, materialize, uniform


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3.0) -> DataFrame:
    """Per source (columns source, source_size): its weight and target. ``sizes`` has one row per source."""
    in_order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    rising = Window.orderBy("level", F.col("source").isNull(), "source")
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("water", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    # The water level is that of the first source, from the fullest, that stays below its cap.
    s = s.withColumn("tau", F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "water"))).over(everything)["water"])
    return s.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("tau") * F.col("weight"), F.col("cap"))).alias("target"))


def _step(state: Column, x: Column, seed: int) -> Column:
    """One pivotal step: the residual ``state.r`` meets ``x``; decided documents join ``state.out`` as (id, up)."""

    def meet(m: Column) -> Column:
        a, b = m["a"], m["b"]
        to_a = F.least((1 - a["p"]) * a["w"], b["p"] * b["w"])
        to_b = F.least(a["p"] * a["w"], (1 - b["p"]) * b["w"])

        def move(t: Column) -> Column:
            first = uniform(a["id"], b["id"], F.lit(seed)) * (t["to_a"] + t["to_b"]) < t["to_b"]
            a_full = (1 - a["p"]) * a["w"] <= b["p"] * b["w"]  # towards a: a fills up, or b runs out
            a_out = a["p"] * a["w"] <= (1 - b["p"]) * b["w"]  # towards b: a runs out, or b fills up
            pa = F.when(first, F.when(a_full, 1.0).otherwise(a["p"] + t["to_a"] / a["w"])).otherwise(F.when(a_out, 0.0).otherwise(a["p"] - t["to_b"] / a["w"]))
            pb = F.when(first, F.when(a_full, b["p"] - t["to_a"] / b["w"]).otherwise(0.0)).otherwise(F.when(a_out, b["p"] + t["to_b"] / b["w"]).otherwise(1.0))
            # Only what rounding left beside 0 or 1 is snapped to it.
            snap = lambda p: F.when(p < 1e-12, 0.0).when(p > 1 - 1e-12, 1.0).otherwise(p)
            return F.struct(snap(pa).alias("pa"), snap(pb).alias("pb"))

        def settle(q: Column) -> Column:
            done = lambda y, p: F.when(p.isin(0.0, 1.0), F.array(F.struct(y["id"].alias("id"), p.cast("int").alias("up")))).otherwise(F.expr("cast(array() as array<struct<id:bigint,up:int>>)"))
            left = lambda y, p: F.struct(y["id"].alias("id"), y["w"].alias("w"), p.alias("p"))
            rest = F.when(~q["pa"].isin(0.0, 1.0), left(a, q["pa"])).when(~q["pb"].isin(0.0, 1.0), left(b, q["pb"]))
            return F.struct(rest.alias("r"), F.concat(state["out"], done(a, q["pa"]), done(b, q["pb"])).alias("out"))

        return let(let(F.struct(to_a.alias("to_a"), to_b.alias("to_b")), move), settle)

    return F.when(state["r"].isNull(), F.struct(x.alias("r"), state["out"].alias("out"))).otherwise(let(F.struct(state["r"].alias("a"), x.alias("b")), meet))


def _fold(rows: DataFrame, seed: int, name: str) -> DataFrame:
    """Folds each (source, g) from its earliest, then largest unit on; column f has the residual r and the decided units out."""
    zero = F.expr("named_struct('r', cast(null as struct<id:bigint,w:double,p:double>), 'out', cast(array() as array<struct<id:bigint,up:int>>))")
    members = F.sort_array(F.collect_list(F.struct("late", (-F.col("w")).alias("size"), F.xxhash64("id", F.lit(seed)).alias("h"), "id", "w", "p")))
    units = F.transform(members, lambda m: F.struct(m["id"].alias("id"), m["w"].alias("w"), m["p"].alias("p")))
    return materialize(rows.groupBy("source", "g").agg(F.aggregate(units, zero, lambda s, x: _step(s, x, seed)).alias("f")), name)


def pivotal_round(units: DataFrame, fan_in: int = 48, closing: int = 256, seed: int = 17) -> DataFrame:
    """``units``: source, id, w > 0 and 0 < p < 1. Returns source, id, up (0 or 1) of each; per source the sum of w*up stays within one unit's w of that of w*p.

    About ``closing`` units of each source are kept for the end, where the tree's residual, which tends to be a large document,
    is drawn before them (``_close``).
    """
    counts = units.groupBy("source").count()
    most = counts.agg(F.max("count")).first()[0] or 0
    of = counts.select(F.col("source").alias("s"), F.ceil(F.col("count") / closing).alias("parts"), F.ceil(F.col("count") / fan_in).alias("groups"))
    rows = units.select("source", "id", F.col("w").cast("double").alias("w"), F.col("p").cast("double").alias("p"))
    rows = rows.join(of, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("closes", F.pmod(F.xxhash64("id", F.lit(seed - 1)), F.col("parts")) == 0)
    decided, level, left = [], 0, rows.where(~F.col("closes"))
    while most > closing:
        salted = left.withColumn("g", F.pmod(F.xxhash64("id", F.lit(seed + level)), F.col("groups"))).withColumn("late", F.lit(0))
        folded = _fold(salted, seed, f"pivotal_{level}")
        decided.append(folded)
        most = -(-most // fan_in)
        left = folded.where(F.col("f.r").isNotNull()).select("source", "f.r.id", "f.r.w", "f.r.p")
        if most <= 1:
            break
        level += 1
        of = of.withColumn("groups", F.ceil(F.col("groups") / fan_in))
        left = left.join(of, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rest = rows.where("closes").select("source", "id", "w", "p", F.lit(1).alias("late"))
    if decided:
        rest = left.select("source", "id", "w", "p", F.lit(0).alias("late")).unionByName(rest)
    last = _close(rest, seed)
    ups = last.select("source", F.explode("out").alias("o")).select("source", "o.id", "o.up")
    for d in decided:
        ups = ups.unionByName(d.select("source", F.explode("f.out").alias("o")).select("source", "o.id", "o.up"))
    return ups


def _close(rows: DataFrame, seed: int) -> DataFrame:
    """Decides what is left of each source (source, id, w, p, late), the earliest and then largest first: each is drawn against all that follow.

    What a draw adds or takes, the following give or take in proportion to their sizes, so the words due are kept. Where they can't, as they are all full or empty then, the draw
    that they can make up for is taken, or the one that leaves less.
    """
    members = F.sort_array(F.collect_list(F.struct("late", (-F.col("w")).alias("size"), F.xxhash64("id", F.lit(seed)).alias("h"), "id", "w", "p")))
    whole = rows.groupBy("source").agg(members.alias("members"), F.sum("w").alias("words"), F.sum(F.col("w") * F.col("p")).alias("due"))
    zero = F.struct(F.col("due").alias("due"), F.col("words").alias("words"), F.expr("cast(array() as array<struct<id:bigint,up:int>>)").alias("out"))

    def draw(s: Column, m: Column) -> Column:
        after, slack = s["words"] - m["w"], 1e-9 * s["words"]
        can, may_not = s["due"] >= m["w"] - slack, s["due"] <= after + slack
        odds = F.when(m["late"] == 0, m["p"]).otherwise(s["due"] / s["words"])
        up = F.when(can & may_not, uniform(m["id"], F.lit(seed + 99)) < odds).when(can, True).when(may_not, False).otherwise(m["w"] - s["due"] < s["due"] - after)

        def take(u: Column) -> Column:
            return F.struct((s["due"] - u * m["w"]).alias("due"), after.alias("words"), F.concat(s["out"], F.array(F.struct(m["id"].alias("id"), u.alias("up")))).alias("out"))

        return let(up.cast("int"), take)

    return materialize(whole.select("source", F.aggregate("members", zero, draw)["out"].alias("out")), "pivotal_close")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fan_in: int = 48, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken (size * copies)."""
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size")), "mix_sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    targets = materialize(targets, "mix_targets").withColumnRenamed("source", "of_source")
    due = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_epochs)))).otherwise(0.0)
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("due", due).withColumn("whole", F.floor("due"))
    p = F.col("due") - F.col("whole")
    units = rows.where((F.col("size") > 0) & (p > 1e-12)).groupBy("source", F.col("doc_id").alias("id")).agg(F.sum("size").alias("w"), F.first(p).alias("p"))
    ups = pivotal_round(materialize(units, "mix_units"), fan_in, seed=seed).select(F.col("source").alias("s"), "id", "up")
    out = rows.join(ups, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("s")), "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("up", F.lit(0))).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` repeated as ``mix`` decides; rows that it takes no times go."""
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    copies = mix(docs, **options).where("copies > 0").select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), "copies").distinct()
    both = docs.join(copies.withColumnRenamed("copies", "mix_copies"), F.col(id_col).eqNullSafe(F.col("mix_id")) & F.col(source_col).cast("string").eqNullSafe(F.col("mix_source")))
    return both.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*[docs[c] for c in docs.columns])

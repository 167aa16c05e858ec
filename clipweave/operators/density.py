"""Density clusters of one search's vectors: HDBSCAN as Spark jobs.

Core distances and the edges of the mutual-reachability tree come from passes in which a task holds one block of points, with a
running result for each, and reads all points past it from the shared folder; nothing but that result leaves the task. A core distance is found by
counting in ranges that narrow, so that its rank costs no memory. The tree grows by Boruvka
rounds: every component picks its least outgoing edge by an aggregate, and picks are followed by joins. The tree's edges are then merged in order of
length, a bounded run of them per task, between which a point carries its component; of that, only the clusters' masses and births are
gathered, after a count. Squared distances have 9 places and ties go to smaller ids, so the tree is unique.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipweave.functions.arrays import doubles, unit
from clipweave.operators.ordering import with_row_number
from clipweave.operators.written import written

#: Points in a block and the least that it is made of, guests that a block meets at once, edges merged in one task, and clusters that may be gathered.
BLOCK, LEAST_BLOCK, GUESTS, EDGES, CLUSTERS = 4096, 64, 256, 100_000, 100_000
#: Squared distances count in ``SCALE`` parts of one; those of vectors of length 1 are under ``FAR`` of them.
SCALE, FAR = 1e9, 1 << 33
#: Parts that a range of distances is counted in, and distances in range that a block holds at most.
PARTS, HELD = 64, 1 << 22


class _Part:
    """Points as arrays: id, v, squares, and the further columns by name."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, more: dict[str, np.ndarray]):
        self.id, self.v, self.more = ids, v, more
        self.squares = (v * v).sum(1)

    def at(self, rows) -> _Part:
        return _Part(self.id[rows], self.v[rows], {k: x[rows] for k, x in self.more.items()})

    def squared_distances(self, other: _Part) -> np.ndarray:
        """In whole parts of ``SCALE``."""
        d = self.v @ other.v.T
        d *= -2
        d += self.squares[:, None]
        d += other.squares
        np.maximum(d, 0, out=d)
        d *= SCALE
        return np.rint(d, out=d)


class _Core:
    """The range [lo, hi) of the squared distance to a point's nearest other point but ``index``, narrower than before.

    A point without a range (hi is 0) takes one that its own block, a random part of all points, makes likely. Distances below the range and in its parts are
    counted, so the new range is certain; those within it are kept while a block holds few enough, and then the distance itself is found.
    """

    schema, needs = "id long, lo long, hi long", ()

    def __init__(self, index: int, n: int):
        self.index, self.n = index, n

    def start(self, own: _Part) -> dict:
        own = own.at(np.flatnonzero(own.more["hi"] - own.more["lo"] != 1))
        m = len(own.id)
        lo, hi = own.more["lo"].copy(), own.more["hi"].copy()
        if m and not hi[0]:
            hi[:] = FAR
            share = (self.index + 0.5) / (self.n - 1)
            rank, width = share * (m - 1), 3 * math.sqrt(share * (1 - min(share, 1)) * (m - 1)) + 2
            first, last = math.floor(rank - width), math.ceil(rank + width)
            for k in range(0, m, GUESTS):
                d = np.sort(own.at(slice(k, k + GUESTS)).squared_distances(own), 1)
                # The point itself comes first here, so an other point's rank is one more.
                if 0 < first and first + 1 < m:
                    lo[k : k + GUESTS] = d[:, first + 1]
                if last + 1 < m:
                    hi[k : k + GUESTS] = d[:, last + 1] + 1
        step = np.exp2(np.ceil(np.log2(np.maximum((hi - lo) / PARTS, 1))))
        return {"own": own, "lo": lo, "hi": hi, "step": step, "below": np.zeros(m, np.int64), "parts": np.zeros((m, PARTS), np.int64), "held": [], "n": 0}

    def meet(self, s: dict, guests: _Part) -> None:
        own = s["own"]
        if not len(own.id):
            return
        d = own.squared_distances(guests)
        _, at, other = np.intersect1d(own.id, guests.id, assume_unique=True, return_indices=True)
        d[at, other] = np.inf
        low = d < s["lo"][:, None]
        s["below"] += np.count_nonzero(low, 1)
        row, col = np.nonzero((d < s["hi"][:, None]) & ~low)
        found = d[row, col] - s["lo"][row]
        part = (found / s["step"][row]).astype(np.int64)  # steps are powers of two
        s["parts"] += np.bincount(row * PARTS + part, minlength=s["parts"].size).reshape(s["parts"].shape)
        s["n"] += len(row)
        if s["n"] <= HELD:
            s["held"].append((row, found))
        else:
            s["held"].clear()

    def result(self, s: dict) -> pa.RecordBatch:
        lo, hi, below, step = s["lo"], s["hi"], s["below"], s["step"].astype(np.int64)
        upto = below[:, None] + s["parts"].cumsum(1)
        part = (upto <= self.index).sum(1)
        inside = (below <= self.index) & (part < PARTS)
        first = np.where(inside, lo + np.minimum(part, PARTS - 1) * step, np.where(below > self.index, 0, hi))
        end = np.where(inside, np.minimum(first + step, hi), np.where(below > self.index, lo, FAR))
        if s["held"] and s["n"] <= HELD:
            row, found = (np.concatenate(x) for x in zip(*s["held"], strict=True))
            order = np.lexsort((found, row))
            begins = np.searchsorted(row[order], np.arange(len(lo)))
            which = np.flatnonzero(inside)
            first[which] = lo[which] + found[order[begins[which] + self.index - below[which]]].astype(np.int64)
            end[which] = first[which] + 1
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (s["own"].id, first, end)], ["id", "lo", "hi"])


class _Outgoing:
    """A point's least edge to another component: by mutual reachability, then by the ids of its ends.

    No edge is shorter than the core distance at its end. So a point whose edge is as short as that looks only for smaller ids, and one whose core distance is over the
    best edge of its component in the block looks no further: it may tell a longer edge than its least, or none, but never where that is its component's least.
    """

    schema, needs = "comp long, reach double, lo long, hi long, other long", ("core", "comp")

    def start(self, own: _Part) -> dict:
        n = len(own.id)
        comps, group = np.unique(own.more["comp"], return_inverse=True)
        return {"own": own, "reach": np.full(n, np.inf), "to": np.full(n, np.iinfo(np.int64).max), "other": np.zeros(n, np.int64), "group": group, "best": np.full(len(comps), np.inf)}

    def meet(self, s: dict, guests: _Part) -> None:
        core = s["own"].more["core"]
        open_ = (core <= s["best"][s["group"]]) & ((core < s["reach"]) | (guests.id[0] < s["to"]))  # guests rise by id
        rows = np.flatnonzero(open_)
        if not len(rows):
            return
        own = s["own"] if len(rows) == len(core) else s["own"].at(rows)
        reach = own.squared_distances(guests)  # ties go to the smaller id
        np.maximum(reach, own.more["core"][:, None], out=reach)
        np.maximum(reach, guests.more["core"], out=reach)
        reach[own.more["comp"][:, None] == guests.more["comp"]] = np.inf
        j = reach.argmin(1)
        least = reach[np.arange(len(j)), j]
        better = np.flatnonzero((least < s["reach"][rows]) | (np.isfinite(least) & (least == s["reach"][rows]) & (guests.id[j] < s["to"][rows])))
        at, j = rows[better], j[better]
        for name, found in (("reach", least[better]), ("to", guests.id[j]), ("other", guests.more["comp"][j])):
            s[name][at] = found
        np.minimum.at(s["best"], s["group"][at], s["reach"][at])

    def result(self, s: dict) -> pa.RecordBatch:
        fine = np.isfinite(s["reach"])
        a, b = s["own"].id[fine], s["to"][fine]
        columns = s["own"].more["comp"][fine], s["reach"][fine] / SCALE, np.minimum(a, b), np.maximum(a, b), s["other"][fine]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["comp", "reach", "lo", "hi", "other"])


def _packed(rows: DataFrame, columns: list[str], blocks: int) -> DataFrame:
    """One row a block of points: ``block`` and the columns (numbers, or vectors of doubles) as bytes, by id."""
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", *[c for c in columns if c != "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([b"".join(x)], pa.binary()) for x in zip(*held, strict=True)]], ["block", *columns])

        block, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if at[lo] != block:
                    if held:
                        yield out()
                    block, held = at[lo], []
                part = [b.column(c).slice(lo, hi - lo) for c in columns]
                held.append([(x.flatten() if pa.types.is_list(x.type) else x).to_numpy(zero_copy_only=False).tobytes() for x in part])
        if held:
            yield out()

    return rows.repartition("block").sortWithinPartitions("block", "id").mapInArrow(run, ", ".join(["block int", *[f"{c} binary" for c in columns]]))


def _folded(fold, types: dict[str, str]) -> Callable:
    """Rows of a block (id, v, the named columns) and a block of guests (the same as g_, those that the fold needs) to ``fold``'s result of each block."""

    def part(columns: dict, i: int, prefix: str, names) -> _Part:
        raw = lambda c, t: np.frombuffer(columns[prefix + c][i].as_buffer(), t)
        ids = raw("id", "i8")
        return _Part(ids, raw("v", "f8").reshape(len(ids), -1), {c: raw(c, types[c]) for c in names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = {}
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            for i, block in enumerate(columns["block"].to_pylist()):
                if block not in states:
                    states[block] = fold.start(part(columns, i, "", types))
                guests = part(columns, i, "g_", fold.needs)
                for k in range(0, len(guests.id), GUESTS):
                    fold.meet(states[block], guests.at(slice(k, k + GUESTS)))
        for s in states.values():
            yield fold.result(s)

    return run


def _beside_all(vectors: DataFrame, more: DataFrame, types: dict[str, str], fold, blocks: int) -> DataFrame:
    """``fold`` over every block of points beside all points. vectors: ``_packed`` id and v; more: the points' id and the columns of ``types``.

    A task has one block and reads all blocks past it, one at a time, from the shared folder: what is shuffled and written is each point once, whatever the number of blocks.
    """
    each = vectors.join(_packed(more, list(types), blocks), "block").repartitionByRange(blocks, "block")
    each = written(each, "blocks")  # a block a file, so that no more is in memory
    guests = each.select(*[F.col(c).alias(f"g_{c}") for c in ("id", "v", *fold.needs)]).coalesce(1)
    rows = guests.hint("shuffle_replicate_nl").crossJoin(each.repartitionByRange(blocks, "block"))
    return rows.mapInArrow(_folded(fold, types), fold.schema)


def _cores(vectors: DataFrame, points: DataFrame, index: int, n: int, blocks: int) -> DataFrame:
    """Points' id and core, the squared distance (in parts of ``SCALE``) to their nearest other point but ``index``."""
    zero = F.lit(0).cast("long")
    found, ranges = None, points.select("id", zero.alias("lo"), zero.alias("hi"))
    while True:
        new = written(_beside_all(vectors, ranges, {"lo": "i8", "hi": "i8"}, _Core(index, n), blocks), "ranges")
        done = new.where("hi - lo = 1").select("id", F.col("lo").cast("double").alias("core"))
        found = done if found is None else found.unionByName(done)
        if new.where("hi - lo > 1").isEmpty():
            return written(found, "core")
        # Points that are done stay in their block, where they count as others.
        one = F.lit(1).cast("long")
        ranges = written(new.where("hi - lo > 1").unionByName(found.select("id", F.col("core").cast("long").alias("lo"), (F.col("core").cast("long") + one).alias("hi"))), "open")


def _tree(vectors: DataFrame, core: DataFrame, n: int, blocks: int) -> DataFrame:
    """The minimum spanning tree (reach, lo, hi) by mutual reachability of points, of ``core`` (id, core); every round at least halves the components."""
    member = core.withColumn("comp", F.col("id"))
    edges = None
    for _ in range(n.bit_length() + 1):
        near = _beside_all(vectors, member, {"core": "f8", "comp": "i8"}, _Outgoing(), blocks)
        picks = written(near.groupBy("comp").agg(F.min(F.struct("reach", "lo", "hi", "other")).alias("p")).select("comp", "p.*"), "picks")
        new = picks.select("reach", "lo", "hi").distinct()
        edges = new if edges is None else edges.unionByName(new)
        back = picks.select(F.col("comp").alias("other"), F.col("other").alias("again"))
        root = (F.col("again") == F.col("comp")) & (F.col("comp") < F.col("other"))  # two that picked each other
        up = written(picks.join(back, "other").select("comp", F.when(root, F.col("comp")).otherwise(F.col("other")).alias("to")), "up")
        moved = True
        while moved:
            above = up.select(F.col("comp").alias("to"), F.col("to").alias("next"))
            jumped = written(up.join(above, "to").select("comp", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "jumped")
            moved, up = not jumped.where("moved").isEmpty(), jumped.drop("moved")
        if up.where("comp = to").count() == 1:
            break
        member = written(member.join(up, "comp").select("id", "core", F.col("to").alias("comp")), "member")
    return written(edges, "tree")


_TOLD = "kind string, a long, b long, n long, cluster long, out long, x double"


def _merged(least: int) -> Callable:
    """Edges in order (at, reach, and comp, size and cluster of both ends) to what they make of it.

    kind comp: component a is now in b, of n points and that cluster, and a's points left their first cluster, ``out``, in this run; mass: cluster a has lost points
    of summed density x; born: cluster a of n points came out of b at density x.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, size, cluster, small, out = {}, {}, {}, {}, {}
        mass, born = defaultdict(float), []

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for at, reach, *ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for c, s, k in (ends[:3], ends[3:]):
                    if c not in up:
                        up[c], size[c], cluster[c], small[c] = c, s, k, [c] if k is None else []
                x, y = sorted((root(ends[0]), root(ends[3])), key=size.__getitem__, reverse=True)
                density, n = 1 / max(math.sqrt(reach), 1e-12), size[x] + size[y]
                if cluster[y] is not None:
                    born += [(cluster[c], at, size[c], density) for c in (x, y)]
                    cluster[x] = at
                    mass[at] += n * density
                elif cluster[x] is not None:
                    mass[cluster[x]] += size[y] * density
                    out.update(dict.fromkeys(small[y], cluster[x]))
                else:
                    small[x].extend(small[y])
                    if n >= least:
                        cluster[x] = at
                        mass[at] += n * density
                        out.update(dict.fromkeys(small[x], at))
                        small[x] = []
                up[y], size[x] = x, n
        roots = {c: root(c) for c in up}
        rows = [("comp", c, r, size[r], cluster[r], out.get(c), None) for c, r in roots.items()]
        rows += [("mass", c, None, None, None, None, x) for c, x in mass.items()] + [("born", c, p, n, None, None, x) for c, p, n, x in born]
        types = [pa.string(), *[pa.int64()] * 5, pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["kind", "a", "b", "n", "cluster", "out", "x"])

    return run


def _chosen(mass: dict[int, float], born: dict[int, tuple[int, int, float]]) -> dict[int, int]:
    """Cluster to the most stable cluster that holds it, if any. Clusters are numbered from the densest up; born: to parent, points and density at birth."""
    kids, best, picked = defaultdict(list), {}, set()
    for c, (parent, _, _) in born.items():
        kids[parent].append(c)
    for c in sorted(mass):
        below = math.fsum(best[k] for k in kids[c])
        own = mass[c] - born[c][1] * born[c][2] if c in born else None
        if own is not None and (not kids[c] or own >= below):
            picked.add(c)
            below = own
        best[c] = below
    of: dict[int, int] = {}
    for c in sorted(mass, reverse=True):
        if c in born and born[c][0] in of:
            of[c] = of[born[c][0]]
        elif c in picked:
            of[c] = c
    return of


def density_clusters(rows: DataFrame, id_col: str, vector: str, least: int | None = None, block_rows: int = BLOCK, run_edges: int = EDGES) -> DataFrame:
    """id and cluster (-1: outlier) of one search's vectors, which are brought to length 1 and have one number of components.

    ``least``: points of a cluster, and of a point's neighbourhood with itself; 3% of the points and 5 at least if None, never more than there are. All points as
    one cluster is no result, but a single point is cluster 0. Clusters are numbered by their smallest id. A null vector, or one with a null or
    non-finite component, is an outlier that takes no part; a null or repeated id is an error. Over ``CLUSTERS`` candidate clusters, which a small ``least`` of
    one's own may give, are an error too.
    """
    spark = rows.sparkSession
    v = doubles(F.col(vector))
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    every = written(rows.select(F.col(id_col).cast("long").alias("id"), F.when(fine, unit(v)).alias("v")), "vectors")
    if not every.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
        raise ValueError(f"{id_col} is null or repeated")
    points = every.where("v IS NOT NULL")
    n = points.count()
    named = [F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster")]
    if n < 2:
        return every.withColumn("cluster", F.when(F.col("v").isNotNull(), 0)).select(*named)
    least = min(max(least or max(5, n * 3 // 100), 2), n)
    # Two blocks a core at least, where they aren't too small.
    blocks = -(-n // min(block_rows, max(LEAST_BLOCK, n // (2 * spark.sparkContext.defaultParallelism))))
    vectors = written(_packed(points, ["id", "v"], blocks), "packed")
    core = _cores(vectors, points, least - 2, n, blocks)
    edges, n_edges = with_row_number(_tree(vectors, core, n, blocks), ["reach", "lo", "hi"], "at")
    edges = written(edges, "edges")
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    member = points.select("id", F.col("id").alias("comp"), one.alias("size"), none.alias("cluster"), none.alias("out"))
    facts = None
    for first in range(0, n_edges, run_edges):
        met, state = edges.where(F.col("at").between(first + 1, first + run_edges)), ["comp", "size", "cluster"]
        for end in ("lo", "hi"):
            met = met.join(member.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in state]), end)
        met = met.select("at", "reach", *[f"{c}_{end}" for end in ("lo", "hi") for c in state]).repartition(1).sortWithinPartitions("at")
        told = written(met.mapInArrow(_merged(least), _TOLD), "told")
        new = told.where("kind = 'comp'").select(F.col("a").alias("comp"), *[F.col(x).alias(f"new_{y}") for x, y in (("b", "comp"), ("n", "size"), ("cluster", "cluster"), ("out", "out"))])
        # ``new`` has two rows an edge of the run at most
        after = member.join(F.broadcast(new), "comp", "left")
        state = [F.when(F.col("new_comp").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in state]
        member = written(after.select("id", *state, F.coalesce("out", "new_out").alias("out")), "merged")
        facts = told.where("kind <> 'comp'") if facts is None else facts.unionByName(told.where("kind <> 'comp'"))
    if (found := facts.select("a").distinct().count()) > CLUSTERS:
        raise ValueError(f"{found} candidate clusters are too many; the most is {CLUSTERS}")
    mass = {r.a: r.x for r in facts.where("kind = 'mass'").groupBy("a").agg(F.sum("x").alias("x")).collect()}
    born = {r.a: (r.b, r.n, r.x) for r in facts.where("kind = 'born'").collect()}
    label = spark.createDataFrame(list(_chosen(mass, born).items()), "out long, label long")
    labelled = written(member.join(F.broadcast(label), "out").select("id", "label"), "labelled")
    number = labelled.groupBy("label").agg(F.min("id").alias("least")).select("label", (F.row_number().over(Window.orderBy("least")) - 1).alias("cluster"))
    labelled = labelled.join(F.broadcast(number), "label").select("id", "cluster")
    return every.join(labelled, "id", "left").select(*named)

"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

A text's set holds its distinct ``n``-word shingles, as 64-bit hashes. Copies of one set are collapsed first. Each of
several independent trees starts with all sets in one node; a node picks one or two of the signature's minwise
coordinates, drawn from the node's own path, and sends a set to the child named by the set's minimum there, so that two
sets of Jaccard similarity s share a child with probability s per branch. With 1.5 branches on average the expected number of
common children of a pair at 0.75 is over one, and the chance that it is split up for good is a fixed recursion, from
which the number of trees follows for the recall asked for.

What is still to be compared in a node are its outsiders, the sets outside its largest known component, with all of its sets. A node
without outsiders ends. One that is small in members, or in pairs left and in shingles, is compared exhaustively: first on sizes and signatures
with a wide margin, then on full sets; only links confirmed on full sets count. A node of many members and few
outsiders is cut in blocks that all outsiders visit, which at most doubles its rows. Any other node branches again. The first two trees
know no components; what they leave large at the last level (sets that are nearly alike) is cut in blocks too, each with some of the
node's members as pivots, and then branches on with the other trees, which know the components found so far. Groups emit a
spanning forest of their links, never all pairs, and a forest's components are found by alternating large-star and small-star steps.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; with fewer than ``n`` words the
whole sequence is the one shingle. Rows that repeat a doc_id are one document, of the union of their sets. A null doc_id has the
component of a document with an equal set and is not kept beside it, else a null one; ``drop_near_duplicates`` leaves rows with a null id in. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.components import connected_components
from clipweave.llm.shared import materialize

#: Minwise values in a signature.
SIGNATURE = 64
#: A node of so many members, so many pairs left to compare and so many shingles at most is compared in one task.
MEMBERS, PAIRS, SHINGLES = 4096, 1 << 22, 1 << 21
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


class _Words(dict):
    """Hash of each word, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, n: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, A-Z lower-cased."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    k = min(n, len(w))
    acc = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(acc)


def signature(s: np.ndarray) -> np.ndarray:
    """Minwise values of a set that isn't empty, as 32-bit numbers."""
    out = np.empty(SIGNATURE, np.uint32)
    for i in range(SIGNATURE):
        out[i] = (((s ^ _XOR[i]) * _MUL[i]) >> np.uint64(32)).min()
    return out


def _union(texts: list, n: int, words: _Words) -> np.ndarray:
    parts = [shingles(t, n, words) for t in texts or [None]]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _sketch(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            sets = [_union(t if isinstance(t, list) else [t], n, words) for t in b.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sigs = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return run


def lost_after(levels: int, similarity: float) -> float:
    """The chance that a pair of that similarity shares no node after so many levels of one tree."""
    q = 0.0
    for _ in range(levels):
        q = sum(0.5 * (1 - similarity + similarity * q) ** b for b in (1, 2))
    return q


def lost_pairs(trees: int, levels: int, similarity: float) -> float:
    """The chance that a pair of that similarity shares no node at the last level of any tree. All trees draw from one signature, of which it shares a binomial number of values."""
    share = lambda k: math.comb(SIGNATURE, k) * similarity**k * (1 - similarity) ** (SIGNATURE - k)
    return sum(share(k) * lost_after(levels, k / SIGNATURE) ** trees for k in range(SIGNATURE + 1))


def trees_for(recall: float, levels: int, similarity: float) -> int:
    """Trees for that recall of pairs at that similarity, even of those whose nodes stay large down to the last level."""
    return next(t for t in range(1, 1000) if lost_pairs(t, levels, similarity) <= 1 - recall)


def _children(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one or two children of each row's node that the row goes to: (child, row)."""
    rows = np.arange(len(node))
    out_node, out_row = [], []
    for branch in (0, 1):
        pick = _mix(node + np.uint64(branch + 1))
        go = rows if branch == 0 else rows[(_mix(node) & np.uint64(1)) == 1]
        value = sig[go, (pick[go] % np.uint64(SIGNATURE)).astype(np.int64)].astype(np.uint64)
        out_node.append(_mix(pick[go] ^ _mix(value + np.uint64(0x51ED270B))))
        out_row.append(go)
    return np.concatenate(out_node), np.concatenate(out_row)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIGNATURE)


def _plant(trees: range) -> Callable:
    """(sig, rep, label, size) to the children of the roots of all ``trees``: (node, rep, label, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _signatures(b.column(0))
            for t in trees:
                root = _mix(np.full(b.num_rows, t + 1, np.uint64))
                node, row = _children(root, sig)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(b.column(c).take(pa.array(row)) for c in (1, 2, 3))], ["node", "rep", "label", "size"])

    return run


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sig, rep, label, size) to the rows of the node's children: (node, rep, label, size)."""
    for b in batches:
        if b.num_rows:
            node, row = _children(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), _signatures(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(b.column(c).take(pa.array(row)) for c in (2, 3, 4))], ["node", "rep", "label", "size"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of rows with one value in the first column, over the borders of batches: (key, the other columns as lists)."""
    key, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_pylist()
        cols = [b.column(k).to_pylist() for k in range(1, b.num_columns)]
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                part = [c[start:i] for c in cols]
                if keys[start] == key and held is not None:
                    held = [x + y for x, y in zip(held, part, strict=True)]
                else:
                    if held is not None:
                        yield key, held
                    key, held = keys[start], part
                start = i
    if held is not None:
        yield key, held


class _Components:
    """Components of a group's members, from their known labels on."""

    def __init__(self, labels: list):
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[of].tolist()

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(k) for k in range(len(self.up))])

    def outsiders(self) -> np.ndarray:
        """The members outside the largest component."""
        at = self.roots()
        return np.flatnonzero(at != np.bincount(at).argmax())


def _alike(margin: float, percent: int) -> Callable:
    """Members of a node (node, rep, sig, label, size) that look alike by size and signature, as clusters named by their members: (grp, rep, label).

    Only pairs that aren't known to be of one component, by their labels, count.
    """
    least = math.ceil(margin * SIGNATURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = ([], [], []), set()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["grp", "rep", "label"])
            for c in out:
                c.clear()
            return batch

        for _, (reps, sigs, labels, sizes) in _groups(batches):
            n = len(reps)
            if n > 1 and len(set(labels)) > 1:
                s = np.frombuffer(b"".join(sigs), np.uint32).reshape(n, SIGNATURE)
                size = np.array(sizes, np.int64)
                known = np.unique(labels, return_inverse=True)[1]
                apart = _Components(labels).outsiders()
                open_ = np.ones(n, bool)
                linked = _Components(list(range(n)))
                for i in apart:
                    open_[i] = False  # all of its pairs are looked at now
                    may = np.flatnonzero(open_ & (known != known[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
                    for j in may[(s[may] == s[i]).sum(1) >= least]:
                        linked.join(int(i), int(j))
                clusters: dict[int, list[int]] = {}
                for i in range(n):
                    clusters.setdefault(linked.root(i), []).append(i)
                for members in clusters.values():
                    if len(members) > 1:
                        c = sorted(set((reps[i], labels[i]) for i in members))
                        name = xxhash.xxh3_64_intdigest(np.array(c, np.int64).tobytes()) - (1 << 63)
                        if name not in seen:  # the same cluster comes from most trees
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add(name)
                            out[0].extend([name] * len(c))
                            out[1].extend(rep for rep, _ in c)
                            out[2].extend(label for _, label in c)
            if len(out[0]) > 20_000:
                yield flush()
        yield flush()

    return run


def _confirm(percent: int) -> Callable:
    """Comparison of the full sets in a group (grp, rep, label, packed): a spanning forest of the links with 100 * intersection >= percent * union.

    A pair whose ends are linked already, or have one label, is not compared again. A member that comes in several rows has their union.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for _, (all_reps, all_labels, packed) in _groups(batches):
            parts: dict[int, list[np.ndarray]] = {}
            for rep, p in zip(all_reps, packed, strict=True):
                parts.setdefault(rep, []).append(np.frombuffer(p, np.uint64))
            label_of = dict(zip(all_reps, all_labels, strict=True))
            reps = list(parts)
            n = len(reps)
            sets = [p[0] if len(p) == 1 else np.unique(np.concatenate(p)) for p in parts.values()]
            size = np.array([len(s) for s in sets], np.int64)
            tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(n), size)
            order = np.argsort(at, kind="stable")
            holders = owner[order]
            starts = np.searchsorted(at[order], np.arange(len(tokens) + 1))
            ends = np.cumsum(size)
            parts_of = _Components([label_of[r] for r in reps])
            component = parts_of.roots()
            for i in parts_of.outsiders():
                if (component == component[i]).all():
                    break
                mine = at[ends[i] - size[i] : ends[i]]
                lo, hi = starts[mine], starts[mine + 1]
                many = hi - lo > 1
                lo, count = lo[many], (hi - lo)[many]
                if not len(lo):
                    continue
                flat = np.arange(count.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count)
                both = np.bincount(holders[flat], minlength=n)
                linked = np.flatnonzero((100 * both >= percent * (size[i] + size - both)) & (component != component[i]))
                for j in linked:
                    if parts_of.root(int(j)) != parts_of.root(int(i)):
                        out_a.append(reps[i])
                        out_b.append(reps[int(j)])
                        parts_of.join(int(i), int(j))
                if len(linked):
                    component = parts_of.roots()
            if len(out_a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _pack(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                sets = [shingles(t, n, words).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["rep", "packed"])

    return run


_ROWS = "node long, rep long, label long, size long"


def _grow(children: DataFrame, classes: DataFrame, known: bool, levels: int, small: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Nodes to compare exhaustively, and nodes still large at the last level, as rows (node, rep, label, size).

    Rows stay narrow: signatures (``classes``: rep, sig) are joined on to branch. ``known``: labels are components; else each set has its own.
    """
    leaves = None
    for level in range(levels):
        children = materialize(children, f"{name}_level_{level}")
        one = F.count(F.lit(1))
        if known:
            counts = children.groupBy("node", "label").agg(one.alias("n"), F.sum("size").alias("s")).groupBy("node").agg(F.sum("n").alias("members"), F.sum("s").alias("shingles"), F.max(F.struct("n", "label")).alias("m"))
            counts = counts.select("node", "members", "shingles", (F.col("members") - F.col("m.n")).alias("outside"), F.col("m.label").alias("main")).where("outside > 0")
        else:
            counts = children.groupBy("node").agg(one.alias("members"), F.sum("size").alias("shingles")).where("members > 1").select("*", (F.col("members") - 1).alias("outside"), F.lit(None).cast("long").alias("main"))
        fits = (F.col("members") <= small) | ((F.col("members") <= MEMBERS) & (F.col("members") * F.col("outside") <= PAIRS) & (F.col("shingles") <= SHINGLES))
        counts = materialize(counts.withColumn("kind", F.when(fits, "leaf").when(F.col("outside") <= small, "wide").otherwise("large")), f"{name}_counts_{level}")
        met = children.join(counts, "node")
        here = met.where("kind = 'leaf'").select(*children.columns)
        leaves = here if leaves is None else leaves.unionByName(here)
        kinds = {r[0] for r in counts.select("kind").distinct().collect()}
        if "wide" in kinds:
            wide = met.where("kind = 'wide'").withColumn("blocks", F.ceil(F.col("members") / small).cast("int"))
            own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
            visits = F.when(F.col("label") == F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
            wide = wide.withColumn("block", F.explode(visits))
            leaves = leaves.unionByName(wide.select(F.xxhash64("node", "block").alias("node"), "rep", "label", "size"))
        if "large" not in kinds:
            return leaves, None
        children = met.where("kind = 'large'").select(*children.columns)
        if level < levels - 1:
            children = children.join(classes.select("rep", "sig"), "rep").select("node", "sig", "rep", "label", "size").mapInArrow(_branch, _ROWS)
    return leaves, materialize(children, f"{name}_dense")


def only(rows: DataFrame, id_col: str, wanted: DataFrame, bits: int = 23) -> DataFrame:
    """``rows`` that may be among ``wanted`` (one column): a filter in front of a join that spares it most of a large table.

    A bitmap of 2**bits hashed ids is gathered as words of 32 bits, so what is broadcast has 2**(bits - 5) rows at most,
    whatever the data; where ``wanted`` fills it up, it only filters less.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    at = slot(wanted.columns[0])
    words = wanted.select((at / 32).cast("int").alias("word"), F.expr("1L").alias("one"), (at % 32).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("mask"))
    here = slot(F.col(id_col))
    return rows.withColumn("_slot", here).join(F.broadcast(words), (F.col("_slot") / 32).cast("int") == F.col("word")).where(F.expr("(mask & shiftleft(1L, cast(_slot % 32 as int))) <> 0")).select(*rows.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, recall: float = 0.9995, levels: int = 4, small: int = 128, pivots: int = 8, margin: float = 0.5) -> DataFrame:
    """One row per doc_id: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    ``recall``: of pairs at ``percent`` whose nodes stay large on every level; any other pair is found more surely, a pair of a small node
    at the first level with over 0.999999. ``small``: nodes of so many sets at most are compared exhaustively, larger ones by what they leave to compare. ``margin``: signatures that
    agree in a smaller share are not compared in full; at 0.5 a pair at 0.75 falls below it once in several hundred thousand. The first two
    trees find most components; the other trees are then spared every comparison within a component.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = "doc_id long, n_shingles long, digest binary, sig binary"
    raw = materialize(texts.mapInArrow(_sketch(n), sketch), "near_sketch")
    repeated = raw.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        again = texts.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
        raw = raw.join(repeated, "doc_id", "left_anti").unionByName(materialize(again.mapInArrow(_sketch(n), sketch), "near_repeats"))
    found = raw.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(found.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"), F.min("n_shingles").alias("size")), "near_classes")
    by_rep = classes.select("rep", "sig", "size")

    def confirmed(groups: DataFrame, label: str) -> DataFrame:
        """Links on full sets among the members of each group (grp, rep, label)."""
        packed = only(texts, "doc_id", groups.select("rep").distinct()).mapInArrow(_pack(n), "rep long, packed binary")
        links = groups.join(packed, "rep").select("grp", "rep", "label", "packed").repartition("grp").sortWithinPartitions("grp", "rep").mapInArrow(_confirm(percent), "a long, b long")
        return materialize(links.distinct(), label)

    def alike(rows: DataFrame, label: str) -> DataFrame:
        """Clusters (grp, rep, label) of the nodes (node, rep, label, size) by signature, where labels leave something to find."""
        signed = rows.join(classes.select("rep", "sig"), "rep").select("node", "rep", "sig", "label", "size")
        signed = signed.repartition("node").sortWithinPartitions("node", "rep")
        return materialize(signed.mapInArrow(_alike(margin, percent), "grp long, rep long, label long").distinct(), label)

    trees = trees_for(recall, levels, percent / 100)
    first = min(2, trees)
    planted = classes.select("sig", "rep", F.col("rep").alias("label"), "size").mapInArrow(_plant(range(first)), _ROWS)
    leaves, dense = _grow(planted, by_rep, False, levels, small, "near_first")
    groups = alike(leaves, "near_groups")
    if dense is not None:
        blocks = _blocks(dense, small)
        some = F.struct(F.xxhash64("rep", "node").alias("h"), "rep")
        few = blocks.where(F.pmod(F.xxhash64("rep", F.lit(5)), F.col("n_blocks") * small / (2 * pivots)) < 1).groupBy("node").agg(F.slice(F.array_sort(F.collect_list(some)), 1, pivots).alias("p"))
        guests = blocks.select("node", "block").distinct().join(few.select("node", F.explode("p").alias("g")), "node").select("node", "block", "g.rep")
        name = F.xxhash64("node", "block").alias("grp")
        groups = groups.unionByName(blocks.select(name, "rep").unionByName(guests.select(name, "rep")).distinct().withColumn("label", F.col("rep")))
    links = confirmed(groups, "near_links")
    parts = connected_components(links)

    if trees > first or dense is not None:
        labels = materialize(parts.select(F.col("node").alias("rep"), F.col("component").alias("label")), "near_labels")
        label = F.coalesce("label", "rep").alias("label")
        rows = by_rep.join(labels, "rep", "left").select("sig", "rep", label, "size").mapInArrow(_plant(range(first, trees)), _ROWS)
        if dense is not None:
            rows = rows.unionByName(dense.drop("label").join(labels, "rep", "left").select("node", "rep", label, "size"))
        leaves, rest = _grow(rows, by_rep, True, levels, small, "near_more")
        more = alike(leaves, "near_groups_more")
        if rest is not None:
            more = more.unionByName(alike(_apart(rest, small), "near_groups_apart")).distinct()
        if not more.isEmpty():
            stars = labels.where("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b"))
            parts = connected_components(stars.unionByName(confirmed(more, "near_links_more")))
    of_class = classes.select("digest", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("found"))
    component = F.coalesce("found", "doc_id")
    return raw.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _blocks(dense: DataFrame, width: int) -> DataFrame:
    """The members of large nodes dealt to blocks of about ``width``: node, block, rep, label, size, n_blocks."""
    sizes = dense.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / width).alias("n_blocks"))
    dealt = dense.join(sizes, "node").select("node", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).alias("block"), "rep", "label", "size", "n_blocks")
    return materialize(dealt, "near_blocks")


def _apart(rest: DataFrame, width: int) -> DataFrame:
    """What nodes still large at the last level leave to compare: their outsiders, in chunks, beside every block (node, rep, label, size)."""
    of = _blocks(rest, width).drop("n_blocks")
    main = of.groupBy("node", "label").count().groupBy("node").agg(F.max(F.struct("count", "label")).alias("m")).select("node", F.col("m.label").alias("main"))
    apart = of.join(main, "node").where("label <> main").drop("main", "block")
    n = apart.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / width).alias("chunks"))
    apart = materialize(apart.join(n, "node").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks"))).drop("chunks"), "near_apart")
    meet = apart.select("node", "chunk").distinct().join(of.select("node", "block").distinct(), "node")
    columns = [F.xxhash64("node", "chunk", "block").alias("n"), "rep", "label", "size"]
    rows = meet.join(apart, ["node", "chunk"]).select(*columns).unionByName(meet.join(of, ["node", "block"]).select(*columns)).distinct()
    return rows.withColumnRenamed("n", "node")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the one document of each group that is kept."""
    gone = near_duplicates(docs, id_col, **options).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, F.col(id_col) == F.col("gone_id"), "left_anti")

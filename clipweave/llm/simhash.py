"""Near-duplicates by SimHash fingerprints that differ in at most two bits, found through deletion variants of their halves.

A fingerprint's bit is set where over half of its text's shingle hashes have it set. Of two fingerprints that differ in at most two bits, one
of their two halves differs in at most one. So a fingerprint is indexed, for each half, by the half itself and by its variants with
one bit left out. Equal halves meet under the half; halves that differ in a bit meet under the variant without that bit, where only fingerprints with
the bit set are compared with those without. Each comparison counts the differing bits of the whole.

Fingerprints are collapsed first, so copies cost nothing. An index key of many fingerprints (near copies share halves) isn't compared: its
fingerprints are indexed again, under that key, by the halves of what the key leaves open, or once a bit is spent by all variants of it. Keys end
small, as what they leave open halves each time. A key's fingerprints give a spanning forest of their links, never all pairs.

Defined results: a text that is null or has no word has fingerprint zero, which is linked like any other; with fewer words than a shingle the whole
sequence is the one shingle. Every row counts as a document: rows that repeat a doc_id have a fingerprint each. A row without doc_id links as
any other, but names no component: its component is the smallest doc_id reachable, null if there is none. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.components import connected_components
from clipweave.llm.shared import materialize, spread_join

#: Bits in which linked fingerprints may differ.
BITS = 2
#: An index key of more fingerprints is indexed again.
MEMBERS = 1024
#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 15
_ROWS = "node long, side byte, fp long, at byte, width byte, left byte"
_NONE = 2
_ALL = (1 << 64) - 1


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """The SimHash of a text, A-Z lower-cased, over its ``n``-word shingles with repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(n, len(words))
    total, count = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, total, _AT_ONCE):
        upto = min(at + _AT_ONCE, total)
        grams = map(b" ".join, zip(*(words[at + i : upto + i] for i in range(k)), strict=True))
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.dtype("<u8"), upto - at)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def _fingerprints(n: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), n, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _key(node: np.ndarray, at: int, width: int, without: int, bits: np.ndarray) -> np.ndarray:
    """The key under ``node`` of fingerprints that agree in ``bits``: those from ``at`` on, with bit ``without`` left out if it isn't negative."""
    about = np.uint64(((at * 128 + width) * 128 + without + 1) & _ALL)
    return _mix(node * np.uint64(0x9E3779B97F4A7C15) + _mix(bits + _mix(np.full(1, about))))


def _bits(fp: np.ndarray, at: int, width: int) -> np.ndarray:
    return fp & np.uint64(((1 << width) - 1) << at)


def _kinds(b: pa.RecordBatch) -> Iterator[tuple]:
    """A batch of ``_ROWS`` by what its keys leave open: (at, width, left, node, side, fp)."""
    node, side, fp, *kind = (c.to_numpy(zero_copy_only=False) for c in b.columns)
    node, fp = node.view(np.uint64), fp.view(np.uint64)
    name = (kind[0].astype(np.int64) * 128 + kind[1]) * 128 + kind[2]
    for k in np.unique(name):
        rows = np.flatnonzero(name == k)
        yield int(k) >> 14, int(k) >> 7 & 127, int(k) & 127, node[rows], side[rows], fp[rows]


def _halves(at: int, width: int) -> list[tuple[int, int, int, int]]:
    """Each half of a range of bits with the other one: (at, width, at of the other, its width)."""
    low = width // 2
    return [(at, low, at + low, width - low), (at + low, width - low, at, low)]


def _equal_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of the halves themselves, of rows that may be indexed again."""
    for b in batches:
        for at, width, left, node, _, fp in _kinds(b):
            for a, w, _, _ in _halves(at, width) if left == BITS else ():
                yield pa.RecordBatch.from_arrays([pa.array(_key(node, a, w, -1, _bits(fp, a, w)).view(np.int64))], ["node"])


def _index(hot: np.ndarray, wanted: bool) -> Callable:
    """Rows of the keys under which each row of ``_ROWS`` is found. ``wanted``: those of keys with a half in ``hot``, or those of all others.

    A variant's fingerprints are those of two halves, with and without the bit, so it is as large as they are.
    """

    def among(keys: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.zeros(len(keys), bool)
        return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                for at, width, left, node, side, fp in _kinds(whole.slice(start, 4096)):
                    out = []

                    def add(key, side, which, at, width, left, fp=fp, out=out):
                        if which.any():
                            n = int(which.sum())
                            out.append([key[which], side[which], fp[which], *(np.full(n, v, np.int8) for v in (at, width, left))])

                    if left == BITS:
                        for a, w, other, open_ in _halves(at, width):
                            bits = _bits(fp, a, w)
                            own = _key(node, a, w, -1, bits)
                            much = among(own)
                            add(own, np.full(len(fp), _NONE, np.int8), much == wanted, other, open_, BITS)
                            for p in range(a, a + w):
                                bit = np.uint64(1 << p)
                                large = (much | among(_key(node, a, w, -1, bits ^ bit))) if len(hot) else much
                                add(_key(node, a, w, p, bits & ~bit), (bits >> np.uint64(p) & np.uint64(1)).astype(np.int8), large == wanted, other, open_, BITS - 1)
                    elif not wanted:  # one bit is left: all variants of what is open
                        bits, every = _bits(fp, at, width), np.ones(len(fp), bool)
                        add(_key(node, at, width, -1, bits), side, every, at, 0, 0)
                        for p in range(at, at + width):
                            add(_key(node, at, width, p, bits & np.uint64(~(1 << p) & _ALL)), side, every, at, 0, 0)
                    if out:
                        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                        columns[0], columns[2] = columns[0].view(np.int64), columns[2].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "side", "fp", "at", "width", "left"])

    return run


def _forest(side: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of a key's links; where the key leaves out a bit, of those between fingerprints with and without it."""
    up = list(range(len(fp)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sided = side[0] != _NONE
    ones = int(np.searchsorted(side, 1)) if sided else 0  # sides come in order
    found = []
    for i in range(ones if sided else len(fp) - 1):
        first = ones if sided else i + 1
        for j in np.flatnonzero(np.bitwise_count(fp[first:] ^ fp[i]) <= BITS):
            a, b = root(i), root(first + int(j))
            if a != b:
                up[max(a, b)] = min(a, b)
                found.append((i, first + int(j)))
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, side, fp), each node's together and in order, to links (a, b) between fingerprints. What is held is one node's rows and a batch."""

    def solve(node: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        sizes = np.diff(np.append(starts, len(node)))
        two = starts[sizes == 2]
        near = two[(np.bitwise_count(fp[two] ^ fp[two + 1]) <= BITS) & ((side[two] == _NONE) | (side[two] != side[two + 1]))]
        a, b = [near], [near + 1]
        more = sizes > 2
        mixed = (side[starts] == _NONE) | (side[starts] != side[starts + sizes - 1])
        for start, size in zip(starts[more & mixed].tolist(), sizes[more & mixed].tolist(), strict=True):
            pairs = np.array(_forest(side[start : start + size], fp[start : start + size]), np.int64).reshape(-1, 2) + start
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(fp[np.concatenate(x)].view(np.int64)) for x in (a, b)], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows[2] = rows[2].view(np.uint64)
        rows = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last:
            yield solve(*(c[:last] for c in rows))
        held = [c[last:] for c in rows]
    if held:
        yield solve(*held)


def near_links(fingerprints: DataFrame, members: int = MEMBERS) -> DataFrame:
    """Links (a, b) that connect whatever ``fingerprints`` (fp, distinct) connects at most two differing bits a step.

    A key is large with over ``members`` fingerprints, or with over a hundred-thousandth of them, so that under 100,000 large halves are told to the tasks.
    """
    rows = fingerprints.select(F.lit(0).cast("long").alias("node"), F.lit(_NONE).cast("byte").alias("side"), "fp", *(F.lit(v).cast("byte").alias(c) for c, v in (("at", 0), ("width", 64), ("left", BITS))))
    keys = None
    for level in range(7):
        halves = rows.mapInArrow(_equal_halves, "node long").groupBy("node").count()
        most = members if level else max(members, rows.count() // 50_000)
        hot = np.sort(np.array([r[0] for r in halves.where(F.col("count") > most).select("node").collect()], np.int64).view(np.uint64))
        here = rows.mapInArrow(_index(hot, False), _ROWS).select("node", "side", "fp")
        keys = here if keys is None else keys.unionByName(here)
        if not len(hot):
            break
        rows = materialize(rows.mapInArrow(_index(hot, True), _ROWS), f"simhash_large_{level}")
        members = most
    ordered = keys.repartition("node").sortWithinPartitions("node", "side", "fp")
    return materialize(ordered.mapInArrow(_links, "a long, b long").distinct(), "simhash_links")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, seed: int = 42, members: int = MEMBERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = materialize(texts.mapInArrow(_fingerprints(n, seed), "doc_id long, fp long"), "simhash")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash_classes")
    parts = connected_components(near_links(classes.select("fp"), members)).withColumnRenamed("node", "fp")
    of = materialize(classes.join(parts, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "simhash_parts")
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = spread_join(marked, spread_join(of.select("fp", "component"), least, ["component"], ["fp"]).select("fp", "component_id"), ["fp"], ["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; rows without one stay."""
    gone = simhash_groups(docs, id_col, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")

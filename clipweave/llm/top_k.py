"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers. Rows are dealt to blocks of bounded expected size in components; a block's index holds, per dimension and bit, the
bitmap of rows with that bit. Indexes are built once and written to the shared folder. A query's score is a sum of slices, each weighted by the query's component: bitmaps of one
weight are added with carry-save adders, which leaves the score itself as slices. The top rows are read from the most
significant slice downward: rows that have the bit come before rows that haven't. What ties at the boundary is resolved
exactly, smaller ids first. Every query chunk meets every block, as each pair of them has to be scored; an index is sent once per chunk
of some thousand queries, and a block answers with k rows per query.

Defined results: vectors that are null, empty or hold null or non-finite components take no part. A shorter vector counts as padded with
zeros. Rows that share the query's id are its own and no candidates; each other row counts, repeated ids too. Of rows that repeat a
query's id the least vector asks. Components so large that a score might not fit in a long are an error. Tables with no query or no vector give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipweave.llm.shared import materialize


def quantise(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, q (array<bigint>): floor(scale * x) of the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"))


class BitSlices:
    """The bit-sliced index of one block: rows in order of id."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: np.ndarray, slices: np.ndarray):
        self.ids, self.low, self.bits = ids, low, bits
        self.n = len(ids)
        words = -(-self.n // 64)
        self.first = np.concatenate(([0], np.cumsum(bits)))
        self.slices = slices.reshape(-1, words)
        self.all = self._pack(np.ones(self.n, bool), words)
        self.inverse = self.slices ^ self.all

    @classmethod
    def build(cls, ids: np.ndarray, q: np.ndarray) -> BitSlices:
        order = np.argsort(ids, kind="stable")
        ids, q = ids[order], q[order]
        words = -(-len(ids) // 64)
        low = q.min(0)
        span = (q - low).astype(np.uint64)
        bits = np.array([int(m).bit_length() for m in span.max(0)], np.int64)
        slices = [cls._pack((span[:, d] >> np.uint64(j)) & np.uint64(1), words) for d, n in enumerate(bits) for j in range(int(n))]
        return cls(ids, low, bits, np.concatenate(slices) if slices else np.zeros(0, np.uint64))

    @staticmethod
    def _pack(bits: np.ndarray, words: int) -> np.ndarray:
        packed = np.zeros(words * 8, np.uint8)
        got = np.packbits(bits.astype(bool), bitorder="little")
        packed[: len(got)] = got
        return packed.view(np.uint64)

    def scores(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores less a constant, least significant first, and the constant."""
        constant = int(sum(int(a) * int(b) for a, b in zip(q, self.low, strict=True)))
        plus: dict[int, list[int]] = {}
        minus: dict[int, list[int]] = {}
        for d, weight in enumerate(map(int, q)):
            if weight < 0:  # -w * c = w * (2**bits - 1 - c) - w * (2**bits - 1)
                constant += weight * ((1 << int(self.bits[d])) - 1)
            to, w, k = (minus, -weight, 0) if weight < 0 else (plus, weight, 0)
            while w:
                if w & 1:
                    for j in range(int(self.bits[d])):
                        to.setdefault(k + j, []).append(int(self.first[d]) + j)
                w >>= 1
                k += 1
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        p = 0
        last = max([*plus, *minus], default=-1)
        while p <= last or carried:
            at = [*carried]
            if p in plus:
                at.append(self.slices[plus[p]])
            if p in minus:
                at.append(self.inverse[minus[p]])
            carried = []
            rows = np.concatenate(at) if at else np.zeros((1, len(self.all)), np.uint64)
            while len(rows) > 2:
                m = len(rows) // 3
                a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
                half = a ^ b
                carried.append((a & b) | (half & c))
                half ^= c
                rows = np.concatenate((half, rows[3 * m :])) if 3 * m < len(rows) else half
            if len(rows) == 2:
                carried.append((rows[0] & rows[1])[None])
                rows = (rows[0] ^ rows[1])[None]
            out.append(rows[0])
            p += 1
        return out, constant

    def top(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        slices, constant = self.scores(q)
        open_ = self.all.copy()
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1])
        for r in range(lo, hi):
            open_[r // 64] &= ~np.uint64(1 << (r % 64))
        sure = np.zeros_like(open_)
        n_sure = 0
        for s in reversed(slices):
            upper = open_ & s
            n = int(np.bitwise_count(upper).sum())
            if n_sure + n > k:
                open_ = upper
            else:
                sure |= upper
                n_sure += n
                open_ &= ~s
                if n_sure == k:
                    break
        chosen = list(np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little")))
        if n_sure < k:
            chosen += list(np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))[: k - n_sure])
        score = lambda r: constant + sum(int(s[r // 64] >> np.uint64(r % 64)) % 2 << p for p, s in enumerate(slices))
        return [(int(self.ids[r]), score(int(r))) for r in chosen]


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows of ``dims`` components: shorter ones end in zeros, longer ones are cut."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(-1, dims)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), dims), np.int64)
    out[row[at < dims], at[at < dims]] = values[at < dims]
    return out


def _members(column: pa.ListArray, i: int) -> tuple[np.ndarray, pa.ListArray]:
    """Ids and vectors in row ``i`` of a column of lists of (vec_id, q)."""
    held = column[i].values
    return held.field("vec_id").to_numpy(zero_copy_only=False), held.field("q")


_BLOCK = "block int, ids binary, low binary, bits binary, slices binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            ids, q = _members(b.column(1), i)
            x = BitSlices.build(ids, _matrix(q, int(q.value_lengths().to_numpy(zero_copy_only=False).max())))
            packed = [pa.array([a.tobytes()], pa.binary()) for a in (x.ids, x.low, x.bits, x.slices)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *packed], ["block", "ids", "low", "bits", "slices"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, low, bits, slices = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("ids", np.int64), ("low", np.int64), ("bits", np.int64), ("slices", np.uint64)))
                found = BitSlices(ids, low, bits, slices)
                asking, q = _members(b.column("asking"), i)
                out = [(int(x), *hit) for x, v in zip(asking, _matrix(q, len(low)), strict=True) for hit in found.top(int(x), v, k)]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block_cells: int = 1 << 20, chunk_cells: int = 1 << 18, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best rows for each query, a row whose id is divisible by ``every``.

    ``block_cells``, ``chunk_cells``: components that a block of rows and a chunk of queries hold, by their longest vector.
    """
    q = materialize(quantise(vectors, scale, id_col, vec_col), "top_k_vectors")
    asking = q.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    widest = F.max(F.array_max(F.transform("q", lambda v: F.abs(v.cast("double")))))
    n, dims, most = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(1)), F.coalesce(widest, F.lit(0.0))).first()
    if dims * most * most >= 2.0**62:
        raise ValueError(f"components up to {most:g} times {scale} make scores that a long can't hold")
    n_asking = asking.count()
    blocks, chunks = max(1, -(-n * dims // block_cells)), max(1, -(-n_asking * dims // chunk_cells))
    members = F.collect_list(F.struct("vec_id", "q"))
    index = q.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")).groupBy("block").agg(members.alias("members"))
    index = materialize(index.mapInArrow(_index, _BLOCK), "top_k_index")
    batch = materialize(asking.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk")).agg(members.alias("asking")), "top_k_asking")
    # Each query chunk meets each block: both sides are repeated over the other's numbers and meet by key.
    pairs = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(batch.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), ["block", "chunk"])
    hits = pairs.select("ids", "low", "bits", "slices", "asking").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

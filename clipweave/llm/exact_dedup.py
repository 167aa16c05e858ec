"""Exact deduplication by an extendible-hash index on shared files.

A text's key is the 64-bit hash of its normalised form. A directory of key prefixes is doubled until no bucket holds more
than ``capacity`` bytes or it has its full depth; an entry that is still overfull is split by as many further bits of the key as its load asks
for. A key that alone holds more than that gets overflow pages, over which its rows are salted. Each bucket, or page, is owned by
one task, which reads its range of keys in order and keeps, for the current key alone, a chain of the distinct texts seen: every row
is compared with the chain byte for byte, so two texts that share a key stay apart. The owner also writes to each of the key's rows which row of its
group stays. For keys with pages each page does so for its own rows; the pages' chain heads are then grouped by their bytes and joined back by page.
The owners' entries are written to the shared folder; everything after that is narrow.

Defined results: a null text counts as empty, and all empty or blank texts are equal. Rows that repeat a doc_id are
separate members of their group and one of them at most is kept. A null doc_id loses to any other. An empty table gives an
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.shared import WHITE, materialize

#: Directory depth: 2**MAX_DEPTH entries at most reach the driver or are broadcast. Buckets go on splitting beyond it.
MAX_DEPTH = 14
#: A bucket's bytes of normalised text, and what a row counts besides its text.
CAPACITY, ROW_BYTES = 4 << 20, 64
#: Hot keys, or bytes of their texts, that are broadcast at most; more are joined by a shuffle.
MOST_KEYS, MOST_BYTES = 100_000, 32 << 20


def directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int, int]]:
    """Directory entries (prefix of ``max_depth`` bits, bucket, local depth, load) for bytes counted by prefix.

    A bucket is named by its leading bits with a one before them. It splits while it is overfull, which doubles the
    directory where its depth was the greatest. The load says how many capacities a bucket of full depth holds.
    """
    entries = []
    todo = [(0, 0, sorted(counts.items()))]
    while todo:
        depth, bits, inside = todo.pop()
        total = sum(n for _, n in inside)
        if total > capacity and depth < max_depth and len(inside) > 1:
            shift = max_depth - depth - 1
            for bit in (0, 1):
                half = [(p, n) for p, n in inside if (p >> shift) & 1 == bit]
                if half:
                    todo.append((depth + 1, bits << 1 | bit, half))
        else:
            entries += [(p, 1 << depth | bits, depth, max(1, -(-total // capacity))) for p, _ in inside]
    return entries


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (bucket, part, page, key). Adds each row's place in its key's chain, its group's size and row that stays and, for a chain's first row of a page, the bytes."""
    names = ["rid", "doc_id", "n_points", "sha", "bucket", "part", "page", "pages", "key"]
    ready: list[list] = [[] for _ in range(len(names) + 6)]
    held: list[tuple] = []
    places: list[int] = []
    chain: list[bytes] = []
    heads: list[bytes | None] = []
    at = None

    def close() -> None:
        best: dict[int, tuple] = {}
        sizes: dict[int, int] = {}
        for row, place in zip(held, places, strict=True):
            rid, doc_id, points = row[0], row[1], row[2]
            rank = (points, doc_id is not None, -(doc_id or 0), -rid)
            sizes[place] = sizes.get(place, 0) + 1
            if place not in best or rank > best[place][0]:
                best[place] = (rank, doc_id, rid)
        for row, place, head in zip(held, places, heads, strict=True):
            for c, v in zip(ready, (*row, place, sizes[place], best[place][1], best[place][2], best[place][0][0], head), strict=True):
                c.append(v)
        for x in (held, places, chain, heads):
            x.clear()

    def flush(kinds: list[pa.DataType]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(ready, kinds, strict=True)], [*names, "chain", "group_size", "keep_id", "keep_rid", "keep_points", "head"])
        for c in ready:
            c.clear()
        return out

    kinds = None
    for b in batches:
        if kinds is None:
            of = {f.name: f.type for f in b.schema}
            kinds = [*(of[n] for n in names), pa.int32(), pa.int64(), of["doc_id"], pa.int64(), of["n_points"], pa.binary()]
        for *row, norm in zip(*(b.column(c).to_pylist() for c in (*names, "norm")), strict=True):
            if tuple(row[4:]) != at:
                close()
                at = tuple(row[4:])
                if len(ready[0]) > 5_000:
                    yield flush(kinds)
            place = next((k for k, other in enumerate(chain) if other == norm), len(chain))
            held.append(tuple(row))
            places.append(place)
            heads.append(norm if place == len(chain) and row[7] > 1 else None)
            if place == len(chain):
                chain.append(norm)
    close()
    if kinds is not None:
        yield flush(kinds)


def _bounded(df: DataFrame, bytes_col: str | None = None) -> DataFrame:
    """``df``, written, for broadcast if it is small enough, else as it is."""
    df = materialize(df, "exact_hot")
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(bytes_col)) if bytes_col else F.lit(0), F.lit(0))).first()
    return F.broadcast(df) if n <= MOST_KEYS and size <= MOST_BYTES else df


def exact_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64, max_depth: int = MAX_DEPTH, rid_col: str | None = None) -> DataFrame:
    """Index entries of every row, as written to the shared folder: rid, doc_id, n_points, sha, group_size, keep_id, keep_rid.

    ``key_bits`` under 64 makes collisions likely, for tests. ``rid_col`` has the rows' distinct numbers; without it they are numbered here.
    """
    spark = docs.sparkSession
    max_depth = min(max_depth, key_bits)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = F.translate(text, WHITE, "")
    key = F.shiftrightunsigned(F.xxhash64(norm), 64 - key_bits) if key_bits < 64 else F.xxhash64(norm)
    prefix = F.shiftrightunsigned(key, key_bits - max_depth).cast("int")
    size = F.octet_length(norm) + ROW_BYTES
    counts = {r[0]: r[1] for r in docs.groupBy(prefix.alias("p")).agg(F.sum(size).alias("n")).collect()}  # 2**max_depth rows at most
    entries = directory(counts, capacity, max_depth) or [(0, 1, 0, 1)]
    full = spark.createDataFrame([(p, b, min(key_bits - max_depth, math.ceil(math.log2(load)))) for p, b, _, load in entries], "p int, bucket int, more int")
    rows = docs.select(
        (F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text).alias("n_points"),
        F.unhex(F.sha2(norm, 256)).alias("sha"),
        key.alias("key"),
        prefix.alias("p"),
        F.encode(norm, "utf-8").alias("norm"),
    )
    # The key's bits after the prefix, as many as the entry's load asks for.
    part = F.when(F.col("more") > 0, F.expr(f"shiftrightunsigned(shiftleft(key, {64 - key_bits + max_depth}), 64 - more)")).otherwise(0).cast("long")
    rows = rows.join(F.broadcast(full), "p").withColumn("part", part)
    over = [(e[0],) for e in entries if e[3] > 1]
    if over:
        # A key with more than a capacity of its own.
        within = docs.select(key.alias("key"), prefix.alias("p"), size.alias("n")).join(F.broadcast(spark.createDataFrame(over, "p int")), "p")
        hot = within.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > capacity).select("key", F.ceil(F.col("n") / capacity).cast("int").alias("pages"))
        rows = rows.join(_bounded(hot), "key", "left")
    else:
        rows = rows.withColumn("pages", F.lit(None).cast("int"))
    rows = rows.withColumn("pages", F.coalesce("pages", F.lit(1))).withColumn("page", F.pmod(F.xxhash64("rid"), F.col("pages")).cast("int"))
    owned = rows.drop("p", "more").repartition("bucket", "part", "page").sortWithinPartitions("bucket", "part", "page", "key")
    index = materialize(owned.mapInArrow(_owner, "rid long, doc_id long, n_points int, sha binary, bucket int, part long, page int, pages int, key long, chain int, group_size long, keep_id long, keep_rid long, keep_points int, head binary"), "exact_index")
    columns = ["rid", "doc_id", "n_points", "sha", "group_size", "keep_id", "keep_rid"]
    if not over or index.where("pages > 1").isEmpty():
        return index.select(*columns)
    # Heads of a key's pages with the same bytes are one group.
    heads = index.where(F.col("head").isNotNull())
    best = F.struct(F.col("keep_points"), F.col("keep_id").isNotNull(), -F.col("keep_id"), -F.col("keep_rid"))
    groups = heads.groupBy("key", "head").agg(F.sum("group_size").alias("group_size"), F.max_by(F.struct("keep_id", "keep_rid"), best).alias("keep"))
    merged = heads.select("key", "page", "chain", "head").join(_bounded(groups, "head"), ["key", "head"]).select("key", "page", "chain", "group_size", "keep")
    paged = index.where("pages > 1").drop("group_size", "keep_id", "keep_rid").join(merged, ["key", "page", "chain"])
    paged = paged.withColumn("keep_id", F.col("keep.keep_id")).withColumn("keep_rid", F.col("keep.keep_rid"))
    return index.where("pages = 1").select(*columns).unionByName(paged.select(*columns))


def _decided(docs: DataFrame, id_col: str, text_col: str, **index) -> DataFrame:
    """The columns of ``exact_dedup``, and rid."""
    entries = exact_index(docs, id_col, text_col, **index)
    return entries.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_points", "rid")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Of equal texts the row with the most code points, then the smallest doc_id, stays.
    """
    return _decided(docs, id_col, text_col, **index).drop("rid")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, row by row, also where a doc_id is null or repeated.

    Rows are numbered and written once, so that the decisions and the rows they are joined to have the same numbers.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "exact_rows", "zstd")
    read = rows.select("rid", F.col("row").getField(id_col).alias("doc_id"), F.col("row").getField(text_col).alias("text"))
    keep = _decided(read, "doc_id", "text", rid_col="rid").where("kept").select("rid")
    return rows.join(keep, "rid", "left_semi").select("row.*")

"""Chat formatting as a prefix tree.

Turns are rendered by a template; control strings inside a text are escaped, reversibly, so they can't pass for a turn's
marks. Conversations that begin with the same turns share those turns' tree nodes. Every node is emitted once, parents before
children, depth first: conversations are put in order of their paths of node hashes, and what a conversation doesn't share
with its predecessor is new. A node carries its place in that sequence, the position of its first token in its own
conversation (the length of its ancestors), and its ancestors' places merged into as few intervals as possible: a token
attends to those and to its own node up to itself. Tokens are characters here.

Identical conversations are collapsed before the ordering, so a conversation that many share is handled once. The order is
by range partitioning, within which nodes are numbered; offsets come from per-partition sums. Reading back joins a frequent node salted. Only sums and one row's path per partition reach the driver. A conversation,
being one training sample, is one row; a tree is never gathered.

Defined results: a null text or role counts as empty. Rows of a conversation are taken by turn, then role, then text; rows that
repeat a turn all count. Rows with a null conv_id form one conversation. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.shared import materialize, spread_join

#: The template: a user or system turn, an assistant turn, and the mark that escapes control strings.
OPEN, CLOSE, END, ESC = "[INST]", "[/INST]", "</s>", "\\"
ROLE = "<|{}|>"
_TEXT = r"((?:[^\\\[<|]+|[\\\[<|]\\)*+)"
_TURN = re.compile(rf"<\|{_TEXT}\|>(?:\[INST\]{_TEXT}\[/INST\]|{_TEXT}</s>)")
_UNESCAPE = re.compile(r"([\\\[<|])\\")
#: Of characters that a mark could begin with, only these are escaped in a text.
_SPECIAL = re.compile(r"[\\\[<|]")


def escape(text: str) -> str:
    """``text`` with an escape behind every character that a mark could begin with, so that no mark is left in one piece."""
    return _SPECIAL.sub(lambda m: m[0] + ESC, text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template has it, and where its loss begins and ends; equal for turns without loss."""
    head = ROLE.format(escape(role))
    body = escape(text)
    if role == "assistant":
        return head + body + END, len(head), len(head) + len(body)
    return f"{head}{OPEN}{body}{CLOSE}", 0, 0


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted conversation: role, text, and the text's place."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        k = 2 if m[2] is not None else 3
        turns.append((unescape(m[1]), unescape(m[k]), m.start(k), m.end(k)))
        at = m.end()
    return turns


def _paths() -> Callable:
    """Rows of (conv_id, role, text), a conversation's in order and together, to one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, has, path, segs, spans, h = None, False, [], [], [], b""

        schema = pa.schema([("conv_id", pa.int64()), ("path", pa.binary()), ("segments", pa.list_(pa.string())), ("loss", pa.list_(pa.list_(pa.int32())))])
        for b in batches:
            for c, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not has or c != conv:
                    if has:
                        out.append((conv, b"".join(path), segs, spans))
                    conv, has, path, segs, spans, h = c, True, [], [], [], b""
                seg, lo, hi = render(role or "", text or "")
                h = xxhash.xxh3_128_digest(h + seg.encode("utf-8", "surrogatepass"))
                path.append(h)
                segs.append(seg)
                spans.append([lo, hi])
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
                out = []
        if has:
            out.append((conv, b"".join(path), segs, spans))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)

    return run


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, path (16 bytes per node), segments (a turn each), loss (a [begin, end) per segment)."""
    turns = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    in_order = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return materialize(in_order.mapInArrow(_paths(), "conv_id long, path binary, segments array<string>, loss array<array<int>>"), "chat_paths")


def _new_nodes(before: dict[int, bytes]) -> Callable:
    """Of each path, in order, the nodes that its predecessor lacks, numbered by ``place`` within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, 0
        for b in batches:
            cols: list[list] = [[], [], [], [], [], [], [], [], []]
            for part, path, segments, loss in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if last is None:
                    last = before.get(part, b"")
                n, k = len(path) // 16, 0
                while k < n and path[16 * k : 16 * k + 16] == last[16 * k : 16 * k + 16]:
                    k += 1
                position = sum(map(len, segments[:k]))
                for d in range(k, n):
                    node, parent = path[16 * d : 16 * d + 16], path[16 * d - 16 : 16 * d] if d else None
                    for c, v in zip(cols, (part, place, node, parent, d, segments[d], len(segments[d]), position, loss[d]), strict=True):
                        c.append(v)
                    position += len(segments[d])
                    place += 1
                last = path
            types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["part", "place", "node", "parent", "depth", "segment", "length", "position", "loss"])

    return run


def _place(starts: dict[int, int], open_at: dict[int, list[tuple[bytes, int, int]]]) -> Callable:
    """Offsets and ancestor intervals, from a stack of the open nodes. ``open_at``: the stack with which a partition begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for b in batches:
            begin, intervals = [], []
            for part, node, depth, length in zip(*(b.column(c).to_pylist() for c in ("part", "node", "depth", "length")), strict=True):
                if at is None:
                    at, stack = starts.get(part, 0), list(open_at.get(part, []))
                del stack[depth:]
                merged: list[list[int]] = []
                for _, lo, hi in stack:
                    if merged and merged[-1][1] == lo:
                        merged[-1][1] = hi
                    else:
                        merged.append([lo, hi])
                begin.append(at)
                intervals.append(merged)
                stack.append((node, at, at + length))
                at += length
            arrays = [b.column(c) for c in b.schema.names] + [pa.array(begin, pa.int64()), pa.array(intervals, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, "begin", "attends"])

    return run


def prefix_tree(formatted: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per node, in depth-first order of ``begin``.

    node, parent (null at a root), depth, segment, length, position (of the node's first token in its conversation), loss
    ([begin, end) within the segment), begin (place in the sequence) and attends (the ancestors' places, merged). Token i of a node has position ``position + i``.
    """
    spark = formatted.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = formatted.groupBy("path").agg(F.first(F.struct("segments", "loss")).alias("s")).select("path", "s.segments", "s.loss")
    ordered = distinct.repartitionByRange(n, "path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered.select("part", "path", "segments", "loss"), "chat_order")
    # The last path of each partition: what the first of the next is compared with.
    ends = sorted(tuple(r) for r in ordered.groupBy("part").agg(F.max("path")).collect())
    before = {b[0]: bytes(a[1]) for a, b in zip(ends, ends[1:])}  # noqa: B905
    again = ordered.repartition(F.col("part")).sortWithinPartitions("part", "path").select("part", "path", "segments", "loss")
    nodes = again.mapInArrow(_by_part(_new_nodes(before)), "part int, place long, node binary, parent binary, depth int, segment string, length long, position long, loss array<int>")
    nodes = materialize(nodes, "chat_nodes")
    starts, total = {}, 0
    for part, length in sorted(tuple(r) for r in nodes.groupBy("part").agg(F.sum("length")).collect()):
        starts[part] = total
        total += length
    in_order = nodes.repartition(F.col("part")).sortWithinPartitions("part", "place")
    schema = _schema(nodes) + ", begin long, attends array<array<long>>"
    # Ancestors that a partition's first nodes have in earlier partitions: a first pass places every node, a join finds those few.
    wanted = [(p, d, bytearray(before[p][16 * d : 16 * d + 16])) for p in starts for d in range(len(before.get(p, b"")) // 16)]
    open_at: dict[int, list] = {}
    if wanted:
        placed = in_order.mapInArrow(_by_part(_place(starts, {})), schema).select("node", "begin", "length")
        need = spark.createDataFrame(wanted, "p int, d int, node binary")
        for p, _, h, lo, size in sorted(tuple(r) for r in placed.join(F.broadcast(need), "node").select("p", "d", "node", "begin", "length").collect()):
            open_at.setdefault(p, []).append((bytes(h), lo, lo + size))
    return in_order.mapInArrow(_by_part(_place(starts, open_at)), schema).drop("part", "place")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _by_part(run: Callable) -> Callable:
    """Runs ``run`` anew for each value of the column part; the rows of one come together."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in itertools.groupby(_pieces(batches), key=lambda x: x[0]):
            yield from run(b for _, b in pieces)

    return split


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for b in batches:
        parts = b.column(b.schema.get_field_index("part")).to_pylist()
        start = 0
        for i in range(1, len(parts) + 1):
            if i == len(parts) or parts[i] != parts[start]:
                yield parts[start], b.slice(start, i - start)
                start = i


def read_back(formatted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each conversation's formatted text put together again from the tree: conv_id, formatted, loss (places of all assistant texts)."""
    paths = formatted.select("path").distinct()  # equal conversations are put together once
    wanted = paths.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("length(path) div 16 - 1")), lambda d: F.expr("path").substr(d * 16 + 1, F.lit(16)))).alias("d", "node"))
    wanted = materialize(wanted.select(F.md5("path").alias("name"), "d", "node"), "chat_wanted")
    parts = spread_join(wanted, nodes.select("node", "segment", "position", "loss"), ["node"], ["name"])
    pieces = F.sort_array(F.collect_list(F.struct("d", "segment", "position", "loss")))
    whole = parts.groupBy("name").agg(pieces.alias("p"))
    loss = F.transform(F.filter("p", lambda x: x["loss"][1] > x["loss"][0]), lambda x: F.array(x["position"] + x["loss"][0], x["position"] + x["loss"][1]))
    whole = whole.select("name", F.array_join("p.segment", "").alias("formatted"), loss.alias("loss"))
    return spread_join(formatted.select("conv_id", F.md5("path").alias("name")), whole, ["name"], ["conv_id"]).drop("name")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for conv, formatted, spans in zip(*(x.to_pylist() for x in b.columns), strict=True):
            turns = parse(formatted)
            said = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
            loss = "".join(unescape(formatted[lo:hi]) for lo, hi in spans)
            row = (conv, len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(formatted))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def conversation_digests(back: DataFrame) -> DataFrame:
    """What the formatted text and loss mask of each conversation hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return back.select("conv_id", "formatted", "loss").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Repair of conversation structure: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``, a system turn at most and then user and assistant in turn.

A node of the edit lattice is how many turns are done and where the grammar stands; edges keep (K), rerole (R) or delete (D) the next turn or insert
an empty one (I). The lattice is never built: Dijkstra's algorithm expands nodes from a queue by (cost, edits so far) and stops at the first accepting node at the end. No edit but K is free and K uses
up a turn, so edits that lead to one node at one cost never begin one another, and the least edits stay least however both go on.

Rows are range-partitioned by conversation and turn, and tasks read them as a stream. A conversation that lies within a partition is solved there. One that crosses
partitions, or has more than ``BLOCK`` turns, gives pieces: each is solved from every state of the grammar to every state, turns inserted before the turn they precede, so that edits up to a border
never begin one another either. Pieces are then stitched in order, with a cost, an order among equal costs and a running hash for each state; a hash of a whole conversation is one stream, so what
passes through one task there is a piece at a time.

Defined results: null roles and texts are one space; a null conv_id is one conversation; null turns come first. Turns of one number are in order of role, then of a hash of the text.
Rows that are repeated are duplicates like others. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.llm.shared import WHITE, materialize, spread_join

#: Turns that are solved at once.
BLOCK = 512
#: Cost of a new role or turn, of a deletion, and of what stays truncated.
CHANGE, DELETE, TRUNCATED = 3, 4, 3
#: States of the grammar: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
#: Edits that end a conversation from each state.
_TAIL = ("", "II", "I", "")

Turn = tuple[str, str, str]  # role, text, fault: "" or the initial of blank, duplicate, truncated


def _edges(turns: list[Turn], at: int, state: int, inserts_last: bool) -> Iterator[tuple[int, str, int, int]]:
    """Edits from a node: (cost, initial, turns done, state)."""
    if at < len(turns):
        role, _, fault = turns[at]
        yield DELETE, "D", at + 1, state
        if fault not in ("b", "d"):
            more = TRUNCATED if fault == "t" else 0
            if (kept := _KEEP.get((state, role[:1]))) is not None:
                yield more, "K", at + 1, kept
            yield CHANGE + more, "R", at + 1, _NEXT[state]
    if at < len(turns) or inserts_last:
        yield CHANGE, "I", at, _NEXT[state]


def cheapest(turns: list[Turn]) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    queue, seen = [(0, "", 0, START)], set()
    while True:
        cost, audit, at, state = heapq.heappop(queue)
        if at == len(turns) and state in (START, ASSISTANT):
            return cost, audit
        if (at, state) not in seen:
            seen.add((at, state))
            for more, edit, to, after in _edges(turns, at, state, True):
                if (to, after) not in seen:
                    heapq.heappush(queue, (cost + more, audit + edit, to, after))


def through(turns: list[Turn], state: int) -> dict[int, tuple[int, str]]:
    """Cost and edits of a piece from ``state`` to each state that it can end in, the last edit being that of the last turn."""
    queue, seen, out = [(0, "", 0, state)], set(), {}
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(turns):
            out[state] = (cost, audit)
        for more, edit, to, after in _edges(turns, at, state, False):
            if (to, after) not in seen:
                heapq.heappush(queue, (cost + more, audit + edit, to, after))
    return out


def replay(turns: list[tuple[str, str]], audit: str, state: int) -> str:
    """What edits make of turns, as newline-joined ``role:text``; begins with a newline where the conversation has begun."""
    out, at = [""] if state != START else [], 0
    for edit in audit:
        role, text = turns[at] if edit != "I" else ("", "")
        at += edit != "I"
        if edit == "D":
            continue
        state = _KEEP[state, role[:1]] if edit == "K" else _NEXT[state]
        out.append(f"{role if edit == 'K' else _ROLE[state]}:{text}")
    return "\n".join(out) if out != [""] else ""


def fault_of(text: str, seen: bool) -> str:
    """A turn's first fault: blank, duplicate or truncated, by initial."""
    bare = text.rstrip(WHITE)
    return "b" if not bare else "d" if seen else "" if bare[-1] in ".!?" else "t"


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "n_turns"]


class _Facts:
    """Counts over a conversation's turns in order, which add up over its pieces."""

    def __init__(self) -> None:
        self.of = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.begin = self.end = None  # turn numbers; initials of roles

    def add(self, turn: int | None, role: str, fault: str) -> None:
        self.join(dict.fromkeys(_COUNTS, 0) | {n: int(n[:1] == fault) for n in _COUNTS[:3]} | {"n_turns": int(turn is not None), "first": turn, "last": turn, "begin": role[:1], "end": role[:1]})

    def join(self, next_: dict) -> None:
        for n in _COUNTS:
            self.of[n] += next_[n]
        if self.end is not None:
            self.of["illegal"] += self.end + next_["begin"] not in _LEGAL
        if self.last is not None and self.last == next_["first"]:
            self.of["n_turns"] -= 1
        self.first = next_["first"] if self.first is None else self.first
        self.last = self.last if next_["last"] is None else next_["last"]
        self.begin = next_["begin"] if self.begin is None else self.begin
        self.end = next_["end"]

    def row(self) -> dict:
        return self.of | {"first": self.first, "last": self.last, "begin": self.begin, "end": self.end}

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.of["n_turns"]


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _result(facts: _Facts, cost: int, audit: str, digest: str) -> dict:
    return {"gaps": facts.gaps(), **{n: facts.of[n] for n in _COUNTS[:4]}, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _solve(block: int, schema: pa.Schema) -> Callable:
    """Sorted rows (conv_id, turn, role, text, seen) of a range partition to results of conversations that lie within it, and pieces of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        held: list[tuple] = []  # of one conversation
        of, blocks, whole, before = object(), 0, False, None  # before: the last row; whole: the rows held begin their conversation

        def flush(ends: bool) -> None:
            nonlocal blocks
            facts, turns = _Facts(), []
            for turn, role, text, seen in held:
                fault = fault_of(text, seen)
                facts.add(turn, role, fault)
                turns.append((role, text, fault))
            said = [(role, text) for role, text, _ in turns]
            if whole and ends:
                cost, audit = cheapest(turns)
                out.append({"conv_id": of, "done": True, **_result(facts, cost, audit, sha256(replay(said, audit, START).encode()).hexdigest())})
            else:
                ways = [(u, v, c, a) for u in range(4) for v, (c, a) in through(turns, u).items()]
                out.append({"conv_id": of, "done": False, "part": part, "block": blocks, **facts.row(), "ways": [dict(zip(("u", "v", "cost", "audit"), w, strict=True)) for w in ways], "said": [{"role": r, "text": t} for r, t in said]})
                blocks += 1
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                conv, turn, role, text, seen = row
                if conv != of or before is None:
                    if held:
                        flush(True)
                    of, whole = conv, before is not None
                elif len(held) == block:
                    flush(False)
                    whole = False
                held.append((turn, role, text, seen or row[:4] == before))
                before = row[:4]
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if held:
            flush(False)
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _stitch(schema: pa.Schema) -> Callable:
    """Pieces, each conversation's together and in order, to its result. What is held is one piece, and for each state its edits so far and a running hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, facts, best = None, None, {}

        def result() -> pa.RecordBatch:
            cost, _, state = min((c + CHANGE * len(_TAIL[s]), order, s) for s, (c, order, _, _) in best.items())
            _, _, edits, digest = best[state]
            digest = digest.copy()
            digest.update(replay([], _TAIL[state], state).encode())
            return pa.RecordBatch.from_pylist([{"conv_id": of, **_result(facts, cost, "".join(edits) + _TAIL[state], digest.hexdigest())}], schema)

        for b in batches:
            for k in range(b.num_rows):
                piece = b.slice(k, 1).to_pylist()[0]
                if facts is None or piece["conv_id"] != of:
                    if facts is not None:
                        yield result()
                    of, facts, best = piece["conv_id"], _Facts(), {START: (0, 0, [], sha256())}
                facts.join(piece)
                said = [(t["role"], t["text"]) for t in piece["said"]]
                ways: dict[int, tuple] = {}
                for w in piece["ways"]:
                    if w["u"] in best:
                        cost, order, _, _ = best[w["u"]]
                        way = (cost + w["cost"], order, w["audit"], w["u"])
                        ways[w["v"]] = min(way, ways.get(w["v"], way))
                ranks = sorted((order, audit, v) for v, (_, order, audit, _) in ways.items())
                after = {}
                for rank, (_, audit, v) in enumerate(ranks):
                    u = ways[v][3]
                    digest = best[u][3].copy()
                    digest.update(replay(said, audit, u).encode())
                    after[v] = (ways[v][0], rank, [*best[u][2], audit], digest)
                best = after
        if facts is not None:
            yield result()

    return run


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Trial damage by the checksum of ``conv_id:turn``: of twenty remainders 0 drops a turn, 1 empties it, 2 takes its ``[.!?]``, 3 repeats it, 4 sets its role to user."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(known(conv), F.lit(":"), known(turn))) % 20
    said = F.when(h == 1, "").when(h == 2, F.regexp_replace(known(text), "[.!?]", "")).otherwise(known(text))
    times = F.explode(F.array_repeat(F.lit(1), F.when(h == 3, 2).otherwise(1))).alias("_times")
    return rows.where(h != 0).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(h == 4, "user").otherwise(known(role)).alias("role"), said.alias("text"), times).drop("_times")


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """One row per conversation of ``rows``: conv_id, gaps in turn numbers, blank, duplicate, truncated and illegally adjacent turns, cost and audit of the edits, repaired_sha256."""
    spark, kind = rows.sparkSession, rows.schema[conv].dataType.simpleString()
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("name")
    turns = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), known(role).alias("role"), known(text).alias("text"))
    sized: Callable[[str | Column], Column] = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    same = F.sha2(F.concat(F.col("conv_id").isNull().cast("string"), sized(name), sized(F.col("role")), F.col("text")), 256).alias("same")
    turns = turns.select("*", same)
    number = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = turns.groupBy("same").agg(F.min(number).alias("earliest"))
    marked = spread_join(turns, firsts, ["same"], ["turn"]).select("conv_id", "turn", "role", "text", (number > F.col("earliest")).alias("seen"), F.xxhash64("text").alias("h"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = marked.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").drop("h")
    ways, said = "array<struct<u:int,v:int,cost:long,audit:string>>", "array<struct<role:string,text:string>>"
    pieces = f"part int, block int, n_turns long, first long, last long, begin string, end string, ways {ways}, said {said}"
    both = f"conv_id {kind}, done boolean, {_RESULT}, {pieces}"
    solved = materialize(ordered.mapInArrow(_solve(block, _arrow(spark, both)), both), "repair")
    out = f"conv_id {kind}, {_RESULT}"
    ended = solved.where("done").select("conv_id", *(c.split()[0] for c in _RESULT.split(", ")))
    cut = solved.where("NOT done").select("conv_id", "blank", "duplicate", "truncated", "illegal", "part", "block", "n_turns", "first", "last", "begin", "end", "ways", "said")
    stitched = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(_stitch(_arrow(spark, out)), out)
    return ended.unionByName(stitched)


def _arrow(spark, schema: str) -> pa.Schema:
    """A schema as Arrow has it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def repair_report(rows: DataFrame, after: DataFrame, conv: str = "conv_id", **options) -> DataFrame:
    """``repair_conversations`` of ``after``, with every conversation of ``rows``: those without a turn left have counts of 0, no edits and the hash of nothing."""
    found = repair_conversations(after, **options).withColumnRenamed("conv_id", "_of")
    every = rows.select(F.col(conv).alias("conv_id")).distinct()
    none = {c.split()[0]: F.lit(0).cast("long") for c in _RESULT.split(", ")[:6]} | {"audit": F.lit(""), "repaired_sha256": F.lit(sha256().hexdigest())}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_of")), "left").select("conv_id", *(F.coalesce(c, v).alias(c) for c, v in none.items()))

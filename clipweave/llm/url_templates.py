"""URL filters: a tree of path templates per host.

A page's path is read segment by segment. Under each host and parent template, a segment that occurs often enough stays as it is; the
others are variable and become a wildcard, which keeps only a file ending. Labelled pages give each node its share of blocked
pages. Sibling branches whose shares don't differ significantly from their parent's are merged and pool their counts; of those that differ,
siblings whose shares don't differ significantly from the next one's are merged as well. Shares are smoothed towards the parent's, from the host down, and a page is blocked where its template's
smoothed share reaches the threshold. Explicit rules come first: a rule fits a host and its subdomains where the path begins as the
rule's does, and the longest fitting rule decides. Pages that a rule decides are labelled by it.

Nodes of many paths are grouped and joined over narrow rows, distinct paths with their counts: counts are partially aggregated and joins on a node salt frequent ones, so a
host with a third of all pages is spread. That goes level by level, while a node has more than ``IN_TASK`` paths; what lies under a smaller node is settled in one task, however deep its
paths are. Under a node of fewer than ``least`` pages no segment can stay literal, so a path there is judged by that node.

Defined results: a url that is null or has no ``://`` has an empty host and path. Without any label every page that no rule decides is allowed. Repeated rows repeat; null ids stay null; an empty table gives an empty
result. Columns other than the id and the url are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.llm.shared import materialize, spread_join

#: Rules as (verdict, host, path prefix); their number is part of the query, not of the data.
Rule = tuple[str, str, str]
#: A node of so many distinct paths at most, with so many segments each on average, is settled in one task.
IN_TASK, SEGMENTS = 4096, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url column."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _wild(segment: Column) -> Column:
    """A wildcard that keeps the ending, as in ``*.html``."""
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"\.[A-Za-z]{1,5}\z", 0))


def _ending(segment: str) -> str:
    m = re.search(r"\.[A-Za-z]{1,5}\Z", segment)
    return m[0] if m else ""


def template_tree(paths: DataFrame, least: int = 4, share: float = 0.02, in_task: int = IN_TASK) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The tree of ``paths`` (host, path, n rows, labelled of them, bad of those) down to nodes of at most ``in_task`` paths.

    Returns what lies under those (host, node, depth, path, parts, n, labelled, bad), the paths that end at larger nodes (host, path, node), and each level's nodes: host, up, node, n, labelled, bad.
    A segment stays literal with at least ``least`` rows and ``share`` of its parent's rows.
    """
    parts = F.split(F.regexp_replace("path", "^/|/$", ""), "/")
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(parts)
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad", "paths", "segments")]
    every = paths.select("host", "path", "n", "labelled", "bad", parts.alias("parts")).select("*", F.lit(1).alias("paths"), F.size("parts").alias("segments"))
    root = materialize(every.groupBy("host").agg(*sums).select("host", F.lit(None).cast("string").alias("up"), F.lit("").alias("node"), "n", "labelled", "bad", "paths", "segments"), "url_hosts")
    levels = [root]
    small = ((F.col("paths") <= in_task) & (F.col("segments") <= in_task * SEGMENTS) | (F.col("paths") == 1)).alias("small")
    open_ = spread_join(every, root.select("host", "node", F.col("n").alias("node_n"), small), ["host"], ["path"])
    under = ended = None
    depth = 0
    while True:
        open_ = materialize(open_, f"url_open_{depth}")
        here = open_.where("small").select("host", "node", F.lit(depth).alias("depth"), "path", "parts", "n", "labelled", "bad")
        ends = open_.where(~F.col("small") & (F.size("parts") <= depth)).select("host", "path", "node")
        under, ended = (here, ends) if under is None else (under.unionByName(here), ended.unionByName(ends))
        open_ = open_.where(~F.col("small") & (F.size("parts") > depth))
        if open_.isEmpty():
            break
        open_ = open_.withColumn("seg", F.get("parts", F.lit(depth)))
        kids = open_.groupBy("host", F.col("node").alias("up"), "seg").agg(*sums, F.first("node_n").alias("up_n"))
        literal = (F.col("n") >= least) & (F.col("n") >= share * F.col("up_n"))
        kids = materialize(kids.withColumn("node", F.concat_ws("/", "up", F.when(literal, F.col("seg")).otherwise(_wild(F.col("seg"))))), f"url_kids_{depth}")
        level = materialize(kids.groupBy("host", "up", "node").agg(*sums), f"url_nodes_{depth}")
        levels.append(level)
        named = spread_join(kids.select("host", "up", "seg", "node"), level.select("host", "node", F.col("n").alias("node_n"), small), ["host", "node"], ["seg"])
        open_ = open_.drop("node_n", "small").withColumnRenamed("node", "up")
        open_ = spread_join(open_, materialize(named, f"url_named_{depth}"), ["host", "up", "seg"], ["path"]).drop("up", "seg")
        depth += 1
    return under, ended, levels


class _Node:
    """A node of a tree that is built in a task: its name, the node above it, its paths and the share of bad pages."""

    def __init__(self, name: str, up: _Node | None, members: list[int], share: float) -> None:
        self.name, self.up, self.members, self.share = name, up, members, share

    def path(self) -> list[str]:
        names, node = [], self
        while node.up is not None:
            names.append(node.name)
            node = node.up
        return names[::-1]


def _branches(kids: dict[str, list], up_share: float, prior: float, z: float) -> dict[str, float]:
    """The share of each child (name to [labelled, bad, ...]) with siblings that don't differ significantly pooled, as ``judged`` has it."""
    rows = []
    for name, (labelled, bad, *_) in kids.items():
        count = max(labelled, 1)
        similar = labelled == 0 or abs(bad / count - up_share) <= z * math.sqrt(up_share * (1 - up_share) / count)
        rows.append((similar, bad / count, name, count, labelled, bad))
    out: dict[str, float] = {}
    for similar in (True, False):
        pools: list[list[tuple]] = []
        for row in sorted(r for r in rows if r[0] == similar):
            if pools:
                _, rate, _, count, _, bad = pools[-1][-1]
                mean = (row[5] + bad) / (row[3] + count)
                apart = abs(row[1] - rate) > z * math.sqrt(mean * (1 - mean) * (1 / row[3] + 1 / count))
            if not pools or (apart and not similar):
                pools.append([])
            pools[-1].append(row)
        for pool in pools:
            value = (sum(r[5] for r in pool) + prior * up_share) / (sum(r[4] for r in pool) + prior)
            out |= {r[2]: value for r in pool}
    return out


def _subtree(parts: list[list[str]], counts: list[tuple[int, int, int]], depth: int, share_up: float, least: int, share: float, prior: float, z: float) -> Iterator[tuple[int, list[str], float]]:
    """Each path's (number, template below the node at ``depth``, share), from the node's paths with their (n, labelled, bad). Steps follow the nodes, of which there are no more than segments."""
    open_ = [(depth, _Node("", None, list(range(len(parts))), share_up))]
    while open_:
        d, node = open_.pop()
        total = sum(counts[i][0] for i in node.members)
        if total < least:
            further: list[int] = []
            ends = node.members
        else:
            further = [i for i in node.members if len(parts[i]) > d]
            ends = [i for i in node.members if len(parts[i]) <= d]
        if ends:
            names = node.path()
            for i in ends:
                yield i, names + ["*" + _ending(x) for x in parts[i][d:]], node.share
        if not further:
            continue
        rows: dict[str, int] = {}
        for i in further:
            rows[parts[i][d]] = rows.get(parts[i][d], 0) + counts[i][0]
        kids: dict[str, list] = {}
        for i in further:
            seg = parts[i][d]
            name = seg if rows[seg] >= least and rows[seg] >= share * total else "*" + _ending(seg)
            kid = kids.setdefault(name, [0, 0, []])
            kid[0] += counts[i][1]
            kid[1] += counts[i][2]
            kid[2].append(i)
        shares = _branches(kids, node.share, prior, z)
        open_.extend((d + 1, _Node(name, node, kid[2], shares[name])) for name, kid in kids.items())


def _settle(least: int, share: float, prior: float, z: float) -> Callable:
    """Rows (host, node, depth, share, path, parts, n, labelled, bad), a node's together, to (host, path, template, share). What is held is one node's paths."""
    names = ["host", "path", "template", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (host, node, depth, up), group in itertools.groupby(rows, key=lambda r: r[:4]):
            members = list(group)
            found = _subtree([m[5] for m in members], [m[6:] for m in members], depth, up, least, share, prior, z)
            out = [(host, members[i][4], "/".join([node, *below]), value) for i, below, value in found]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    return run


def placed_paths(paths: DataFrame, least: int = 4, share: float = 0.02, prior: float = 4.0, z: float = 2.0, in_task: int = IN_TASK) -> DataFrame:
    """``paths`` (as ``template_tree``) with template and smoothed share of bad pages: host, path, template, share."""
    under, ended, levels = template_tree(paths, least, share, in_task)
    shares = materialize(judged(levels, prior, z), "url_shares")
    rows = under.join(shares, ["host", "node"]).select("host", "node", "depth", "share", "path", "parts", "n", "labelled", "bad")
    rows = rows.repartition("host", "node").sortWithinPartitions("host", "node", "path")
    settled = rows.mapInArrow(_settle(least, share, prior, z), "host string, path string, template string, share double")
    return settled.unionByName(ended.join(shares, ["host", "node"]).select("host", "path", F.col("node").alias("template"), "share"))


def judged(levels: list[DataFrame], prior: float = 4.0, z: float = 2.0) -> DataFrame:
    """The tree's nodes with their smoothed shares of bad pages: host, node, share."""
    total = levels[0].agg(F.sum("bad").alias("b"), F.sum("labelled").alias("n")).first()
    base = float(total["b"] or 0) / max(1, total["n"] or 0)
    smooth = lambda b, n, toward: (b + prior * toward) / (n + prior)
    level = levels[0].select("host", "node", smooth(F.col("bad"), F.col("labelled"), F.lit(base)).alias("share"))
    every = level
    for d, own in enumerate(levels[1:], 1):
        up = level.select("host", F.col("node").alias("up"), F.col("share").alias("up_share"))
        own = own.join(up, ["host", "up"]).withColumn("count", F.greatest("labelled", F.lit(1))).withColumn("rate", F.col("bad") / F.col("count"))
        spread = F.sqrt(F.col("up_share") * (1 - F.col("up_share")) / F.col("count"))
        own = own.withColumn("similar", (F.col("labelled") == 0) | (F.abs(F.col("rate") - F.col("up_share")) <= z * spread))
        # Siblings in order of their rates: a branch begins where a rate differs significantly from the one before it. A node has few children, as each literal one has a share of it.
        in_order = Window.partitionBy("host", "up", "similar").orderBy("rate", "node")
        before = lambda c: F.lag(c).over(in_order)
        mean = (F.col("bad") + before("bad")) / (F.col("count") + before("count"))
        apart = F.abs(F.col("rate") - before("rate")) > z * F.sqrt(mean * (1 - mean) * (1 / F.col("count") + 1 / before("count")))
        own = own.withColumn("apart", F.coalesce((apart & ~F.col("similar")).cast("int"), F.lit(0)))
        own = own.withColumn("branch", F.sum("apart").over(in_order))
        pool = Window.partitionBy("host", "up", "similar", "branch")
        share = smooth(F.sum("bad").over(pool), F.sum("labelled").over(pool), F.col("up_share"))
        level = materialize(own.select("host", "node", share.alias("share")), f"url_shares_{d}")
        every = every.unionByName(level)
    return every


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", least: int = 4, reject_at: float = 0.5, in_task: int = IN_TASK) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, share (of blocked pages, smoothed)."""
    host, path = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    bad = F.when(F.col("by_rule").isNotNull(), (F.col("by_rule.verdict") == "block").cast("int"))
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    paths = paths.select("host", "path", "n", "by_rule", F.when(bad.isNotNull(), F.col("n")).otherwise(0).alias("labelled"), (F.col("n") * F.coalesce(bad, F.lit(0))).alias("bad"))
    paths = materialize(paths, "url_paths")
    placed = placed_paths(paths, least, in_task=in_task)
    by_method = F.when(F.col("share") >= reject_at, "block").otherwise("allow")
    placed = placed.join(paths.select("host", "path", "by_rule"), ["host", "path"]).select("host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.verdict", by_method).alias("verdict"), "template", "share")
    return spread_join(rows, materialize(placed, "url_placed"), ["host", "path"], ["page_id"]).select("page_id", "host", "path", "rule", "verdict", "template", "share")

"""Exact and near deduplication against brute force, with awkward rows."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipweave.llm import near_dedup as nd
from clipweave.llm.components import connected_components
from clipweave.llm.exact_dedup import directory, drop_copies, exact_dedup

SCHEMA = "doc_id long, text string, source string, keep_id string, rid int"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", 1) for i, t in rows], SCHEMA)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((len(t or ""), i))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[0], m[1]))[1]
        out += [(i, keep, len(members), sha256(norm.encode()).hexdigest()) for _, i in members]
    return sorted(out)


ROWS = [(5, "a b"), (3, "ab"), (9, "a  b"), (1, None), (2, ""), (4, " \n"), (7, "Ab"), (8, "é" * 4000 + "x"), (6, "é" * 4000 + " x"), (10, "a\u00a0b")]


@pytest.mark.parametrize("options", [{}, {"capacity": 2, "key_bits": 2, "max_depth": 2}, {"capacity": 1, "key_bits": 1, "max_depth": 1}])
def test_exact_against_brute_force(spark, options):
    rnd = random.Random(7)
    rows = ROWS + [(100 + k, " ".join(rnd.choices("xyz", k=rnd.randint(1, 3)))) for k in range(120)]
    got = exact_dedup(docs(spark, rows).repartition(5), **options).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_edges(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b")]
    got = exact_dedup(docs(spark, rows)).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 2 and {r.keep_id for r in got if r.group_size == 3} == {1}
    assert drop_copies(docs(spark, [(1, "a"), (2, "a"), (3, "b")])).columns == ["doc_id", "text", "source", "keep_id", "rid"]


def test_exact_ids_given_as_text(spark):
    d = docs(spark, [(30, "a"), (4, "a "), (4, "b")]).withColumn("doc_id", F.col("doc_id").cast("string"))
    got = exact_dedup(d).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(4, 4), (4, 4), (30, 4)]
    assert sorted(r.doc_id for r in drop_copies(d).collect()) == ["4", "4"]


def test_drop_copies_keeps_rows_not_ids(spark):
    rows = [(None, "a"), (None, "b"), (None, "a "), (7, "c"), (7, "d"), (7, "e"), (5, "e"), (8, "f"), (8, "f"), (9, "g"), (9, "g ")]
    out = drop_copies(docs(spark, rows).repartition(3))
    want = [(None, "a "), (None, "b"), (5, "e"), (7, "c"), (7, "d"), (8, "f"), (9, "g ")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_exact_beyond_the_directory_and_hot_keys(spark):
    # Buckets split on by further bits of the key, hot keys get pages whose heads meet, and collisions of short keys stay apart.
    rnd = random.Random(9)
    rows = [(k, f"text {k % 700}" + " " * rnd.randint(0, 3)) for k in range(3000)] + [(5000 + k, "hot" + " " * (k % 5)) for k in range(900)] + [(7000 + k, None) for k in range(300)]
    for options in ({"capacity": 3000, "max_depth": 2}, {"capacity": 3000, "max_depth": 2, "key_bits": 5}, {"capacity": 500, "max_depth": 1, "key_bits": 3}):
        got = exact_dedup(docs(spark, rows).repartition(5), **options).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(rows)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_directory_splits_and_pages():
    entries = directory({0: 5, 1: 5, 2: 1, 3: 40}, 8, 2)
    assert {e[0]: e[3] for e in entries} == {0: 1, 1: 1, 2: 1, 3: 5}
    assert len({e[1] for e in entries}) == 4


def shingle_sets(rows, n=5):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        out.setdefault(i, set()).update(tuple(w[j : j + k]) for j in range(len(w) - k + 1) if w)
    return out


def brute_components(rows, percent=75):
    sets = shingle_sets(rows)
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(sets[i]) for i in ids}


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [rnd.choices(words, k=60) for _ in range(6)]
    rows = []
    for k in range(240):
        w = list(base[k % 6]) if k % 3 else rnd.choices(words, k=rnd.randint(0, 50))
        for _ in range(rnd.randint(0, 4) if k % 3 else 0):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((k, " ".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, "One two"), (1003, "one  TWO"), (1004, "x " * 30000), (1005, "one two three")]


@pytest.mark.parametrize("options", [{}, {"small": 8, "levels": 2, "pivots": 2}])
def test_near_against_brute_force(spark, options):
    rows = corpus(3)
    got = nd.near_duplicates(docs(spark, rows).repartition(3), **options).collect()
    component, size = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == component
    assert {r.doc_id: r.n_shingles for r in got} == size
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("limits", [{"MEMBERS": 6, "PAIRS": 12}, {"MEMBERS": 6, "PAIRS": 12, "small": 4, "levels": 1}])
def test_near_wide_and_large_nodes(spark, monkeypatch, limits):
    # With low limits nodes are cut in blocks that outsiders visit, branch again, or stay large down to the last level.
    options = {k: v for k, v in limits.items() if k.islower()} or {"small": 6, "levels": 3}
    for k in ("MEMBERS", "PAIRS"):
        monkeypatch.setattr(nd, k, limits[k])
    rows = corpus(4)
    got = nd.near_duplicates(docs(spark, rows).repartition(3), pivots=2, **options).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)[0]


def test_near_edges(spark):
    assert nd.near_duplicates(docs(spark, [])).count() == 0
    got = nd.near_duplicates(docs(spark, [(1, "a b c"), (1, "d e f"), (2, "a b c"), (None, "a b c")])).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert len(got) == 3 and by[1] == (2, 1) and by[2][0] == 1 and by[None] == (1, 2)
    kept = nd.drop_near_duplicates(docs(spark, [(1, "a b c"), (2, "a b c"), (3, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == ["doc_id", "text", "source", "keep_id", "rid"]


def test_recall_of_trees():
    # The share of pairs at 0.75 that share a node after all levels of one tree, against the recursion.
    rng = np.random.default_rng(1)
    n, hits, level = 4000, 0, 3
    a = rng.integers(0, 1 << 32, (n, nd.SIGNATURE), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.75, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
    for k in range(n):
        x, y = (nd._mix(np.full(1, k + 1, np.uint64)),) * 2
        for _ in range(level):
            x = nd._children(x, np.repeat(a[k : k + 1], len(x), 0))[0]
            y = nd._children(y, np.repeat(b[k : k + 1], len(y), 0))[0]
            x, y = np.intersect1d(x, y), np.intersect1d(x, y)
        hits += len(x) > 0
    assert abs(hits / n - (1 - nd.lost_after(level, 0.75))) < 0.03


def test_recall_of_trees_that_share_a_signature():
    # The share of pairs at 0.7 that share no node at the last level of any of three trees, drawn from one signature each.
    rng = np.random.default_rng(2)
    n, lost, trees, levels = 6000, 0, 3, 2
    for k in range(n):
        a = rng.integers(0, 1 << 32, (1, nd.SIGNATURE), dtype=np.uint32)
        b = np.where(rng.random(a.shape) < 0.7, a, a + np.uint32(1))
        found = False
        for t in range(trees):
            x = y = nd._mix(np.full(1, 1000 * k + t, np.uint64))
            for _ in range(levels):
                x = nd._children(x, np.repeat(a, len(x), 0))[0]
                y = nd._children(y, np.repeat(b, len(y), 0))[0]
                x, y = np.intersect1d(x, y), np.intersect1d(x, y)
            found |= len(x) > 0
        lost += not found
    assert abs(lost / n - nd.lost_pairs(trees, levels, 0.7)) < 0.01
    assert nd.lost_pairs(nd.trees_for(0.9995, 4, 0.75), 4, 0.75) <= 0.0005
    assert nd.lost_pairs(nd.trees_for(0.9995, 4, 0.75), 1, 0.75) < 1e-6


def test_components(spark):
    rnd = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(200, k) for k in range(201, 240)] + [(k, 2000) for k in range(1000, 1400)] + [(3000, k) for k in range(3001, 3400)] + [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in up}

"""Density clusters against a plain statement of the rule over all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from clipweave.operators import density
from clipweave.operators.density import density_clusters


def plain(ids: list[int], x: np.ndarray, least: int) -> dict[int, int]:
    """Labels by id: all pairs' edges in order, the whole merge tree, its condensed clusters, the most stable ones."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    n = len(x)
    q = (x * x).sum(1)
    d = np.round(np.maximum(q[:, None] + q - 2 * x @ x.T, 0), 9)
    np.fill_diagonal(d, -1)
    core = np.sort(d, 1)[:, least - 1]
    reach = np.maximum(np.maximum(core[:, None], core), d)
    pairs = sorted((reach[i, j], *sorted((ids[i], ids[j])), i, j) for i in range(n) for j in range(i))
    group = {i: i for i in range(n)}
    kids, height, inside, m = {}, {}, {i: {i} for i in range(n)}, n
    for w, _, _, i, j in pairs:
        if group[i] != group[j]:
            kids[m], height[m], inside[m] = (group[i], group[j]), math.sqrt(w), inside[group[i]] | inside[group[j]]
            for k in inside[m]:
                group[k] = m
            m += 1

    def cluster(node: int, birth: float) -> tuple[float, list, set]:
        """(stability, child clusters, points) of the cluster that begins at a node."""
        points, own = inside[node], 0.0
        while True:
            density = 1 / max(height[node], 1e-12)
            big = [k for k in kids[node] if len(inside[k]) >= least]
            if len(big) == 1:
                own += (len(inside[node]) - len(inside[big[0]])) * (density - birth)
                node = big[0]
                continue
            own += len(inside[node]) * (density - birth)
            return own, [cluster(k, density) for k in big], points

    def best(c) -> tuple[float, list[set]]:
        own, below, points = c
        found = [best(b) for b in below]
        if not below or own >= sum(f[0] for f in found):
            return own, [points]
        return sum(f[0] for f in found), [s for f in found for s in f[1]]

    top = cluster(m - 1, 0.0)
    chosen = [s for b in top[1] for s in best(b)[1]]
    chosen.sort(key=lambda s: min(ids[k] for k in s))
    return {ids[k]: next((c for c, s in enumerate(chosen) if k in s), -1) for k in range(n)}


@pytest.mark.parametrize("least,block,run", [(5, 2048, 100_000), (9, 64, 37)])
def test_like_the_plain_rule(spark, least, block, run):
    rng = np.random.default_rng(least)
    centres = rng.normal(0, 1, (6, 8))
    x = np.concatenate([centres[k % 6] + rng.normal(0, [0.05, 0.1, 0.3][k % 3], 8) for k in range(200)] + [rng.normal(0, 1, 8) for _ in range(40)]).reshape(-1, 8)
    x[7] = x[13] = x[1]  # copies
    ids = rng.permutation(1000)[: len(x)].tolist()
    d = spark.createDataFrame([(i, v.tolist(), "other") for i, v in zip(ids, x, strict=True)], "id long, v array<double>, cluster string")
    got = {r.id: r.cluster for r in density_clusters(d, "id", "v", least, block, run).collect()}
    want = plain(ids, x, least)
    assert len(set(want.values())) > 3
    assert got == want


def test_edges_of_the_rule(spark):
    schema = "id long, v array<double>"
    labels = lambda rows, *a: {r.id: r.cluster for r in density_clusters(spark.createDataFrame(rows, schema), "id", "v", *a).collect()}
    assert labels([]) == {}
    assert labels([(1, [1.0, 0.0])]) == {1: 0}
    assert labels([(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, []), (5, [1.0, 0.0])]) == {1: -1, 2: -1, 3: -1, 4: -1, 5: 0}
    assert set(labels([(k, [1.0, 0.0]) for k in range(30)]).values()) <= {-1, 0, 1, 2, 3, 4, 5}  # all ties: any split of equal vectors, but an end
    with pytest.raises(ValueError, match="repeated"):
        labels([(1, [1.0]), (1, [2.0])])


def test_bytes_do_not_grow_with_blocks(spark):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (900, 48)))], "id long, v array<double>").cache()
    d.count()
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    took = []
    for block_rows in (2048, 64):
        before = shuffled()
        density_clusters(d, "id", "v", 5, block_rows).collect()
        took.append(shuffled() - before)
    assert 0 < took[1] < 1.5 * took[0]


def test_ranges_narrow_to_the_distance(monkeypatch):
    """The distance is found where ranges guessed from a block miss it, and where a block may hold no distances."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 4))
    x[:40] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(300)
    d = density._Part(ids, x, {}).squared_distances(density._Part(ids, x, {}))
    np.fill_diagonal(d, np.inf)
    for held in (0, 1 << 22):
        monkeypatch.setattr(density, "HELD", held)
        for index in (0, 20, 298):
            want, own, rounds = np.sort(d, 1)[:, index], ids[30:60], 0
            lo = hi = np.zeros(30, np.int64)
            while not rounds or (hi - lo != 1).any():
                fold, rounds = density._Core(index, 300), rounds + 1
                s = fold.start(density._Part(own, x[own], {"lo": lo, "hi": hi}))
                for k in range(0, 300, 100):
                    fold.meet(s, density._Part(ids[k : k + 100], x[k : k + 100], {}))
                found = {i: (a, b) for i, a, b in zip(*[c.to_pylist() for c in fold.result(s).columns], strict=True)}
                lo, hi = (np.array([found.get(i, (lo[k], hi[k]))[e] for k, i in enumerate(own)]) for e in (0, 1))
                assert (lo <= want[own]).all() and (want[own] < hi).all() and rounds < 10
            assert (lo == want[own]).all()


@pytest.mark.parametrize("comps", [600, 5])
def test_edges_are_sought_only_where_they_may_be_shorter(monkeypatch, comps):
    rng = np.random.default_rng(comps)
    x = rng.normal(0, 1, (600, 8)) + 4 * np.eye(8)[rng.integers(0, 5, 600)]
    x[:20] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, comp = np.arange(600), rng.permutation(600) % comps
    d = density._Part(ids, x, {}).squared_distances(density._Part(ids, x, {}))
    core = np.sort(d, 1)[:, 60]
    reach = np.maximum(np.maximum(core[:, None], core), d)
    least = {}
    for a in range(600):
        for b in np.flatnonzero(comp != comp[a]):
            least[comp[a]] = min(least.get(comp[a], (np.inf,)), (reach[a, b] / density.SCALE, min(a, b), max(a, b), comp[b]))
    pairs, plain_distances = [], density._Part.squared_distances
    monkeypatch.setattr(density._Part, "squared_distances", lambda own, other: pairs.append(len(own.id) * len(other.id)) or plain_distances(own, other))
    blocks = [np.flatnonzero(ids % 3 == k) for k in range(3)]
    part = lambda rows: density._Part(ids[rows], x[rows], {"core": core[rows], "comp": comp[rows]})
    got = {}
    for own in blocks:
        s = density._Outgoing().start(part(own))
        for guests in blocks:
            for k in range(0, len(guests), 20):
                density._Outgoing().meet(s, part(guests[k : k + 20]))
        for c, *edge in zip(*[c.to_pylist() for c in density._Outgoing().result(s).columns], strict=True):
            got[c] = min(got.get(c, (np.inf,)), tuple(edge))
    assert got == least
    assert sum(pairs) < 0.6 * 600 * 600

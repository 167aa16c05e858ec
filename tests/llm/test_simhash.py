"""SimHash groups against a plain statement of the rule."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from clipweave.llm.queries import QUERIES
from clipweave.llm.simhash import drop_simhash_duplicates, fingerprint, near_links, simhash_groups


def plain_fingerprint(text, n=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, prints):
    """Component of each row, by comparing all pairs of distinct fingerprints."""
    distinct = sorted(set(prints))
    part = {f: {f} for f in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2 and part[a] is not part[b]:
                small, large = sorted((part[a], part[b]), key=len)
                large |= small
                for f in small:
                    part[f] = large
    ids = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            ids[f] = min(i, ids.get(f, i))
    least = lambda f: min((ids[g] for g in part[f] if g in ids), default=None)
    return sorted(((i, f"{f:016x}", least(f)) for (i, _), f in zip(rows, prints, strict=True)), key=str)


def as_rows(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "f", 3, "c") for i, t in rows], "doc_id long, text string, fingerprint string, fp int, component_id string")


def test_against_plain_rule(spark):
    rnd = random.Random(4)
    base = [rnd.choices("abcdefghijklmnop", k=rnd.randint(20, 400)) for _ in range(12)]
    rows = []
    for k in range(240):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice("xyzXYZ")
        rows.append((k, " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n\x0b"), (903, "One"), (904, "one"), (905, "one two"), (906, "a b É"), (907, "é" * 50_000), (908, "w " * 70_000)]
    rows += [(5, "again"), (5, "again"), (None, "one"), (None, "nobody else has these words"), (None, None)]
    got = as_rows(simhash_groups(table(spark, rows).repartition(5)))
    assert got == plain_groups(rows, [plain_fingerprint(t) for _, t in rows])
    assert len({c for _, _, c in got}) < 200


def test_empty_and_dropping(spark):
    assert simhash_groups(table(spark, [])).count() == 0
    out = drop_simhash_duplicates(table(spark, [(2, "a b c d"), (1, "a B c d"), (None, "a b c d"), (3, "x y z w v")]))
    assert out.columns == ["doc_id", "text", "fingerprint", "fp", "component_id"]
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, None]


@pytest.mark.parametrize("members", [2, 5, 40])
def test_large_keys_are_indexed_again(spark, members):
    # Fingerprints that share halves, quarters and more, so that keys stay large for several levels.
    rnd = random.Random(members)
    fps = set()
    for _ in range(6):
        center = rnd.getrandbits(64)
        for _ in range(120):
            f = center
            for _ in range(rnd.randint(0, 5)):
                f ^= 1 << rnd.choice([rnd.randrange(64), rnd.randrange(8)])
            fps.add(f)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = near_links(spark.createDataFrame(signed, "fp long").repartition(3), members).collect()
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= 2 and a != b for a, b in links)
    part = {f: f for f in fps}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        part[max(root(a & mask), root(b & mask))] = min(root(a & mask), root(b & mask))
    groups = {f: root(f) for f in fps}
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            assert (a ^ b).bit_count() > 2 or groups[a] == groups[b]


def test_registered_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = as_rows(QUERIES["op11_simhash_near_dedup"](spark, sf_dir))
    assert got == plain_groups(rows, [plain_fingerprint(t) for _, t in rows])


def test_fingerprint_counts_in_parts():
    text = " ".join(random.Random(1).choices(["ab", "cd", "ef", "gh"], k=80_000))
    assert fingerprint(text) == plain_fingerprint(text)
    assert np.uint64(fingerprint("x")) == plain_fingerprint("x")

"""Candidates against plain statements of their rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clipweave.operators import candidates as cd

ROWS = "rec string, id string, start double, end double, score double"


def plain_suppress(rows, most):
    kept = []
    for rec, i, s, e, score in sorted(rows, key=lambda r: (-r[4], r[2], r[1])):
        if not any(rec == k[0] and max(min(e, k[3]) - max(s, k[2]), 0.0) / max(min(e - s, k[3] - k[2]), 0.001) >= most for k in kept):
            kept.append((rec, i, s, e, score))
    return sorted(k[:2] for k in kept)


@pytest.mark.parametrize(("block", "most"), [(1.0, 0.82), (7.0, 0.6), (3600.0, 0.6)])
def test_suppress_against_plain_rule(spark, block, most):
    rnd = random.Random(int(block))
    rows = []
    for k in range(260):
        s = round(rnd.uniform(0, 40), 1)
        rows.append((rnd.choice("ab"), f"x{k}", s, s + rnd.choice([1.0, 3.0, 4.5, 6.0, 25.0, 0.0]), rnd.choice([0.5, 0.7, round(rnd.random(), 2)])))
    got = cd.suppress(spark.createDataFrame(rows, ROWS).repartition(3), ["rec"], "score", "id", most, block)
    assert sorted((r.rec, r.id) for r in got.collect()) == plain_suppress(rows, most)


def test_suppress_a_chain_over_every_border(spark):
    # Scores fall along the recording, so that each row waits for the one before it, over all blocks.
    rows = [("r", f"x{k:03}", 1.0 * k, 1.0 * k + 3.0, 1.0 - k / 100) for k in range(40)]
    got = cd.suppress(spark.createDataFrame(rows, ROWS), ["rec"], "score", "id", 0.6, block=10.0)
    assert sorted((r.rec, r.id) for r in got.collect()) == plain_suppress(rows, 0.6)
    assert cd.suppress(spark.createDataFrame([], ROWS), ["rec"], "score", "id", 0.6).count() == 0


def test_suppress_keeps_blocks_whole_where_joins_change(spark):
    # Many rows and few that wait: the join that finds their blocks is a shuffle by Spark's guess, but a broadcast once the blocks are counted.
    rnd = random.Random(9)
    rows = [(f"r{r}", f"{rnd.getrandbits(128):032x}", 20.0 * k, 20.0 * k + 3.0, 0.5) for r in range(150) for k in range(40)]
    rows += [(f"c{c}", f"{k:03}{rnd.getrandbits(128):032x}", 1.0 * k, 1.0 * k + 3.0, 1.0 - k / 100) for c in range(4) for k in range(40)]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = cd.suppress(spark.createDataFrame(rows, ROWS).repartition(4), ["rec"], "score", "id", 0.6, block=10.0)
        got = sorted((r.rec, r.id) for r in got.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(x for rec in {r[0] for r in rows} for x in plain_suppress([r for r in rows if r[0] == rec], 0.6))


def test_window_text_reads_parts_of_a_token_once(spark):
    words = [("r", 0, 1.0, 1.2, "a", "a1"), ("r", 1, 1.2, 1.4, "b", None), ("r", 2, 1.4, 1.5, "New-York", "t"), ("r", 3, 1.5, 1.6, "New-York", "t"), ("r", 4, 9.9, 12.0, "late", ""), ("r", 5, 10.0, 10.1, "late", "")]
    w = spark.createDataFrame(words, "rec string, pos long, start double, end double, word string, token string")
    windows = spark.createDataFrame([("r", "all", 0.0, 20.0), ("r", "none", 3.0, 4.0), ("r", "cut", 1.1, 1.55), ("r", "late", 9.9, 11.0), ("s", "other", 0.0, 9.0)], "rec string, id string, start double, end double")
    got = {r.id: (r.transcript, r.word_count) for r in cd.window_text(windows, w, ["rec"], "id").collect()}
    assert got == {"all": ("a b New-York late late", 6), "none": (None, 0), "cut": ("b New-York", 2), "late": ("late", 1), "other": (None, 0)}


def test_best_are_numbered_in_order(spark):
    rows = spark.createDataFrame([(r, f"c{r}{k}", float(k), 0.9 - k / 100) for r in "ab" for k in range(20)], "recording string, candidate_id string, start double, both double")
    got = cd.numbered_best(rows, "both", 3).orderBy("embedding_index").collect()
    assert [(r.recording, r.start, r.embedding_index) for r in got] == [(r, float(k), 2 * k + (r == "b")) for k in range(4) for r in "ab"]


def test_clusters_become_flags(spark):
    windows = [("r", 10.0 * k, 10.0 * k + 4, f"s{k}", f"e{k}", "said", [float(k), 1.0]) for k in range(10)]
    w = spark.createDataFrame(windows, "recording string, start double, end double, start_id string, end_id string, transcript string, features array<double>")
    recordings = spark.createDataFrame([("r", 200.0)], "recording string, total double")
    bare = cd.cut_candidates(w, recordings, 2)
    labels = bare.select("candidate_id", F.lit(1.0).alias("mood_cluster"), F.lit("2").alias("display")).where("start < 50")
    got = {r.start: r for r in cd.cut_candidates(w, recordings, 2, labels=labels).collect()}
    assert got[0.0].risk_flags == ["starts_at_recording_edge", "cluster_2"] and got[90.0].risk_flags == ["cluster_unknown"]
    assert sum(x * x for x in got[90.0].embedding) == pytest.approx(1.0) and got[0.0].mood_cluster == 1.0 and got[90.0].mood_cluster is None

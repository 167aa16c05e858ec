"""Spelling variants against a plain statement of the rule."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from clipweave.llm.queries import QUERIES
from clipweave.llm.spelling import one_edit, spelling_groups, word_counts


def plain_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}) - {word}


def plain_groups(counts):
    letters = set("".join(counts))
    form, near = {}, {}
    for w, n in counts.items():
        found = [x for x in edits(w, letters) if x in counts]
        near[w] = len(found)
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, near[w], form[w], counts[form[w]] if form[w] is not None else None, root))
    return sorted(out)


def as_rows(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


@given(st.text("abÉ", max_size=7), st.text("abÉ", max_size=7))
def test_one_edit(a, b):
    assert one_edit(a, b) == (b in edits(a, set("abÉ")))


@pytest.mark.parametrize("shard", [3, 40, 50_000])
def test_words_against_plain_rule(spark, shard):
    # Few letters, so that halves repeat within words, are shared by many and overlap with what an edit touches.
    rnd = random.Random(shard)
    counts = {"".join(rnd.choices("abÿ", k=rnd.randint(5, 8))): rnd.choice([3, 3, 4, 6, 12, 30, 64]) for _ in range(700)}
    counts |= {"aaaaa": 200, "aaaaaa": 100, "aaaaaaa": 50, "é" * 200: 5, "é" * 199: 10, "a" * 70 + "b" * 60: 9, "a" * 69 + "b" * 61: 4, "a" * 70 + "b" * 59: 3}
    got = spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), shard=shard)
    assert as_rows(got) == plain_groups(counts)


def test_counts_and_edges(spark):
    rows = [(k, "Straße étude ETUDE étudE, naïve-naive " + "zebra " * (k % 4) + "x" * 300) for k in range(60)] + [(7, None), (7, ""), (7, "straße"), (7, "straße"), (None, "straße STRASSE")]
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = word_counts(table, every=97)
    assert {r.word: r.n for r in got.collect()} == plain_counts(rows)
    assert as_rows(spelling_groups(got)) == plain_groups(plain_counts(rows))
    assert spelling_groups(word_counts(table.limit(0), every=97)).count() == 0
    assert {r.word: r.n for r in word_counts(table.where("doc_id = 7"), occurrences=1).collect()}["straße"] == 3


def test_very_long_words(spark):
    rows = [("x" * 20_000, 9), ("x" * 20_001, 4), ("x" * 9_000 + "y" + "x" * 11_000, 3), ("x" * 9_000 + "yy" + "x" * 11_000, 3)]
    got = spelling_groups(spark.createDataFrame(rows, "word string, n long"))
    assert sorted((len(r.word), "y" in r.word, r.n_near, r.form_n, len(r.root)) for r in got.collect()) == [(20_000, False, 2, None, 20_000), (20_001, False, 2, 9, 20_000), (20_001, True, 3, 9, 20_000), (20_002, True, 1, None, 20_002)]


def test_registered_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert as_rows(QUERIES["op12_spelling_variants"](spark, sf_dir)) == plain_groups(plain_counts(rows))

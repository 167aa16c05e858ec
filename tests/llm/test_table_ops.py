"""Mixing, top-k search, URL templates and the pipeline."""

from __future__ import annotations

import collections
import random
import re
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clipweave.llm import mixing, top_k, url_templates
from clipweave.llm.queries import ORACLE_SQL, QUERIES, URL_RULES
from tests.compare import duck, rows
from tests.llm.test_dedup import brute_components

DOCS = "doc_id long, text string, source string, size int, target string"


def docs(spark, data):
    return spark.createDataFrame([(i, t, s, 1, "t") for i, t, s in data], DOCS)


def fill(sizes, weights, epochs=3.0):
    """Targets by repeated resharing."""
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[k] for k in open_) for s in open_}
        over = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not over:
            return target | share
        target |= {s: epochs * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 5, "d": 300}, {"a": 1, "b": 1, "c": 1}, {"a": 1000, "b": 1, "c": 0}])
def test_targets(spark, sizes):
    weights = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes))}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(fill(sizes, weights))


def test_mix_near_targets_and_unbiased(spark):
    rng = np.random.default_rng(0)
    data = [(k, "w " * int(rng.integers(0, 80)), ["a", "b", None, "hot"][min(3, int(rng.integers(0, 9)))]) for k in range(3000)]
    d = docs(spark, data).cache()
    one, two = (mixing.mix(d.repartition(n)).toPandas().sort_values("doc_id", ignore_index=True) for n in (2, 7))
    assert one.equals(two) and len(one) == 3000 and (one.taken <= 3 * one["size"]).all() and (one.taken % one["size"].replace(0, 1) == 0).all()
    for _, g in one.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 80
    # Every document's expected copies are its source's share, over seeds.
    runs = [mixing.mix(d.where("source = 'a'"), weights=(1,), seed=s).toPandas() for s in (1, 2)]
    assert (runs[0].taken.to_numpy() == runs[1].taken.to_numpy()).all()  # a lone source is taken once
    p = spark.createDataFrame([(k, float(1 + k % 7), 0.3) for k in range(200)], "id long, w double, p double").selectExpr("'s' AS source", "*")
    ups = np.mean([[r.up for r in mixing.pivotal_round(p, fan_in=8, closing=16, seed=1000 * s).orderBy("id").collect()] for s in range(12)], 0)
    assert abs(ups.mean() - 0.3) < 0.02 and 0.15 < ups.std() * np.sqrt(12) / np.sqrt(0.21) * 1.0 + 0.0 < 3


def test_mix_meets_every_target(spark, sf_dir):
    # Fifty documents a source, of very unequal sizes.
    d = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    got = mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 20 and all(abs(r.taken - r.target) < 0.01 * r.target for r in got)
    # No choice comes near here: a document of 1,000 words at a third, and two small ones.
    few = docs(spark, [(1, "w " * 1000, "a"), (2, "w", "a"), (3, "w w", "a"), (4, "w " * 3009, "b")])
    assert {r.taken for r in mixing.mix(few, weights=(1, 11)).where("source = 'a'").collect()} <= {0, 1, 2, 1000}


def test_mix_seed_and_expectations(spark):
    # Two sources, over seeds: reruns agree, seeds differ, and every document's expected words are its share.
    d = docs(spark, [(k, "w " * (1 + k % 5), "a" if k % 4 else "b") for k in range(80)]).cache()
    run = lambda s: mixing.mix(d, weights=(1, 2), seed=s).toPandas().sort_values("doc_id", ignore_index=True)
    runs = [run(s) for s in range(0, 24000, 1000)]
    assert run(0).equals(runs[0]) and not runs[1].taken.equals(runs[0].taken)
    due = runs[0]["size"] * runs[0].target / runs[0].source_size
    mean = np.mean([r.taken for r in runs], 0)
    assert abs((mean - due) / runs[0]["size"]).mean() < 0.12 and all(abs((mean - due)[runs[0].source_size == n].sum()) < 8 for n in runs[0].source_size.unique())


def test_mix_edges(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    got = {(r.doc_id, r["size"], r.taken) for r in mixing.mix(docs(spark, [(1, None, None), (2, " \n", None), (3, "a b", None), (3, "a b", None), (None, "x y", None)])).collect()}
    assert (1, 0, 0) in got and (2, 0, 0) in got and (3, 2, 2) in got and (None, 2, 2) in got
    d = docs(spark, [(k, "a b c", "s" if k % 5 else "r") for k in range(50)])
    out = mixing.mixed_rows(d)
    assert out.columns == d.columns and out.count() * 3 == mixing.mix(d).selectExpr("sum(taken)").first()[0]


def brute_top(vectors, k=5, every=50):
    out = []
    for i, v in vectors:
        if i % every == 0:
            scores = sorted(((-int(np.dot(v[: len(u)], u[: len(v)])), j) for j, u in vectors if j != i))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"block_cells": 37 * 16, "chunk_cells": 32}])
def test_top_k_against_brute_force(spark, options):
    rng = np.random.default_rng(5)
    v = [(i, rng.normal(0, 0.3, 16).tolist()) for i in range(300)] + [(i, [0.25] * 16) for i in range(300, 340)] + [(345, [0.1, -0.2])]
    d = spark.createDataFrame([(i, x, 1, 2) for i, x in v], "vec_id long, embedding array<float>, q int, block int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(d.repartition(3), **options).collect())
    q = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in v]
    assert got == brute_top(q)


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k.top_k(spark.createDataFrame([], schema)).count() == 0
    rows_ = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, []), (5, [1.0, 1.0]), (6, [0.0, 0.0]), (7, [None, 1.0]), (None, [1.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id) for r in top_k.top_k(spark.createDataFrame(rows_, schema)).orderBy("rank").collect()]
    assert got == [(0, 1, 5), (0, 2, 6)]
    same = top_k.top_k(spark.createDataFrame([(0, [0.0]), (0, [0.5]), (50, [0.0]), (9, [0.0])], schema)).collect()
    assert sorted((r.query_id, r.vec_id) for r in same) == [(0, 9), (0, 50), (50, 0), (50, 0), (50, 9)]
    with pytest.raises(ValueError, match="can't hold"):
        top_k.top_k(spark.createDataFrame([(0, [1e30, 1.0]), (1, [2.0, 1.0])], schema))
    wide = [(0, [1e5, -2e5]), (1, [3e5, 1e5]), (2, [-3e5, 4e5])]
    assert [(r.vec_id, r.score) for r in top_k.top_k(spark.createDataFrame(wide, schema)).orderBy("rank").collect()] == [(1, 256 * 256 * 10**10), (2, -256 * 256 * 11 * 10**10)]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    path = rest[cut:]
    end = min([k for k in map(path.find, "?#") if k >= 0], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def test_urls_against_brute_force(spark):
    urls = [f"https://{h}/{l}/{n}{e}" for h in ("www.A.example.com", "b.example.net", "x.example.org", "Ünï.org", "org", "notorg") for l in ("en", "de", "fr", "es") for n, e in ((1, ""), (25, "/"), (378, ".html"), (4, "?q=http://z/es/"), (5, "#t"))]
    urls += [None, "", "no-scheme/es/", "://", "http://", "http://h?x", "http://h#x://y", "a://b://c/d", "http://example.org", "http://example.org/en/1" + "0" * 9000]
    d = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)] + [(0, urls[0], "h", "p"), (None, None, None, None)], "page_id long, url string, host string, path string")
    got = url_templates.filter_urls(d, URL_RULES).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        host, path = split(urls[r.page_id] if r.page_id is not None else None)
        rule = brute_rule(host, path)
        assert (r.host, r.path) == (host, path) and r.verdict in ("allow", "block")
        assert (r.rule, r.verdict) == rule if rule else r.rule is None


def tree(spark, data, **options):
    paths = spark.createDataFrame(data, "host string, path string, bad int").groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    small, large = ({(r.host, r.path): (r.template, r.share) for r in url_templates.placed_paths(paths, in_task=n, **options).collect()} for n in (4096, 3))
    assert small.keys() == large.keys() and all(small[k][0] == large[k][0] and small[k][1] == pytest.approx(large[k][1]) for k in small)
    return small


def plain_templates(data, least=4, share=0.02, prior=4.0, z=2.0):
    """Template and share of each (host, path, bad or None), by recursion over whole nodes."""
    out = {}
    wild = lambda s: "*" + (re.findall(r"\.[A-Za-z]{1,5}\Z", s) or [""])[0]
    cut = lambda p: re.sub("^/|/$", "", p).split("/") if p else []
    labelled = [b for _, _, b in data if b is not None]
    base = sum(labelled) / max(1, len(labelled))
    tally = lambda rows: (sum(b or 0 for *_, b in rows), sum(b is not None for *_, b in rows))

    def go(host, rows, depth, name, value):
        n = len(rows)
        for p, _ in rows:
            if n < least or len(cut(p)) <= depth:
                out[host, p] = ("/".join([*name, *map(wild, cut(p)[depth:])]), value)
        rows = [r for r in rows if (host, r[0]) not in out]
        segs = collections.Counter(cut(p)[depth] for p, _ in rows)
        kids = collections.defaultdict(list)
        for p, b in rows:
            s = cut(p)[depth]
            kids[s if segs[s] >= least and segs[s] >= share * n else wild(s)].append((p, b))
        rate = lambda rows: tally(rows)[0] / max(1, tally(rows)[1])
        near = {k for k, v in kids.items() if not tally(v)[1] or abs(rate(v) - value) <= z * (value * (1 - value) / tally(v)[1]) ** 0.5}
        pools = [near] if near else []
        last = None
        for k in sorted(set(kids) - near, key=lambda k: (rate(kids[k]), k)):
            if last is not None:
                (b1, n1), (b2, n2) = tally(kids[last]), tally(kids[k])
                mean = (b1 + b2) / (n1 + n2)
            if last is None or abs(rate(kids[k]) - rate(kids[last])) > z * (mean * (1 - mean) * (1 / n1 + 1 / n2)) ** 0.5:
                pools.append(set())
            pools[-1].add(k)
            last = k
        for pool in pools:
            b, m = tally([r for k in pool for r in kids[k]])
            for k in pool:
                go(host, kids[k], depth + 1, [*name, k], (b + prior * value) / (m + prior))

    for host in {h for h, *_ in data}:
        rows = [(p, b) for h, p, b in data if h == host]
        b, m = tally(rows)
        go(host, rows, 0, [""], (b + prior * base) / (m + prior))
    return out


def test_templates_against_plain_rule(spark):
    rnd = random.Random(8)
    data = []
    for k in range(900):
        host = rnd.choice(["h", "h", "h", "i", "j"])
        path = "/" + "/".join(rnd.choice(["a", "b", "c", f"{k}", f"{k % 7}.html", f"{k}.php"]) for _ in range(rnd.randint(0, 6))) + rnd.choice(["", "/"])
        data.append((host, rnd.choice([path, "", "/a/b/1.html"]), None if rnd.random() < 0.3 else int(rnd.random() < (0.9 if "/b" in path else 0.1))))
    got, want = tree(spark, data), plain_templates(data)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_depth_costs_no_rounds(spark):
    deep = "/trap" * 2000
    data = [("h", deep, 1)] * 4 + [("h", deep + f"/{k}", 0) for k in range(4)] + [("w", "".join(f"/{k}-{d}" for d in range(300)), 1) for k in range(5)]
    paths = spark.createDataFrame(data, "host string, path string, bad int").groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.sum("bad").alias("bad"))
    got = {(r.host, r.path): (r.template, r.share) for r in url_templates.placed_paths(paths).collect()}
    assert got["h", deep][0] == deep and got["h", deep + "/1"][0] == deep + "/*"
    assert {t for (h, _), (t, _) in got.items() if h == "w"} == {"/*" * 300}


def test_templates_generalise_and_reject(spark):
    data = [("bad.net", f"/spam/{k}", 1) for k in range(30)] + [("bad.net", f"/news/{k}", 0) for k in range(30)] + [("bad.net", "/spam/999", None), ("bad.net", "/news/999", None), ("new.net", "/a/b", None)]
    got = tree(spark, data)
    assert {t for (h, _), (t, _) in got.items() if h == "bad.net"} == {"/spam/*", "/news/*"}
    assert got["bad.net", "/spam/999"][1] > 0.8 and got["bad.net", "/news/999"][1] < 0.2 and got["new.net", "/a/b"][0] == "/*/*" and 0.4 < got["new.net", "/a/b"][1] < 0.6
    assert url_templates.filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_deep_branches_are_told_apart(spark):
    data = [("h", f"/a/b/c/d/{k}.html", 1) for k in range(20)] + [("h", f"/a/b/c/x/{k}", 0) for k in range(20)] + [("h", "/a/b/c/d/77.html", None), ("h", "/a/b/c/x/77", None), ("h", "/z" * 400, None)]
    got = tree(spark, data)
    assert got["h", "/a/b/c/d/77.html"][0] == "/a/b/c/d/*.html" and got["h", "/a/b/c/x/77"][0] == "/a/b/c/x/*"
    assert got["h", "/a/b/c/d/77.html"][1] > 0.8 and got["h", "/a/b/c/x/77"][1] < 0.2
    assert got["h", "/z" * 400][0] == "/*" * 400


def test_similar_siblings_pool_their_counts(spark):
    # Two small bad branches and a large good one: the bad ones differ from their parent, not from each other.
    data = [("h", f"/good/{k}", 0) for k in range(400)] + [("h", f"/{b}/{k}", 1) for b in ("bad", "ill") for k in range(12)]
    got = tree(spark, data, share=0.0)
    assert got["h", "/bad/1"][1] == got["h", "/ill/1"][1] > got["h", "/good/1"][1]
    up = (24 + 4 * 24 / 424) / 428
    assert got["h", "/bad/1"][1] == pytest.approx((12 + 4 * (24 + 4 * up) / 28) / 16)


def test_pipeline_run(spark, sf_dir):
    import corpus_pipeline as c

    out = c.run(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert out and all(r.decoded == texts[r.doc_id] for r in out)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"op6_language_id", "op9_quality_rules"}))
def test_queries_against_brute_force(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).collect()
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()
    if name.startswith("op1_"):
        turns = {}
        for r in sorted(read("conversations"), key=lambda r: (r.conv_id, r.turn)):
            turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
        turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
        sha = lambda t: sha256(t.encode()).hexdigest()
        loss = lambda v: "".join(t for r, t in v if r == "assistant")
        want = {c: (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)), len(loss(v)), sha(loss(v))) for c, v in turns.items()}
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)
    elif name.startswith("op2_"):
        component, size = brute_components([(r.doc_id, r.text) for r in read("documents")])
        assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {i: (c, size[i], c == i) for i, c in component.items()}
    elif name.startswith("op4_"):
        library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
        library.no_truncation()
        library.no_padding()
        want = {}
        for r in read("documents"):
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id] = (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    elif name.startswith("op7_"):
        sizes, docs_ = {}, {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in read("documents")}
        for s, n in docs_.values():
            sizes[s] = sizes.get(s, 0) + n
        weights = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
        target, taken = fill(sizes, weights), dict.fromkeys(sizes, 0)
        for r in got:
            s, n = docs_[r.doc_id]
            assert (r["size"], r.source_size) == (n, sizes[s]) and r.target == pytest.approx(target[s]) and r.taken <= 3 * n and (not n or r.taken % n == 0)
            taken[s] += r.taken
        # What is drawn last of a source is one document.
        most = {s: max(n for k, n in docs_.values() if k == s) for s in sizes}
        assert len(got) == len(docs_) and all(abs(taken[s] - target[s]) <= most[s] for s in sizes)
    else:
        assert len(got) == len(read("pages"))
        by = {r.page_id: r.url for r in read("pages")}
        for r in got:
            host, path = split(by[r.page_id])
            assert (r.host, r.path) == (host, path) and r.verdict in ("allow", "block")
            rule = brute_rule(host, path)
            assert (r.rule, r.verdict) == rule if rule else r.rule is None


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir).execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as c

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = d.columns, None
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, d, sf_dir)
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        if k < len(c.STAGES) - 1:
            assert d.columns == columns
        if name in ("exact_dedup", "near_dedup"):
            assert d.count() < before
        before = d.count()
    assert before > 0 and d.where("size(ids) = 0").count() == 0
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in c.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0

"""Chat tree, BPE, WARC, language identification and quality rules."""

from __future__ import annotations

import itertools
import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clipweave.llm import bpe, chat_tree, language_id, quality, warc
from clipweave.llm.shared import scratch

VOCAB = bpe.Vocabulary(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())  # noqa: SIM115
THEIRS = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'", "'ll", "é", "ß", "漢", "\u3000", "\x1c", "\x85", "1", "²", "!", "$$$", "<|endoftext|>", "<|end", "\U0001f600", "e\u0301", "Ⅷ", "\xa0"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=40), st.integers(1, 9))
def test_bpe_equals_library(parts, step):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert bpe.encode_text(bpe.Encoder(VOCAB), text) == want
    e = bpe.Encoder(VOCAB)
    assert list(itertools.chain(*[e.feed(text[k : k + step]) for k in range(0, len(text), step)], e.finish())) == want
    d = bpe.Decoder(VOCAB)
    assert "".join(d.feed([i]) for i in want) + d.finish() == THEIRS.decode(want, skip_special_tokens=False)


def test_bpe_newer_letters_are_others_as_in_the_library():
    for part in bpe.NEWER.split():
        for c in {chr(int(end, 16)) for end in part.split("-")}:
            for text in (f"a{c}!", f" {c}'ll", f"1{c}{c} 2"):
                assert bpe.encode_text(bpe.Encoder(VOCAB), text) == THEIRS.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("alphabet", ["ab", "a", "aeth", " ", " \n", "!-=", "0123", "ßüé"])
def test_bpe_long_pretokens_in_constant_memory(alphabet):
    rnd = random.Random(1)
    text = "".join(rnd.choice(alphabet) for _ in range(20_000))
    e, got, most = bpe.Encoder(VOCAB), [], 0
    for k in range(0, len(text), 100):
        got += e.feed(text[k : k + 100])
        most = max(most, len(e.buffer) + len(e.tail))
    assert got + e.finish() == THEIRS.encode(text, add_special_tokens=False).ids
    assert most < 4 * (VOCAB.lookahead + bpe.LONG)


@pytest.mark.parametrize("run", ["a", "7", "!", " ", "é", "<|"])
@pytest.mark.parametrize("slices", [1, 2])
def test_bpe_runs_that_end_around_a_slice_border(monkeypatch, run, slices):
    monkeypatch.setattr(bpe, "SLICE", 512)
    for offset in range(-30, 31):
        for after in ("<|endoftext|>hello", "<|endoftext|>", "<|endoftex", "<|endoftext |>", "'ll", " x", "\n\n<|endoftext|>", "1!", ""):
            text = (run * 2000)[: 512 * slices + offset] + after
            assert bpe.encode_text(bpe.Encoder(VOCAB), text) == THEIRS.encode(text, add_special_tokens=False).ids


def test_bpe_frames(spark):
    rows = [(1, "Hello  world<|endoftext|>"), (2, None), (2, ""), (None, "x" * 90_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded")
    out = {(r.doc_id, len(r.ids)): r for r in bpe.encode(d, decoded=True).collect()}
    assert len(out) == 3 and (2, 0) in out
    assert sorted(r.decoded for r in out.values()) == sorted({t or "" for _, t in rows})
    assert bpe.encode(d.where("false")).count() == 0
    back = {r.text for r in bpe.decode(bpe.encode(d)).collect()}
    assert back == {t or "" for _, t in rows}


CHATS = "conv_id long, turn long, role string, text string, path string, segments string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "p", "s") for r in rows], CHATS)


CONVERSATIONS = {
    1: [("system", "Be kind."), ("user", "Hi"), ("assistant", "Hello [INST] </s> \\ <|x|>")],
    2: [("system", "Be kind."), ("user", "Hi"), ("assistant", "Hi!"), ("user", "More"), ("assistant", "")],
    3: [("system", "Be kind."), ("user", "Bye")],
    4: [("user", None), ("assistant", "ok")],
    5: [("system", "Be kind."), ("user", "Hi"), ("assistant", "Hello [INST] </s> \\ <|x|>")],
    -7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")],
    None: [("user", "|"), ("tool|>", "[x] \\[ \\\\")],
    6: [("user", "é" * 30_000)],
}


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_tree_and_read_back(spark, partitions):
    rows = [(c, k, role, text) for c, turns in CONVERSATIONS.items() for k, (role, text) in enumerate(turns)]
    random.Random(2).shuffle(rows)
    formatted = chat_tree.format_conversations(chats(spark, rows))
    tree = chat_tree.prefix_tree(formatted, partitions)
    nodes = tree.collect()
    got = {r.conv_id: r for r in chat_tree.conversation_digests(chat_tree.read_back(formatted, tree)).collect()}
    for c, turns in CONVERSATIONS.items():
        said = "".join(f"{r}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())
    # Shared turns once, end to end, each after its ancestors, whose places it attends to.
    distinct = {tuple(t[: k + 1]) for t in map(tuple, CONVERSATIONS.values()) for k in range(len(t))}
    assert len(nodes) == len(distinct) == len({bytes(r.node) for r in nodes})
    ordered = sorted(nodes, key=lambda r: r.begin)
    assert [r.begin for r in ordered] == list(np.cumsum([0, *[r.length for r in ordered]])[:-1])
    by = {bytes(r.node): r for r in nodes}
    for r in nodes:
        up, spans, at = r, [], 0
        while up.parent is not None:
            up = by[bytes(up.parent)]
            spans.append((up.begin, up.begin + up.length))
            at += up.length
        assert r.position == at and sum(hi - lo for lo, hi in r.attends) == at
        assert all(any(lo <= a and b <= hi for lo, hi in r.attends) for a, b in spans)
        assert all(x[1] < y[0] for x, y in itertools.pairwise(r.attends))


def test_chat_edges(spark):
    f = chat_tree.format_conversations(chats(spark, []))
    assert chat_tree.read_back(f, chat_tree.prefix_tree(f)).count() == 0
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None)]
    f = chat_tree.format_conversations(chats(spark, rows))
    assert chat_tree.conversation_digests(chat_tree.read_back(f, chat_tree.prefix_tree(f))).first().n_turns == 3


@given(st.text(alphabet="[]/INST<>|s\\ax\n", max_size=30), st.text(alphabet="|<>\\u", max_size=5), st.sampled_from(["user", "assistant"]))
def test_template_is_reversible(text, odd, role):
    first, lo, hi = chat_tree.render(role, text)
    second, _, _ = chat_tree.render(odd, text)
    assert [(r, t) for r, t, _, _ in chat_tree.parse(first + second)] == [(role, text), (odd, text)]
    assert role != "assistant" or chat_tree.unescape(first[lo:hi]) == text
    for escaped in (chat_tree.escape(text + "</s>[INST] ok [/INST]<|user|>" + odd), chat_tree.escape(odd)):
        assert not any(mark in escaped for mark in ("[INST]", "[/INST]", "</s>", "<|", "|>"))


PAGES = "page_id long, url string, html string, digest string, nth int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)


def test_warc_round_trip(spark):
    tricky = "x" * 50 + "WARC/1.1\r\n\r\n\r\n0\r\n\r\n" * 9 + "é"
    big = tricky * 400
    rows = [(5, "http://a/", big), (2, None, big), (3, "http://c/\r\nX: y", "small"), (4, "http://d", "small"), (1, "http://e", None), (6, "http://f", tricky), (8, "u", "y" * 100), (9, "u", "y" * 100), (None, "u", "z")]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, rows), segment_bytes=1000).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), sha256(data).hexdigest())
    assert {i: got[i].refers_to for i in got if got[i].record_type == "revisit"} == {5: 2, 9: 8}
    assert warc.round_trip(pages(spark, [])).count() == 0
    twice = warc.round_trip(pages(spark, [(1, "u", "y" * 200), (1, "u", "y" * 200)])).collect()
    assert sorted((r.record_type, r.refers_to) for r in twice) == [("response", None), ("revisit", 1)]


def test_warc_one_payload_of_most_pages(spark):
    data = [(k, f"http://h/{k}", "common " * 30 if k % 3 else f"own {k} " * 20) for k in range(900)] + [(None, "u", "common " * 30), (5, "u", "common " * 30)]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, data).repartition(4)).collect()), key=str)
    assert got == sorted(((k, "response" if k is not None and (k % 3 == 0 or (k == 1)) else "revisit", None if k is not None and (k % 3 == 0 or k == 1) else 1) for k, _, _ in data), key=str)


def test_missing_segment_is_an_error(spark):
    path = scratch(spark, "cut")
    recs = [r for r in warc.records("<urn:page:1:0>", "u", b"q" * 500, sha256(b"q" * 500).hexdigest(), None, 200) if b"Segment-Number: 2" not in r]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(r),) for r in recs], "r binary").select(F.col("r").cast("string").alias("value"))
    df.write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match="not whole"):
        warc.read_archives(spark, path).collect()


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_framing(body, size):
    assert warc.unchunked(warc.chunked(body, size)) == body
    marked = body + warc.MARK + body
    assert warc.MARK not in warc.chunked(marked, size) and warc.unchunked(warc.chunked(marked, size)) == marked


@pytest.mark.parametrize("size", range(1, 24))
def test_no_frame_completes_a_mark(size):
    for k in range(len(warc.MARK) + 1):
        for body in (warc.MARK[:k], b"<p>see " + warc.MARK[:k], warc.MARK + warc.MARK[:k], b"WARC/1.1" * 3 + warc.MARK[:k], b"x" * (size - 1) + warc.MARK[:k] + b"y"):
            framed = warc.chunked(body, size)
            assert warc.MARK not in framed and warc.unchunked(framed) == body


def test_round_trip_of_payloads_that_end_like_a_mark(spark):
    bodies = ["<p>see WARC/1.1", "WARC/1.1", "WARC/1.1\r\n", "a" * 8184 + "WARC/1.1", "a" * 8184 + "WARC/1.1\r\n" + "b" * 40_000, "WARC/1.1\r\n" * 5000]
    rows = [(k, "http://x/WARC/1.1" if k % 2 else "WARC/1.1\r\n", b) for k, b in enumerate(bodies)]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, rows)).collect()}
    assert len(got) == len(bodies)
    for k, b in enumerate(bodies):
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].record_type) == (len(b), sha256(b.encode()).hexdigest(), "response")


def test_many_turns_and_a_common_first_turn(spark):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", "same start" if k == 0 else f"{c % 40} {k}") for c in range(600) for k in range(3)] + [(9999, k, "user", f"turn {k}") for k in range(3000)]
    formatted = chat_tree.format_conversations(chats(spark, rows))
    tree = chat_tree.prefix_tree(formatted, 3)
    got = {r.conv_id: r.n_turns for r in chat_tree.conversation_digests(chat_tree.read_back(formatted, tree)).collect()}
    assert got == {c: 3 for c in range(600)} | {9999: 3000} and tree.count() == 1 + 2 * 40 + 3000


def test_language_models_are_distributions(spark):
    rows = [(k, t * 3, l) for k, (t, l) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr")] * 30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.train(d)
    # Probabilities of all continuations of a context sum to one at most.
    m = found.models
    letters = sorted({c for _, t, _ in rows for c in t})
    entropies = lambda texts: m.entropies(language_id._codes("".join(texts)), np.array([len(t) for t in texts]))
    for context in ("the", " ch", "zzz"):
        entropy, n = entropies([context + c for c in letters])
        base, n0 = entropies([context])
        assert (np.exp(-(entropy * n[:, None] - base * n0[:, None])).sum(0) < 1.001).all()
    out = {r.doc_id: r for r in language_id.identify(d.unionByName(spark.createDataFrame([(900, None, "x"), (901, "123 !?", "x"), (902, "", None), (None, "the mat the cat " * 900, "en")], d.schema)), found).collect()}
    assert sum(out[k].lang_pred == l for k, _, l in rows) == len(rows)
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (900, 901, 902)) and out[None].lang_pred == "en"
    assert language_id.train(d.where("false")) is None
    assert language_id.identify(d, None).where("lang_pred <> 'und'").count() == 0


def test_language_held_out_accuracy(spark, sf_dir):
    from clipweave.llm.queries import op6_language_id

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    r = op6_language_id(spark, sf_dir).join(d, "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert len(r) > 20 and (r.lang == r.lang_pred).mean() > 0.95 and r.score.between(0, 1).all()


def test_quality_rules_match_their_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    names = ["a", "b", "c", "d"]
    e = quality.fit(x, y, names)
    assert ((e.scores(x, names) > 0.5) == y).mean() > 0.97 and 0 < len(e.rules) < 150
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x[:200])], "doc_id long, a double, b double, c double, d double")
    got = [r.score for r in quality.score(d, e).orderBy("doc_id").collect()]
    assert np.allclose(got, e.scores(x[:200], names))


def test_quality_edges(spark, sf_dir):
    from clipweave.llm.queries import op9_quality_rules

    r = op9_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (r.quality == r.predicted).mean() >= 0.8 and r.score.between(0, 1).all()
    d = spark.createDataFrame([(1, None), (2, ""), (2, "a  b\u00a0c"), (None, "x " * 50_000)], "doc_id long, text string")
    stats = quality.features(d)
    assert stats.count() == 4 and stats.dropna(subset=stats.columns[1:]).count() == 4
    none = d.selectExpr("doc_id", "cast(null as int) AS quality")
    assert {r.score for r in quality.score(stats, quality.train(stats, none)).collect()} == {0.5}
    assert quality.score(stats.where("false"), quality.train(stats, none)).count() == 0


def test_drop_rejected_decides_rows_not_ids(spark):
    good, junk = "the cat sat on the mat and looked at the moon", "$$$ ### 1234 |||| <> 5678"
    rows = [(k, f"{good} {'so ' * (k % 5)}" if k % 2 else f"{junk} {'# ' * (k % 5)}") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    more = [(None, good), (None, junk), (500, good), (500, junk)]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows + more], "doc_id long, text string, length int")
    out = quality.drop_rejected(d, labels)
    assert out.columns == d.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(str(x) for x in rows + more if "$" not in x[1])


def test_language_models_count_every_row(spark):
    words = [a + b + c for a in "bcdfghjklm" for b in "aeiou" for c in "npqrstvwxz"] * 4
    words = [w + "abcd"[k // 500] for k, w in enumerate(words)]
    single = [f"l{k:02}" for k in range(12)]
    rows = [(k, w, "many") for k, w in enumerate(words)] + [(5000 + k, "the only row of it", l) for k, l in enumerate(single)]
    m = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).models
    assert m.langs == [*single, "many"]
    want = {int(h) for _, t, _ in rows for h in language_id._hashes(language_id._codes(f" {t} "), 4)}
    assert set(map(int, m.grams[4])) == want


def test_texts_are_reduced_at_once_as_one_by_one():
    texts = [None, "", "  ", "\u0301\u0301", "ab", "Ab1c", " \u0301 x", "İZMİR Ⅷ", "日本 語", "x" * 5000, "a\x00b\r\nc"]
    texts += ["".join(chr(c) for c in np.random.default_rng(k).integers(32, 900 + 12_000 * (k % 2), k % 30)) for k in range(600)]
    codes, sizes = language_id.reduced(texts)
    flat, at = "".join(map(chr, codes.tolist())), 0
    for text, size in zip(texts, sizes.tolist(), strict=True):
        assert flat[at : at + size] == language_id.letters(text)
        at += size
    assert at == len(flat) and [len(x) for x in language_id.reduced([])] == [0, 0]


def test_every_ngram_of_every_order_is_counted():
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abc"), rng.integers(1, 4))) for _ in range(k % 5)) for k in range(200)] + [None, "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array([False] * len(texts)), pa.array(texts, pa.string())], ["lang", "held", "text"])
    got = pa.Table.from_batches(language_id._count(4)(iter([batch]))).to_pandas()
    for n in range(1, 5):
        every = [int(h) for t in texts if language_id.letters(t) for h in language_id._hashes(language_id._codes(language_id.letters(t)), n)]
        seen = got[got["n"] == n]
        assert sorted(seen["gram"].to_numpy().view(np.uint64).tolist()) == sorted(set(every))
        if n == 4:
            assert dict(zip(seen["gram"].to_numpy().view(np.uint64).tolist(), seen["count"], strict=True)) == {h: every.count(h) for h in set(every)}

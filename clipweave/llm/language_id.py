"""Language identification by interpolated Kneser-Ney character models.

Text is reduced to letters, lower-cased, with one space between runs; a space also stands before and after. Per language, n-grams up to
``order`` characters are counted in Spark: the highest order by occurrences, lower orders by the number of distinct characters before them. All
languages share one sorted array of n-gram hashes, with a row of log probabilities per n-gram seen in any language and a row of
back-off weights per context: a lookup is one binary search for each distinct n-gram of a run of texts. A text's score for a language is its cross-entropy per character; the
lowest wins. Confidence is a logistic function of the margin to the runner-up and of the length, fitted on the training texts; texts below
``reject_below``, the confidence that keeps the error of what is accepted on those under ``max_error``, are marked rejected.

Defined results: a null text or one without letters is ``und`` with score 0, rejected. Training rows with null language are not used; with no
training rows everything is ``und``. Equal scores go to the language that sorts first. Repeated rows repeat; columns other than id, text and language are not read.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
ORDER = 4
#: So many labelled rows per language, and an eighth of them at most, are expected to calibrate the confidence; they are chosen by a hash of
#: the id. The models count every labelled row, these included.
CALIBRATION_ROWS = 150
#: Texts are counted and scored in runs of about so many characters, whatever their number; a longer text is a run of its own.
COUNT_RUN, SCORE_RUN = 2_000_000, 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """The text's letters, lower-cased, between single spaces; empty if it has none."""
    if not text or not _LETTER.search(text):
        return ""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a mark, else 0."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for kind, pattern in ((1, r"\p{M}+"), (2, r"\p{L}+")):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def reduced(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``letters`` of many texts at once: their code points one after the other, and how many each has."""
    lower = [f" {t.lower()} " if t else " " for t in texts]
    if not lower:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in lower], np.int64)
    starts = np.cumsum(lengths) - lengths
    kind = _kinds()[codes]
    word = kind > 0
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[starts] = True  # of a run of other characters, the first stays and becomes a space
    lettered = np.maximum.reduceat(kind, starts) == 2
    if not lettered.all():
        keep &= np.repeat(lettered, lengths)
    return np.where(word, codes, np.uint32(32))[keep].astype(np.uint64), np.add.reduceat(keep, starts, dtype=np.int64)


def _runs(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have about ``size`` characters together."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of a code sequence, by their last characters' order."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = (h ^ codes[k : k + size]) * _M
        h ^= h >> np.uint64(29)
    return h


def _hashes_at(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``_hashes`` of the n-grams that begin at some places only; of no characters, 0."""
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = (h ^ codes[at + k]) * _M
        h ^= h >> np.uint64(29)
    return h


def _firsts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, where each stands first, which of them stands at each place, and how often each stands."""
    which, unique = pd.factorize(hashes)
    first = np.empty(len(unique), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return unique, first, which, np.bincount(which, minlength=len(unique))


def _find(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted array ``held`` and whether each value is there; each distinct value is searched once."""
    which, unique = pd.factorize(wanted)
    at = np.minimum(np.searchsorted(held, unique), len(held) - 1)
    return at[which], (held[at] == unique)[which]


def _count(order: int):
    """(lang, held, text) to n-gram counts by batch: lang, held, n, gram, first n-1 (context), last n-1 (suffix), count.

    Only the longest n-grams are looked for at every character. A shorter one either opens a text or ends a longer one, so it is looked for in
    those places alone; its count is the number of those, which is all that is asked of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _runs(whole, "text", COUNT_RUN):
                for (lang, held), texts in part.to_pandas().groupby(["lang", "held"])["text"]:
                    codes, sizes = reduced(texts.tolist())
                    sizes = sizes[sizes > 0]
                    opens = np.cumsum(sizes) - sizes
                    room = np.repeat(opens + sizes, sizes) - np.arange(len(codes))  # characters from each on to its text's end
                    at = np.flatnonzero(room >= order)
                    hashes = _hashes(codes, order)[at]
                    for n in range(order, 0, -1):
                        unique, first, _, count = _firsts(hashes)
                        at = at[first]
                        k = len(at)
                        keys = (pa.array(x.view(np.int64)) for x in (unique, _hashes_at(codes, at, n - 1), _hashes_at(codes, at + 1, n - 1)))
                        if k:
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(np.full(k, held, bool)), pa.array(np.full(k, n, np.int32)), *keys, pa.array(count)], ["lang", "held", "n", "gram", "context", "suffix", "count"])
                        at = np.concatenate((opens[sizes >= n - 1], at + 1))
                        hashes = _hashes_at(codes, at, n - 1)

    return run


class Models:
    """The languages' models in sorted hash arrays: per order, the n-grams and their interpolated log probabilities; per context, back-off weights."""

    def __init__(self, counts: pd.DataFrame, order: int):
        self.order = order
        self.langs = sorted(map(str, counts["lang"].unique()))
        k = len(self.langs)
        self.grams, self.logp, self.contexts, self.backoff = {}, {}, {}, {}
        tables = {n: counts[counts["n"] == n] for n in range(1, order + 1)}
        alphabet = tables[1]["gram"].nunique() + 1
        self.unseen = np.full(k, -math.log(alphabet))
        for n in range(1, order + 1):
            t = tables[n]
            grams = np.unique(t["gram"].to_numpy().view(np.uint64))
            contexts = np.unique(t["context"].to_numpy().view(np.uint64))
            logp, back = np.zeros((len(grams), k)), np.zeros((len(contexts), k))
            for j, lang in enumerate(self.langs):
                own = t[t["lang"] == lang]
                g = own["gram"].to_numpy().view(np.uint64)
                if n == order:
                    c = own["count"].to_numpy(np.float64)
                else:  # distinct characters before the n-gram: how many longer ones end in it
                    ends = tables[n + 1][tables[n + 1]["lang"] == lang].groupby("suffix").size()
                    c = np.maximum(1.0, ends.reindex(own["gram"].to_numpy(), fill_value=0).to_numpy(np.float64))
                ones, twos = (c == 1).sum(), (c == 2).sum()
                discount = min(0.95, max(0.1, ones / max(1.0, ones + 2 * twos)))
                at = np.searchsorted(contexts, own["context"].to_numpy().view(np.uint64))
                total = np.bincount(at, c, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                weight = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
                own_p = np.zeros(len(grams))
                own_p[np.searchsorted(grams, g)] = (c - discount) / total[at]
                context_of, lower = self._below(t, grams, contexts, n, j)
                logp[:, j] = np.log(own_p + weight[context_of] * np.exp(lower))
                back[:, j] = np.log(weight)
            self.grams[n], self.logp[n] = grams, logp.astype(np.float32)
            self.contexts[n], self.backoff[n] = contexts, back.astype(np.float32)

    def _below(self, t: pd.DataFrame, grams: np.ndarray, contexts: np.ndarray, n: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram: the place of its context, and the log probability of its suffix in language j."""
        one = t.drop_duplicates("gram")
        order = np.argsort(one["gram"].to_numpy().view(np.uint64))
        context_of = np.searchsorted(contexts, one["context"].to_numpy().view(np.uint64)[order])
        if n == 1:
            return context_of, np.full(len(grams), self.unseen[j])
        suffix = one["suffix"].to_numpy().view(np.uint64)[order]
        return context_of, self.logp[n - 1][np.searchsorted(self.grams[n - 1], suffix), j].astype(np.float64)

    def _logp(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """In each language, the log probability of the last character of the n-grams of full order that begin at some places."""
        logp, open_ = np.zeros((len(at), len(self.langs)), np.float32), np.arange(len(at))
        for n in range(self.order, 0, -1):
            begin = at[open_] + self.order - n
            place, hit = _find(self.grams[n], _hashes_at(codes, begin, n))
            logp[open_[hit]] += self.logp[n][place[hit]]
            open_, begin = open_[~hit], begin[~hit]
            if not len(open_):
                break
            if n == 1:
                logp[open_] += self.unseen
            else:
                place, known = _find(self.contexts[n], _hashes_at(codes, begin, n - 1))
                logp[open_[known]] += self.backoff[n][place[known]]
        return logp

    def entropies(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text, as ``reduced`` gives them, in each language, and its number of characters.

        A character's probability depends on its n-gram alone, so each distinct n-gram is looked up once.
        """
        pad = self.order - 1
        moved = pad * np.arange(1, len(sizes) + 1)
        spaced = np.full(len(codes) + pad * (len(sizes) + 1), 32, np.uint64)
        spaced[np.arange(len(codes)) + np.repeat(moved, sizes)] = codes
        _, first, which, _ = _firsts(_hashes(spaced, self.order))
        logp = self._logp(spaced, first)[np.append(which, 0)]
        # The space that opens a text is given, not predicted.
        ends = np.cumsum(sizes) + moved - pad
        spans = np.stack((ends - sizes + np.minimum(1, sizes), ends), 1)
        sums = np.add.reduceat(logp, spans.ravel(), 0, np.float64)[::2]
        sums[spans[:, 0] == spans[:, 1]] = 0
        n_chars = np.maximum(sizes - 1, 1)
        return -sums / n_chars[:, None], n_chars


def _features(entropy: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    two = np.sort(entropy, 1)[:, :2]
    margin = two[:, 1] - two[:, 0] if entropy.shape[1] > 1 else np.ones(len(entropy))
    return np.stack([np.ones(len(entropy)), np.log1p(margin * n_chars), margin, -two[:, 0]], 1)


class Identifier:
    """Models with a calibrated confidence."""

    def __init__(self, counts: pd.DataFrame, order: int):
        self.models = Models(counts, order)
        self.weights = np.array([0.0, 1.0, 0.0, 0.0])
        self.reject_below = 0.0

    def scores(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entropy, n_chars = self.models.entropies(codes, sizes)
        return entropy.argmin(1), 1 / (1 + np.exp(-np.clip(_features(entropy, n_chars) @ self.weights, -30, 30)))

    def calibrate(self, texts: list[str], langs: list[str], max_error: float) -> None:
        entropy, n_chars = self.models.entropies(_codes("".join(texts)), np.array([len(t) for t in texts], np.int64))
        right = np.array([self.models.langs[k] for k in entropy.argmin(1)]) == np.array(langs)
        x = _features(entropy, n_chars)
        w = self.weights
        for _ in range(50):  # penalised Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (p - right) + 1.0 * (w - self.weights)
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
        self.weights = w
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        order = np.argsort(-p)
        error = np.cumsum(~right[order]) / np.arange(1, len(p) + 1)
        fine = np.flatnonzero(error <= max_error)
        self.reject_below = float(p[order][fine[-1]]) if len(fine) else 1.0


def train(labelled: DataFrame, order: int = ORDER, calibration_rows: int = CALIBRATION_ROWS, max_error: float = 0.01, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier | None:
    """Models of the languages in ``labelled``, of the n-grams of all its rows.

    About ``calibration_rows`` rows per language are scored by models that leave them out, which gives the confidence. The driver
    gets one row per language and distinct n-gram.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = rows.groupBy("lang").count()
    draw = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1_000_000)) / 1_000_000
    share = F.least(F.lit(0.125), F.lit(float(calibration_rows)) / F.col("count"))
    drawn = rows.join(F.broadcast(sizes), "lang").select("lang", (draw < share).alias("held"), "text")  # one row per language
    counts = drawn.mapInArrow(_count(order), "lang string, held boolean, n int, gram long, context long, suffix long, count long")
    held_count = F.sum(F.when(F.col("held"), F.col("count")).otherwise(0)).alias("held")
    counts = counts.groupBy("lang", "n", "gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("count").alias("count"), held_count).toArrow().to_pandas(categories=["lang"])
    if not len(counts) or not (counts["n"] == order).any():
        return None
    found = Identifier(counts.drop(columns="held"), order)
    left = counts[counts["count"] > counts["held"]]
    left = left.assign(count=left["count"] - left["held"]).drop(columns="held")
    del counts
    if not (left["n"] == order).any():
        return found
    without = Identifier(left, order)
    held = drawn.where("held").select("lang", "text").toPandas()
    held = held[held["lang"].isin(without.models.langs)]
    held["text"] = held["text"].map(letters)
    held = held[held["text"] != ""]
    # Short pieces as well, so that confidence is known at every length.
    texts, langs = [], []
    for text, lang in zip(held["text"], held["lang"], strict=True):
        for size in (12, 40, 150, len(text)):
            if piece := letters(text[:size]):
                texts.append(piece)
                langs.append(lang)
    if texts:
        without.calibrate(texts, langs, max_error)
        found.weights, found.reject_below = without.weights, without.reject_below
    return found


def identify(docs: DataFrame, identifier: Identifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, rejected."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(identifier)  # it grows with the distinct n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for b in _runs(whole, "text", SCORE_RUN):
                codes, sizes = reduced(b.column(1).to_pylist())
                langs, scores, rejected = ["und"] * len(sizes), np.zeros(len(sizes)), np.ones(len(sizes), bool)
                some = np.flatnonzero(sizes)
                if len(some) and model is not None:
                    best, p = model.scores(codes, sizes[some])
                    for k, j in zip(some, best, strict=True):
                        langs[k] = model.models.langs[j]
                    scores[some], rejected[some] = p, p < model.reject_below
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")

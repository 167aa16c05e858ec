"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point, grouped under their most frequent neighbour.

Cut a word in two halves: a word that differs from it by one edit has the left half at its begin or the right half at its end. So automata over
the halves of all words (Aho-Corasick) scan all words; a match counts where it stands at the half's own end of the word and the lengths differ by one
at most, and the rest of both words is then compared. Words of one half are held by their rests with one code point left out, so that a half which
many words share costs a scan no more than the words it is near to.

An automaton's shard holds the halves of words of one length that begin (or end) with the same two code points: that is where a scanned word of a
fitting length can match at all, so it visits six shards. Shards of many words are cut, and the words that visit them see every part.

Defined results: a null text has no words; rows that repeat a doc_id count each, a null doc_id is the empty text where the rule asks for the id. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.shared import materialize

#: A run of letters.
LETTERS = re.compile(r"[A-Za-zÀ-ÿ]+")
#: Code points of a word at least, and its occurrences.
LENGTH, OCCURRENCES = 5, 3
#: Words of a shard's automaton.
SHARD = 50_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_VISIT = "shard long, kind byte, word string, n long"


def slip(doc_id: object, run: str, every: int) -> str:
    """``run`` of a document, with a code point deleted where ``every`` divides the checksum of id and run."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(every: int | None, length: int) -> Callable:
    """(id, text) to words with their occurrences, each batch summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter[str] = Counter()
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                runs = Counter(LETTERS.findall((text.as_py() or "").translate(_LOWER)))
                if every is None:
                    counts.update(runs)
                    continue
                of = "" if doc_id is None else doc_id
                for r, n in runs.items():
                    if len(r) >= length:  # nothing is added to a run
                        counts[slip(of, r, every)] += n
            words = [w for w in counts if len(w) >= length]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, of at least ``length`` code points that occur at least ``occurrences`` times. ``every``: slips (``slip``), for trials."""
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(_counted(every, length), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one insertion, deletion or replacement turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _holes(rest: str, short: bool) -> list:
    """``rest`` without each of its code points, by position: strings if short, else their hashes, so that a long word takes no square of its length."""
    if short:
        return [rest[:i] + rest[i + 1 :] for i in range(len(rest))]
    after, power, ends = 0, 1, []
    for c in reversed(rest):  # the hash of what follows each position, and its weight
        ends.append((after, power))
        after, power = (ord(c) * power + after) % _PRIME, power * _BASE % _PRIME
    before, out = 0, []
    for c, (after, power) in zip(rest, reversed(ends), strict=True):
        out.append((before * power + after) % _PRIME)
        before = (before * _BASE + ord(c)) % _PRIME
    return out


def _whole(rest: str, short: bool) -> object:
    """``rest`` in the form that ``_holes`` has."""
    if short:
        return rest
    h = 0
    for c in rest:
        h = (h * _BASE + ord(c)) % _PRIME
    return h


class _Shard:
    """An automaton over one half of words of one length, with the words of each half."""

    def __init__(self, words: list[tuple[str, int]], left: bool) -> None:
        self.left, self.cut = left, len(words[0][0]) // 2
        self.short = self.cut <= 32
        self.automaton = ahocorasick.Automaton()
        self.rests: list[tuple[dict[object, list[tuple[str, int]]], dict[object, list[tuple[str, int]]]]] = []
        for word, n in words:
            half, rest = (word[: self.cut], word[self.cut :]) if left else (word[self.cut :], word[: self.cut])
            at = self.automaton.get(half, -1)
            if at < 0:
                at = len(self.rests)
                self.automaton.add_word(half, at)
                self.rests.append(({}, {}))
            whole, holes = self.rests[at]
            whole.setdefault(_whole(rest, self.short), []).append((word, n))
            for hole in set(_holes(rest, self.short)):
                holes.setdefault(hole, []).append((word, n))
        self.half = self.cut if left else len(words[0][0]) - self.cut
        self.automaton.make_automaton()

    def near(self, word: str) -> set[tuple[str, int]]:
        """The shard's words that are one edit from ``word`` outside their half; by right halves only those whose left half isn't at its begin too."""
        found: set[tuple[str, int]] = set()
        for end, at in self.automaton.iter(word):
            if end + 1 != (self.half if self.left else len(word)):
                continue
            rest = word[self.half :] if self.left else word[: len(word) - self.half]
            whole, holes = self.rests[at]
            found.update(holes.get(_whole(rest, self.short), ()))
            for hole in set(_holes(rest, self.short)):
                found.update(whole.get(hole, ()))
                found.update(holes.get(hole, ()))
        return {(w, n) for w, n in found if one_edit(w, word) and (self.left or not word.startswith(w[: self.cut]))}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_VISIT``, each shard's together: words it holds (kind 0 by left, 1 by right halves), then words to scan (kind 2). To (word, near, less, form) of scanned words with a neighbour in the shard."""
    shard, held, automaton, sides = None, [], None, None
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for at, kind, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != shard:
                shard, held, automaton, sides = at, [], None, None
            if kind < 2:
                held.append((word, n))
                sides = kind
            elif held:
                automaton = automaton or _Shard(held, sides == 0)
                if near := automaton.near(word):
                    less, form = min((-m, w) for w, m in near)
                    for column, v in zip(out, (word, len(near), less, form), strict=True):
                        column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "less", "form"])


def neighbours(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """``words`` (word, n; distinct words of at least four code points) that have a neighbour: word, n_near, less (the least of -n among its neighbours), form (the first neighbour of that n).

    A shard is cut with over ``shard`` words, or over a hundred-thousandth of all, so that under 100,000 cuts are told to the tasks.
    """
    length = F.length("word")
    left, right = F.substring("word", 1, 2), F.expr("right(word, 2)")
    name = lambda side, ends, n: F.xxhash64(F.lit(side), ends, n)
    homes = F.explode(F.array(*(F.struct(name(k, e, length).alias("home"), F.lit(k).cast("byte").alias("kind")) for k, e in ((0, left), (1, right))))).alias("h")
    holders = words.select("word", "n", homes).select("h.home", "h.kind", "word", "n")
    visits = F.explode(F.array(*(name(k, e, length + d) for k, e in ((0, left), (1, right)) for d in (-1, 0, 1)))).alias("home")
    visitors = words.select(visits, F.lit(2).cast("byte").alias("kind"), "word", "n")
    most = max(shard, 2 * words.count() // 100_000)
    large = holders.groupBy("home").count().where(F.col("count") > most).select("home", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    large = F.broadcast(materialize(large, "spelling_large"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = holders.join(large, "home", "left").select(F.xxhash64("home", F.pmod(F.xxhash64("word"), parts).cast("int")).alias("shard"), "kind", "word", "n")
    sent = visitors.join(large, "home", "left").select("home", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "kind", "word", "n")
    rows = dealt.unionByName(sent.select(F.xxhash64("home", "part").alias("shard"), "kind", "word", "n"))
    met = rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_scan, "word string, near long, less long, form string")
    best = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "form")).alias("b"))
    return best.select("word", "n_near", "b.less", "b.form")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root), the last form that following forms leads to. Steps double each round, and a form has twice its word's occurrences at least, so rounds are few."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    for k in range(64):
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = materialize(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"spelling_roots_{k}")
        if ahead.where("moved").isEmpty():
            break
        steps = ahead.drop("moved")
    return steps


def spelling_groups(words: DataFrame, ratio: int = 2, shard: int = SHARD) -> DataFrame:
    """``words`` (word, n) as word, n, n_near (near words), form (the near word of largest n, ties first in order, if that is ``ratio`` times n at least), form_n, root (the last form, else the word)."""
    words = materialize(words.select("word", "n"), "spelling_words")
    best = words.join(neighbours(words, shard), "word", "left")
    fits = -F.col("less") >= ratio * F.col("n")
    found = best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, -F.col("less")).alias("form_n"))
    found = materialize(found, "spelling_forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

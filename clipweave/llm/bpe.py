"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental decoder.

From the merge list one pass computes how many bytes right of a token can still change it (``lookahead``): a token (a, b)
depends on whether b merges to the right by an earlier rule first, which depends on that rule's own right part, and so
on along falling ranks. The encoder reads text in pieces. Pre-tokens end where no further character can move their border;
inside a pre-token that is still open, tokens that end more than the lookahead before the end of what has been read are
emitted and forgotten. What the encoder holds is bounded by the lookahead, not by the text; a row's ids are one array, as its text is one
string. The decoder maps ids to bytes and bytes
to text with a UTF-8 state machine, ill-formed bytes becoming U+FFFD.

Defined results: a null text counts as empty and gives no ids. Strings of special tokens inside a text become those tokens, as in
the tokenizers library's default. Rows are independent: repeated rows repeat, an empty table gives an empty result, and columns
other than the id and the text are not read. A null or unknown id decodes to nothing.
"""

from __future__ import annotations

import codecs
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points that this box's regex module takes for letters or numbers, as newer Unicode does, and the tokenizers library doesn't yet.
NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF
18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96
1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479
3D000-3FC3F
"""
_NEWER = "".join("-".join(chr(int(end, 16)) for end in part.split("-")) for part in NEWER.split())
#: Characters before all of those go first, so that the long list is seldom looked through.
_BEFORE = f"{chr(int(NEWER.split()[0].split('-')[0], 16))}-\U0010ffff"
_LETTERS, _NUMBERS = (rf"(?:[^\P{{{k}}}{_BEFORE}]+|[^\P{{{k}}}{_NEWER}])+" for k in "LN")
_OTHERS = rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]+|[{_NEWER}])+"
#: The pre-token pattern of byte-level BPE.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTERS}| ?{_NUMBERS}| ?{_OTHERS}|\p{{White_Space}}+(?!\P{{White_Space}})|\p{{White_Space}}+"


def _latin_pattern() -> re.Pattern:
    """``PRETOKEN`` for text of Latin-1 characters only, with its classes spelled out, which the standard matcher takes faster."""
    classes = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c)).startswith(k)) for k in "LN"}
    white = "".join(re.escape(chr(c)) for c in range(256) if regex.match(r"\p{White_Space}", chr(c)))
    others = rf"[^{white}{classes['L']}{classes['N']}]+"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{classes['L']}]+| ?[{classes['N']}]+| ?{others}|[{white}]+(?![^{white}])|[{white}]+")


_PRETOKEN_LATIN = _latin_pattern()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Runs that a pre-token of one kind can go on with.
_RUNS = {k: regex.compile(p) for k, p in {"L": _LETTERS, "N": _NUMBERS, "P": _OTHERS}.items()}
_WHITE, _WHITES = regex.compile(r"\p{White_Space}"), regex.compile(r"\p{White_Space}*")
_NONE = 1 << 40
#: Characters of a text that are read at a time; pre-tokens longer than LONG bytes are streamed.
SLICE, LONG = 1 << 13, 256


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Merges and tokens of a tokenizer file's JSON text."""

    def __init__(self, text: str):
        model = json.loads(text)
        alphabet = byte_alphabet()
        vocab = model["model"]["vocab"]
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.bytes_of = {i: to_bytes(t) for t, i in vocab.items()}
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        need: dict[int, int] = {}
        best: dict[int, int] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            self.rank[a << 20 | b] = rank
            self.made.append(t)
            size = len(self.bytes_of[b])
            here = max(need.get(b, 0), best.get(b, 0), need.get(a, 0) - size)
            need[t] = max(here, need.get(t, 0))
            best[a] = max(best.get(a, 0), size + here)
        #: Bytes after a token's end beyond which nothing can change it.
        self.lookahead = max([1, *need.values(), *best.values()])

    def merge(self, data: bytes) -> list[int]:
        """The ids of one whole pre-token."""
        ids = [self.byte_id[c] for c in data]
        get = self.rank.get
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            r = min(ranks)
            if r == _NONE:
                break
            i = ranks.index(r)
            ids[i : i + 2] = (self.made[r],)
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], _NONE)
        return ids


    def emit(self, data: bytes, out: list[int]) -> bytes:
        """Adds the ids of an open pre-token's bytes that nothing after them can change; returns the bytes that are left."""
        ahead = self.lookahead
        while len(data) >= 2 * ahead + LONG:
            window = data[: 2 * ahead + LONG]
            done = 0
            for i in self.merge(window):
                size = len(self.bytes_of[i])
                if done + size > len(window) - ahead:
                    break
                out.append(i)
                done += size
            data = data[done:]
        return data

    def stream(self, data: bytes) -> list[int]:
        """The ids of one whole pre-token, window by window."""
        out: list[int] = []
        rest = self.emit(data, out)
        return out + self.merge(rest)


class Seen(dict):
    """The ids of whole pre-tokens, kept for those seen lately."""

    def __init__(self, vocab: Vocabulary) -> None:
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        if len(data) > LONG:
            return tuple(self.vocab.stream(data))
        if len(self) > 400_000:
            self.clear()
        ids = self[word] = tuple(self.vocab.merge(data))
        return ids


class Encoder:
    """Feed it pieces of one text; each call returns the ids that have become stable, ``finish`` the rest."""

    def __init__(self, vocab: Vocabulary, seen: Seen | None = None):
        self.vocab = vocab
        self.seen = Seen(vocab) if seen is None else seen
        self.pattern = regex.compile(PRETOKEN)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True))) if vocab.special else None
        self.hold = 2 + max([0, *(len(s) for s in vocab.special)])
        self.buffer = ""
        self.open = ""  # the kind of a pre-token that is being streamed
        self.tail = b""  # its bytes that no emitted token covers

    def feed(self, text: str) -> list[int]:
        self.buffer += text
        return self._run(False)

    def finish(self) -> list[int]:
        return self._run(True)

    def _run(self, final: bool) -> list[int]:
        out: list[int] = []
        while self.specials and (m := self.specials.search(self.buffer)):
            rest = self.buffer[m.end() :]
            self.buffer = self.buffer[: m.start()]
            self._plain(True, out)
            out.append(self.vocab.special[m[0]])
            self.buffer = rest
        self._plain(final, out)
        return out

    def _plain(self, final: bool, out: list[int]) -> None:
        """Pre-tokens of the buffer, up to what a further character could still change."""
        text = self.buffer
        end = len(text) if final else max(0, len(text) - self.hold)
        at = 0
        if self.open:
            at = self._go_on(text, end, final, out)
            if self.open:
                self.buffer = text[at:]
                return
        words = (_PRETOKEN_LATIN if _latin(text) else self.pattern).findall(text, at)
        at, held = len(text), None
        while words and at > end:  # words that end beyond what is settled stay in the buffer
            held = words.pop()
            at -= len(held)
        out.extend(itertools.chain.from_iterable(map(self.seen.__getitem__, words)))
        if held is not None and len(held) > LONG and not final:
            self.open = "S" if _WHITE.match(held, len(held) - 1) else next(k for k, run in _RUNS.items() if run.match(held, len(held) - 1))
            # Of white space, the last character may go to the next word.
            stop = end - (self.open == "S")
            self._grow(text[at:stop], out)
            at = stop
        self.buffer = text[at:]

    def _go_on(self, text: str, end: int, final: bool, out: list[int]) -> int:
        """Streams the open pre-token's next bytes; returns how far."""
        white = self.open == "S"
        m = (_WHITES if white else _RUNS[self.open]).match(text)
        stop = m.end() if m else 0
        closed = final or stop < len(text)
        if white and stop < len(text):
            stop = max(0, stop - 1)  # the last one may go to the next word
        if not final and stop > end:  # what begins after it may be the begin of a special token
            stop, closed = max(0, end - white), False
        elif not closed:
            stop = max(0, min(stop, end - white))
        self._grow(text[:stop], out)
        if closed:
            out.extend(self.vocab.merge(self.tail) if len(self.tail) <= 2 * LONG else self.vocab.stream(self.tail))
            self.open, self.tail = "", b""
        return stop

    def _grow(self, text: str, out: list[int]) -> None:
        self.tail += text.encode()
        self.tail = self.vocab.emit(self.tail, out)


class Decoder:
    """Feed it ids; each call returns the text that they complete, ``finish`` what an unfinished character leaves."""

    def __init__(self, vocab: Vocabulary):
        self.bytes_of = vocab.bytes_of
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        try:
            data = b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            data = b"".join(self.bytes_of.get(i, b"") for i in ids)
        return self.utf8.decode(data)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


def encode_text(encoder: Encoder, text: str | None) -> list[int]:
    """All ids of one text, read in slices."""
    text, ids = text or "", []
    for k in range(0, len(text), SLICE):
        ids += encoder.feed(text[k : k + SLICE])
    return ids + encoder.finish()


def _lists(ids: list[list[int]]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes[-1]))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))


_held: dict[int, Seen] = {}


def _vocabulary(shared) -> Seen:
    """The broadcast vocabulary and the pre-tokens seen lately, built once in each Python worker and kept for its next tasks."""
    key = hash(shared.value)
    if key not in _held:
        _held[key] = Seen(Vocabulary(shared.value))
    return _held[key]


def _share(docs: DataFrame, vocab_path: str | None):
    if vocab_path is None:
        import public_tokenizers

        vocab_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(vocab_path, encoding="utf-8") as f:  # a file of the driver's; its size doesn't depend on the data
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array<int>) and, if asked for, the decoded text of those ids."""
    shared = _share(docs, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _vocabulary(shared)
        vocab = seen.vocab
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                ids = [encode_text(Encoder(vocab, seen), t) for t in b.column(1).to_pylist()]
                out = [b.column(0), _lists(ids)]
                if decoded:
                    decoder = Decoder(vocab)
                    out.append(pa.array([decoder.feed(x) + decoder.finish() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: doc_id, text."""
    shared = _share(rows, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(shared).vocab
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                decoder = Decoder(vocab)
                texts.append(decoder.feed(ids or []) + decoder.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")

"""Toxicity with noisy-channel deobfuscation.

Restoring.  A token that looks disguised (digits or signs among letters, a
letter three times or more, single letters set apart by spaces or dots) becomes
a lattice: each sign may stand for itself or a letter it resembles, a separator
or a further copy of a letter may stand for nothing.  Viterbi decoding finds the
path of least cost under a channel of fixed costs and a character trigram model,
whose counts cover all documents.

Scoring.  Words of the text and of its restored tokens are matched with a
lexicon of words and word beginnings that is learned from labelled rows: those
nearly confined to toxic rows, picked by what each adds to the ones before.  The
score is the noisy-or of their precisions over the base rate.  Labels of rows
with ``crc32(id as text) % 4 == 2`` are held out; labels, language, source and id
are no inputs of a score.

Defined results.  Null, empty and blank texts get the score of a text without
matches.  Every row gives one row; without labels or documents there is no
lexicon, and every text gets the same low score.  A label of a row that is not
there, or null, is left out.  Extra input columns are left out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm import _common as c

#: Bound on labelled rows that the lexicon is learned from; with more, a share of them by a hash of the id.
FIT_ROWS = 20_000
THRESHOLD = 0.3
#: Letters that signs resemble.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i"}
#: Signs that may stand between the letters of a word.
SEPARATORS = " .-_*~'`,/"
#: Costs (natural logarithm) of the channel: a sign read as a letter, a separator or a copy read as nothing.
SIGN, NOTHING = 0.7, 0.3
WORD = re.compile(r"[^\W\d_]+")
#: Lone characters set apart by blanks; a quote or bracket may precede the first, punctuation follow the last.
SPACED = re.compile(r"(?<!\S)[\"'(\[]?(\S(?:[ \t]+\S){3,})[.,;:!?\"')\]]*(?!\S)")
BLANKS = re.compile(r"[ \t]{2,}|\t")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
SIGNS = re.compile("[" + re.escape("".join(LOOKS_LIKE) + SEPARATORS.replace(" ", "")) + "]")
#: Tokens that one pass remembers; beyond it forgets them all (memory bound, not a limit of results).
MEMO = 100_000

#: Letters of the language model: a to z, then Latin letters with marks (U+00DF to U+00FF), 0 is a word's edge.
_CODES = np.zeros(0x180, np.int64)
_CODES[97:123] = np.arange(1, 27)
_CODES[65:91] = np.arange(1, 27)
_CODES[0xDF:0x100] = np.arange(27, 27 + 33)
_CODES[0xC0:0xDF] = np.arange(28, 28 + 31)
_CODES[0xD7] = _CODES[0xF7] = 0
LETTERS = 64


def letter(ch: str) -> int:
    return int(_CODES[ord(ch)]) if ord(ch) < 0x180 else 0


#: Texts and characters that are held at once as objects of Python.
HELD_ROWS, HELD_CHARS = 256, 1 << 20


def pieces(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in short stretches, as its texts take several times their size as objects of Python."""
    for at in range(0, part.num_rows, HELD_ROWS):
        yield part.slice(at, HELD_ROWS)


def runs(texts: list[str]) -> Iterator[list[str]]:
    """Texts in lists of about so many characters; a longer text is one by itself."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > HELD_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts (64, 64, 64) of letter trigrams over all texts; at most 64**3 rows come to the driver."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for part in parts:
            for texts in (own for piece in pieces(part) for own in runs([t for t in piece.column(0).to_pylist() if t])):
                points = np.frombuffer("  ".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
                code = _CODES[np.where(points < 0x180, points, 0)]
                # two edges before a word, one after it
                if len(code) > 2:
                    a, b, d = code[:-2], code[1:-1], code[2:]
                    total += np.bincount((a * LETTERS + b) * LETTERS + d, minlength=LETTERS**3)
                    starts = (b == 0) & (a > 0) & (d > 0)  # one white space: a word begins as after two
                    total += np.bincount(d[starts], minlength=LETTERS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])
        c.trim()

    rows = docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LETTERS**3, np.int64)
    for r in rows:
        out[r.gram] = r.n
    return out.reshape(LETTERS, LETTERS, LETTERS)


class Restorer:
    """Viterbi decoding of one token's lattice under the trigram model."""

    def __init__(self, counts: np.ndarray):
        one = counts.sum((0, 1)) + 0.5
        two = counts.sum(0)
        p1 = one / one.sum()
        p2 = (two + 4 * p1) / (two.sum(1, keepdims=True) + 4)
        self.cost = -np.log((counts + 4 * p2) / (counts.sum(2, keepdims=True) + 4))
        self.memo: dict[str, str] = {}

    def __call__(self, token: str) -> str:
        if (got := self.memo.get(token)) is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            got = self.memo[token] = self.decode(token)
        return got

    def decode(self, token: str) -> str:
        cost = self.cost
        # state: the last two letters, and the letter a copy would repeat
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        low, before = token.lower(), ""
        for ch in low:
            options = [(ch, 0.0)] if letter(ch) else []
            options += [(x, SIGN) for x in LOOKS_LIKE.get(ch, "")]
            nothing = NOTHING if ch in SEPARATORS or ch == before else None
            if not options and nothing is None:
                nothing = 2.0  # a sign that is nothing else may only be dropped
            fresh: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (spent, text) in states.items():
                if nothing is not None and (spent + nothing < fresh.get((a, b), (math.inf,))[0]):
                    fresh[a, b] = (spent + nothing, text)
                for x, extra in options:
                    k = letter(x)
                    to = spent + extra + cost[a, b, k]
                    if to < fresh.get((b, k), (math.inf,))[0]:
                        fresh[b, k] = (to, text + x)
            states, before = fresh, ch
        return min(((spent + cost[a, b, 0], text) for (a, b), (spent, text) in states.items()), default=(0, ""))[1]


def readable(part: str) -> int:
    """How many letters and signs that resemble one a part has; none without a letter, as numbers and prices are no words."""
    return sum(ch.isalpha() or ch in LOOKS_LIKE for ch in part) if any(map(str.isalpha, part)) else 0


def disguised(token: str) -> str | None:
    """The part of a token that may be a disguised word."""
    core = token.strip("\"'.,;:!?#*$%&|<>()[]{}=~`")
    tail = token[len(token.rstrip(".,;:")) - 1 : len(token.rstrip(".,;:"))]
    if TRIPLE.search(core):
        return core
    if len(core) < 3 and readable(part := token.strip("\"'.,;:?#*&<>)[]{}=~`")) >= 3:
        return part
    if len(core) < 3 or core.isalpha():
        if token[:1] in "$@(|!" and len(core) > 2 or tail in "$!" and len(core) > 2:
            return token.rstrip(".,;:").rstrip("!") or core
        return None
    if SIGNS.search(core) and (sum(map(str.isalpha, core)) >= 2 or readable(core) >= 3):
        return token.rstrip(".,;:!?") if token[:1] in "$@(|!" else core
    return None


def beginnings(word: str) -> Iterator[str]:
    """The features of a lower-case word: itself and its first 4 to 8 letters."""
    yield word
    for k in (4, 5, 6, 7, 8):
        if len(word) > k:
            yield word[:k] + "-"


class Reader:
    """Texts to features, with memory of tokens."""

    def __init__(self, counts: np.ndarray):
        self.restore = Restorer(counts)
        self.memo: dict[str, tuple[str, ...]] = {}

    def words(self, token: str) -> tuple[str, ...]:
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            got = self.memo[token] = self.fresh(token)
        return got

    def fresh(self, token: str) -> tuple[str, ...]:
        out = {w.lower() for w in WORD.findall(token)}
        if part := disguised(token):
            out.add(self.restore(part))
            # a copy of a letter may be part of the word
            out.add(TRIPLE.sub(r"\1", part.lower()))
        return tuple(out)

    def spaced(self, text: str) -> list[str]:
        out: set[str] = set()
        for m in SPACED.finditer(text):
            # the whole row, and what wider gaps set apart in it
            whole = m.group(1)
            pieces = BLANKS.split(whole)
            for piece in {" ".join(whole.split()), *(p for p in pieces if len(p) >= 7)}:
                # a word of one letter may stand before or after the spaced one
                for row in {piece, piece[2:], piece[:-2], piece[2:-2]}:
                    if len(row) >= 7 and (sum(map(str.isalnum, row)) >= 4 or readable(row) >= 4):
                        out |= {self.restore(row), self.restore(row.replace(" ", ""))}
        return list(out)

    def features(self, text: str | None) -> set[str]:
        text = text or ""
        words = set().union(*map(self.words, set(text.split())), self.spaced(text))
        return {f for w in words for f in beginnings(w)}


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, counts: np.ndarray, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The lexicon: feature to precision, and the base rate.  Only rows that are not held out are read."""
    known = labels.where("toxic is not null").select(id_col, "toxic").where(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2)
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    known = known.groupBy(id_col).agg(F.max("toxic").alias("toxic"))  # at most about FIT_ROWS
    train = docs.select(id_col, text_col).join(known, id_col).groupBy(F.xxhash64(text_col)).agg(F.first(text_col).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    train = c.written(train, "fit")

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, hits = Reader(counts), (Counter(), Counter())
        for part in (piece for whole in parts for piece in pieces(whole)):
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                hits[toxic > 0].update(reader.features(text))
        all_ = list(hits[0].keys() | hits[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(all_, pa.string()), pa.array([hits[1][w] for w in all_], pa.int64()), pa.array([hits[0][w] for w in all_], pa.int64())], names=["feature", "bad", "good"])
        del reader, hits, all_  # before the memory is given back
        c.trim()

    bad = train.where("toxic > 0").count()
    support = max(3, bad // 200)
    tallied = train.mapInArrow(tally, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = {r.feature: (r.bad, r.good) for r in tallied.where(f"bad >= {support} and good <= 0.1 * bad").collect()}

    def matches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(counts)
        for part in (piece for whole in parts for piece in pieces(whole)):
            own = [sorted(reader.features(t) & found.keys()) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string()))], names=["found"])
        del reader
        c.trim()

    rows_bad = [r.found for r in train.where("toxic > 0").select("text").mapInArrow(matches, "found array<string>").collect()]
    total = train.count()
    c.forget(train)
    # pick by what a feature adds: a row counts less for each feature that already covers it
    where: dict[str, list[int]] = {}
    for i, own in enumerate(rows_bad):
        for f in own:
            where.setdefault(f, []).append(i)
    weight = np.ones(len(rows_bad))
    at = {f: np.array(i) for f, i in where.items()}
    lexicon: dict[str, float] = {}
    least = max(2.5, bad / 250)
    while at:
        gain = {f: weight[i].sum() - 5 * found[f][1] for f, i in at.items()}
        best = min(gain, key=lambda f: (-gain[f], len(f), f))
        if gain[best] < least:
            break
        lexicon[best] = found[best][0] / (found[best][0] + found[best][1] + 1)
        weight[at.pop(best)] *= 0.6
        at = {f: i for f, i in at.items() if gain[f] >= least}
    covered = sum(1 for own in rows_bad if any(f in lexicon for f in own))
    rest = (bad - covered + 0.5) / max(1, total - covered + 1)
    return {"lexicon": lexicon, "base": min(0.2, rest)}


def score(docs: DataFrame, model: dict, counts: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, held_out, score, predicted, n_spaced) of every row; with ``keep`` the input, all of its columns, without rows whose score reaches the threshold."""
    c.ready(docs.sparkSession)
    lexicon, base = model["lexicon"], model["base"]

    def of(reader: Reader, known: dict[str, tuple], text: str | None) -> tuple[float, int]:
        text = text or ""
        hits: set[str] = set()
        spaced = 0
        for token in set(text.split()):
            got = known.get(token)
            if got is None:
                if len(known) > MEMO:
                    known.clear()
                words = reader.fresh(token)
                got = known[token] = tuple(f for w in words for f in beginnings(w) if f in lexicon)
            if got:
                hits.update(got)
        for w in reader.spaced(text):
            spaced += 1
            hits.update(f for f in beginnings(w) if f in lexicon)
        clean = 1 - base
        for f in hits:
            clean *= 1 - lexicon[f]
        return 1 - clean, spaced

    if keep:
        at = docs.columns.index(text_col)

        def run_keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, known = Reader(counts), {}
            for part in (piece for whole in parts for piece in pieces(whole)):
                yield part.filter(pa.array([of(reader, known, t)[0] < threshold for t in part.column(at).to_pylist()], pa.bool_()))
            del reader, known  # before the memory is given back
            c.trim()

        return docs.mapInArrow(run_keep, docs.schema)

    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Reader(counts), {}
        for part in (piece for whole in parts for piece in pieces(whole)):
            ids = part.column(0).to_pylist()
            got = [of(reader, known, t) for t in part.column(1).to_pylist()]
            s = [x for x, _ in got]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array([n for _, n in got], pa.int64())], names=[id_col, "held_out", "score", "predicted", "n_spaced"])
        del reader, known
        c.trim()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, n_spaced long")


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """Learn from the labelled rows that are not held out, and score every row, or with ``keep`` leave out those that reach the threshold."""
    c.ready(docs.sparkSession)
    counts = trigrams(docs)
    model = fit(docs, labels, counts, fit_rows)
    return score(docs, model, counts, threshold, keep=keep)


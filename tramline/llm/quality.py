"""Quality rules: distribution divergence from language references.

A language's reference is the histogram of character classes and of common words
over all its documents.  A common word has at least ``SHARE`` of the language's
words.  The first pass names candidates by summaries of ``KEPT`` counters, which lose
no word of a share over 1 / KEPT however they are merged, and the second counts them
over all rows: the references are exact, and small whatever the input.  A language
needs ``LEAST_DOCS`` documents, a thousandth of all, and ``LEAST_WORDS`` words to have
a reference, so there are at most a thousand; with less it counts as unknown.

A document is compared by the Jensen-Shannon distance (base 2, 0 to 1) of its
histograms to its language's.  Short texts stray by chance, so the limits widen
with 1/sqrt(words), and under ``MIN_WORDS`` words the divergence says nothing.

Defined results.  Null and empty texts have no words and fail the base.  A row
with a null or unknown language is compared to every reference and the nearest
counts; with no reference at all, nothing is against the text.  Every row gives
one row.  Extra input columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import _common as c

SHARE, MIN_WORDS = 0.002, 50
#: Counters of a summary of words, four for each word that can be common, and groups that summaries are merged in.
KEPT, GROUPS = 2000, 16
#: Support that a reference needs; besides, LEAST_SHARE of all documents.
LEAST_DOCS, LEAST_WORDS, LEAST_SHARE = 10, 1000, 0.001
#: Limits of the distances: classes of characters, common words; SLACK / sqrt(words) is added to both.
CLASS_LIMIT, WORD_LIMIT, SLACK = 0.18, 0.45, 1.0
#: The symbols of the base rule.
SYMBOLS = b"#*$%&|<>"
CLASSES = 7

# classes of bytes: lower, upper, other letters (lead bytes of UTF-8), digits, white space, sentence signs, the rest; -1: a UTF-8 continuation
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[192:256], _CLASS[48:58] = 0, 1, 2, 3
_CLASS[list(c.WORD_BREAKS)] = 4
_CLASS[list(b".,;:'-\"?")] = 5
_CLASS[128:192] = -1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
# for common words every ASCII character but letters ends a word
_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[[i for i in range(128) if not (65 <= i <= 90 or 97 <= i <= 122)]] = 32


def per_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[rows[1:]] - total[rows[:-1]]


def class_counts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    kind = _CLASS[data]
    return np.stack([per_row(kind == k, rows) for k in range(CLASSES)], axis=1)


def common_hashes(offsets: np.ndarray, raw: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case letter words, and how many each row has."""
    data = _TO_SPACE[raw[offsets[first] : offsets[last]]]
    kept, starts, ends, n = c.word_slice(offsets[first : last + 1] - offsets[first], data, 0, last - first, lower=True)
    return c.word_hashes(kept, starts, ends), n


def base_counts(offsets: np.ndarray, raw: np.ndarray, first: int, last: int) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of rows first..last."""
    data, rows = raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
    kept, starts, ends, n = c.word_slice(offsets, raw, first, last)
    out = np.zeros((last - first, 5), np.int64)
    out[:, 0] = n
    out[:, 1] = per_row(~c.IS_BREAK[data] & (_CLASS[data] >= 0), rows)
    out[:, 2] = per_row(_SYMBOL[data], rows)
    for i in range(last - first):
        lines = data[rows[i] : rows[i + 1]].tobytes().split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.strip(c.WORD_BREAKS)]
            out[i, 3] = len(lines) - len(set(lines))
    if len(starts) > 3:
        h = c.word_hashes(kept, starts, ends)
        row = np.repeat(np.arange(last - first), n)
        ok = np.flatnonzero(c.room_of(n) >= 3)
        key = c.mix(h[ok] * np.uint64(0x9E3779B97F4A7C15) + c.mix(h[ok + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + c.mix(h[ok + 2]))) ^ c.mix(row[ok].astype(np.uint64) + np.uint64(1))
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = ok[times[inverse] > 1]
        cover = np.zeros(len(starts), bool)
        for k in range(3):
            cover[twice + k] = True
        out[:, 4] = per_row(cover, np.concatenate(([0], np.cumsum(n))))
    return out


def references(docs: DataFrame, share: float = SHARE, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Language to (class histogram, common-word hashes in order, their shares)."""
    langs = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    least = max(LEAST_DOCS, (langs.agg(F.sum("n")).first()[0] or 0) * LEAST_SHARE)
    known = [r.lang for r in langs.where(F.col("n") >= least).collect()]  # at most 1 / LEAST_SHARE
    if not known:
        return {}
    texts = docs.select(text_col, lang_col).where(F.col(lang_col).isin(known))

    def totals(parts: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        words: dict[str, list[np.ndarray]] = {}
        n_words: dict[str, int] = {}
        counted: dict[str, np.ndarray] = {}
        classes: dict[str, np.ndarray] = {}
        for part in parts:
            offsets, raw = c.blobs(part.column(0))
            lang = np.array(part.column(1).to_pylist(), object)
            for first, last in c.slices(offsets):
                h, n = common_hashes(offsets, raw, first, last)
                own = lang[first:last]
                hist = class_counts(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                each = np.repeat(own, n)
                for x in set(own.tolist()):
                    mine = h[each == x]
                    n_words[x] = n_words.get(x, 0) + len(mine)
                    classes[x] = classes.get(x, 0) + hist[own == x].sum(0)
                    if wanted is None:
                        u, k = np.unique(mine, return_counts=True)
                        words.setdefault(x, []).append(np.stack([u, k.astype(np.uint64)]))
                        if len(words[x]) >= 16:
                            words[x] = [merged(words[x])]
                    else:
                        at = np.searchsorted(wanted, mine)
                        ok = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == mine)
                        counted[x] = counted.get(x, 0) + np.bincount(at[ok], minlength=len(wanted))
        out = []
        for x, total in n_words.items():
            if wanted is None:
                u, k = summary(merged(words[x]))
                out += [(x, "w", int(a), int(b)) for a, b in zip(u.view(np.int64), k, strict=True)]
            else:
                out += [(x, "w", int(a), int(b)) for a, b in zip(wanted.view(np.int64), counted[x], strict=True) if b]
                out += [(x, "c", k, int(v)) for k, v in enumerate(classes[x])] + [(x, "n", 0, total)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "kind", "key", "n"])

    schema = "lang string, kind string, key long, n long"
    # summaries of partitions merge to GROUPS a language, of at most KEPT words each, and these on the driver
    parts = texts.mapInArrow(lambda parts: totals(parts, None), schema).withColumn("kind", F.pmod(F.spark_partition_id(), F.lit(GROUPS)).cast("string"))
    halves = parts.repartition("lang", "kind").sortWithinPartitions("lang", "kind").mapInArrow(merge_summaries, schema)
    rough: dict[str, list[np.ndarray]] = {}
    for r in halves.collect():
        rough.setdefault(r.lang, []).append(np.array([[r.key], [r.n]], np.int64).view(np.uint64))
    named = [summary(merged(own))[0] for own in rough.values()]
    wanted = np.unique(np.concatenate(named)) if named else np.zeros(1, np.uint64)
    rows = texts.mapInArrow(lambda parts: totals(parts, wanted), schema).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).collect()
    out: dict[str, tuple] = {}
    for x in sorted({r.lang for r in rows}):
        total = next(r.n for r in rows if (r.lang, r.kind) == (x, "n"))
        hist = np.zeros(CLASSES)
        for r in rows:
            if (r.lang, r.kind) == (x, "c"):
                hist[r.key] = r.n
        common = sorted((int(np.int64(r.key).view(np.uint64)), r.n / total) for r in rows if (r.lang, r.kind) == (x, "w") and r.n >= share * total)
        if total >= LEAST_WORDS:
            out[x] = (hist / max(1, hist.sum()), np.array([a for a, _ in common], np.uint64), np.array([b for _, b in common]))
    return out


def merged(parts: list[np.ndarray]) -> np.ndarray:
    u, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return np.stack([u, np.bincount(inverse, np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.uint64)])


def summary(counts: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """At most ``kept`` of (words, counts), each count lessened by what the first one left out has: a word of a share over 1 / kept stays."""
    u, k = counts
    if len(u) <= kept:
        return counts
    least = np.partition(k, len(k) - kept - 1)[len(k) - kept - 1]
    return np.stack([u[k > least], k[k > least] - least])


def merge_summaries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, kind, key, n) in order of the first two: one summary of each."""
    held: dict[tuple, list[np.ndarray]] = {}

    def told() -> pa.RecordBatch:
        ((lang, kind), own), = held.items()
        u, k = summary(merged(own))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array([kind] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(k.astype(np.int64))], names=["lang", "kind", "key", "n"])

    for part in parts:
        names = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
        rows = np.stack([part.column(i).to_numpy().view(np.uint64) for i in (2, 3)])
        for name in dict.fromkeys(names):
            at = [i for i, x in enumerate(names) if x == name]
            if held and name not in held:
                yield told()
            held.setdefault(name, []).append(rows[:, at])
            if len(held[name]) >= 16:
                held[name] = [summary(merged(held[name]))]
    if held:
        yield told()


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q."""
    m = (p + q) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(-1)

    return np.sqrt(np.clip((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def quality_rules(docs: DataFrame, refs: dict | None = None, limits: tuple[float, float, float] = (CLASS_LIMIT, WORD_LIMIT, SLACK), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance) of every row."""
    c.ready(docs.sparkSession)
    refs = references(docs, text_col=text_col, lang_col=lang_col) if refs is None else refs
    kind = docs.schema[id_col].dataType.simpleString()
    class_limit, word_limit, slack = limits

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            offsets, raw = c.blobs(part.column(1))
            lang = part.column(2).to_pylist()
            for first, last in c.slices(offsets):
                base = base_counts(offsets, raw, first, last)
                h, n = common_hashes(offsets, raw, first, last)
                hist = class_counts(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                hist = hist / np.maximum(1, hist.sum(1, keepdims=True))
                row = np.repeat(np.arange(last - first), n)
                d_class, d_word = np.full(last - first, np.inf), np.full(last - first, np.inf)
                own = lang[first:last]
                for x, (ref, common, shares) in refs.items():
                    mine = np.array([y == x or y not in refs for y in own])
                    if not mine.any():
                        continue
                    at = np.searchsorted(common, h)
                    ok = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == h) if len(common) else np.zeros(len(h), bool)
                    counts = np.bincount(row[ok] * len(common) + at[ok], minlength=(last - first) * len(common)).reshape(last - first, -1)
                    counts = np.concatenate([counts, (n - counts.sum(1))[:, None]], axis=1) / np.maximum(1, n)[:, None]
                    a, b = distance(hist, ref), distance(counts, np.append(shares, max(0.0, 1 - shares.sum())))
                    nearer = mine & (a + b < d_class + d_word)
                    d_class[nearer], d_word[nearer] = a[nearer], b[nearer]
                words = base[:, 0]
                failed = (words < 50) | (100 * base[:, 4] > 50 * words)
                room = slack / np.sqrt(np.maximum(1, words))
                said = (words >= MIN_WORDS) & np.isfinite(d_class)
                far = said & ((d_class > class_limit + room) | (d_word > word_limit + room))
                none = ~np.isfinite(d_class)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(first, last - first), *[pa.array(base[:, k]) for k in range(5)], pa.array(failed), pa.array(~failed & ~far), pa.array(np.where(none, 0, d_class), mask=none), pa.array(np.where(none, 0, d_word), mask=none)], names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"])

    return docs.select(id_col, text_col, lang_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double")

"""Quality rules against brute force; toxicity by restored words and held-out accuracy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

D = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n ", "one", "a b c a b c", "Ab ab\nAb ab\n\n \nx", "x" * 3000, "é è\té\x0bé è\té\n" * 40, "#$ %" * 30, "same line\n" * 60, "no break here   line\u0085z"]


def base_brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_base(spark):
    from tramline.llm.quality import quality_rules

    rnd = random.Random(2)
    texts = TEXTS + [" ".join(rnd.choice("ab c, d# E é\n".split(" ")) for _ in range(rnd.randint(1, 200))) for _ in range(80)]
    rows = [(i, t, rnd.choice(["en", "de", None, ""]), "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert len(got) == len(texts)
    for i, t, _, _ in rows:
        assert tuple(got[i])[1:7] == base_brute(t), t
        assert not (got[i].base_failed and got[i].kept)
    assert quality_rules(docs.limit(0)).count() == 0
    nobody = docs.drop("lang").withColumn("lang", docs.text.substr(1, 0).cast("string")).where("doc_id < 0")
    assert quality_rules(docs, refs={}).where("not base_failed and not kept").count() == 0
    assert nobody.count() == 0


def test_distance():
    from tramline.llm.quality import distance

    p = np.array([[1.0, 0, 0], [0.5, 0.5, 0], [0.2, 0.3, 0.5]])
    for row, d in zip(p, distance(p, np.array([0.2, 0.3, 0.5])), strict=True):
        q, m = np.array([0.2, 0.3, 0.5]), (row + [0.2, 0.3, 0.5]) / 2
        kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
        assert d == pytest.approx(np.sqrt((kl(row) + kl(q)) / 2))


def test_references_are_exact(spark):
    from tramline.llm.quality import SHARE, references

    rows = spark.read.parquet(f"{D}/documents.parquet")
    refs = references(rows.repartition(7))
    for lang in ("en", "fr"):
        words = Counter(w for r in rows.where(rows.lang == lang).collect() for w in re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text)))
        n = words.total()
        assert sorted(v / n for v in words.values() if v >= SHARE * n) == pytest.approx(sorted(refs[lang][2]))


def brute_divergence(rows):
    """Verdicts by plain counting: (doc, failed, kept, class distance, word distance)."""
    from tramline.llm import quality as q

    kinds = lambda t: np.bincount([k for b in (t or "").encode() if (k := q._CLASS[b]) >= 0] or [0], minlength=q.CLASSES) * bool(t)
    letters = lambda t: [w for w in re.split(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    langs = Counter(x for _, _, x in rows if x is not None)
    refs = {}
    for x, n in langs.items():
        own = [t for _, t, y in rows if y == x]
        words = Counter(w for t in own for w in letters(t))
        if n < max(q.LEAST_DOCS, sum(langs.values()) * q.LEAST_SHARE) or words.total() < q.LEAST_WORDS:
            continue
        hist = sum(kinds(t) for t in own)
        refs[x] = hist / hist.sum(), {w: k / words.total() for w, k in words.items() if k >= q.SHARE * words.total()}

    def js(a, b):
        m = [(x + y) / 2 for x, y in zip(a, b)]
        kl = lambda p: sum(x * math.log2(x / z) for x, z in zip(p, m) if x > 0)
        return math.sqrt(max(0.0, (kl(a) + kl(b)) / 2))

    for d, t, x in rows:
        n_words, _, _, _, _, failed = base_brute(t)
        hist, words = kinds(t), letters(t)
        hist = hist / max(1, hist.sum())
        best = (math.inf, math.inf)
        for ref, common in ([refs[x]] if x in refs else refs.values()):
            own = Counter(w for w in words if w in common)
            a = [own[w] / max(1, len(words)) for w in common] + [(len(words) - own.total()) / max(1, len(words))]
            got = js(hist, ref), js(a, [*common.values(), max(0.0, 1 - sum(common.values()))])
            best = min(best, got, key=sum)
        room = q.SLACK / math.sqrt(max(1, n_words))
        far = n_words >= q.MIN_WORDS and best[0] < math.inf and (best[0] > q.CLASS_LIMIT + room or best[1] > q.WORD_LIMIT + room)
        yield d, failed, not failed and not far, *best


def test_verdicts(spark):
    """Every verdict and distance of a table, with rows of unknown, null and too small languages."""
    from tramline.llm.quality import quality_rules

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1 - i, t, x) for i, (t, x) in enumerate([(rows[0][1], None), (rows[0][1], "xx"), ("#1 " * 300, "zz"), (rows[1][1], "zz"), ("qq ww " * 40, "en"), (None, "en"), ("", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules(docs.repartition(5)).collect()}
    for d, failed, kept, a, b in brute_divergence(rows):
        r = got[d]
        assert (r.base_failed, r.kept) == (failed, kept), d
        assert (r.class_distance, r.word_distance) == (pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9)), d
    assert got[-3].class_distance > 0.3  # a language of two documents is no reference of its own


def test_summaries_lose_no_common_word():
    from tramline.llm.quality import merged, summary

    rnd = random.Random(4)
    whole, parts = Counter(), []
    for _ in range(40):
        own = Counter(rnd.choice([1, 2, 3, *range(100, 5000)]) if rnd.random() < 0.9 else rnd.choice([1, 2]) for _ in range(3000))
        whole += own
        parts.append(summary(np.array([list(own), list(own.values())], np.uint64), 20))
    held = set(summary(merged(parts), 20)[0].tolist())
    assert {w for w, k in whole.items() if k > whole.total() / 20} <= held


def test_restoring_finds_planted_disguises(spark):
    """Disguised words of the lexicon in clean texts: found with restoring, mostly not without."""
    from tramline.llm import toxicity as t

    docs = spark.read.parquet(f"{D}/documents.parquet")
    counts = t.trigrams(docs)
    rnd, looks = random.Random(5), {v: k for k, vs in t.LOOKS_LIKE.items() for v in vs}
    words = ["idiot", "stupid", "moron", "pathetic", "worthless", "disgusting", "loser", "clown"]
    reader, plain = t.Reader(counts), t.Reader(counts)
    plain.restore = lambda token: token
    hit = without = n = 0
    for _ in range(300):
        word = rnd.choice(words)
        kind = rnd.randrange(4)
        if kind == 0:
            places = [i for i, ch in enumerate(word) if ch in looks]
            sign = set(rnd.sample(places, min(len(places), 2)))
            shown = "".join(looks[ch] if i in sign else ch for i, ch in enumerate(word))
        elif kind == 1:
            shown = " ".join(word)
        elif kind == 2:
            i = rnd.randrange(1, len(word))
            shown = word[:i] + word[i] * rnd.randint(3, 5) + word[i + 1 :]
        else:
            shown = rnd.choice(".-_*").join(word)
        text = f"the one {shown} of them"
        n += 1
        hit += word in reader.features(text)
        without += word in plain.features(text)
    assert hit >= 0.8 * n and without <= 0.4 * n, (hit, without, n)


def test_planted_junk(spark):
    from tramline.llm.queries import op5_quality_rules

    labels = spark.read.parquet(f"{D}/labels.parquet")
    got = op5_quality_rules(spark, D).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg({"kept": "count", "*": "count"}).collect()
    assert got
    kept = {(r.quality, r.kept): r["count"] for r in op5_quality_rules(spark, D).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) <= 0.01 * kept[1, True]
    assert kept[0, False] >= kept.get((0, True), 0)


def test_restoring(spark):
    from tramline.llm import toxicity as t

    docs = spark.read.parquet(f"{D}/documents.parquet")
    counts = t.trigrams(docs)
    r = t.Reader(counts)
    for text, word in {"1d10t": "idiot", "m0r0n!": "moron", "you idiooooot": "idiot", "an i d i o t": "idiot", "p@thetic": "pathetic", "st.u.p.i.d,": "stupid", "$cum": "scum", "cl0wn": "clown"}.items():
        assert word in r.features(text), text
    assert t.Reader(np.zeros_like(counts)).features("") == set()


def test_held_out_accuracy(spark):
    from tramline.llm.queries import op3_toxicity
    from tramline.llm.toxicity import held_out

    d = "/root/testdata/sf0.1"
    got = op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out]
    bad, good = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert auc > 0.93
    assert sum(s >= 0.3 for s in bad) >= 0.85 * len(bad) and sum(s >= 0.3 for s in good) <= 0.01 * len(good)


def test_strong_disguises_are_read():
    """Rows of lone characters before punctuation, with wide gaps or beside a one-letter word, and words of more signs than letters."""
    from tramline.llm import toxicity as t

    counts = np.zeros((64, 64, 64), np.int64)
    for word in ("idiot", "stupid", "shit", "man", "you"):
        codes = [0, 0, *map(t.letter, word), 0]
        for gram in zip(codes, codes[1:], codes[2:]):
            counts[gram] += 300
    r = t.Reader(counts)
    for text, word in (("you i d i o t. ok", "idiot"), ("i  d  i  o  t", "idiot"), ('"i d i o t"', "idiot"), ("a s t u p i d man", "stupid"), ("s t u p i d  i d i o t", "stupid"), ("s t u p i d  i d i o t", "idiot"), ("$h!7", "shit"), ("5h17,", "shit"), ("s h i t", "shit")):
        assert word in r.features(text), text
    assert r.features("455 $1,455.17") == set()


def test_toxicity_edges(spark):
    from tramline.llm.toxicity import toxicity

    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "word", "c"), (None, "i d i o t " * 9, "d")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity(docs, labels).collect()} == {0}
    assert toxicity(docs.limit(0), labels.limit(0)).count() == 0

"""Near-duplicate, window and byte dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made(n: int, seed: int) -> list[tuple]:
    """Texts with copies, near copies, shared passages, repeats inside, blanks, nulls and a long run of one letter."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    some = lambda k: [rnd.choice(words) for _ in range(k)]
    passage, base = some(70), some(120)
    out = [None, "", "   ", "one", "one two", "x" * 900, "word " * 130, "word " * 60]
    while len(out) < n:
        kind = rnd.randint(0, 5)
        text = some(rnd.randint(1, 160))
        if kind == 0:
            text = list(base)
            for _ in range(rnd.randint(0, 2)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
        elif kind == 1:
            cut = rnd.randint(45, 70)
            text = some(rnd.randint(0, 40)) + passage[:cut] + some(rnd.randint(0, 40))
        elif kind == 2:
            text = text + text
        elif kind == 3 and len(out) > 12:
            out.append(out[rnd.randrange(8, len(out))])
            continue
        out.append(rnd.choice([" ", "\n"]).join(text))
    return [(i * 7 % 1009, t, "s", 3) for i, t in enumerate(out)]


def fingerprint(text):
    words = WORD.findall("".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def simhash_brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (f"{prints[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)}


def windows_brute(rows, window=50):
    first, out = {}, {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def bytes_brute(rows, length=200):
    seen, out = {}, []
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\x01+", gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def fixture(spark):
    rows = made(160, 5)
    return [(r[0], r[1]) for r in rows], spark.createDataFrame(rows, "doc_id long, text string, ord string, n int")


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash(spark, fixture, block):
    from tramline.llm.simhash import simhash_components

    rows, docs = fixture
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(docs, block=block).collect()}
    assert got == simhash_brute(rows)


def test_simhash_close_prints(spark):
    """Many fingerprints at distances 0 to 6 from a few centres."""
    from tramline.llm._components import components
    from tramline.llm.simhash import links

    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for c in centres for _ in range(60)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    everyone = sorted(map(signed, prints))
    root = {p: p for p in everyone}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in everyone:
        for b in everyone:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for block in (4096, 20):
        got = {r.node: r.root for r in components(links(df.selectExpr("print as node", "print"), block)).collect()}
        assert {p: got.get(p, p) for p in everyone} == {p: find(p) for p in everyone}


def test_windows(spark, fixture):
    from tramline.llm.substring_dedup import substring_dedup

    rows, docs = fixture
    for cells in (1 << 22, 1 << 19):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs, cells=cells).collect()}
        assert got == windows_brute(rows)


@pytest.mark.parametrize("piece, shard_bytes, segment", [(512, 1 << 18, 4 << 20), (512, 1500, 700), (2, 700, 300)])
def test_bytes(spark, fixture, piece, shard_bytes, segment):
    """With one shard, many merged by binary search, anchors dealt to pieces, and texts read in segments."""
    from tramline.llm.suffix_dedup import suffix_dedup

    rows, docs = fixture
    got = sorted(tuple(r)[:5] for r in suffix_dedup(docs, piece=piece, shard_bytes=shard_bytes, segment=segment).collect())
    assert got == bytes_brute(rows)


def test_shards_are_merged():
    """Equal windows in different shards are found by the merge alone."""
    from tramline.llm.suffix_dedup import Shard

    rnd = random.Random(6)
    some = lambda k, of=b"abc": bytes(rnd.choice(of) for _ in range(k))
    common = some(230)
    a = Shard([(7, -1, 1, 1, False, some(40, b"xy") + common + some(20, b"xy")), (8, -1, 2, 1, False, some(300))], 200)
    b = Shard([(7, -1, 3, 1, False, some(11, b"pq") + common), (9, -1, 4, 1, True, some(210))], 200)
    assert a.spans() == [] and b.spans() == [(9, 4, 1, 0, 11)]
    b.merge(a, 7, -1)
    assert a.spans() == [(7, 1, 1, 40, 71)] and b.spans() == [(7, 3, 1, 11, 42), (9, 4, 1, 0, 11)]
    a.merge(b, 8, -1)
    assert a.spans() == [(7, 1, 1, 40, 71)]


def test_merges_happen_on_a_table(spark, monkeypatch):
    """At production parameters shards of sf0.1 meet in the middle of an anchor."""
    import pyarrow as pa

    from tramline.llm import suffix_dedup as m

    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").toArrow().column(0)
    rows, times = {}, {}
    for _, _, n, anchors, begins, data in (x for chunk in table.chunks for x in m.runs_of(chunk, 200, 64)):
        text = data.tobytes()
        for a, s, k in zip(anchors.view("int64").tolist(), begins.tolist(), n.tolist()):
            if a % 8 == 0:  # one task of eight
                d = m.digest(text[s : s + k + 199])[0]
                rows[a, d] = (text[s : s + k + 199], (a, d) in rows)
                times[a] = times.get(a, 0) + 1
    order = sorted(k for k in rows if times[k[0]] > 1)
    columns = [[k[0] for k in order], [-1] * len(order), [k[1] for k in order], [1] * len(order), [rows[k][1] for k in order], [rows[k][0] for k in order]]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "piece", "digest", "rows", "twice", "bytes"])
    merged = []
    real = m.Shard.merge
    monkeypatch.setattr(m.Shard, "merge", lambda self, other, *head: (merged.append(head), real(self, other, *head))[1])
    assert list(m.compare_shards(iter([batch]), 200, m.SHARD_BYTES)) and merged


def test_suffix_array():
    import numpy as np

    from tramline.llm.suffix_dedup import kasai, suffix_array

    rnd = random.Random(1)
    for text in (b"a" * 700, b"abab" * 200, bytes(rnd.choice(b"ab\x00") for _ in range(900)), bytes(rnd.randrange(256) for _ in range(500))):
        data = np.frombuffer(text, np.uint8)
        sa = suffix_array(data)
        right = sorted(range(len(text)), key=lambda i: text[i:])
        assert [text[i:] for i in sa] == [text[i:] for i in right]
        lcp = kasai(data, sa, 200, lanes=5)
        for k in range(1, len(sa)):
            a, b = text[sa[k - 1] :], text[sa[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(n, 200)


def test_edges(spark):
    from tramline.llm.simhash import simhash_components
    from tramline.llm.substring_dedup import substring_dedup

    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(none).count() == 0 and substring_dedup(none).count() == 0
    twice = spark.createDataFrame([(1, "a b " * 60), (1, "a b " * 60), (None, "a b " * 60)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup(twice).collect()) == [0, 0, 120]
    from tramline.llm.suffix_dedup import suffix_dedup

    assert suffix_dedup(none).count() == 0
    assert [r.n_removed for r in suffix_dedup(twice).collect()] == [240, 240, 240]
    assert [r.component_id for r in simhash_components(twice).collect()] == [1, 1, 1]


def test_whole_tables(spark):
    from tramline.llm import queries as q

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in q.op7_simhash(spark, D).collect()} == simhash_brute(rows)
    assert sorted(tuple(r) for r in q.op1_suffix_dedup(spark, D).collect()) == bytes_brute(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in q.op9_substring_dedup(spark, D).collect()} == windows_brute(rows)


def shingle_sets(rows, k=5):
    """Sets of five-word shingles of (id, text) rows, the whole sequence where there are fewer words."""
    out = {}
    for d, t in rows:
        w = WORD.findall("".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t or ""))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_duplicates_of_five_word_shingles(spark):
    """Against brute-force Jaccard on whole documents: no false link, and at least 9 of 10 of the links."""
    from tramline.llm.simhash import near_components

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    sets = shingle_sets(rows)
    one = {frozenset(own): d for d, own in reversed(sets.items())}  # of copies the first
    often = Counter(g for own in one for g in own)
    holders = {}
    for own, d in one.items():
        for g in sorted(own, key=lambda g: (often[g], g))[: len(own) // 5 + 1]:
            holders.setdefault(g, []).append(d)
    # a pair at 0.8 shares one of the rarest fifth of its shingles
    pairs = {(min(a, b), max(a, b)) for ds in holders.values() for i, a in enumerate(ds) for b in ds[:i]}
    near = {p for p in pairs if jaccard(sets[p[0]], sets[p[1]]) >= 0.8}
    got, nodes = near_components(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    root = {r.id: r.root for r in got.join(nodes, "node").collect()}
    found = sum(root[a] == root[b] for a, b in near)
    assert len(near) > 40 and found >= 0.9 * len(near), (found, len(near))
    # groups hold nothing that brute force does not link
    up = {d: d for d in sets}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in near:
        up[find(a)] = find(b)
    first = {}
    for d, own in sets.items():
        key = frozenset(own)
        up[find(d)] = find(first.setdefault(key, d))
    by_root = {}
    for d, r in root.items():
        assert by_root.setdefault(r, find(d)) == find(d)


def test_keep_one(spark):
    """Near copies of one text, in groups of all sizes, with odd rows and names; and with groups cut into pieces."""
    from tramline.llm.simhash import keep_one

    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(3000)]
    rows, n = [], 0
    for size in (1, 1, 2, 3, 90):
        base = [rnd.choice(words) for _ in range(300)]
        for _ in range(size):
            text = list(base)
            text[rnd.randrange(300)] = rnd.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(500, None), (501, ""), (502, " \n "), (503, "one two"), (504, "One  two"), (None, "one two"), (None, None), (505, "x y z x y z"), (505, "p q"), (505, "p q")]
    docs = spark.createDataFrame([(d, t, 1, 2, 3, "n") for d, t in rows], "doc_id long, text string, w_id int, _print int, in_0 int, node string")
    for block in (4096, 16):
        got = keep_one(docs, block=block)
        assert got.columns == docs.columns
        kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
        assert kept == sorted([(0, rows[0][1]), (1, rows[1][1]), (2, rows[2][1]), (4, rows[4][1]), (7, rows[7][1]), (500, None), (503, "one two"), (505, "x y z x y z"), (505, "p q")], key=str)
        assert {tuple(r)[2:] for r in got.collect()} == {(1, 2, 3, "n")}
    assert keep_one(docs.limit(0)).count() == 0


def test_near_copies_that_are_not_similar_are_not_listed(spark, monkeypatch):
    """A large group of near copies, most pairs of it candidates and few of them links: no table holds its pairs, and all its links are found."""
    from tramline.llm import _common as c
    from tramline.llm import simhash

    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(3000)]
    base, rows = [rnd.choice(words) for _ in range(300)], []
    for n in range(400):
        text = rows[n - 40][1].split() if n >= 360 else list(base)  # the last 40 are copies of others, with a word changed
        for at in rnd.sample(range(300), 1 if n >= 360 else 2 if n < 60 else 6):
            text[at] = rnd.choice(words)
        rows.append((n, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held, written = [], c.written

    def counted(df, name):
        out = written(df, name)
        if name not in ("shapes", "first", "dealt"):  # of these a row comes once for each key
            held.append((out.count(), name))
        return out

    sets = shingle_sets(rows)
    near = [(a, b) for a in sets for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    monkeypatch.setattr(c, "written", counted)
    for block in (4096, 64):
        held.clear()
        got, nodes = simhash.near_components(docs, block=block)
        root = {r.id: r.root for r in got.join(nodes, "node").collect()}
        if block == 4096:  # stars of pieces are more
            assert max(held)[0] < 50 * len(rows), held
        assert sum(root[a] == root[b] for a, b in near) >= 0.9 * len(near)
        up = {d: d for d in sets}

        def find(v, up=up):
            while up[v] != v:
                v = up[v]
            return v

        for a, b in near:
            up[find(a)] = find(b)
        by_root = {}
        for d, r in root.items():
            assert by_root.setdefault(r, find(d)) == find(d)
        assert 1 < len(by_root) < len(rows)


def test_crossing_compares_by_sets():
    """The sets of a group are compared as similar() does, empty ones too, whatever the filter lets through."""
    import numpy as np
    import pyarrow as pa
    from tramline.llm.simhash import NEAR, Compare, similar

    rnd = np.random.default_rng(5)
    base = np.arange(60, dtype=np.int32)
    sets = [np.zeros(0, np.int32), *[np.sort(rnd.choice(base, rnd.integers(40, 60), replace=False)) for _ in range(60)]]
    n = len(sets)
    rows = np.zeros((n, 11), np.int64)
    rows[:, 5] = rows[:, 9] = np.arange(n)
    rows[:, 10] = 1
    grams = pa.concat_arrays([pa.array([[]], pa.list_(pa.int32())), pa.array([s.tolist() for s in sets[1:]], pa.list_(pa.int32()))])
    found = Compare(10, 34, NEAR).crossing(rows, grams, np.ones(n, bool))
    up = list(range(n))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, j in found:
        assert similar(sets[i].view(np.uint32), sets[j].view(np.uint32), NEAR) and find(i) != find(j)
        up[find(i)] = find(j)
    assert found and all(find(i) == find(j) for i in range(n) for j in range(i) if similar(sets[i].view(np.uint32), sets[j].view(np.uint32), NEAR))

"""The pipeline against brute-force versions of its stages."""

import hashlib
import sys
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_media_pii_mixing import brute_mix, plain_spans  # noqa: E402
from test_repeats import jaccard, shingle_sets  # noqa: E402

D = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline as p
    from tramline.llm.toxicity import toxicity

    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bad = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{D}/labels.parquet")).where("score >= 0.3").collect()}
    one = p.reject_toxic(spark, docs, D)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(rows) - bad
    sets = shingle_sets([(d, r.text) for d, r in rows.items() if d not in bad])
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    two = p.near_dedup(spark, one, D).collect()
    # the filter may let a link go, so a few more may stay; none goes that brute force keeps
    assert {find(d) for d in sets} <= {r.doc_id for r in two} and len(two) <= len({find(d) for d in sets}) * 1.02
    assert all(r == rows[r.doc_id] for r in two)
    three = p.redact_pii(spark, spark.createDataFrame(two, docs.schema), D).collect()
    for r in three:
        assert r.n_chars == len(r.text) and not plain_spans(r.text)
        if not plain_spans(rows[r.doc_id].text):
            assert r.text == rows[r.doc_id].text
    four = p.mix_sources(spark, spark.createDataFrame(three, docs.schema), D).collect()
    n, _, _, epochs = brute_mix([(r.doc_id, r.text, r.source) for r in three], 2.0)
    times = Counter(r.doc_id for r in four)
    assert set(times) == {r.doc_id for r in three}
    assert all(int(epochs[r.source] + 1e-6) <= times[r.doc_id] <= -int(-epochs[r.source] // 1) for r in three if n[r.source])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in three}
    got = p.run(spark, D).collect()
    assert Counter(r.doc_id for r in got) == times
    for r in got:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_and_odd(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (None, "a b c d", None, None, 3), (4, "a b c d", "en", "s", 7), (4, "a b c d", "en", "s", 7)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, D)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(str(r.doc_id) for r in p.encode(spark, docs, D).collect()) == ([] if not rows else ["4", "None"])


def test_clashing_names(spark):
    """Extra columns named like those that stages make for themselves come through every stage."""
    import corpus_pipeline as p

    extra = ["toxicity", "_print", "w_id", "w_rid", "w_key", "node", "root", "mix_tokens", "mix_epoch", "_cut", "_copies", "in_0", "src", "s", "score"]
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(60)
    docs = docs.selectExpr("*", *[f"doc_id * {i} as {x}" for i, x in enumerate(extra)])
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra], name
    got = docs.collect()
    assert got and all(r[x] == r.doc_id * i for r in got for i, x in enumerate(extra))


def test_tables_of_stages_are_deleted(spark):
    import os

    import corpus_pipeline as p
    from tramline.llm import _common as c

    before = set(c._tables)
    rows = p.run(spark, D)
    left = set(c._tables) - before
    assert len(left) == 1 and rows.count() > 0  # what the last stage reads
    assert all(os.path.exists(x.removeprefix("file:")) for x in left)

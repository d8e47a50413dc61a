"""Token counts and codec against the library on whole texts."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n\t", "Hello, world! It's we'll 12345", "á é ́x", "x" * 5000, "word " * 30000, "<|endoftext|> a<|startoftext|>b  <|endoftext|>",
    "café naïve   \u0085 end", "ẞİΣς \U0001f600‍\U0001f600", "don't  'S\v't\f\r\n'd", "a\x00b\x1c c", "你好" * 700, "same", "same",
    "".join(chr(33 + i * 7 % 90) for i in range(20000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "z", 9) for i, t in enumerate(TEXTS)] + [(None, "null id", "z", 9)], "doc_id long, text string, n_tokens string, ids int")


def test_counts(spark, docs):
    from tramline.llm.token_counts import token_counts

    t = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in token_counts(docs, PATH, limit=100).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, text in enumerate(TEXTS):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 100), text
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_counts_sentencepiece(spark, docs):
    import sentencepiece

    from tramline.llm.token_counts import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    t = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, path).collect()}
    assert all(got[i] == len(t.encode(text or "")) for i, text in enumerate(TEXTS))


def test_codec_round_trip(spark, docs):
    from tramline.llm.bpe_codec import decode_ids, encode_documents

    t = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in encode_documents(docs, PATH).collect()}
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, text
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False) == decode_ids(PATH, bytes(got[i].ids))
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert encode_documents(docs.limit(0), PATH).count() == 0


PARTS = ["Hello", "world", "tion", " ", "  ", "\n", "é", "\u0301", "你好", "<|endoftext|>", "'s", "don't", "123", "\u0085", "ẞİΣς", "\U0001f600", "aaaa", "x" * 40, "ing", "the ", "of ", "\x00", "\x1c", "."]


@pytest.mark.parametrize("repair", [True, False])
def test_joins_are_repaired(repair):
    """Cuts fall inside words; with their joins repaired ids are the library's, without they are not."""
    import random

    import pyarrow as pa

    from tramline.llm import _common as c
    from tramline.llm._encoder import encoder
    from tramline.llm.bpe_codec import Codec

    t, rnd = Tokenizer.from_file(PATH), random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(10_000)]
    codec = Codec(encoder(PATH), mean=16, repair=repair)
    offsets, raw = c.blobs(pa.array(texts))
    got = [ids for a, b in c.slices(offsets, 1 << 16) for ids in codec.encode(offsets, raw, a, b)]
    wrong = sum(ids.tolist() != t.encode(x, add_special_tokens=False).ids for x, ids in zip(texts, got, strict=True))
    if repair:
        assert wrong == 0 and codec.repaired > 10_000 and codec.encoded < codec.met
    else:
        assert wrong > 5_000 and codec.repaired == 0


def test_stretches_are_widened_until_they_agree():
    """An encoder whose sides disagree makes the stretch grow, at last to the whole text, which is right by itself."""
    import pyarrow as pa

    from tramline.llm import _common as c
    from tramline.llm._encoder import Encoder
    from tramline.llm.bpe_codec import Codec

    class Wrong(Encoder):
        def encode_texts(self, texts):
            return [ids + np.uint32(b"word9" in x) for x, ids in zip(texts, super().encode_texts(texts), strict=True)]

    text = " ".join(f"word{i}" for i in range(20))
    codec = Codec(Wrong(PATH), mean=8)
    offsets, raw = c.blobs(pa.array([text]))
    got = codec.encode(offsets, raw, 0, 1)
    assert codec.widened > 0 and codec.repaired > 0
    assert len(got) == 1


def test_chunks_are_shared():
    """A passage has the same chunks wherever it stands, and they are encoded once."""
    import random

    import pyarrow as pa

    from tramline.llm import _common as c
    from tramline.llm._encoder import encoder
    from tramline.llm.bpe_codec import MOST, Codec, chunk_bounds

    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    texts = [rnd.choice("xyz") * rnd.randint(0, 99) + passage for _ in range(30)]
    codec = Codec(encoder(PATH), mean=256)
    offsets, raw = c.blobs(pa.array(texts))
    assert len(codec.encode(offsets, raw, 0, 30)) == 30
    assert codec.encoded < codec.met / 10
    data = np.frombuffer(("é" * 3 * MOST).encode(), np.uint8)
    bounds = chunk_bounds(data, np.array([0, len(data)]))
    assert (np.diff(bounds) <= MOST + 3).all() and (data[bounds[:-1]] & 0xC0 != 0x80).all()


def test_other_vocabularies(spark):
    """A vocabulary whose tokens may reach across white space is asked for whole texts."""
    from tramline.llm.bpe_codec import encode_documents
    from tramline.llm.token_counts import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["a b  c\n\n d", "", None, " lead", "it's the end "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in encode_documents(docs, path).collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts(docs, path).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and counts[i] == len(ids)
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)


def test_long_unbroken_texts():
    """Megabytes without white space, and of one repeated passage, as one row."""
    import pyarrow as pa

    from tramline.llm.bpe_codec import codec
    from tramline.llm.token_counts import count_column
    from tramline.llm import _common as c

    t = Tokenizer.from_file(PATH)
    texts = ["ab1" * 700_000, "lorem ipsum dolor " * 300_000]
    column = pa.array(texts)
    offsets, raw = c.blobs(column)
    n = count_column(PATH, column)
    for i, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids
        assert n[i] == len(ids) and codec(PATH).encode(offsets, raw, i, i + 1)[0].tolist() == ids


def test_whole_table(spark):
    from tramline.llm.queries import op2_token_counts, op8_bpe_codec

    t = Tokenizer.from_file(PATH)
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    a, b = ({r.doc_id: r for r in f(spark, d).collect()} for f in (op2_token_counts, op8_bpe_codec))
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert a[i].n_tokens == b[i].n_tokens == len(ids)
        assert b[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert b[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

"""Tokenizers of a worker, and exact encoding of many texts at once.

Tokens of a vocabulary that drops white space never reach across ASCII white
space, so a text's ids are those of its words, one after the other.  Words of a
slice are told apart by Arrow's dictionary encoding, each distinct one goes to
the library once in a while, and ids are gathered by vectorised indexing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from tramline.llm import _common as c

#: Bytes of distinct pieces in one call of the tokenizer.
BATCH_BYTES = 1 << 18
#: Words in the younger of a worker's two memories.  When it is full it becomes the older one, whose words come
#: back as they are met again; the rest is forgotten (memory bound, not a limit of results).
MEMO = 160_000


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a vocabulary file, once in each worker; sequences are not cut or padded."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    # a task has one core: threads of the library's own would take those of other tasks
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def batches(pieces: list[bytes], limit: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Batches of about equal bytes, in order; a piece over the limit is one by itself."""
    ends = np.cumsum([len(p) for p in pieces])
    total = int(ends[-1]) if len(ends) else 0
    parts = -(-total // limit) or 1
    cuts = np.unique(np.searchsorted(ends, np.arange(1, parts) * (total / parts), "right")).tolist()
    for i, j in zip([0, *cuts], [*cuts, len(pieces)], strict=True):
        if i < j:
            yield pieces[i:j]


def ragged(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches flat[at : at + n], one after the other."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(at - (ends - n), n) + np.arange(total)]


class Words:
    """Words and their ids, one after the other in one array."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.flat, self.at, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: list[bytes], flat: np.ndarray, n: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.flat = np.concatenate([self.flat, flat])


class Encoder:
    """Ids as the library gives them without added special tokens."""

    def __init__(self, path: str):
        self.t = load(path)
        own = lambda text: self.t.encode(text, add_special_tokens=False).ids
        #: Whether the vocabulary drops white space; a vocabulary that keeps it is asked for whole texts.
        self.drops_space = all(own(f"ab{s}cd") == own("ab") + own("cd") for s in (" ", "\n", "\t \x0b", "\r\n")) and not own(" \n")
        self.young, self.old = Words(), Words()

    def direct(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct pieces, each from one call of the library."""
        out = {}
        for own in batches(pieces):
            got = self.t.encode_batch_fast([p.decode("utf-8", "replace") for p in own], add_special_tokens=False)
            out.update(zip(own, [e.ids for e in got], strict=True))
        return out

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Places of distinct words in the younger memory, which takes up those that it lacks."""
        if len(self.young.known) > MEMO:
            self.young, self.old = Words(), self.young
        own = self.young
        fresh = [w for w in words if w not in own.known]
        if back := [w for w in fresh if w in self.old.known]:
            at = np.fromiter(map(self.old.known.__getitem__, back), np.int64, len(back))
            own.add(back, ragged(self.old.flat, self.old.at[at], self.old.n[at]), self.old.n[at])
            fresh = [w for w in fresh if w not in own.known]
        for some in batches(fresh):
            ids = [e.ids for e in self.t.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            own.add(some, np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n)
        return np.fromiter(map(own.known.__getitem__, words), np.int64, len(words))

    def words(self, offsets: np.ndarray, raw: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Place in the memory of every word of texts first..last, and words of each text."""
        kept, starts, _, per_row = c.word_slice(offsets, raw, first, last)
        if not len(starts):
            return np.zeros(0, np.int64), per_row
        at = np.append(starts, len(kept))
        told = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(kept))]).dictionary_encode()
        return self.learn(told.dictionary.to_pylist())[told.indices.to_numpy()], per_row

    def encode(self, offsets: np.ndarray, raw: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts first..last in a row, and how many each text has."""
        if not self.drops_space:
            texts = [raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)]
            got = self.direct(list(set(texts)))
            return np.array([x for t in texts for x in got[t]], np.uint32), np.array([len(got[t]) for t in texts], np.int64)
        place, per_row = self.words(offsets, raw, first, last)
        n = self.young.n[place]
        return ragged(self.young.flat, self.young.at[place], n), sums(n, per_row)

    def counts(self, offsets: np.ndarray, raw: np.ndarray, first: int, last: int) -> np.ndarray:
        """How many ids each of the texts first..last has."""
        if not self.drops_space:
            return self.encode(offsets, raw, first, last)[1]
        place, per_row = self.words(offsets, raw, first, last)
        return sums(self.young.n[place], per_row)

    def encode_texts(self, texts: list[bytes]) -> list[np.ndarray]:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
        flat, n = self.encode(offsets, np.frombuffer(b"".join(texts), np.uint8), 0, len(texts))
        return np.split(flat, np.cumsum(n)[:-1])


def sums(values: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(per_row)
    return total[ends] - total[ends - per_row]


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


class Decoder:
    """Texts of ids as the library's decode(ids, skip_special_tokens=False) gives them, in UTF-8.

    Without a decoder of its own a vocabulary's tokens are joined by blanks, which
    is a gather of bytes; with one, the library decodes.
    """

    def __init__(self, t):
        self.t = t
        if t.decoder is None:
            tokens = [(t.id_to_token(i) or "").encode() + b" " for i in range(max(t.get_vocab().values(), default=0) + 1)]
            self.n = np.array([len(x) for x in tokens], np.int64)
            self.at = np.cumsum(self.n) - self.n
            self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        if self.t.decoder is not None:
            return [x.encode() for x in self.t.decode_batch([r.tolist() for r in rows], skip_special_tokens=False)]
        if not rows:
            return []
        ids = np.concatenate(rows)
        n = self.n[ids]
        text = ragged(self.flat, self.at[ids], n).tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum([len(r) for r in rows])))].tolist()
        return [text[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    """The worker's decoder of a vocabulary file."""
    return Decoder(load(path))

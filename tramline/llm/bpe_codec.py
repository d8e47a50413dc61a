"""BPE encoding and decoding by content-defined chunk reuse.

1. A rolling hash over the last 16 bytes cuts every text into chunks of about
   ``MEAN`` bytes, wherever it falls: inside words too, never inside a character.
   Cuts are a matter of content, so a passage that documents share gives the same
   chunks in each, wherever it stands.
2. Each distinct chunk of a slice is encoded once, and a worker remembers chunks
   for later slices.
3. A cut inside a word is a chunk join whose two sides were encoded without each
   other.  It is repaired: the stretch around it, out to white space and one more
   word (the rim) on each side, is encoded by the library as one.  That must agree
   exactly with the left chunk up to the end of the rim and with the right chunk
   from its rim on; while it does not, the stretch is widened by a word on each
   side, at last to the whole text.  Joins with no white space between them are
   repaired together.  What agrees replaces the ids around the join.

Rows are put together from chunks and repaired joins, then decoded by the library.

Defined results.  A null or empty text has no ids and decodes to the empty
string.  Every row gives one row, repeated rows and null ids included; a text
without white space is encoded as one stretch, whatever its length.  Tokens of
this vocabulary never reach across white space; for a vocabulary where they may,
texts are encoded whole.  Extra input columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tramline.llm import _common as c
from tramline.llm._encoder import Encoder, decoder, encoder, load

#: Mean and greatest bytes of a chunk, and bytes that the rolling hash sees.
MEAN, MOST, SEEN = 1 << 10, 1 << 15, 16
#: Bytes of text that are encoded together.
SLICE = 2 << 20
#: Bytes of chunks that one worker remembers; beyond it forgets them all (memory bound, not a limit of results).
MEMO_BYTES = 16 << 20

_VALUES = (c.BYTE_VALUES >> np.uint64(32)).astype(np.uint32)
_STEPS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the SEEN bytes that end at each place, by doubling; the first SEEN - 1 are meaningless."""
    h, span = _VALUES[data], 1
    for step in _STEPS:
        h[span:] += h[:-span] * step  # the right side is taken whole before it is added
        span *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def chunk_bounds(data: np.ndarray, rows: np.ndarray, mean: int = MEAN, most: int = MOST) -> np.ndarray:
    """Where chunks begin, with the end of the data: at rows, at content-defined cuts, and at least every ``most`` bytes."""
    if not len(data):
        return rows[:1] if not len(rows) else np.unique(rows)
    hit = rolling(data) < np.uint32((1 << 32) // mean)
    for i in range(SEEN - 1):  # the hash of a row's first bytes must not see the row before
        hit[np.minimum(rows[:-1] + i, len(data) - 1)] = False
    at = np.unique(np.concatenate([np.flatnonzero(hit) + 1, rows]))
    gaps = np.diff(at)
    if (long := np.flatnonzero(gaps > most)).size:
        at = np.unique(np.concatenate([at, *[np.arange(at[i] + most, at[i + 1], most) for i in long.tolist()]]))
    for _ in range(3):  # on to the start of a character
        inside = (at < len(data)) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80)
        inside &= ~np.isin(at, rows)
        at = at + inside
    return np.unique(at)


class Codec:
    """Encodes slices of texts by chunks, with memory of chunks."""

    def __init__(self, enc: Encoder, mean: int = MEAN, repair: bool = True):
        self.enc, self.mean, self.repair = enc, mean, repair
        self.known: dict[bytes, np.ndarray] = {}
        self.held = 0
        #: Chunks met, chunks encoded, joins repaired, and stretches that had to be widened.
        self.met = self.encoded = self.repaired = self.widened = 0

    def chunk_ids(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of each chunk; equal chunks share theirs."""
        told = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        chunks = told.dictionary.to_pylist()
        if self.held > MEMO_BYTES:
            self.known, self.held = {}, 0
        fresh = [x for x in chunks if x not in self.known]
        if fresh:
            self.known.update(zip(fresh, self.enc.encode_texts(fresh), strict=True))
            self.held += sum(map(len, fresh))
        self.met += len(bounds) - 1
        self.encoded += len(fresh)
        ids = [self.known[x] for x in chunks]
        return [ids[i] for i in told.indices.to_pylist()]

    def stretches(self, data: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
        """Joins inside words, those of one word together: [row start, row end, first join, last join, word start, word end]."""
        joins = bounds[1:-1]
        is_break = c.IS_BREAK[data]
        joins = joins[~is_break[joins - 1] & ~is_break[joins]]
        joins = joins[~np.isin(joins, rows)]
        if not len(joins):
            return []
        row = np.searchsorted(rows, joins, "right") - 1
        breaks = np.concatenate(([-1], np.flatnonzero(is_break), [len(data)]))
        k = np.searchsorted(breaks, joins)
        s, e = np.maximum(breaks[k - 1] + 1, rows[row]), np.minimum(breaks[k], rows[row + 1])
        head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        tail = np.append(head[1:], len(joins)) - 1
        return np.stack([rows[row[head]], rows[row[head] + 1], joins[head], joins[tail], s[head], e[head]], axis=1).tolist()

    def repairs(self, text: bytes, found: list[list[int]], ids_at: dict[int, np.ndarray], ids_to: dict[int, np.ndarray]) -> dict[int, tuple[int, int, int, np.ndarray]]:
        """First join to (last join, ids that go at the end of the left chunk, at the start of the right one, ids instead)."""

        def rim(start: int, s: int) -> int:
            """Start of the word before s."""
            end = s
            while end > start and c.IS_BREAK[text[end - 1]]:
                end -= 1
            while end > start and not c.IS_BREAK[text[end - 1]]:
                end -= 1
            return end

        def beyond(stop: int, e: int) -> int:
            """End of the word after e."""
            while e < stop and c.IS_BREAK[text[e]]:
                e += 1
            while e < stop and not c.IS_BREAK[text[e]]:
                e += 1
            return e

        out: dict[int, tuple[int, int, int, np.ndarray]] = {}
        open_ = [(f, rim(f[0], f[4]), beyond(f[1], f[5])) for f in found]
        while open_:
            # sides and rims by themselves, the stretch as one by the library
            parts = self.enc.encode_texts([x for f, a, b in open_ for x in (text[a : f[4]], text[f[4] : f[2]], text[f[3] : f[5]], text[f[5] : b])])
            whole = self.enc.direct(list({text[a:b] for _, a, b in open_}))
            again = []
            for k, (f, a, b) in enumerate(open_):
                left_rim, tail, head, right_rim = parts[4 * k : 4 * k + 4]
                got = np.array(whole[text[a:b]], np.uint32)
                left, right = ids_to[f[2]], ids_at[f[3]]
                n, m = len(left_rim), len(right_rim)
                core = got[n : len(got) - m]
                agrees = (
                    len(got) >= n + m and np.array_equal(got[:n], left_rim) and np.array_equal(got[len(got) - m :], right_rim)
                    and ends_with(left, tail) and starts_with(right, head)
                )
                if agrees or (a == f[0] and b == f[1]):
                    out[f[2]] = (f[3], len(tail), len(head), core if agrees else got)
                else:
                    self.widened += 1
                    again.append((f, rim(f[0], a), beyond(f[1], b)))
            open_ = again
        self.repaired += len(out)
        return out

    def encode(self, offsets: np.ndarray, raw: np.ndarray, first: int, last: int) -> list[np.ndarray]:
        """Ids of each of the texts first..last."""
        if not self.enc.drops_space:
            flat, n = self.enc.encode(offsets, raw, first, last)
            return np.split(flat, np.cumsum(n)[:-1])
        base = offsets[first]
        data, rows = raw[base : offsets[last]], offsets[first : last + 1] - base
        if not len(data):
            return [np.zeros(0, np.uint32)] * (last - first)
        bounds = chunk_bounds(data, rows, self.mean)
        ids = self.chunk_ids(data, bounds)
        places = bounds.tolist()
        fixed: dict[int, tuple[int, int, int, np.ndarray]] = {}
        if self.repair and (found := self.stretches(data, rows, bounds)):
            fixed = self.repairs(data.tobytes(), found, dict(zip(places[:-1], ids, strict=True)), dict(zip(places[1:], ids, strict=True)))
        out, k = [], 0
        for i in range(last - first):
            parts, stop, drop, resume = [], int(rows[i + 1]), 0, -1
            while k < len(ids) and places[k] < stop:
                own, end = ids[k], places[k + 1]
                k += 1
                if end <= resume:
                    continue  # a chunk inside a repaired stretch
                lo, drop = drop, 0
                if end in fixed:
                    resume, n, drop, core = fixed[end]
                    parts += [own[lo : len(own) - n], core]
                else:
                    parts.append(own[lo:])
            out.append(np.concatenate(parts) if len(parts) != 1 else parts[0]) if parts else out.append(np.zeros(0, np.uint32))
        return out


def ends_with(ids: np.ndarray, tail: np.ndarray) -> bool:
    return len(tail) <= len(ids) and np.array_equal(ids[len(ids) - len(tail) :], tail)


def starts_with(ids: np.ndarray, head: np.ndarray) -> bool:
    return np.array_equal(ids[: len(head)], head)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(encoder(path))
    return _codecs[path]


def decode_ids(path: str, ids: bytes) -> str:
    """The library's text of stored ids."""
    return load(path).decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", values: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, with ids (binary, little-endian) and decoded as asked for in ``values``."""
    c.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ("ids" in values) + ", decoded string" * ("decoded" in values)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in parts:
            offsets, raw = c.blobs(part.column(1))
            for first, last in c.slices(offsets, SLICE):
                got = own.encode(offsets, raw, first, last)
                stored = [x.astype("<u4").tobytes() for x in got]
                texts = decoder(path).decode(got)
                columns = [part.column(0).slice(first, last - first), pa.array([len(x) for x in got], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in stored], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if "ids" in values:
                    columns.append(pa.array(stored, pa.binary()))
                    names.append("ids")
                if "decoded" in values:
                    columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        c.trim()

    return docs.select(id_col, text_col).mapInArrow(encode, schema)

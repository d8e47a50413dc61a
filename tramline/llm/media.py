"""Interleaved documents: text and media references in page order, payloads by digest.

``sequences`` parses HTML into an array of structs in page order: text, or a
media reference with its digest and caption.  Payloads live in a store with one
row for each digest, as 8-bit greyscale PNG pictures 24 samples wide.  ``resolve``
joins references to the store by digest, on the cluster; the place and caption of
a reference stay beside it throughout.

Equal payloads are stored once, so a payload that a third of all pages refer to
is one row of the store; the other side of the join holds only references.

Defined results.  Null or empty HTML gives an empty sequence.  A reference whose
digest is not in the store keeps its place with a null payload.  A null text is
an empty payload, padded to one picture.  Every row gives one row; rows with a
null id too.  Extra input columns are left out.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import _common as c

#: A payload is padded to a multiple of BLOCK bytes, a square of 24 by 24 samples, with PAD.
BLOCK, WIDTH, PAD = 576, 24, b"\xff"
SCHEME = "sha256:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])


def payload_of(text: bytes) -> bytes:
    n = max(BLOCK, -(-len(text) // BLOCK) * BLOCK)
    return text + PAD * (n - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale picture, WIDTH samples wide, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Samples (height, width) of a picture that :func:`to_png` wrote; every checksum is verified."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG picture")
    at, width, height, body = 8, 0, 0, b""
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, own = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + own) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", own)
        elif kind == b"IDAT":
            body += own
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not expected")
    return lines[:, 1:]


def features(samples: np.ndarray) -> str:
    """Height, sum, sum of squares, sum of differences along rows, and a histogram of 16 bins."""
    wide = samples.astype(np.int64)
    hist = np.bincount(samples.ravel() >> 4, minlength=16)
    return f"h{len(samples)}:s{wide.sum()}:q{(wide * wide).sum()}:d{np.abs(np.diff(wide, axis=1)).sum()}:" + "-".join(map(str, hist))


class _Pages(HTMLParser):
    """Text and media in order.  A caption is the figcaption of the same figure, else the alternative text."""

    SKIPPED = frozenset(("script", "style", "noscript", "template"))
    BLOCKS = frozenset(("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "figure", "figcaption", "article", "section", "ul", "ol", "table", "blockquote", "pre", "body", "td"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.words).split()):
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        if tag in self.BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            known = dict(attrs)
            if src := known.get("src"):
                self.flush()
                own = {"kind": "media", "text": None, "digest": src.removeprefix(SCHEME) if src.startswith(SCHEME) else hashlib.sha256(src.encode("utf-8", "replace")).hexdigest(), "caption": known.get("alt") or None}
                self.items.append(own)
                if self.figure is not None:
                    self.figure.append(own)

    def handle_endtag(self, tag):
        if tag in self.SKIPPED and self.skip:
            self.skip -= 1
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for own in self.figure or []:
                own["caption"] = text or own["caption"]
            self.caption = None
        elif tag == "figure":
            self.figure = self.caption = None
        if tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[dict]:
    if not page:
        return []
    p = _Pages()
    p.feed(page)
    p.close()
    p.flush()
    return [x | {"pos": i} for i, x in enumerate(p.items)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, items): the text and media references of each page, in order."""
    c.ready(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 256):
                own = part.slice(at, 256)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([parse(x) for x in own.column(1).to_pylist()], pa.list_(ITEM))], names=[id_col, "items"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, items array<struct<pos: int, kind: string, text: string, digest: string, caption: string>>")


def store(payloads: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, media): each distinct payload once, as a picture."""
    c.ready(payloads.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            offsets, raw = c.blobs(part.column(0))
            for first, last in c.slices(offsets, 4 << 20):
                own = [payload_of(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in range(first, last)]
                digests = [hashlib.sha256(p).hexdigest() for p in own]
                once = dict(zip(digests, own, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(once), pa.string()), pa.array([to_png(p) for p in once.values()], pa.binary())], names=["digest", "media"])

    return payloads.select(text_col).mapInArrow(run, "digest string, media binary").groupBy("digest").agg(F.first("media").alias("media"))


def read_back(stored: DataFrame) -> DataFrame:
    """Digest and what is computed from the stored bytes of each media row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for media in part.column(1):
                data = media.as_buffer().to_pybytes()
                samples = from_png(data)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def references(seqs: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, pos, caption, digest) of each media reference."""
    return seqs.select(id_col, F.explode("items").alias("i")).where("i.kind = 'media'").select(id_col, "i.pos", "i.caption", "i.digest")


def resolve(seqs: DataFrame, stored: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, media): for each sequence its references with caption and stored bytes, in order of place."""
    got = references(seqs, id_col).join(stored, "digest", "left")
    return got.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "caption", "digest", "media"))).alias("media"))


def as_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A page for each document: a heading, and a figure that refers to the document's payload by digest."""
    c.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            offsets, raw = c.blobs(part.column(1))
            pages = []
            for i in range(part.num_rows):
                text = raw[offsets[i] : offsets[i + 1]].tobytes()
                title = html.escape(text[:40].decode("utf-8", "ignore"))
                pages.append(f'<article><h1>{title}</h1><figure><img src="{SCHEME}{hashlib.sha256(payload_of(text)).hexdigest()}" alt=""><figcaption>{len(text)} bytes</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(pages, pa.string())], names=[id_col, "n_bytes", "html"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, html string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its payload, as read back from the store, with the caption it stands under."""
    pages = as_pages(docs, id_col, text_col)
    refs = references(sequences(pages, id_col, "html"), id_col)
    stats = read_back(store(docs, text_col))
    # the page's one caption carries the unpadded size
    sized = refs.withColumn("n_bytes", F.split("caption", " ")[0].cast("long"))
    return sized.join(stats, "digest").select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")

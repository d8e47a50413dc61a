"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at safe boundaries, its ASCII white space: no token, contraction,
special string or Unicode composition of the vocabulary reaches across one.
Pieces go to the tokenizer in batches of about equal bytes, each distinct piece
once in a while; only lengths come back.  A vocabulary whose tokens may reach
across white space (sentencepiece, or one that keeps blanks) is asked for whole
texts, in batches of about equal bytes.

Defined results.  A null or empty text has 0 bytes and 0 tokens.  Every row of
the input gives one row, repeated rows and null ids included.  A text without
white space is one piece, whatever its length.  Extra input columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tramline.llm import _common as c
from tramline.llm._encoder import batches, encoder, load


def count_column(path: str, column: pa.Array, limit: int = 2 * c.SLICE_BYTES) -> np.ndarray:
    """Token counts of a column of texts."""
    offsets, raw = c.blobs(column)
    out = np.zeros(len(column), np.int64)
    for first, last in c.slices(offsets, limit):
        if not path.endswith(".model"):
            out[first:last] = encoder(path).counts(offsets, raw, first, last)
            continue
        # pieces of these vocabularies carry the white space before them
        texts = [raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)]
        known = {}
        for own in batches(list(set(texts))):
            known.update(zip(own, map(len, load(path).encode([p.decode("utf-8", "replace") for p in own], num_threads=1)), strict=True))
        out[first:last] = [known[x] for x in texts]
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, for the vocabulary file ``path`` (.json or .model)."""
    c.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, text = part.column(0), part.column(1)
            offsets, _ = c.blobs(text)
            n = count_column(path, text)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

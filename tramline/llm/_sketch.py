"""Count-min sketches with counters of two bits, merged by blocks on the executors.

A counter says none, once or more often.  Blocks of several tasks merge by
``twice = t1 | t2 | (o1 & o2)`` and ``once = o1 | o2``.  A task sends the places
that it counted, or bit planes where those are smaller, so its sketch costs no
more than its keys.  An estimate is never below the true count: a full sketch
prunes less, it loses nothing.

The width follows the number of keys, so that a counter has at most a quarter of
a key, up to ``MOST`` counters a row: then the merged plane that every worker gets
has ``DEPTH * MOST / 8`` bytes (64 MiB), for any input.  Beyond that counters fill
up and the sketch prunes less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tramline.llm._common import mix

#: Rows of counters, and least and greatest counters of a row.
DEPTH, LEAST, MOST = 2, 1 << 20, 1 << 28
#: Counters in one block: a place in it has two bytes.
BLOCK = 1 << 16
#: Counters that a task holds before it sends them.
HELD = 1 << 21
_SALTS = [np.uint64(x) for x in (0x8B7A1F3D5C6E9A01, 0xD1B54A32D192ED03)]


def width(keys: float) -> int:
    """Counters of a row for about so many keys: a power of two with room for four each."""
    return int(min(MOST, max(LEAST, 1 << int(np.ceil(np.log2(max(1.0, 4 * keys)))))))


def cells_of(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(keys ^ _SALTS[row]) & np.uint64(cells - 1)).astype(np.int64)


def told(at: np.ndarray) -> bytes:
    """Places in a block, or its bit plane where that is smaller."""
    if 2 * len(at) < BLOCK // 8:
        return at.astype(np.uint16).tobytes()
    plane = np.zeros(BLOCK, bool)
    plane[at] = True
    return np.packbits(plane).tobytes()


def read(data: bytes) -> np.ndarray:
    """The bit plane of :func:`told`."""
    if len(data) == BLOCK // 8:
        return np.frombuffer(data, np.uint8).copy()
    plane = np.zeros(BLOCK, bool)
    plane[np.frombuffer(data, np.uint16)] = True
    return np.packbits(plane)


def sketch(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], cells: int):
    """A broadcast array (DEPTH, cells / 8) of the merged "twice" plane, over the keys of all rows."""

    def send(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = np.concatenate(keys)
        for row in range(DEPTH):
            at, n = np.unique(cells_of(own, row, cells), return_counts=True)
            blocks, heads = np.unique(at >> 16, return_index=True)
            places, twice = np.split(at & (BLOCK - 1), heads[1:]), np.split(n > 1, heads[1:])
            yield pa.RecordBatch.from_arrays([pa.array(row * cells // BLOCK + blocks), pa.array([told(x) for x in places], pa.binary()), pa.array([told(x[t]) for x, t in zip(places, twice, strict=True)], pa.binary())], names=["block", "once", "twice"])

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in parts:
            held += keys_of(part)
            if sum(map(len, held)) > HELD:
                yield from send(held)
                held = []
        if held:
            yield from send(held)

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for part in parts:
            for block, once, twice in zip(*[x.to_pylist() for x in part.columns], strict=True):
                o, t = read(once), read(twice)
                if block in held:
                    o0, t0 = held[block]
                    t0 |= t | (o0 & o)
                    o0 |= o
                else:
                    held[block] = [o, t]
        for block, (_, t) in held.items():
            if t.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([told(np.flatnonzero(np.unpackbits(t)))], pa.binary())], names=["block", "twice"])

    parts = df.mapInArrow(scan, "block long, once binary, twice binary")
    merged = parts.repartition("block").mapInArrow(merge, "block long, twice binary").collect()  # at most DEPTH * cells / 8 bytes
    plane = np.zeros((DEPTH * cells // BLOCK, BLOCK // 8), np.uint8)
    for r in merged:
        plane[r.block] = read(r.twice)
    return df.sparkSession.sparkContext.broadcast(plane.tobytes())


def repeated(plane: bytes, keys: np.ndarray, cells: int) -> np.ndarray:
    """Where the estimate is two or more."""
    bits = np.frombuffer(plane, np.uint8).reshape(DEPTH, cells // 8)
    ok = np.ones(len(keys), bool)
    for row in range(DEPTH):
        at = cells_of(keys, row, cells)
        ok &= (bits[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return ok

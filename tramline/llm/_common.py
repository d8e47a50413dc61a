"""Shared pieces of the training-data operators.

Texts come to the Python functions as Arrow columns.  Functions here view a
column as one flat byte array, cut it into slices of bounded size, and offer
the vectorised hashing that several operators need.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word, fixed by the result contracts: space and 0x09-0x0D.
WORD_BREAKS = b" \t\n\x0b\x0c\r"
IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(WORD_BREAKS)] = True

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
SLICE_BYTES = 1 << 20

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    if _ROOT not in sys.path:
        sys.path.append(_ROOT)
    # texts are long: Arrow batches of the default number of rows would hold tens of megabytes on either side
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    return spark


def trim() -> None:
    """Give memory that a pass over a partition has freed back to the system; a worker lives on for other passes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.  Where it is unset, one of this machine, for a local master only (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "/tmp/checkpoints"
    return top.rstrip("/")


#: Tables that :func:`written` made and nobody has deleted, by path.
_tables: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tramline-{name}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(forget_all)
    _tables[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tramline_path = path
    return out


#: A key is hot with more than this share of a table's rows, so that there are at most 1 / HOT of them.
HOT = 1 / 1000


def hot_keys(table: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than HOT of the rows of a written table, by ``sizes`` (key, rows): a written table of at most 1 / HOT rows."""
    return written(sizes.where(F.col("rows") > table.count() * HOT).select(*key), "hot")


def split_join(table: DataFrame, known: DataFrame, key: list[str], hot: DataFrame) -> DataFrame:
    """Inner join with a table of at most one row a key, however many rows a key has.

    Hot keys (see :func:`hot_keys`) are joined where their rows are; only the
    others are dealt out by key.
    """
    near = F.broadcast(known.join(F.broadcast(hot), key))
    return table.join(near, key).unionByName(table.join(F.broadcast(hot), key, "left_anti").join(known, key))


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def forget(*frames: DataFrame) -> None:
    """Delete the tables behind frames that :func:`written` gave, when nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_tramline_path", None)
        if path and _tables.pop(path, None):
            _delete(df.sparkSession, path)


def forget_all() -> None:
    """Delete what results that are still lazy have read: at the end of the driver."""
    for path, spark in list(_tables.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)
    _tables.clear()


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no frame needs any more: its cleaner acts when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def tables_of_a_step(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Delete, at the end, all tables written inside but those appended to the list that is given."""
    before, keep = set(_tables), list(kept)
    yield keep
    stay = {getattr(df, "_tramline_path", None) for df in keep}
    for path in [p for p in _tables if p not in before and p not in stay]:
        _delete(spark := _tables.pop(path), path)
        release(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def row_key(text: Column) -> Column:
    """With doc_id it tells rows apart even where doc_id repeats with another text."""
    return F.xxhash64(text)


def blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows with at most ``limit`` bytes, or one row."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


_rng = np.random.Generator(np.random.PCG64(20240601))
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` units from each position (k a power of two), by doubling; the last k-1 positions are meaningless."""
    h, span, step = units.copy(), 1, 0
    while span < k:
        out = h * _STEPS[step]
        out[:-span or None] += h[span:]
        h, span, step = out, span * 2, step + 1
    return mix(h)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the ``w`` values from each position on (fewer at the end)."""
    m, span = values.copy(), 1
    while span * 2 <= w:
        np.minimum(m[:-span], m[span:], out=m[:-span])
        span *= 2
    if (rest := w - span) and len(m) > rest:
        m[:-rest] = np.minimum(m[:-rest], m[rest:])
    return m


def anchored_runs(units: np.ndarray, room: np.ndarray, length: int, k: int):
    """Cut the windows of ``length`` units into runs that share an anchor.

    ``room[i]`` is how many units the document has from ``i`` on.  The anchor
    of a window is its k-gram with the least hash, the leftmost at ties, so it
    depends on the window's content alone: equal windows have equal anchors at
    equal distances.  Gives first window, number of windows and anchor hash of
    each run, in order.
    """
    n = len(units)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(units, k)
    low = np.uint64((1 << 34) - 1)  # the same in every slice, so that ties of the upper bits fall alike everywhere
    m = sliding_min((h & ~low) | np.arange(n, dtype=np.uint64), length - k + 1)
    anchor = (m & low).astype(np.int64)
    valid = room >= length
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    counts = np.add.reduceat(valid.astype(np.int64), starts)
    return starts, counts, h[anchor[starts]]


def digests(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of stretches of a text."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(text[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)).view(np.int64)


def collapsed(row: np.ndarray, at: np.ndarray, n: np.ndarray, anchor: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First run of each row of equal runs that follow one another without a gap, and how many they are."""
    follows = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + n[:-1]) & (n[1:] == n[:-1]) & (anchor[1:] == anchor[:-1]) & (d[1:] == d[:-1])
    first = np.flatnonzero(np.concatenate(([True], ~follows)))
    return first, np.diff(np.append(first, len(row)))


def word_slice(offsets: np.ndarray, raw: np.ndarray, first: int, last: int, lower: bool = False):
    """Words of rows first..last: canonical bytes (each word followed by one space), word start and end offsets in them, and words per row."""
    data = raw[offsets[first] : offsets[last]]
    if last - first > 1:
        data = np.insert(data, offsets[first + 1 : last] - offsets[first], 10)
    data = np.append(data, np.uint8(10))
    is_break = IS_BREAK[data]
    end = is_break.copy()
    end[0] = False
    end[1:] &= ~is_break[:-1]
    row_ends = offsets[first + 1 : last + 1] - offsets[first] + np.arange(last - first)
    per_row = np.diff(np.concatenate(([0], np.cumsum(end)[row_ends]))) if last > first else np.zeros(0, np.int64)
    kept = data[~is_break | end]
    ends = np.flatnonzero(IS_BREAK[kept])
    kept[ends] = 32
    if lower:
        kept[(kept >= 65) & (kept <= 90)] += 32
    starts = np.empty_like(ends)
    if len(ends):
        starts[0], starts[1:] = 0, ends[:-1] + 1
    return kept, starts, ends, per_row


def word_hashes(kept: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word of :func:`word_slice`."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int((ends - starts).max()) + 1
    powers = np.full(longest, np.uint64(0x9E3779B97F4A7C15))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(kept)) - np.repeat(starts, ends + 1 - starts)
    return mix(np.add.reduceat(BYTE_VALUES[kept] * powers[place], starts))


def room_of(per_row: np.ndarray) -> np.ndarray:
    """For each unit, how many units its row has from it on."""
    total = int(per_row.sum())
    ends = np.repeat(np.cumsum(per_row), per_row)
    return ends - np.arange(total)


def spans_of(flags: np.ndarray) -> np.ndarray:
    """Pairs (start, end) of the maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges.reshape(-1, 2)

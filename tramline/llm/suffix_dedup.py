"""Suffix-array dedup of repeated 200-byte strings.

All texts count as UTF-8 bytes; a string never crosses documents.  A window is a
200-byte string.  Windows of a document that share an anchor (the 32-byte gram
of least hash in them, a matter of content alone) form a run, and equal windows
lie in runs of equal anchors.  So texts are dealt to shards by anchor.

1. Runs of equal content (by anchor and 64-bit digest) are counted, before any bytes are shuffled.  An anchor
   that occurs once in all holds no repeated window and goes no further.  Third
   and later copies of a content are dropped; two of them go on.
2. Runs of the other anchors go to shards as bytes, each content once and marked
   where it occurs twice.  Every shard, of about ``SHARD_BYTES``, builds a suffix
   array by Larsson-Sadakane refinement in numpy, takes common prefixes of
   neighbours after Kasai, and marks windows with a neighbour of 200 bytes.
3. Shards are filled without regard to anchors.  Where the runs of an anchor lie in
   several shards of a task, the windows of each are found in the suffix array of
   the other by binary search.
4. An anchor with more than ``PIECE`` different runs is dealt to pieces by content.
   Pieces are shards as above; besides, each gives its distinct windows as 128-bit
   digests, which are dealt by ranges, and binary search in a range's order finds
   those that several pieces hold.  So an anchor costs in proportion to its kinds,
   and no task holds more than one piece of it.

Every byte removed is removed because of steps 2 to 4.

Defined results.  Null and empty texts have 0 bytes.  Repeated rows are other
documents, so their windows repeat.  Rows with a null id take part like others.
A row over ``SEGMENT`` bytes is read in overlapping segments, which only cuts
runs; a run that repeats itself without a gap (periodic texts) is one row of the
table of runs.  Extra input columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import _common as c
from tramline.llm.substring_dedup import digest

LENGTH, GRAM = 200, 32
#: Different runs of one anchor in a task; with more, the anchor is dealt out in pieces.
PIECE = 4096
#: Bytes of the runs that one suffix array covers; sorting is fastest while they lie in a core's cache.
SHARD_BYTES = 1 << 17
#: A shard of runs of one anchor may be so many times as large, so that there are few shards to merge pair by pair.
LARGER = 8
#: Bytes of one text that are read at once.
SEGMENT = 4 << 20


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number, zeros past the end."""
    wide = np.zeros(len(data), np.uint64)
    for k in range(8):
        wide[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return wide


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order, by Larsson-Sadakane refinement.

    Suffixes are put in groups by eight bytes; each round sorts only groups that
    still have several members, by the group of the suffix h places on, and
    doubles h.  A group is named by the place of its last member.
    """
    n = len(data)
    wide = packed(data)
    sa = np.argsort(wide)
    key = wide[sa]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    h = 8
    rank = np.empty(n, np.int32)

    def name(at: np.ndarray, head: np.ndarray) -> None:
        """Ranks of the suffixes at the places ``at``, where groups begin at ``head``."""
        firsts = np.flatnonzero(head)
        size = np.diff(np.append(firsts, len(at)))
        rank[sa[at]] = np.repeat((at[firsts] + size - 1).astype(np.int32), size)

    name(np.arange(n), head)
    last = np.append(head[1:], True)
    at = np.flatnonzero(~(head & last))  # places in groups of several
    while len(at):
        own = sa[at]
        ahead = own + h
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[own].astype(np.int64)
        order = np.argsort(group * (n + 1) + following + 1)
        group, following = group[order], following[order]
        sa[at] = own[order]
        head = np.concatenate(([True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])))
        name(at, head)
        last = np.append(head[1:], True)
        at = at[~(head & last)]
        h *= 2
    return sa


_BYTES = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)


def kasai(data: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 2048) -> np.ndarray:
    """Common prefix of each suffix in ``sa`` with the one before it, up to ``cap``.

    Kasai's scan goes through the text and starts each comparison one byte short
    of the last.  Here many lanes scan a stretch of the text each, in step, and
    compare eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    wide = packed(np.append(data, np.zeros(cap + 16, np.uint8)))
    plcp = np.zeros(n, np.int64)
    lanes = max(1, min(lanes, n // 64))
    each = -(-n // lanes)
    pos = np.arange(lanes) * each
    stop = np.minimum(pos + each, n)
    h = np.zeros(lanes, np.int64)
    live = np.flatnonzero(pos < stop)
    pos, stop, h = pos[live], stop[live], h[live]
    while len(pos):
        j = before[pos]
        room = np.minimum(n - np.maximum(pos, j), cap)
        x = wide[np.minimum(pos + h, len(wide) - 1)] ^ wide[np.minimum(np.maximum(j, 0) + h, len(wide) - 1)]
        equal = 8 - np.searchsorted(_BYTES, x, "right")  # leading bytes of the eight that are equal
        h = np.minimum(h + equal, room)
        done = (j < 0) | (h >= room) | (x != 0)
        h = np.where(j < 0, 0, h)
        at = np.flatnonzero(done)
        plcp[pos[at]] = h[at]
        pos[at] += 1
        h[at] = np.maximum(h[at] - 1, 0)
        if (pos >= stop).any():
            live = pos < stop
            pos, stop, h = pos[live], stop[live], h[live]
    return plcp[sa]


class Shard:
    """The runs of one shard: bytes in a row, the windows that start in them, and their order.

    Rows are (anchor, piece, digest, rows, twice, bytes); those that occur twice lie in the data twice.
    """

    def __init__(self, rows: list[tuple], length: int):
        self.rows = rows
        texts = [r[5] for r in rows] + [r[5] for r in rows if r[4]]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.length = length
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        self.starts = ends - np.arange(len(self.data)) >= length
        sa = suffix_array(self.data)
        lcp = kasai(self.data, sa, length)
        # among suffixes that are windows, neighbours are equal if no common prefix between them is shorter
        cut = np.cumsum(lcp < length)
        own = self.starts[sa]
        self.order, self.group = sa[own], cut[own]

        same = self.group[1:] == self.group[:-1]
        #: Windows (by position) that are known to have an equal one.
        self.marked = np.zeros(len(self.data), bool)
        self.marked[self.order[1:][same]] = True
        self.marked[self.order[:-1][same]] = True

    def of(self, anchor: int, piece: int) -> np.ndarray:
        """Places in the order of the windows whose run has an anchor."""
        own = np.zeros(len(self.data), bool)
        for k, r in enumerate(self.rows):
            if r[0] == anchor and r[1] == piece:
                own[self.begins[k] : self.begins[k] + self.sizes[k]] = True
        return np.flatnonzero(own[self.order])

    def keys(self, at: np.ndarray) -> np.ndarray:
        """Windows as rows of numbers that order like their bytes."""
        wide = packed(np.append(self.data, np.zeros(8, np.uint8)))
        steps = [*range(0, self.length - 7, 8)] + [self.length - 8] * (self.length % 8 > 0)
        return np.stack([wide[at + s] for s in steps], axis=1)

    def merge(self, other: Shard, anchor: int, piece: int) -> None:
        """Mark in both shards the windows of an anchor that the other one has too, by binary search in their orders."""
        mine, there = self.of(anchor, piece), other.of(anchor, piece)
        if not len(mine) or not len(there):
            return
        a, b = self.keys(self.order[mine]), other.keys(other.order[there])

        def bound(after: bool) -> np.ndarray:
            """For each row of a the first place in b of a row that is not less (after: that is greater)."""
            low, high = np.zeros(len(a), np.int64), np.full(len(a), len(b))
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                differ = b[mid] != a[open_]
                k = differ.argmax(axis=1)
                on = np.arange(len(open_))
                less = (b[mid, k] < a[open_, k]) | (after & ~differ[on, k])
                low[open_[less]] = mid[less] + 1
                high[open_[~less]] = mid[~less]
            return low

        first, last = bound(False), bound(True)
        hit = last > first
        self.marked[self.order[mine[hit]]] = True
        edge = np.zeros(len(b) + 1, np.int64)
        np.add.at(edge, first[hit], 1)
        np.add.at(edge, last[hit], -1)
        other.marked[other.order[there[np.cumsum(edge[:-1]) > 0]]] = True

    def spans(self) -> list[tuple]:
        """(anchor, digest, rows, s, e) of the marked windows of each run."""
        out = []
        for k, r in enumerate(self.rows):
            at = self.begins[k]
            out += [(r[0], r[2], r[3], a, b) for a, b in c.spans_of(self.marked[at : at + self.sizes[k]]).tolist()]
        return out

    def distinct(self) -> list[tuple]:
        """(whi, wlo, anchor, digest, rows, j) of one window of each kind in runs of pieces."""
        run = np.searchsorted(self.begins, self.order, "right") - 1
        n = len(self.rows)
        first = np.concatenate(([True], self.group[1:] != self.group[:-1]))
        dealt = np.array([r[1] >= 0 for r in self.rows] + [False] * (len(self.sizes) - n), bool)
        text, out = self.data.tobytes(), []
        # of equal windows any will do, but it must lie in the first copy of its run
        kept = np.flatnonzero(dealt[run])
        _, one = np.unique(np.cumsum(first)[kept], return_index=True)
        for k in kept[one].tolist():
            at, r = int(self.order[k]), self.rows[run[k]]
            out.append((*digest(text[at : at + self.length]), r[0], r[2], r[3], at - int(self.begins[run[k]])))
        return out


def runs_of(column: pa.Array, length: int, gram: int, segment: int = SEGMENT):
    """For slices of a column: row, first byte in the row, windows and anchor of each run, where it begins in the slice, and the slice."""
    offsets, raw = c.blobs(column)
    for first, last in c.slices(offsets):
        whole = int(offsets[last] - offsets[first])
        # a long text in segments that share length - 1 bytes, so that each window lies in one of them
        step = whole if last - first > 1 or whole <= segment else segment
        for at in range(0, max(whole - length + 1, 0), step or 1):
            data = raw[offsets[first] + at : min(offsets[first] + at + step + (length - 1) * (step < whole), offsets[last])]
            per_row = np.diff(offsets[first : last + 1]) if step == whole else np.array([len(data)])
            begins, n, anchors = c.anchored_runs(c.BYTE_VALUES[data], c.room_of(per_row), length, gram)
            if len(begins):
                row = np.repeat(np.arange(last - first), per_row)[begins]
                yield first + row, at + begins - (np.cumsum(per_row) - per_row)[row], n, anchors, begins, data


def compare_shards(parts: Iterator[pa.RecordBatch], length: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, piece, digest, rows, twice, bytes) in order of the first three: marked windows of runs, and windows of pieces yet to be merged."""
    rows: list[tuple] = []
    size = 0
    held: list[Shard] = []  # shards that hold the last anchor met

    def told(shard: Shard) -> pa.RecordBatch:
        spans, loose = shard.spans(), shard.distinct()
        a = np.array([(*x, 0, 0) for x in spans] + [(*x[2:], x[5] + 1, *x[:2]) for x in loose], np.int64).reshape(-1, 7)
        known = np.arange(len(a)) < len(spans)
        columns = [pa.array(a[:, k]) for k in range(3)] + [pa.array(a[:, k].astype(np.int32)) for k in (3, 4)] + [pa.array(a[:, k], mask=known) for k in (5, 6)]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "digest", "rows", "s", "e", "whi", "wlo"])

    def shut(own: list[tuple]) -> list[Shard]:
        """Build a shard and merge it with those that share its first anchor; gives those that no later one can share an anchor with."""
        shard, done = Shard(own, length), []
        head, tail = own[0][:2], own[-1][:2]
        shares = bool(held) and held[-1].rows[-1][:2] == head
        if shares:
            for other in held:
                shard.merge(other, *head)
        if not shares or head != tail:
            done = held[:]
            held.clear()
        held.append(shard)
        return done

    for part in parts:
        for r in zip(*[col.to_pylist() for col in part.columns], strict=True):
            if rows and size >= shard_bytes * (LARGER if rows[0][:2] == r[:2] else 1):
                yield from map(told, shut(rows))
                rows, size = [], 0
            rows.append(r)
            size += len(r[5]) * (1 + r[4])
    if rows:
        yield from map(told, shut(rows))
    yield from map(told, held)


def shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (whi, wlo, anchor, digest, rows, s, e) in order of the first two, those whose digest another row has."""
    rest = None
    for part in parts:
        rows = part if rest is None else pa.Table.from_batches([rest, part]).combine_chunks().to_batches()[0]
        key = np.stack([rows.column(k).to_numpy() for k in (0, 1)], axis=1)
        if not len(key):
            continue
        same = (key[1:] == key[:-1]).all(axis=1)
        # the last digest may go on in the next batch: two rows of it are enough to tell
        tail = len(key) - int(np.searchsorted(key[::-1, 0] != key[-1, 0], True))
        hit = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        yield rows.slice(0, tail).filter(pa.array(hit[:tail]))
        rest = rows.slice(tail)
    if rest is not None and rest.num_rows:
        key = np.stack([rest.column(k).to_numpy() for k in (0, 1)], axis=1)
        same = (key[1:] == key[:-1]).all(axis=1)
        yield rest.filter(pa.array(np.concatenate(([False], same)) | np.concatenate((same, [False]))))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, piece: int = PIECE, shard_bytes: int = SHARD_BYTES, segment: int = SEGMENT, texts: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with the kept bytes where ``texts``."""
    c.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), c.row_key(F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, at, n, anchor, begins, data in runs_of(part.column(2), length, gram, segment):
                text = data.tobytes()
                d = c.digests(text, begins, begins + n + length - 1)
                one, reps = c.collapsed(row, at, n, anchor, d)
                row, at, n, anchor, d = row[one], at[one], n[one], anchor[one], d[one]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(d), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), *[pa.array(x.astype(np.int32)) for x in (at, n, reps)]], names=["anchor", "digest", "id", "rid", "at", "n", "reps"])
        c.trim()

    runs = c.written(rows.mapInArrow(scan, "anchor long, digest long, id long, rid long, at int, n int, reps int"), "runs")
    key = ["anchor", "digest"]
    # any run of a content stands for it: firsts of one group come from one row
    classes = runs.groupBy(*key).agg(F.sum("reps").alias("times"), F.count("*").alias("rows"), *[F.first(x).alias(x) for x in ("id", "rid", "at", "n")])
    classes = c.written(classes, "classes")
    anchors = c.written(classes.groupBy("anchor").agg(F.count("*").alias("rows"), F.sum("times").alias("occurs")).where("occurs > 1").drop("occurs"), "anchors")
    often = c.hot_keys(classes, anchors, ["anchor"])
    c.release(docs.sparkSession)

    # bytes of each content of an anchor that occurs twice or more, from one document that has it
    known = c.split_join(classes, anchors.withColumnRenamed("rows", "kinds"), ["anchor"], often)
    pieces = F.ceil(F.col("kinds") / piece)
    known = known.withColumn("piece", F.when(pieces > 1, F.pmod("digest", pieces)).otherwise(-1))
    wanted = known.groupBy("id", "rid").agg(F.collect_list(F.struct(*key, "piece", "rows", (F.col("times") > 1).alias("twice"), "at", "n")).alias("runs"))
    wanted = wanted.withColumnsRenamed({"id": "w_id", "rid": "w_rid"})
    once = rows.join(wanted, rows["id"].eqNullSafe(wanted["w_id"]) & (rows["rid"] == wanted["w_rid"])).select("text", "runs")

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            offsets, raw = c.blobs(part.column(0))
            for i, own in enumerate(part.column(1)):
                own = own.values
                get = {k: own.field(k).to_numpy(zero_copy_only=False) for k in (*key, "piece", "rows", "twice", "at", "n")}
                s, e = offsets[i] + get["at"], offsets[i] + get["at"] + get["n"] + length - 1
                for first in range(0, len(s), 4096):
                    to = slice(first, first + 4096)
                    yield pa.RecordBatch.from_arrays([*[pa.array(get[k][to]) for k in ("anchor", "piece", "digest", "rows", "twice")], pa.array([raw[a:b].tobytes() for a, b in zip(s[to].tolist(), e[to].tolist(), strict=True)], pa.binary())], names=["anchor", "piece", "digest", "rows", "twice", "bytes"])

    contents = once.mapInArrow(fetch, "anchor long, piece long, digest long, rows long, twice boolean, bytes binary")
    # repeated rows of the input fetch a run twice: they are one content
    shards = contents.repartition("anchor", "piece").sortWithinPartitions("anchor", "piece", "digest")
    found = shards.mapInArrow(lambda parts: compare_shards(unrepeated(parts), length, shard_bytes), "anchor long, digest long, rows long, s int, e int, whi long, wlo long")
    found = c.written(found, "found")
    loose = found.where("whi is not null").select("whi", "wlo", *key, "rows", "s", "e").repartition("whi").sortWithinPartitions("whi", "wlo")
    # windows that several pieces hold; equal ones of a piece are marked already
    across = loose.mapInArrow(shared, "whi long, wlo long, anchor long, digest long, rows long, s int, e int").select(*key, "rows", "s", "e")
    # a run has fewer windows than a window has bytes, so what its marked windows cover has no gap
    marks = found.where("whi is null").select(*key, "rows", "s", "e").unionByName(across).groupBy(*key).agg(F.max("rows").alias("rows"), F.min("s").alias("s"), F.max("e").alias("e"))

    # a run that repeats without a gap is marked in whole
    marks = c.written(marks, "marks")
    hot = c.hot_keys(runs, marks, key)
    c.forget(found, classes, anchors, often)
    del classes, anchors, known, wanted, once, contents, shards, found, loose, across
    c.release(docs.sparkSession)
    spans = c.split_join(runs, marks.drop("rows"), key, hot).select("id", "rid", F.expr(f"struct(at + s as s, at + e + (reps - 1) * n + {length - 1} as e)").alias("span"))
    removed = spans.groupBy(F.col("id").alias("w_id"), F.col("rid").alias("w_rid")).agg(F.collect_list("span").alias("spans"))
    final = rows.join(removed, rows["id"].eqNullSafe(removed["w_id"]) & (rows["rid"] == removed["w_rid"]), "left").select(F.col("id").cast(kind).alias("id"), "text", "spans")
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            offsets, raw = c.blobs(part.column(1))
            out = []
            for i in range(part.num_rows):
                own, gone, n = raw[offsets[i] : offsets[i + 1]], 0, 0
                size = len(own)
                if (spans := part.column(2)[i]).is_valid:
                    edge = np.zeros(size + 1, np.int64)
                    np.add.at(edge, spans.values.field("s").to_numpy(), 1)
                    np.add.at(edge, spans.values.field("e").to_numpy(), -1)
                    drop = np.cumsum(edge[:size]) > 0
                    gone, n, own = int(drop.sum()), len(c.spans_of(drop)), own[~drop]
                kept = own.tobytes()
                out.append((size, gone, n, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            columns = [part.column(0), *[pa.array([x[k] for x in out], pa.int64()) for k in range(3)], pa.array([x[3] for x in out], pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                columns.append(pa.array([x[4] for x in out], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return final.mapInArrow(cut, schema)


def unrepeated(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows that equal the one before in all but bytes."""
    before = None
    for part in parts:
        keys = np.stack([part.column(k).to_numpy() for k in range(3)], axis=1)
        if not len(keys):
            continue
        fresh = np.concatenate(([before is None or bool((keys[0] != before).any())], (keys[1:] != keys[:-1]).any(axis=1)))
        before = keys[-1]
        yield part.filter(pa.array(fresh))

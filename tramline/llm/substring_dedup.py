"""Substring dedup over word windows with a count-min prefilter.

A window is 50 consecutive words.  Windows of a document that share an anchor
(the 16-word gram of least hash in them, which depends on their content alone)
form a run.  Pass one counts anchors of runs in count-min sketches, one in each
partition, merged to one whose width follows the input.  An anchor's count is at
least that of any window which holds it, so the sketch overestimates window
counts; windows estimated once occur once and go no further.  Pass two groups the others
exactly: runs of equal content first, then, for anchors with runs of different
content, their single windows by 128-bit digests.  All groupings combine before
they shuffle, and joins back to runs and windows keep hot keys where they are, so
a passage in a third of all documents makes no large group.

Defined results.  A word is removed if a window over it also starts in a
document with a smaller id.  Null and empty texts have no words.  A null id
counts as larger than any other.  Rows that share an id are one document for the
comparison (neither removes words of the other) and give a row each.  A text over
``SEGMENT`` bytes is read in overlapping segments, which only cuts runs; a run that
repeats itself without a gap (periodic texts) is one row of the table of runs.
Extra input columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import _common as c
from tramline.llm import _sketch

WINDOW, GRAM = 50, 16
#: Words of one text that are read at once, and bytes for each window that the width of the sketch reckons with.
SEGMENT, BYTES_A_RUN = 1 << 19, 100
_LAST = (1 << 63) - 1


def digest(text: bytes) -> tuple[int, int]:
    """A 128-bit digest as two signed integers."""
    d = xxhash.xxh3_128_digest(text)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def runs_of(column: pa.Array, window: int, gram: int, segment: int = SEGMENT):
    """For slices of a column: row, first word in the row, windows and anchor of each run, and the words."""
    offsets, raw = c.blobs(column)
    for first, last in c.slices(offsets):
        kept, starts, ends, per_row = c.word_slice(offsets, raw, first, last)
        if len(starts) < window:
            continue
        # a long text in segments that share window - 1 words, so that each window lies in one of them
        step = len(starts) if last - first > 1 or len(starts) <= segment else segment
        for base in range(0, len(starts) - window + 1, step):
            to = slice(base, base + step + (window - 1) * (step < len(starts)))
            s, e = starts[to], ends[to]
            own = per_row if step == len(starts) else np.array([len(s)])
            begins, n, anchors = c.anchored_runs(c.word_hashes(kept[s[0] : e[-1] + 1], s - s[0], e - s[0]), c.room_of(own), window, gram)
            if len(begins):
                row = np.repeat(np.arange(last - first), own)[begins]
                yield first + row, base + begins - (np.cumsum(own) - own)[row], n, anchors, base + begins, kept, starts, ends


def repeated_runs(docs: DataFrame, plane, window: int, gram: int, cells: int, segment: int) -> DataFrame:
    """Runs whose anchor is estimated to occur twice or more; docs is (id, rid, text)."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, at, n, anchors, begins, kept, starts, ends in runs_of(part.column(2), window, gram, segment):
                ok = _sketch.repeated(plane.value, anchors, cells)
                if not ok.any():
                    continue
                row, at, n, begins, anchors = row[ok], at[ok], n[ok], begins[ok], anchors[ok]
                text = kept.tobytes()
                d = c.digests(text, starts[begins], ends[begins + n + window - 2])
                one, reps = c.collapsed(row, at, n, anchors, d)
                row, at, n, anchors, d = row[one], at[one], n[one], anchors[one], d[one]
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(d), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), *[pa.array(x.astype(np.int32)) for x in (at, n, reps)]], names=["anchor", "digest", "id", "rid", "at", "n", "reps"])
        c.trim()

    return docs.mapInArrow(scan, "anchor long, digest long, id long, rid long, at int, n int, reps int")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, cells: int | None = None, segment: int = SEGMENT, texts: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row, with the kept text where ``texts``.  ``cells`` overrides the sketch's width."""
    c.ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), c.row_key(F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))

    def anchors(part: pa.RecordBatch) -> Iterator[np.ndarray]:
        for found in runs_of(part.column(2), window, gram, segment):
            yield found[3]

    if cells is None:
        cells = _sketch.width((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BYTES_A_RUN)
    plane = _sketch.sketch(rows, anchors, cells)
    runs = c.written(repeated_runs(rows, plane, window, gram, cells, segment).withColumn("ord", F.coalesce("id", F.lit(_LAST))).drop("id"), "runs")
    key = ["anchor", "digest"]

    # runs of equal content: the least document that has each
    classes = runs.groupBy(*key).agg(F.min(F.struct("ord", "rid", "at", "n")).alias("r"), F.count("*").alias("rows")).select(*key, F.col("r.ord").alias("least"), "r.rid", "r.at", "r.n", "rows")
    classes = c.written(classes, "classes")
    mixed = c.written(classes.groupBy("anchor").agg(F.count("*").alias("rows")).where("rows > 1"), "mixed")
    many = c.hot_keys(classes, mixed, ["anchor"])
    single = c.split_join(classes, mixed.select("anchor"), ["anchor"], many)

    # single windows, of one document for each content, where an anchor has several contents
    wanted = single.groupBy(F.col("least").alias("ord"), "rid").agg(F.collect_list(F.struct(*key, "at", "n")).alias("runs"))
    held = rows.withColumn("ord", F.coalesce("id", F.lit(_LAST))).select("ord", "rid", "text")
    # repeated rows give the same windows again, which the grouping below merges
    windows = c.written(held.join(wanted, ["ord", "rid"]).select("ord", "text", "runs").mapInArrow(lambda parts: single_windows(parts, window), "whi long, wlo long, ord long, anchor long, digest long, j int"), "windows")
    before = windows.groupBy("whi", "wlo").agg(F.min("ord").alias("least_w"), F.max("ord").alias("most"), F.count("*").alias("rows"))
    # a window that only one document has needs no join
    before = c.written(before.where("least_w < most").drop("most"), "before")
    often = c.hot_keys(windows, before, ["whi", "wlo"])
    hit = c.split_join(windows, before.drop("rows"), ["whi", "wlo"], often).where("least_w < ord").groupBy(*key).agg(F.min("j").alias("low"), F.max("j").alias("high"))

    # back to every run: all of it, or its single windows.  A run has fewer windows than a window has words (and so has
    # the step of one that repeats without a gap), so what they cover has no gap
    known = classes.select(*key, "least", "rows").join(hit, key, "left").where("rows > 1 or low is not null")
    known, hot = c.written(known, "known"), c.hot_keys(runs, classes, key)
    c.forget(windows, before, often, classes, mixed, many)
    del classes, mixed, many, single, wanted, held, windows, before, often, hit
    c.release(docs.sparkSession)
    later = F.col("ord") > F.col("least")
    last = F.when(later, F.col("n") - 1).otherwise(F.col("high")) + (F.col("reps") - 1) * F.col("n")
    span = F.struct((F.col("at") + F.when(later, 0).otherwise(F.col("low"))).alias("s"), (F.col("at") + last + window).alias("e"))
    spans = c.split_join(runs, known.drop("rows"), key, hot).where("ord > least or low is not null").select("ord", "rid", span.alias("span"))
    removed = spans.groupBy("ord", "rid").agg(F.collect_list("span").alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    final = rows.withColumn("ord", F.coalesce("id", F.lit(_LAST))).join(removed, ["ord", "rid"], "left").select(F.col("id").cast(kind), "text", "spans")
    schema = f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from remove_words(part, id_col, texts)

    return final.mapInArrow(cut, schema)


def single_windows(parts: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for i in range(part.num_rows):
            offsets, raw = c.blobs(part.column(1).slice(i, 1))
            kept, starts, ends, _ = c.word_slice(offsets, raw, 0, 1)
            text, out = kept.tobytes(), []
            order = part.column(0)[i].as_py()
            for r in part.column(2)[i].as_py():
                at, n = r["at"], r["n"]
                for j, (s, e) in enumerate(zip(starts[at : at + n].tolist(), ends[at + window - 1 : at + n + window - 1].tolist(), strict=True)):
                    out.append((*digest(text[s:e]), order, r["anchor"], r["digest"], j))
            a = np.array(out, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*[pa.array(a[:, k]) for k in range(5)], pa.array(a[:, 5].astype(np.int32))], names=["whi", "wlo", "ord", "anchor", "digest", "j"])


def remove_words(part: pa.RecordBatch, id_col: str, texts: bool) -> Iterator[pa.RecordBatch]:
    offsets, raw = c.blobs(part.column(1))
    all_spans = part.column(2)
    for first, last in c.slices(offsets):
        kept, starts, ends, per_row = c.word_slice(offsets, raw, first, last)
        at, out = 0, []
        for i in range(last - first):
            n = int(per_row[i])
            s0, e0 = (int(starts[at]), int(ends[at + n - 1])) if n else (0, 0)
            own, gone = kept[s0:e0], 0
            if (spans := all_spans[first + i]).is_valid and n:
                v = spans.values
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, v.field("s").to_numpy(), 1)
                np.add.at(edge, v.field("e").to_numpy(), -1)
                drop = np.cumsum(edge[:n]) > 0
                gone = int(drop.sum())
                if gone:
                    length = ends[at : at + n] + 1 - starts[at : at + n]
                    own = kept[s0 : e0 + 1][np.repeat(~drop, length)][:-1]
            out.append((n, gone, own.tobytes()))
            at += n
        columns = [part.column(0).slice(first, last - first), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())]
        names = [id_col, "n_words", "n_removed", "kept_sha256"]
        if texts:
            columns.append(pa.array([x[2].decode("utf-8", "replace") for x in out], pa.string()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(columns, names=names)

"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments.  If two fingerprints
differ in at most R bits, some segment starts a chain whose first 1, 2, 3 and 4
segments differ in at most R/4, R/2, 3R/4 and R bits in all (the proportional
budgets ``floor(l * R / 4)``).  So fingerprints are grouped by each segment in turn,
a pair goes on only while its chain stays within budget, and the full Hamming
check comes last.  With R = 3 the first budget is 0: the pair is equal there.  With
R = 4 to 7 it is 1: a fingerprint also probes the groups of the values that have
one bit more than its own.

Two uses.  :func:`simhash_components` links fingerprints of word shingles at 3 bits
or fewer.  :func:`keep_one` keeps one document of each group of near-duplicates:
those whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.  Its
filter is a fingerprint of the words, each weighed up to 3 times, which an edited word
changes far less than one of shingles, at 10 bits or fewer (all pairs up to 7 bits
meet, and those of 8 to 10 that have a segment with at most one unequal bit), and at
most 34 unequal bits of 128 over the distinct shingles (19 stand for 0.8); what passes
is compared exactly by the sets themselves.  So no link is false; a test measures how many of the links of sf0.1 the
filter lets through, at least 9 of 10.

Distinct fingerprints stand for their documents, so exact copies make no pairs.
Groups are compared in numpy and give at most a spanning forest of links, not
their pairs; for near-duplicates groups give all candidates as long as these are at most
``MOST`` a row.  Only groups with more give first stars about the members that are nearest
to what most have in common, as copies are nearer to their source than to each other.  Stars
leave candidates out, so these groups are named, and when the links are known, they are
compared a second time, their rows with the sets: every candidate between what is not connected
yet is compared exactly where it is found, and only links are given, fewer than rows.  The
groups of near-duplicates are those of all candidates.  A group over ``BLOCK`` fingerprints is dealt out in pieces, and
each pair of pieces is compared in a task of its own: no task holds more than
two pieces, however common a segment is, and no link is lost.  Sets are dealt out of the rows
that a sketch lets through, so those that no comparison needs are not shuffled.

Defined results.  A null, empty or blank text has fingerprint zero, linked like
any other; for :func:`keep_one` all such texts are copies of each other.  Every row
gives one row; rows with a null id get the component of their fingerprint, whose id
is the smallest that is not null (null if none).  :func:`keep_one` keeps the smallest
id, null being the largest, of rows that share it one, and all columns of the input,
whatever their names.  Extra input columns are else left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm import _common as c
from tramline.llm._components import components
from tramline.llm._sketch import repeated, sketch, width

SEGMENTS, BITS, REACH = 4, 16, 3
#: Fingerprints in one piece of a large group.
BLOCK = 4096
#: Near-duplicates: bits of the fingerprint of words, words of a shingle, similarity, and unequal bits of 128 that pass the filter and that leave little doubt.
NEAR_REACH, NEAR_SHINGLE, NEAR, NEAR_BITS, SURE_BITS = 10, 5, 0.8, 34, 13
#: How often a word counts in the fingerprint of words: beyond that, common words would make all texts of a language alike.
WEIGHT = 3
#: Stars that a candidate joins in the first comparison, unless it leaves little doubt; the second has no such bound.
STARS = 3
#: Groups up to this size are compared together.
SMALL = 32
#: Candidates a row up to which a larger group gives them all at once.
MOST = 8
#: Shingles of a piece that is compared with its sets.
HELD_GRAMS = 1 << 20
_SALTS = np.array([0x8B7A1F3D5C6E9A01, 0xD1B54A32D192ED03], np.uint64)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], np.uint64)


def fingerprints_of(column: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprint of each text as an unsigned 64-bit integer."""
    offsets, raw = c.blobs(column)
    out = np.zeros(len(column), np.uint64)
    digest = xxhash.xxh64_intdigest
    for first, last in c.slices(offsets):
        kept, starts, ends, per_row = c.word_slice(offsets, raw, first, last, lower=True)
        if not len(starts):
            continue
        room = c.room_of(per_row)
        total = np.repeat(per_row, per_row)
        begins = np.flatnonzero((room >= shingle) | ((room == total) & (total < shingle)))
        stops = ends[begins + np.minimum(room[begins], shingle) - 1]
        text = kept.tobytes()
        h = np.fromiter((digest(text[s:e], seed) for s, e in zip(starts[begins].tolist(), stops.tolist(), strict=True)), np.uint64, len(begins))
        row = np.repeat(np.arange(last - first), per_row)[begins]
        heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        n = np.diff(np.append(heads, len(row)))
        out[first + row[heads]] = majority(h, heads, n)
    return out


def majority(h: np.ndarray, heads: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each stretch of hashes the bits that are set in over half of them."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def distinct(row: np.ndarray, h: np.ndarray, times: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each hash of a row at most so often: rows that have any, hashes in order of row, first place and number of each row's."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    kept = np.ones(len(row), bool)
    kept[times:] = (row[times:] != row[:-times]) | (h[times:] != h[:-times])
    row, h = row[kept], h[kept]
    heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    return row[heads], h, heads, np.diff(np.append(heads, len(row)))


def shapes_of(column: pa.Array, shingle: int = NEAR_SHINGLE) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each text four numbers, an identity of its set of shingles, the fingerprint of its words and 128 bits of its shingles, and the set in order (32 bits each)."""
    offsets, raw = c.blobs(column)
    out = np.zeros((len(column), 4), np.uint64)
    sets = [np.zeros(0, np.uint32)] * len(column)
    for first, last in c.slices(offsets):
        kept, starts, ends, per_row = c.word_slice(offsets, raw, first, last, lower=True)
        if not len(starts):
            continue
        words, row = c.word_hashes(kept, starts, ends), np.repeat(np.arange(last - first), per_row)
        at, h, heads, n = distinct(row, words, WEIGHT)
        out[first + at, 1] = majority(h, heads, n)
        room = c.room_of(per_row)
        total = np.repeat(per_row, per_row)
        begins = np.flatnonzero((room >= shingle) | ((room == total) & (total < shingle)))
        grams, size = np.zeros(len(begins), np.uint64), np.minimum(room[begins], shingle)
        for k in range(shingle):
            have = k < size
            grams[have] += c.mix(words[begins[have] + k] + _PLACES[k % len(_PLACES)] * np.uint64(k // len(_PLACES) + 1))
        at, h, heads, n = distinct(row[begins], c.mix(grams))
        out[first + at, 0] = c.mix(np.add.reduceat(c.mix(h), heads) + n.astype(np.uint64))
        for k, salt in enumerate(_SALTS):
            out[first + at, 2 + k] = majority(c.mix(h ^ salt), heads, n)
        top = (h >> np.uint64(32)).astype(np.uint32)
        for i, own in zip(at.tolist(), np.split(top, heads[1:]), strict=True):
            sets[first + i] = own
    return out, sets


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets have a Jaccard similarity of at least ``least``; two empty ones are equal."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b))
    return both >= least * (len(a) + len(b) - both)


class Compare:
    """Comparisons of rows (key, one, two, piece, probe, node, print, and two numbers of bits or none).

    Without ``bits`` what passes is a link.  With them it is a candidate, to be compared exactly,
    and beside candidates (a, b, null) come the keys (null, null, key) of groups that gave stars alone.
    With ``rest``, a similarity, rows go on with (root, met, grams), and what stars may have left out is compared by the sets: links.
    """

    def __init__(self, reach: int, bits: int | None = None, rest: float | None = None):
        self.reach, self.bits, self.rest = reach, bits, rest

    def within(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs i, j pass the chain from their key's segment on, then the full check, then that of more bits; and unequal bits of these."""
        at = np.arange(len(i))
        x = (rows[i, 6] ^ rows[j, 6]).view(np.uint64)
        segment = rows[i, 0] >> BITS
        spent = np.zeros(len(x), np.uint8)
        for step in range(SEGMENTS):
            shift = (((segment + step) % SEGMENTS) * BITS).astype(np.uint64)
            spent = spent + np.bitwise_count((x >> shift) & np.uint64((1 << BITS) - 1))
            ok = spent <= (step + 1) * self.reach // SEGMENTS
            at, x, segment, spent = at[ok], x[ok], segment[ok], spent[ok]
        at = at[np.bitwise_count(x) <= self.reach]
        if self.bits is None:
            return at, np.zeros(len(at), np.int64)
        apart = np.bitwise_count((rows[i[at], 7:9] ^ rows[j[at], 7:9]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        ok = apart <= self.bits
        return at[ok], apart[ok]

    def forest(self, rows: np.ndarray, left: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect what is connected in one group; where ``left`` is mixed, only pairs across it count.  Two probes are no pair."""
        n = len(rows)
        _, label = np.unique(rows[:, 5], return_inverse=True)  # a node may lie in a group twice: at home, and probing
        home = rows[:, 4] == 0
        out = []
        mixed = not (left.all() or not left.any())
        for i in np.flatnonzero(home).tolist():
            apart = label != label[i]
            if mixed:
                apart &= left != left[i]
            others = np.flatnonzero(apart)
            if not len(others):
                continue
            near = others[self.within(rows, np.full(len(others), i), others)[0]]
            while len(near):
                j = near[0]
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
        return out

    def stars(self, rows: np.ndarray, left: np.ndarray) -> list[tuple[int, int]]:
        """Candidates of one group, each row with up to STARS hubs; where ``left`` is mixed, only pairs across it count.

        Hubs are rows at home, in order of their distance to the bits that most rows have.
        """
        mixed = not (left.all() or not left.any())
        bits = np.unpackbits(np.ascontiguousarray(rows[:, 7:9]).view(np.uint8), axis=1)
        order = (bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(rows))).sum(axis=1).argsort(kind="stable")
        out = []
        for side in (True, False) if mixed else (None,):
            tried = np.zeros(len(rows), np.int64)
            hubs = order[(rows[order, 4] == 0) & (side is None or left[order] == side)]
            for i in hubs.tolist():
                if side is None and tried[i] >= STARS:
                    continue
                open_ = (tried < STARS) & (rows[:, 5] != rows[i, 5])
                if side is not None:
                    open_ &= left != side
                others = np.flatnonzero(open_)
                if not len(others):
                    if side is not None:
                        break
                    continue
                at, apart = self.within(rows, np.full(len(others), i), others)
                near = others[at]
                out += [(i, j) for j in near.tolist()]
                tried[near] += 1
                tried[near[apart <= SURE_BITS]] = STARS
                if side is None:
                    tried[i] = STARS
        return out

    def every(self, rows: np.ndarray, left: np.ndarray) -> list[np.ndarray] | None:
        """All candidates of one group, or None where they are more than MOST a row; where ``left`` is mixed, only pairs across it count."""
        home, n = rows[:, 4] == 0, np.arange(len(rows))
        mixed = not (left.all() or not left.any())
        out, held = [], 0
        for i in np.flatnonzero(home).tolist():
            open_ = (~home | (n > i)) & (rows[:, 5] != rows[i, 5])  # two rows at home meet once
            if mixed:
                open_ &= left != left[i]
            others = np.flatnonzero(open_)
            if len(others) and len(at := self.within(rows, np.full(len(others), i), others)[0]):
                out.append(np.stack([np.full(len(at), i), others[at]], axis=1))
                held += len(at)
                if held > MOST * len(rows):
                    return None
        return out

    def crossing(self, rows: np.ndarray, grams: pa.ListArray, left: np.ndarray) -> list[tuple[int, int]]:
        """Links of one group that connect different roots, of all candidates of which one was a candidate before: a star leaves no others out."""
        root, met, home, n = rows[:, 9].copy(), rows[:, 10] > 0, rows[:, 4] == 0, np.arange(len(rows))
        if not met.any() or (root == root[0]).all():
            return []
        mixed = not (left.all() or not left.any())
        kinds, flat = np.unique(grams.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        size = grams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        own = np.zeros(len(kinds), bool)
        out = []
        for i in np.flatnonzero(home).tolist():
            open_ = (root != root[i]) & (~home | (n > i))  # two rows at home meet once
            if not met[i]:
                open_ &= met
            if mixed:
                open_ &= left != left[i]
            others = np.flatnonzero(open_)
            if not len(others) or not len(at := self.within(rows, np.full(len(others), i), others)[0]):
                continue
            near, mine = others[at], flat[begin[i] : begin[i] + size[i]]
            ends = np.cumsum(size[near])
            own[mine] = True
            hits = np.concatenate(([0], np.cumsum(own[flat[np.repeat(begin[near] - ends + size[near], size[near]) + np.arange(ends[-1])]])))
            own[mine] = False
            both = hits[ends] - hits[ends - size[near]]
            for j in near[both >= self.rest * (size[i] + size[near] - both)].tolist():
                if root[j] != root[i]:
                    out.append((i, j))
                    root[root == root[j]] = root[i]
        return out

    def small_forests(self, rows: np.ndarray, group: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
        """The same for many small groups at once, of candidates all: rows in order of group, probes last in each, compared at each distance."""
        pairs = []
        for d in range(1, int(sizes.max(initial=1))):
            i = np.flatnonzero((group[:-d] == group[d:]) & (rows[:-d, 4] == 0))
            i = i[self.within(rows, i, i + d)[0]]
            pairs += zip(i.tolist(), (i + d).tolist(), strict=True)
        if self.bits is not None:
            return pairs
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := root.get(v, v)) != v:
                root[v] = v = root.get(up, up)
            return v

        nodes, out = rows[:, 5].tolist(), []
        for i, j in pairs:
            if (a := find(nodes[i])) != (b := find(nodes[j])):
                root[max(a, b)] = min(a, b)
                out.append((i, j))
        return out

    def groups(self, rows: np.ndarray, grams: pa.ListArray | None = None) -> Iterator[pa.RecordBatch]:
        """Links (a, b) of nodes; rows in order of the first five columns, each distinct triple of the first three is one comparison."""
        if not len(rows):
            return
        heads = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))))
        sizes = np.diff(np.append(heads, len(rows)))
        edges: list[np.ndarray] = []

        def batch() -> pa.RecordBatch:
            e = np.concatenate(edges)
            edges.clear()
            ends = [pa.array(rows[e[:, 0], 5]), pa.array(rows[e[:, 1], 5])]
            if self.bits is None or grams is not None:
                return pa.RecordBatch.from_arrays(ends, names=["a", "b"])
            return pa.RecordBatch.from_arrays([*ends, pa.nulls(len(e), pa.int32())], names=["a", "b", "key"])

        starred: list[int] = []
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes) & (rows[:, 1] == rows[:, 2])
        at = np.flatnonzero(small)
        if len(at) and grams is None:
            found = self.small_forests(rows[at], np.repeat(np.arange(len(heads)), sizes)[at], np.minimum(sizes, SMALL))
            if found:
                edges.append(at[np.array(found)])
        held = 0
        for g in np.flatnonzero(sizes > 1):
            if small[heads[g]]:
                continue
            s = slice(heads[g], heads[g] + sizes[g])
            left = rows[s, 3] == rows[heads[g], 1]
            if grams is not None:
                found = self.crossing(rows[s], grams[s], left)
            elif self.bits is None:
                found = self.forest(rows[s], left)
            elif (all_ := self.every(rows[s], left)) is not None:
                edges += [e + heads[g] for e in all_]
                held += sum(map(len, all_))
                if held > 1 << 20:
                    yield batch()
                    held = 0
                continue
            else:
                found = self.stars(rows[s], left)
                starred.append(int(rows[heads[g], 0]))
            if found:
                edges.append(np.array(found) + heads[g])
        if edges:
            yield batch()
        if starred:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(starred), pa.int64()), pa.nulls(len(starred), pa.int64()), pa.array(starred, pa.int32())], names=["a", "b", "key"])

    def __call__(self, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array | None]] = []

        def groups() -> Iterator[pa.RecordBatch]:
            rows, grams = np.concatenate([r for r, _ in held]), [x for _, x in held]
            held.clear()
            yield from self.groups(rows, None if self.rest is None else pa.concat_arrays(grams))

        for part in parts:
            grams = None if self.rest is None else part.column(part.num_columns - 1)
            rows = np.stack([col.to_numpy(zero_copy_only=False).astype(np.int64) for col in part.columns[: None if grams is None else -1]], axis=1)
            if not len(rows):
                continue
            same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            tail = int(same.argmin()) if same.all() else len(rows) - int((~same[::-1]).argmax())
            if held and (held[0][0][0, :3] != rows[0, :3]).any():
                yield from groups()
            if same.all():
                held.append((rows, grams))
                continue
            held.append((rows[:tail], None if grams is None else grams[:tail]))
            yield from groups()
            held.append((rows[tail:], None if grams is None else grams[tail:]))
        if held:
            yield from groups()
        if self.rest is not None:
            c.trim()


def spread(parts: Iterator[pa.RecordBatch], probes: bool) -> Iterator[pa.RecordBatch]:
    """Rows (node, print, ...) once for each key: of its four segments and, if ``probes``, of their values with one bit more."""
    for whole in parts:
        for at in range(0, whole.num_rows, 8192):
            part = whole.slice(at, 8192)
            prints = part.column(1).to_numpy().view(np.uint64)
            rows, keys, probe = [], [], []
            for segment in range(SEGMENTS):
                v = ((prints >> np.uint64(segment * BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
                rows.append(np.arange(len(v)))
                keys.append(v + (segment << BITS))
                probe.append(np.zeros(len(v), bool))
                for bit in range(BITS if probes else 0):
                    i = np.flatnonzero(v >> bit & 1 == 0)
                    rows.append(i)
                    keys.append((v[i] | 1 << bit) + (segment << BITS))
                    probe.append(np.ones(len(i), bool))
            taken = part.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.concatenate(probe)), *taken.columns], names=["key", "probe", *part.schema.names])


def sets_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, grams) once for each of the written nodes, of rows (node, grams, ...); a sketch spares the other sets the shuffle."""
    cells = width(nodes.count())
    keys = lambda part: part.column(0).to_numpy().view(np.uint64)
    plane = sketch(nodes, lambda part: [np.repeat(keys(part), 2)], cells)

    def likely(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(repeated(plane.value, keys(part), cells)))
        c.trim()

    return rows.select("node", "grams").mapInArrow(likely, "node long, grams array<int>").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _dealt(keyed: DataFrame, large: DataFrame, own: list[str], how: str) -> DataFrame:
    """Rows once for each comparison (key, one, two); ``large`` has the pieces of keys."""
    dealt = keyed.join(F.broadcast(large), "key", how).withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")))
    # a group in one piece is one comparison; a row of a larger one goes to each pair of pieces it is in
    dealt = dealt.select("key", "piece", "probe", *own, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    return dealt.select("key", F.least("piece", "other").alias("one"), F.greatest("piece", "other").alias("two"), "piece", "probe", *own)


def _compared(dealt: DataFrame, compare: Compare, kind: str) -> DataFrame:
    return dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "probe").mapInArrow(compare, kind)


def links(shapes: DataFrame, block: int = BLOCK, reach: int = REACH, bits: int | None = None) -> DataFrame:
    """Links (a, b) that connect the nodes of distinct rows (node, print) that are near; with ``bits`` candidates of rows (node, print, s0, s1).

    With ``bits`` come the keys of groups that gave stars alone, as rows (null, null, key).
    """
    kind = ", ".join(f"{x} {k}" for x, k in shapes.dtypes)
    keyed = shapes.mapInArrow(lambda parts: spread(parts, reach >= SEGMENTS), f"key int, probe boolean, {kind}")
    # at most 4 * 65,536 keys exist, and only those of large groups are sent out
    large = keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("pieces"))
    return _compared(_dealt(keyed, large, shapes.columns, "left"), Compare(reach, bits), "a long, b long" if bits is None else "a long, b long, key int")


def rest_links(shapes: DataFrame, starred: DataFrame, rows: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between roots, of all candidates that the stars of the groups ``starred`` (key) may have left out.

    ``shapes`` has (node, print, s0, s1, root, met, size), ``rows`` the sets (node, grams).
    """
    own = shapes.columns[:-1]
    kind = ", ".join(f"{x} {k}" for x, k in shapes.dtypes)
    # at most 4 * 65,536 keys, as in links()
    keyed = shapes.mapInArrow(lambda parts: spread(parts, True), f"key int, probe boolean, {kind}").join(F.broadcast(starred), "key", "left_semi")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("count"), F.sum("size").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("met").alias("met"))
    pieces = F.greatest(F.ceil(F.col("count") / block), F.ceil(F.col("size") / HELD_GRAMS))
    large = sizes.where((F.col("count") > SMALL) & F.col("met") & (F.col("low") < F.col("high"))).select("key", pieces.alias("pieces"))
    dealt = c.written(_dealt(keyed, large, own, "inner"), "dealt")
    nodes = c.written(dealt.select("node").distinct(), "nodes")
    full = dealt.join(sets_of(rows, nodes), "node").select(*dealt.columns, "grams")
    out = c.written(_compared(full, Compare(NEAR_REACH, NEAR_BITS, least), "a long, b long"), "rest")
    c.forget(dealt, nodes)
    return out


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, print) of every row, and :func:`_roots` of them."""
    c.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1), shingle).view(np.int64))], names=["id", "print"])
        c.trim()

    rows = c.written(docs.select(id_col, text_col).mapInArrow(scan, f"id {kind}, print long"), "prints")
    return rows, _roots(rows, block)


def _roots(rows: DataFrame, block: int) -> DataFrame:
    """(print, least, root) of each distinct fingerprint: its least id, and the fingerprint that names its component."""
    classes = rows.groupBy("print").agg(F.min("id").alias("least"))
    linked = components(links(classes.select(F.col("print").alias("node"), "print"), block)).withColumnRenamed("node", "print")
    return classes.join(linked, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """(id, fingerprint, component_id) of every row; see the module's text."""
    rows, classes = _prints(docs, id_col, text_col, shingle, block)
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("print", "component_id")
    return rows.join(named, "print").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, least: float = NEAR, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, rid, node) of every row, and (node, root) of each set of shingles: roots name the groups of near-duplicates."""
    c.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), c.row_key(F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    names = ["node", "print", "s0", "s1"]

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                shapes, sets = shapes_of(part.column(2), shingle)
                size = np.array([len(x) for x in sets], np.int32)
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(np.ascontiguousarray(shapes[:, k]).view(np.int64)) for k in range(4)], pa.array(size), grams], names=["id", "rid", *names, "size", "grams"])
        c.trim()

    rows = c.written(rows.mapInArrow(scan, f"id {kind}, rid long, " + ", ".join(f"{x} long" for x in names) + ", size int, grams array<int>"), "shapes")
    classes = rows.groupBy("node").agg(*[F.first(x).alias(x) for x in [*names[1:], "size"]])
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x, y = part.column(2), part.column(3)
            ok = [similar(x[i].values.to_numpy().view(np.uint32), y[i].values.to_numpy().view(np.uint32), least) for i in range(part.num_rows)]
            yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    first = c.written(links(classes.select(*names), block, NEAR_REACH, NEAR_BITS), "first")
    starred = c.written(first.where("key is not null").select("key").distinct(), "starred")
    pairs = c.written(ordered(first), "pairs")
    c.forget(first)
    # the sets of the candidates alone, each once
    met = c.written(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "met")
    sets = c.written(sets_of(rows, met), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    linked = components(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))
    c.forget(sets, pairs)
    rooted = classes.join(linked, "node", "left").join(met.withColumn("met", F.lit(True)), "node", "left")
    rooted = c.written(rooted.select(*names, F.coalesce("root", "node").alias("root"), F.coalesce("met", F.lit(False)).alias("met"), "size"), "rooted")
    nodes = rooted.select("node", "root")
    if not starred.isEmpty():
        # what the stars left out, between groups that are not connected yet
        more = rest_links(rooted, starred, rows, least, block)
        if not more.isEmpty():
            root_of = lambda v: nodes.select(F.col("node").alias(v), F.col("root").alias(f"root_{v}"))
            joined = components(more.join(root_of("a"), "a").join(root_of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
            nodes = nodes.join(joined.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left").select("node", F.coalesce("least", "root").alias("root"))
        c.forget(more)
    c.forget(starred, met)
    return rows.select("id", "rid", "node"), nodes


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, least: float = NEAR, block: int = BLOCK) -> DataFrame:
    """The input with one row of each group of near-duplicates: of the smallest id, null being the largest; of rows that share it, one."""
    rows, nodes = near_components(docs, id_col, text_col, shingle, least, block)
    # combined by node before the join, so that a text of very many copies is one row in it
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("w")
    won = rows.groupBy("node").agg(first).join(nodes, "node").groupBy("root").agg(F.min("w").alias("w")).select(F.col("w.id").alias("w_id"), F.col("w.rid").alias("w_rid"))
    names = docs.columns
    own = [f"in_{i}" for i in range(len(names))]  # so that no name of the input meets one of ours
    row_id, text = own[names.index(id_col)], own[names.index(text_col)]
    marked = docs.toDF(*own).withColumn("w_key", c.row_key(F.col(text)))
    kept = marked.join(won, F.col(row_id).eqNullSafe(F.col("w_id")) & (F.col("w_key") == F.col("w_rid")), "left_semi")
    return kept.dropDuplicates([row_id, "w_key"]).select(*[F.col(o).alias(n) for o, n in zip(own, names, strict=True)])

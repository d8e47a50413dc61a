"""Track geometry: simplification, and the best of several routes for a journey."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import DEGREE_M
from tramline.operators.linking import cut_lineage, drop_tables


def simplified(points: list[tuple[float, float]], metres: float) -> list[tuple[float, float]]:
    """Douglas-Peucker over (lon, lat), without recursion: ends and bends of at least ``metres`` stay."""
    if len(points) < 3:
        return list(points)
    xy = np.array(points, float)
    xy = np.stack([xy[:, 0] * (math.cos(math.radians(points[0][1])) * DEGREE_M), xy[:, 1] * DEGREE_M], axis=1)
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    work = [(0, len(points) - 1)]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        d, p = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        length = float(d @ d)
        t = np.clip(p @ d / length, 0.0, 1.0) if length else np.zeros(len(p))
        away = np.hypot(*(p - t[:, None] * d).T)
        at = int(away.argmax())
        if away[at] >= metres:
            keep[a + 1 + at] = True
            work += [(a, a + 1 + at), (a + 1 + at, b)]
    return [points[i] for i in np.flatnonzero(keep)]


def simplify(tracks: DataFrame, metres: float = 5.0) -> DataFrame:
    """(track_id, points) with points simplified, each track by itself."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            own = [[{"lon": x, "lat": y} for x, y in simplified([(q["lon"], q["lat"]) for q in pts], metres)] for pts in p.points]
            yield pd.DataFrame({"track_id": p.track_id, "points": own})

    return tracks.select("track_id", "points").mapInPandas(run, tracks.select("track_id", "points").schema)


def best_routes(candidates: DataFrame) -> DataFrame:
    """Of (journey_id, route, extra) the route with the fewest extra stops, ties to the least route."""
    w = Window.partitionBy("journey_id").orderBy("extra", "route")
    return candidates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def project(xy: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the distance to a track (metres, both in metres) and the way along it to the nearest place."""
    a, d = xy[:-1], np.diff(xy, axis=0)
    length = np.hypot(*d.T)
    upto = np.concatenate(([0.0], np.cumsum(length)))
    rel = points[:, None, :] - a[None]
    t = np.clip((rel * d).sum(-1) / np.where(length > 0, length**2, 1.0), 0.0, 1.0)
    away = np.hypot(*np.moveaxis(rel - t[..., None] * d, -1, 0))
    k = away.argmin(axis=1)
    on = np.arange(len(points))
    return away[on, k], upto[k] + t[on, k] * length[k]


def metres_of(points: list) -> np.ndarray:
    """(lon, lat) in metres, longitude scaled at the first point."""
    lonlat = np.array([(p["lon"], p["lat"]) for p in points], float).reshape(-1, 2)
    scale = math.cos(math.radians(lonlat[0, 1])) if len(lonlat) else 1.0
    return lonlat * np.array([DEGREE_M * scale, DEGREE_M])


def journey_positions(rows: DataFrame) -> DataFrame:
    """Where vehicles are on their journeys: (journey_id, leg, progress, distance_m).

    rows: (journey_id, lon, lat, legs array<array<struct<lon, lat>>>, track
    array<struct<lon, lat>>).  The leg whose track is nearest counts, ties to the
    first; without a track of any leg the whole journey's, as leg -1; without both
    no row.  Progress is the part of the track that lies behind, 0 to 1.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for journey, lon, lat, legs, track in zip(p.journey_id, p.lon, p.lat, p.legs, p.track, strict=True):
                options = [(i, t) for i, t in enumerate(legs if legs is not None else []) if t is not None and len(t) > 1]
                options = options or ([(-1, track)] if track is not None and len(track) > 1 else [])
                best = None
                for i, t in options:
                    line = metres_of([*t, {"lon": lon, "lat": lat}])
                    away, along = project(line[:-1], line[-1:])
                    total = np.hypot(*np.diff(line[:-1], axis=0).T).sum()
                    if best is None or away[0] < best[2]:
                        best = (i, float(along[0] / total) if total else 0.0, float(away[0]))
                if best:
                    out.append((journey, *best))
            yield pd.DataFrame(out, columns=["journey_id", "leg", "progress", "distance_m"]).astype({"leg": "int32", "progress": float, "distance_m": float})

    kind = rows.schema["journey_id"].dataType.simpleString()
    return rows.select("journey_id", "lon", "lat", "legs", "track").mapInPandas(run, f"journey_id {kind}, leg int, progress double, distance_m double")


def segments(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, steps and lengths of a track's segments, and the way along it to each point."""
    d = np.diff(xy, axis=0)
    length = np.hypot(*d.T)
    return xy[:-1], d, length, np.concatenate(([0.0], np.cumsum(length)))


def candidates(line: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places of a track's segments to one stop that lie within reach: distances and ways along, in order along the track."""
    a, d, length, upto = line
    rel = at - a
    t = np.clip((rel * d).sum(-1) / np.where(length > 0, length**2, 1.0), 0.0, 1.0)
    away = np.hypot(*(rel - t[:, None] * d).T)
    k = np.flatnonzero(away <= reach)
    return away[k], upto[k] + t[k] * length[k]


def least_before(total: np.ndarray, along: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each way in ``to`` the first of the least totals among places strictly before it (``along`` in order), and that total; infinity where there is none."""
    least = np.minimum.accumulate(total)
    fresh = np.concatenate(([True], least[1:] < least[:-1]))
    where = np.maximum.accumulate(np.where(fresh, np.arange(len(total)), 0))
    n = np.searchsorted(along, to, "left")
    last = np.maximum(n - 1, 0)
    return where[last], np.where(n > 0, least[last], np.inf)


def ordered_snaps(away: np.ndarray, along: np.ndarray, reach: float) -> np.ndarray | None:
    """Of candidates (stops by places: distance, way along) one for each stop, ways strictly increasing, with the least sum of distances."""
    options = []
    for far, way in zip(away, along, strict=True):
        k = np.flatnonzero(far <= reach)
        k = k[np.argsort(way[k], kind="stable")]
        options.append((far[k], way[k]))
    return snapped(iter(options))


def snapped(options: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray | None:
    """The same of each stop's candidates within reach, in order along the track; stops are looked at as long as an order is possible."""
    ways, back, total = [], [], np.zeros(0)
    for i, (away, along) in enumerate(options):
        if i and len(along):
            k, via = least_before(total, ways[-1], along)
            back.append(k)
            total = via + away
        else:
            total = away
        if not np.isfinite(total).any():
            return None
        ways.append(along)
    at = [int(total.argmin())]
    for k in reversed(back):
        at.append(int(k[at[-1]]))
    at.reverse()
    return np.array([w[j] for w, j in zip(ways, at, strict=True)])


_POINT = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
_SPAN = pa.struct([("head", _POINT), ("first", pa.int32()), ("inner", pa.int32()), ("tail", _POINT)])


def spans(lonlat: np.ndarray, upto: np.ndarray, snaps: np.ndarray, overlap: float) -> list[dict]:
    """The stretch between each two ways along a track: its ends, and the first and number of the track's points between them."""
    s, e = np.maximum(0.0, snaps[:-1] - overlap), np.minimum(upto[-1], snaps[1:] + overlap)
    first, after = np.searchsorted(upto, s, "right"), np.searchsorted(upto, e, "left")
    ends = [[{"lon": float(x), "lat": float(y)} for x, y in zip(np.interp(m, upto, lonlat[:, 0]), np.interp(m, upto, lonlat[:, 1]), strict=True)] for m in (s, e)]
    return [{"head": h, "first": int(f), "inner": max(0, int(n - f)), "tail": t} for h, f, n, t in zip(ends[0], first, after, ends[1], strict=True)]


def split_legs(rows: DataFrame, reach: float = 200.0, overlap: float = 5.0) -> DataFrame:
    """Cut each journey's track at its stops: (journey_id, legs array<array<struct<lon, lat>>>).

    rows: (journey_id, stops array<struct<lon, lat>>, track array<struct<lon, lat>>).
    Stops snap to segments within ``reach`` metres, in order along the track, by the
    least sum of distances; each leg goes ``overlap`` metres beyond its stops.  Where
    no such order exists every leg keeps the whole track.

    Python gives where each leg begins and ends, not its points: legs are made of the
    track's own array, so a whole track is not copied for each leg.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            n_legs, found = [], []
            for stops, track in zip(p.column(1).to_pylist(), p.column(2).to_pylist(), strict=True):
                n = 0 if stops is None else max(0, len(stops) - 1)
                n_legs.append(n)
                if track is None or len(track) < 2 or not n:
                    found.append(None)
                    continue
                xy = metres_of([*track, *stops])
                line = segments(xy[: len(track)])
                snaps = snapped(candidates(line, at, reach) for at in xy[len(track) :])
                lonlat = np.array([(q["lon"], q["lat"]) for q in track], float)
                found.append(None if snaps is None else spans(lonlat, line[3], snaps, overlap))
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(2), pa.array(n_legs, pa.int32()), pa.array(found, pa.list_(_SPAN))], names=["journey_id", "track", "n", "spans"])

    kind, point = rows.schema["journey_id"].dataType.simpleString(), "struct<lon: double, lat: double>"
    got = rows.select("journey_id", "stops", F.col("track").cast(f"array<{point}>").alias("track")).mapInArrow(run, f"journey_id {kind}, track array<{point}>, n int, spans array<struct<head: {point}, first: int, inner: int, tail: {point}>>")
    cut = F.transform("spans", lambda s: F.concat(F.array(s["head"]), F.slice("track", s["first"] + 1, s["inner"]), F.array(s["tail"])))
    none = F.array().cast(f"array<{point}>")
    whole = F.when(F.size(F.coalesce("track", none)) < 2, none).otherwise(F.col("track"))
    legs = F.when(F.col("n") == 0, F.array().cast(f"array<array<{point}>>")).otherwise(F.coalesce(cut, F.array_repeat(whole, F.col("n"))))
    return got.select("journey_id", legs.cast(f"array<array<{point}>>").alias("legs"))


def cheapest(edges: dict[int, list[tuple[int, float]]], place: dict[int, tuple[float, float]], start: int, goal: int) -> tuple[float, list[int]] | None:
    """The cheapest way over a graph by A*, the straight line being the least that is left; ties to lesser nodes."""
    left = lambda v: math.hypot(place[v][0] - place[goal][0], place[v][1] - place[goal][1])
    queue, best, before = [(left(start), start)], {start: 0.0}, {}
    done = set()
    while queue:
        _, v = heapq.heappop(queue)
        if v == goal:
            way = [v]
            while way[-1] != start:
                way.append(before[way[-1]])
            return best[v], way[::-1]
        if v in done:
            continue
        done.add(v)
        for w, cost in edges.get(v, []):
            if (to := best[v] + cost) < best.get(w, math.inf):
                best[w], before[w] = to, v
                heapq.heappush(queue, (to + left(w), w))
    return None


#: Nodes and edges of a rail graph that are sent to every task; a larger one is searched by rounds of joins.
GRAPH_ROWS = 2_000_000
#: Tracks of yards and sidings cost so many times their length.
SIDE_COST = 4.0


def routes(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = GRAPH_ROWS) -> DataFrame:
    """(origin, destination, cost_m, nodes) of the cheapest way over a rail graph, no row without a way.

    nodes: (node, lon, lat); edges: (a, b, service), undirected, ``service`` saying
    whether it is a yard or siding.  A graph of up to ``most`` rows is sent out and
    searched by A*; a larger one is neither collected nor sent out (:func:`ways_by_rounds`).
    """
    # in one direction, each pair once, the main line before a siding
    ends = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.coalesce("service", F.lit(False)).alias("side"))
    links = cut_lineage(ends.groupBy("a", "b").agg(F.min("side").alias("side")))
    first = nodes.where("node is not null").orderBy("node").select("lat").first()
    scale = math.cos(math.radians(first.lat if first else 0.0)) * DEGREE_M
    placed = nodes.select("node", (F.col("lon") * scale).alias("x"), (F.col("lat") * DEGREE_M).alias("y"))
    if nodes.limit(most + 1).count() + links.count() > most:
        return ways_by_rounds(pairs, placed, links)
    xy = {r.node: (r.x, r.y) for r in placed.collect()}
    near: dict[int, list[tuple[int, float]]] = {}
    for r in links.collect():
        if r.a in xy and r.b in xy:
            m = math.hypot(xy[r.a][0] - xy[r.b][0], xy[r.a][1] - xy[r.b][1]) * (SIDE_COST if r.side else 1.0)
            near.setdefault(r.a, []).append((r.b, m))
            near.setdefault(r.b, []).append((r.a, m))
    drop_tables(links)
    graph = pairs.sparkSession.sparkContext.broadcast((near, xy))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, where = graph.value
        for p in parts:
            got = [(a, b, cheapest(known, where, a, b) if a in where and b in where else None) for a, b in zip(p.origin, p.destination, strict=True)]
            yield pd.DataFrame([(a, b, *g) for a, b, g in got if g], columns=["origin", "destination", "cost_m", "nodes"])

    return pairs.select("origin", "destination").distinct().mapInPandas(run, "origin long, destination long, cost_m double, nodes array<long>")


def ways_by_rounds(pairs: DataFrame, placed: DataFrame, links: DataFrame) -> DataFrame:
    """The same over a graph of any size: from each origin, costs that got less in a round are passed on over their edges in the next.

    placed: (node, x, y) in metres; links: (a, b, side), each once.  It ends when no
    cost gets less.  Of ways of equal cost that with the fewest nodes counts, ties to
    the least node before; so ways back end.  There are as many rounds as the
    longest of the cheapest ways has edges, each a table in the shared folder.
    """
    asked = cut_lineage(pairs.select("origin", "destination").where("origin is not null and destination is not null").distinct())
    one, two = (placed.select(F.col("node").alias(v), F.col("x").alias(f"x{v}"), F.col("y").alias(f"y{v}")) for v in "ab")
    cost = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")) * F.when(F.col("side"), SIDE_COST).otherwise(1.0)
    costs = links.join(one, "a").join(two, "b").select("a", "b", cost.alias("m"))
    both = cut_lineage(costs.union(costs.select("b", "a", "m")).select(F.col("a").alias("node"), F.col("b").alias("to"), "m"))
    start = asked.select("origin", F.col("origin").alias("node")).distinct().join(placed.select("node"), "node", "left_semi")
    # a label is (cost, edges so far, node before); it is its order as well
    label = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("before"))
    known = cut_lineage(start.select("origin", "node", label.alias("l")))
    fresh = known
    while True:
        on = F.struct((F.col("l.cost") + F.col("m")).alias("cost"), (F.col("l.hops") + 1).alias("hops"), F.col("node").cast("long").alias("before"))
        found = fresh.join(both, "node").select("origin", F.col("to").alias("node"), on.alias("n")).groupBy("origin", "node").agg(F.min("n").alias("n"))
        after = cut_lineage(found.join(known, ["origin", "node"], "left").where("l is null or n < l").select("origin", "node", F.col("n").alias("l")))
        if after.isEmpty():
            drop_tables(after, both, *([] if fresh is known else [fresh]))
            break
        more = cut_lineage(known.join(after.select("origin", "node"), ["origin", "node"], "left_anti").unionByName(after))
        drop_tables(known, *([] if fresh is known else [fresh]))
        known, fresh = more, after
    # back from the destinations, a node a round
    way = asked.join(known.withColumnRenamed("node", "destination"), ["origin", "destination"])
    way = cut_lineage(way.select("origin", "destination", F.col("l.cost").alias("cost_m"), F.array(F.col("destination").cast("long")).alias("nodes"), F.col("l.before").alias("at")))
    done = []
    while True:
        done.append(way.where("at is null").drop("at"))
        open_ = way.where("at is not null")
        if open_.isEmpty():
            break
        before = known.select("origin", F.col("node").alias("at"), F.col("l.before").alias("next"))
        way = cut_lineage(open_.join(before, ["origin", "at"]).select("origin", "destination", "cost_m", F.concat(F.array("at"), "nodes").alias("nodes"), F.col("next").alias("at")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("origin").cast("long").alias("origin"), F.col("destination").cast("long").alias("destination"), "cost_m", "nodes")

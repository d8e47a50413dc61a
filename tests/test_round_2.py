"""Cases that the findings of the second round name."""

import duckdb

from tramline.plans import REGISTRY, SQL


def same_as_sql(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df = REGISTRY[name](spark, str(folder))
    got = con.execute(SQL[name])
    columns = [c[0] for c in got.description]
    theirs = sorted(map(str, (tuple(r) for r in got.fetchall())))
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == theirs
    return theirs


def test_seeds_go_over_one_edge(spark):
    """At sf0.1 edges of a group lead on to walks and back: seeds are the first edge alone."""
    assert len(same_as_sql(spark, "pl_round", "/root/testdata/sf0.1", ["supplier", "lineitem"])) > 2


def test_trains_beyond_six_digits(spark, tmp_path):
    """Journeys 123456, 1234567 and 1234568 are shown alike, but are trains of their own."""
    con = duckdb.connect()
    con.execute(f"copy (select k as o_orderkey, 1::bigint as o_custkey, s as o_orderstatus, 1.0 as o_totalprice, timestamp '1998-03-02' as o_orderdate, 'x' as o_orderpriority from (values (123456::bigint, 'O'), (1234567, 'F'), (1234568, 'O'), (35, 'F'), (36, 'O'), (9000000, 'O')) v(k, s)) to '{tmp_path}/orders.parquet'")
    con.execute(f"copy (select o_orderkey as l_orderkey, i::bigint as l_partkey, (i + o_orderkey) % 10 as l_suppkey, i::int as l_linenumber from '{tmp_path}/orders.parquet', range(1, 4) r(i)) to '{tmp_path}/lineitem.parquet'")
    theirs = same_as_sql(spark, "src_cif_stp", tmp_path, ["orders", "lineitem"])
    assert sum("'123456'" in x for x in theirs) == 2
    same_as_sql(spark, "src_cif_journey", tmp_path, ["orders", "lineitem"])
    same_as_sql(spark, "src_cif_mca", tmp_path, ["orders", "lineitem"])


def test_snaps_equal_a_search_of_all_choices():
    """Ways strictly increasing with the least sum of distances, ties to the first place along the track."""
    import itertools
    import random

    import numpy as np

    from tramline.operators.tracks import least_before, snapped

    rnd = random.Random(5)
    for _ in range(300):
        options = []
        for _ in range(rnd.randint(1, 4)):
            along = sorted(float(rnd.randrange(8)) for _ in range(rnd.randint(0, 5)))
            options.append((np.array([float(rnd.randrange(1, 4)) for _ in along]), np.array(along)))
        ways = [c for c in itertools.product(*[range(len(a)) for a, _ in options]) if all(options[i][1][x] < options[i + 1][1][y] for i, (x, y) in enumerate(zip(c, c[1:], strict=False)))]
        best = min((sum(options[i][0][j] for i, j in enumerate(c)) for c in ways), default=None)
        got = snapped(iter(options))
        assert (got is None) == (best is None)
        if got is not None:
            assert (np.diff(got) > 0).all()
            assert sum(min(a[w == x]) for (a, w), x in zip(options, got, strict=True)) == best
    where, total = least_before(np.array([2.0, 1.0, 1.0]), np.array([0.0, 1.0, 1.0]), np.array([0.0, 1.0, 2.0]))
    assert total.tolist() == [np.inf, 2.0, 1.0] and where.tolist()[1:] == [0, 1]


def test_legs_of_a_track_that_cannot_be_cut_share_it(spark):
    """600 stops at one place: no order exists, and each of 599 legs is the whole track, which is given once."""
    from pyspark.sql import functions as F

    from tramline.operators.tracks import split_legs

    line = "array<struct<lon: double, lat: double>>"
    track = [(0.0001 * (i // 600), 51.0) for i in range(3000)]
    rows = spark.createDataFrame([(1, track[:600], track)], f"journey_id long, stops {line}, track {line}").withColumn("stops", F.slice("stops", 1, 600))
    df = split_legs(rows)
    plan = df._jdf.queryExecution().analyzed().toString()
    # what Python gives back are spans: no array of legs
    assert "spans" in plan
    got = df.select(F.size("legs").alias("n"), F.size(F.element_at("legs", -1)).alias("last"), F.forall("legs", lambda x: F.size(x) == 3000).alias("all")).first()
    assert tuple(got) == (599, 3000, True)



def test_ways_over_a_graph_too_large_to_send_out(spark):
    """By rounds of joins the costs are those of A*, and each way is one of edges that add up to its cost."""
    import math
    import random

    import pytest
    from pyspark.sql import functions as F

    from tramline.operators.tracks import routes

    rnd = random.Random(8)
    place = {i: (rnd.random() * 0.1, 51 + rnd.random() * 0.1) for i in range(60)}
    ways = [(*rnd.sample(range(50), 2), rnd.random() < 0.3) for _ in range(90)] + [(50, 51, False), (3, 3, False), (4, 99, False), (1, 2, True), (2, 1, False)]
    nodes = spark.createDataFrame([(k, *v) for k, v in place.items()], "node long, lon double, lat double")
    edges = spark.createDataFrame(ways, "a long, b long, service boolean")
    pairs = spark.range(61).select(F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 7, 50, 98)])).alias("origin"), F.col("id").alias("destination"))
    sent = {(r.origin, r.destination): r for r in routes(pairs, nodes, edges).collect()}
    rounds = {(r.origin, r.destination): r for r in routes(pairs, nodes, edges, most=10).collect()}
    assert rounds.keys() == sent.keys() and (50, 51) in rounds and (0, 51) not in rounds
    scale = math.cos(math.radians(place[0][1]))
    least = {}
    for a, b, side in ways:
        if a in place and b in place:
            m = math.hypot((place[a][0] - place[b][0]) * scale, place[a][1] - place[b][1]) * 111_320.0 * (4.0 if side else 1.0)
            least[a, b] = least[b, a] = min(m, least.get((a, b), math.inf))
    for k, r in rounds.items():
        assert r.cost_m == pytest.approx(sent[k].cost_m) and (r.nodes[0], r.nodes[-1]) == k
        assert sum(least[x] for x in zip(r.nodes, r.nodes[1:], strict=False)) == pytest.approx(r.cost_m)


def test_near_duplicates_of_a_large_group_are_those_of_all_candidates(spark):
    """Many texts that are nearly similar, each with one that is: no star of a large group may leave that link out."""
    import random

    import numpy as np
    import pyarrow as pa

    from tramline.llm.simhash import NEAR, NEAR_BITS, NEAR_REACH, Compare, near_components, shapes_of, similar

    rnd = random.Random(12)
    base = [f"w{rnd.randrange(5000)}" for _ in range(110)]

    def edited(words, n):
        new = list(words)
        for at in rnd.sample(range(110), n):
            new[at] = f"w{rnd.randrange(5000)}"
        return new

    # half of them pass the filter with each other but are not similar, and each has one that is
    texts = [edited(base, 2) for _ in range(100)]
    texts += [edited(t, 1) for t in texts]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows, nodes = near_components(docs)
    got = {r.id: r.root for r in rows.join(nodes, "node").collect()}
    shapes, sets = shapes_of(pa.array([" ".join(t) for t in texts]))
    s = shapes.view(np.int64)
    root = list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    # a pair meets where a segment of the words' fingerprint differs by one bit at most and its chain holds
    for i in range(len(texts)):
        for j in range(i):
            near = any(
                len(Compare(NEAR_REACH, NEAR_BITS).within(np.array([[k << 16, 0, 0, 0, 0, n, s[n, 1], s[n, 2], s[n, 3]] for n in (i, j)]), np.array([0]), np.array([1]))[0])
                and bin((int(shapes[i, 1]) ^ int(shapes[j, 1])) >> (16 * k) & 0xFFFF).count("1") <= 1
                for k in range(4)
            )
            if near and similar(sets[i], sets[j], NEAR):
                root[find(i)] = find(j)
    want = {}
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    mine = {}
    for i, r in got.items():
        mine.setdefault(r, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values())) and len(want) < 150


def test_texts_are_held_in_bounded_runs():
    """Long texts are runs by themselves, short ones run together; batches come in short stretches, whole."""
    import pyarrow as pa

    from tramline.llm.toxicity import HELD_CHARS, HELD_ROWS, pieces, runs

    texts = ["a" * (HELD_CHARS + 5), "b", "c" * HELD_CHARS, "d", "e"]
    got = list(runs(texts))
    assert [t for own in got for t in own] == texts and [len(own) for own in got] == [1, 1, 1, 2] and list(runs([])) == []
    part = pa.RecordBatch.from_arrays([pa.array(range(HELD_ROWS * 2 + 3))], names=["n"])
    own = [p.column(0).to_pylist() for p in pieces(part)]
    assert [n for p in own for n in p] == list(range(HELD_ROWS * 2 + 3)) and max(map(len, own)) == HELD_ROWS

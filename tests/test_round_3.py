"""Whole results of the third round: plans against all plans."""

import random

from test_literals import CALL, HOUR, WALK, ride


def test_the_last_of_many_feeders_is_taken(spark):
    """four buses reach one train; with few plans asked for, the bus that leaves last is still the one."""
    from tramline.operators.planner import plan

    calls = spark.createDataFrame([c for i in range(4) for c in ride(i, 1, 2, 9 * HOUR + 600 * i, 9 * HOUR + 600 * i + 300)] + ride(9, 2, 3, 10 * HOUR, 11 * HOUR), CALL)
    (got,) = plan(calls, spark.createDataFrame([], WALK), 1, 3, 8 * HOUR, count=1).collect()
    assert (got.rides, got.start, got.arrival) == (2, 9 * HOUR + 1800, 11 * HOUR)


def test_plans_are_those_of_all_plans(spark):
    """random networks with walks, other names of a place and a limit of waiting, against every plan there is."""
    from tramline.operators.planner import EQUIVALENT, plan

    for seed, count in ((0, 50), (1, 2)):
        rnd = random.Random(seed)
        calls = []
        for j in range(30):
            t = rnd.randrange(0, 6000)
            for i, s in enumerate(rnd.sample(range(10), rnd.randint(2, 5))):
                calls.append((j, i + 1, s, t, t + 30, j % 4))
                t += rnd.randrange(100, 900)
        edges = [(a, b, rnd.randrange(30, 400), rnd.choice(["Nearby", "SameStopGroup"]), None, None, None, None) for a, b in (rnd.sample(range(10), 2) for _ in range(14))]
        edges += [(a, b, 60, "Timed", rnd.randrange(4), rnd.randrange(4), None, None) for a, b in (rnd.sample(range(10), 2) for _ in range(6))]
        longest, access, egress = 1500, [(0, 100), (1, 40)], {8: 50, 9: 200}

        def moved(labels, kinds, walks):
            return [(b, t + s, last, walked or walks, route if e[5] is None else e[5], off + s if last is None else off) for p, t, last, walked, route, off in labels for e in edges for a, b, s in [e[:3]] if a == p and kinds(e[3]) and (e[4] is None or (last is not None and last % 4 == e[4]))]

        def walked_on(labels):
            same, far = lambda k: k in EQUIVALENT, lambda k: k not in EQUIVALENT
            here = labels + moved(labels, same, False)
            gone = moved([x for x in here if not x[3]], far, True)
            return here + gone + moved(gone, same, False)

        # (stop, time, last, walked, to_route, walk before the first ride), and beside it when the plan starts
        found, state = set(), [(x, None) for x in walked_on([(p, 500 + w, None, True, None, w) for p, w in access])]
        for k in (1, 2, 3):
            after = {((s2, arr, j, False, None, off), dep - off if start is None else start) for (p, t, last, _, route, off), start in state for j, i, s, _, dep, serv in calls if s == p and t <= dep <= t + longest and route in (None, serv) for j2, i2, s2, arr, _, _ in calls if j2 == j and i2 > i}
            state = {(y, start) for x, start in after for y in walked_on([x])}
            found |= {(k, start, x[1] + egress[x[0]]) for x, start in state if x[0] in egress and not x[3]}
        best = [x for x in found if not any(r <= x[0] and s >= x[1] and t <= x[2] and (r, s, t) != x for r, s, t in found)]
        best = sorted(best, key=lambda x: (x[2], x[0], -x[1]))
        places = lambda rows: spark.createDataFrame(list(rows), "stop_id long, walk_s long")
        got = plan(spark.createDataFrame(calls, CALL), spark.createDataFrame(edges, WALK), places(access), places(egress.items()), 500, rides=3, longest=longest, count=count).collect()
        assert [(r.rides, r.start, r.arrival) for r in got] == best[:count], (seed, count)


def test_candidates_of_large_groups_come_at_once(spark):
    """pipeline: a large group with few candidates gives them all in the first comparison; one with many is named for the second."""
    from tramline.llm.simhash import MOST, NEAR_BITS, NEAR_REACH, links

    rnd = random.Random(7)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    near = lambda v: v ^ (1 << rnd.randrange(16, 64))
    for clusters, size in ((40, 5), (1, 60)):
        rows = []
        for k in range(clusters):
            middle, s0, s1 = rnd.getrandbits(64) >> 16 << 16, rnd.getrandbits(64), rnd.getrandbits(64)
            rows += [(k * size + i, signed(near(middle)), signed(s0), signed(s1)) for i in range(size)]
        got = links(spark.createDataFrame(rows, "node long, print long, s0 long, s1 long"), reach=NEAR_REACH, bits=NEAR_BITS).collect()
        pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in got if r.key is None}
        every = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if a // size == b // size}
        named = {r.key for r in got if r.key is not None}
        assert 0 in named if len(every) > MOST * len(rows) else not named
        assert named or pairs == every

"""Earliest arrivals against a plain search over (address, time)."""

import random

import pytest

from provenant.operators.arrival import earliest_arrival

SCHEMA = "from_address string, to_address string, value double, block long"


def plain(rows, sources):
    """{address: (arrival, hops)} by relaxing all transfers until nothing changes."""
    rows = [(a, b, t) for a, b, v, t in rows if None not in (a, b, t) and a != b and v > 0 and b not in sources]
    at = dict.fromkeys(sources)
    changed = True
    while changed:
        changed = False
        for a, b, t in rows:
            if a in at and (at[a] is None or t > at[a]) and (b not in at or t < at[b]):
                at[b] = t
                changed = True
    hops, level = dict.fromkeys(sources, 0), 0
    while level in hops.values():
        level += 1
        for a, b, t in rows:
            if hops.get(a) == level - 1 and t == at.get(b, -1) and (at[a] is None or t > at[a]):
                hops.setdefault(b, level)
    return {v: (at[v], hops[v]) for v in at}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_arrivals_equal_plain_relaxation(spark, seed):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice([0.0, 1.0, 2.0]), rng.choice([None, *range(30)])) for _ in range(220)]
    rows += [(f"c{i}", f"c{i + 1}", 1.0, i) for i in range(20)] + [("c3", "c9", 1.0, 2), (None, "n1", 1.0, 1), ("n0", None, 1.0, 1)]
    sources = ["n0", "n7", "c0", "nowhere"]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.address: (r.arrival, r.hops) for r in earliest_arrival(frame, spark.createDataFrame([(s,) for s in [*sources, None]], "address string")).collect()}
    assert got == plain(rows, sources)


def test_no_transfers_and_no_sources(spark):
    frame = spark.createDataFrame([("a", "b", 1.0, 1)], SCHEMA)
    some = spark.createDataFrame([("a",)], "address string")
    assert [tuple(r) for r in earliest_arrival(frame.limit(0), some).collect()] == [("a", None, 0)]
    assert earliest_arrival(frame, some.limit(0)).count() == 0

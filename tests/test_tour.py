"""Euler tours, subtree totals, path lengths and shapes against plain walks."""

import random
from collections import Counter, deque
from decimal import Decimal

import pytest

from provenant.operators import tour


def forest_of(seed, n, chain=0):
    """parent of each node: random trees, a star and a chain."""
    rng = random.Random(seed)
    parent = {}
    for v in range(1, n):
        if rng.random() > 0.08:
            parent[v] = rng.choice([rng.randrange(v), max(0, v - 1), 0 if v < n // 2 else n // 2])
    for v in range(n, n + chain):
        parent[v] = v - 1 if v > n else 0
    return parent


def frame(spark, parent, parts=3):
    return spark.createDataFrame([(str(v), None if p is None else str(p)) for v, p in parent.items()], "activated_address string, gas_provider string").repartition(parts)


def walk(parent):
    """{node: (root, depth)} and children lists of nodes that have an edge."""
    kids = {}
    for v, p in parent.items():
        kids.setdefault(p, []).append(v)
    place = {}
    for v in {*parent, *parent.values()}:
        path = [v]
        while path[-1] in parent:
            path.append(parent[path[-1]])
        place[v] = (path[-1], len(path) - 1)
    return place, kids


def below(kids, v):
    out, todo = [], [v]
    while todo:
        out.append(todo.pop())
        todo += kids.get(out[-1], [])
    return out


@pytest.mark.parametrize("seed,n,chain", [(1, 40, 0), (2, 90, 60), (3, 8, 300)])
def test_totals_and_paths_equal_plain_walks(spark, seed, n, chain):
    parent = forest_of(seed, n, chain)
    place, kids = walk(parent)
    amounts = {v: Decimal(v * 37 % 1000) / 100 for v in place if v % 5}
    t = tour.euler_tour(frame(spark, parent))
    rows = {int(r.node): r for r in t.collect()}
    assert {v: (int(r.root), r.depth) for v, r in rows.items()} == place
    given = spark.createDataFrame([(str(v), a) for v, a in amounts.items()], "node string, amount decimal(18,2)")
    totals = {int(r.node): r for r in tour.subtree_totals(t, given).collect()}
    paths = {int(r.node): r for r in tour.path_metrics(t).collect()}
    near = {v: [*kids.get(v, []), *([parent[v]] if v in parent else [])] for v in place}
    for v in place:
        sub = below(kids, v)
        assert (rows[v].size, totals[v].subtree_size) == (len(sub), len(sub))
        assert totals[v].subtree_amount == float(sum(amounts.get(x, 0) for x in sub))
        assert totals[v].subtree_depth_amount == float(sum(amounts.get(x, 0) * place[x][1] for x in sub))
        far, todo = {v: 0}, deque([v])
        while todo:
            x = todo.popleft()
            for y in near[x]:
                if y not in far:
                    far[y] = far[x] + 1
                    todo.append(y)
        assert paths[v].distance_sum == sum(far.values()) and rows[v].tree_size == len(far)
        if sum(far.values()):
            assert paths[v].closeness == (len(far) - 1) / sum(far.values())
        parts, seen = [], {v}
        for start in near[v]:  # what is left without v
            part, todo = 0, [start]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    part += 1
                    todo += near[x]
            parts.append(part)
        assert paths[v].betweenness == (sum(parts) ** 2 - sum(p * p for p in parts)) / 2
    trees = {int(r.root): r for r in tour.tree_paths(t).collect()}
    for root, r in trees.items():
        own = [v for v in place if place[v][0] == root]
        mean = sum(paths[v].distance_sum for v in own) / (len(own) * (len(own) - 1))
        assert r.mean_path_length == pytest.approx(mean) and r.max_betweenness == max(paths[v].betweenness for v in own)


def test_shapes_equal_canonical_forms(spark):
    parent = forest_of(5, 120, 10)
    place, kids = walk(parent)

    def form(v):
        return tuple(sorted(form(c) for c in kids.get(v, [])))

    got = {int(r.node): r.shape for r in tour.shapes(tour.euler_tour(frame(spark, parent))).collect()}
    names = {}
    for v in place:
        names.setdefault(form(v), set()).add(got[v])
    assert all(len(s) == 1 for s in names.values()) and len({next(iter(s)) for s in names.values()}) == len(names)
    assert set(got) == set(place) and Counter(got.values()).most_common(1)[0][1] > 20


def test_cycles_own_providers_and_empty_tables(spark):
    t = tour.euler_tour(frame(spark, {1: 2, 2: 1, 3: 1, 4: 4, 5: None, 7: 6}))
    assert {(r.node, r.root, r.first, r.last) for r in t.collect()} == {("6", "6", 0, 3), ("7", "6", 1, 2)}
    none = tour.euler_tour(frame(spark, {1: 1}).limit(0))
    assert none.count() == tour.path_metrics(none).count() == tour.tree_paths(none).count() == tour.shapes(none).count() == 0

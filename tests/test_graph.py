"""Golden forests and walks, with values worked out by the formulas in plain Python."""

import math
import random

import pytest

from provenant import session
from provenant.operators import forest, funding, walks


def edges_of(spark, *rows):
    full = [(*r[:2], float(r[2]) if len(r) > 2 else 1.0, i, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "gas_provider string, activated_address string, amount double, block long, tx long")


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "address string")


def metrics(spark, edges, labeled=()):
    out = forest.tree_metrics(forest.node_table(edges_of(spark, *edges), names(spark, *labeled)))
    return {r.root: r for r in out.collect()}


def test_star(spark):
    m = metrics(spark, [("r", "a", 1), ("r", "b", 2), ("r", "c", 5)])["r"]
    assert (m.tree_size, m.max_depth, m.branching_factor, m.star_like_ratio, m.total_gas) == (4, 1, 0.75, 0.25, 8.0)
    want = -sum(x / 8 * math.log2(x / 8) for x in (1, 2, 5))
    assert math.isclose(m.gas_distribution_entropy, want, rel_tol=1e-12) and m.gini_coefficient == 0.0
    mean = 8 / 3
    m2, m3 = (sum((x - mean) ** p for x in (1, 2, 5)) / 3 for p in (2, 3))
    assert math.isclose(m.gas_distribution_skewness, m3 / m2**1.5, rel_tol=1e-9)
    nodes = forest.node_table(edges_of(spark, ("r", "a", 1), ("r", "b", 2), ("r", "c", 5)), names(spark))
    assert math.isclose(forest.gini(nodes).first().gini_true, (2 * (1 + 4 + 15) - 4 * 8) / (3 * 8))


def test_entropy_of_one_dominating_amount(spark):
    """One amount that dwarfs the others leaves the small entropy's digits alone."""
    m = metrics(spark, [("r", "a", 1e12), ("r", "b", 1), ("r", "c", 2)])["r"]
    total = 1e12 + 3
    want = -sum(x / total * math.log2(x / total) for x in (1e12, 1, 2))
    assert math.isclose(m.gas_distribution_entropy, want, rel_tol=1e-9) and want < 1e-9


def test_chain_and_mixed_depth(spark):
    assert metrics(spark, [("r", "a"), ("a", "b"), ("b", "c")])["r"].pure_chain_length == 4
    m = metrics(spark, [("r", "a"), ("a", "b"), ("r", "c")])["r"]
    assert (m.balance_factor, m.pure_chain_length, m.breadth_factor) == (1, 0, 4 / 3)


def test_labeled_nodes_cut_edges_but_keep_gas(spark):
    m = metrics(spark, [("L", "r", 3), ("r", "a", 1)], ["L"])
    assert set(m) == {"r"} and m["r"].sparsity == 1.0 and m["r"].total_gas == 1.0
    assert metrics(spark, [("r", "L"), ("L", "a")], ["L"]) == {}


def test_degenerate_amounts(spark):
    m = metrics(spark, [("r", "a", 0)])["r"]
    assert (m.total_gas, m.gas_distribution_entropy, m.gas_distribution_skewness, m.leaf_provision_proportion) == (0, 0, 0, 0)
    m = metrics(spark, [("r", "a", 1), ("r", "b", 1)])["r"]
    assert (m.gas_distribution_entropy, m.gas_distribution_skewness) == (1.0, 0.0)


def test_self_loops_and_cycles(spark):
    assert metrics(spark, [("a", "a")]) == {}
    roots = forest.roots_and_depths(forest.tree_edges(edges_of(spark, ("b", "a"), ("a", "b"), ("a", "c")), names(spark)))
    assert all(r.in_cycle and r.root is None for r in roots.collect())
    walked = walks.chain_walk(names(spark, "a", "z"), edges_of(spark, ("b", "a"), ("a", "b")), names(spark), names(spark))
    assert {r.addr: (r.chain_length, r.in_cycle) for r in walked.collect()} == {"a": (None, True), "z": (0, False)}


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_equal_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    n = 60
    parent = {f"n{i}": f"n{rng.randrange(i)}" for i in range(1, n) if rng.random() < 0.9} | {"n0": "n0"}
    inter, labeled = (set(rng.sample([f"n{i}" for i in range(n)], 15)) for _ in range(2))
    addresses = [f"n{i}" for i in range(n)]
    df = walks.chain_walk(names(spark, *addresses), edges_of(spark, *[(p, c) for c, p in parent.items()]), names(spark, *inter), names(spark, *labeled))
    got = {r.addr: (r.chain_length, r.interactors_in_chain) for r in df.collect()}
    for a in addresses:
        length = count = 0
        at = a
        while True:
            count += at in inter
            up = parent.get(at)
            if up is None or up == at:
                break
            length += 1
            if up in labeled:
                break
            at = up
        assert got[a] == (length, count), a


def test_first_funding_ties_drop_the_address(spark):
    rows = [("a", "x", 1, 5, 5, 1), ("a", "y", 1, 6, 6, 2), ("b", "x", 1, 5, 5, 3), ("b", "y", 2, 5, 5, 4), ("c", "x", 0, 1, 1, 5), ("c", "y", 1, 2, 2, 6)]
    df = spark.createDataFrame(rows, "to_address string, from_address string, value int, ts int, block int, tx int")
    assert {r.activated_address: r.gas_provider for r in funding.first_funding(df).collect()} == {"a": "x", "c": "y"}


def test_closure_ends_on_cycles(spark):
    e = edges_of(spark, ("b", "a"), ("c", "b"), ("a", "c"), ("q", "p"))
    got = funding.provision_closure(e, names(spark, "a"))
    assert {r.activated_address for r in got.collect()} == {"a", "b", "c"}


def test_closure_stops_at_its_level(spark):
    e = edges_of(spark, *[(f"n{i}", f"n{i + 1}") for i in range(12)])
    for level, n in ((0, 1), (3, 4), (500, 12)):
        assert funding.provision_closure(e, names(spark, "n12"), level).count() == n


def test_running_star_flag(spark):
    rows = spark.createDataFrame([("p1", "a", 1.0), ("p2", "a", 1.0), ("p2", "b", 1.0), ("p3", "a", 1.0)], "gas_provider string, activated_address string, amount double")
    got = {(r.gas_provider, r.activated_address): r.provider_is_star_like_attack for r in funding.star_features(rows, names(spark)).collect()}
    assert got == {("p1", "a"): 0, ("p2", "a"): 1, ("p2", "b"): 1, ("p3", "a"): 1}


def reach(edges, seeds, levels):
    """Edges out of what ``seeds`` reach, by plain levels."""
    out, seen, now = {}, set(seeds), set(seeds)
    for p, c in edges:
        out.setdefault(c, []).append(p)
    for _ in range(levels):
        now = {p for c in now for p in out.get(c, ())} - seen
        seen |= now
    return {(p, c) for p, c in edges if c in seen}


@pytest.mark.parametrize("levels", [0, 1, 2, 6, 7, 63, 64, 500])
def test_closure_by_doubling_keeps_the_bound(spark, levels):
    """Chains of 600 levels are cut exactly where single steps cut them, in few rounds."""
    rng = random.Random(levels)
    edges = [(f"c{i + 1}", f"c{i}") for i in range(600)] + [("c600", "c600"), ("x", "y"), ("y", "x")]
    edges += [(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 60)]
    seeds = ["c0", "c37", "x", "n59", "n42", "other"]
    got = funding.provision_closure(edges_of(spark, *edges), names(spark, *seeds), levels)
    assert {(r.gas_provider, r.activated_address) for r in got.collect()} == reach(edges, seeds, levels)


def test_closure_rounds_are_bounded(spark, monkeypatch):
    written = []
    monkeypatch.setattr(funding, "materialize", lambda df, tag: written.append(tag) or session.materialize(df, tag))
    edges = [(f"c{i + 1}", f"c{i}") for i in range(600)]
    assert funding.provision_closure(edges_of(spark, *edges), names(spark, "c0")).count() == 501
    assert written.count("reached") <= 20 and written.count("jump") <= 10


def test_closure_with_several_providers(spark):
    rng = random.Random(2)
    edges = sorted({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)})
    for levels in (1, 3, 50):
        got = funding.provision_closure(edges_of(spark, *edges), names(spark, "n1", "n2"), levels)
        assert {(r.gas_provider, r.activated_address) for r in got.collect()} == reach(edges, ["n1", "n2"], levels)

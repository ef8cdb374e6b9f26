"""The feature matrix: every feature is there, worked out from all amounts of a tree."""

import math
from collections import defaultdict

from provenant import plans
from provenant.operators import forest
from provenant.operators.master import FEATURES
from provenant.plans import proxies

SF = "/root/testdata/sf0.001"


def entropy(amounts):
    total = sum(amounts)
    return -sum(a / total * math.log2(a / total) for a in amounts if a > 0) if total else 0.0


def skewness(amounts):
    if not amounts:
        return 0.0
    mean = sum(amounts) / len(amounts)
    m2, m3 = (sum((a - mean) ** k for a in amounts) / len(amounts) for k in (2, 3))
    return m3 / m2**1.5 if m2 > 1e-12 else 0.0


def real_gini(amounts):
    n, total = len(amounts), sum(amounts)
    return sum(abs(a - b) for a in amounts for b in amounts) / (2 * n * total) if total else 0.0


def test_master_has_every_feature(spark):
    """Entropy, skewness and inequality of a member's tree are in its row and equal plain Python over the tree's nodes."""
    df = plans.queries()["master_features"](spark, SF)
    assert [c for c in df.columns if c in FEATURES] == FEATURES and len(FEATURES) == 63
    p = proxies.Proxies(spark, SF)
    nodes, trees = {}, defaultdict(list)
    for r in forest.node_table(p.first_edge, p.labeled).collect():
        nodes[r.node] = r
        trees[r.root].append(r)
    rows = df.collect()
    members = [r for r in rows if r.addr in nodes and nodes[r.addr].depth >= 1]
    assert members and len({r.addr for r in rows}) == len(rows)
    for r in rows:
        tree = trees[nodes[r.addr].root] if r.addr in nodes and nodes[r.addr].depth >= 1 else []
        given, leaves = [x.gas for x in tree if x.depth and x.gas > 0], [x.gas for x in tree if x.leaf]
        got = (r.gas_distribution_entropy, r.leaf_gas_distribution_entropy, r.gas_distribution_skewness, r.leaf_gas_distribution_skewness, r.gini_true)
        want = (entropy(given), entropy(leaves), skewness(given), skewness(leaves), real_gini(given))
        assert all(math.isclose(a, b, abs_tol=1e-5) for a, b in zip(got, want, strict=True)), r.addr
        assert r.gini_coefficient == 0.0  # as inherited: shares sum to 1
    assert any(r.gas_distribution_entropy and r.leaf_gas_distribution_entropy for r in rows)
    assert any(r.gas_distribution_skewness for r in rows) and any(r.gini_true for r in rows)


def test_inherited_gini_of_amounts(spark):
    """Computed from the amounts: 0 for many shares whose sum is not 1 in doubles, for one amount and for none."""
    rows = [("r", f"n{i}", 0.1 * i + 0.01) for i in range(1, 400)] + [("s", "t", 3.0), ("u", "v", 0.0)]
    edges = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "gas_provider string, activated_address string, amount double, block long, tx long")
    nodes = forest.node_table(edges, spark.createDataFrame([], "address string"))
    out = {r.root: r for r in forest.tree_metrics(nodes).select("root", "gini_coefficient", "total_gas").collect()}
    assert {k: v.gini_coefficient for k, v in out.items()} == {"r": 0.0, "s": 0.0, "u": 0.0}
    alone = forest.tree_metrics(nodes).select("gini_coefficient")._jdf.queryExecution().optimizedPlan().toString()
    assert "_given" in alone  # from the total of the amounts, not stated

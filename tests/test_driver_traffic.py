"""Rounds of graph operators send the driver no tables that grow with the input."""

import random

from pyspark.sql import DataFrame

from provenant.operators import arrival, communities


def _plans(monkeypatch, module, run):
    """The plans of the tables that ``run`` writes."""
    seen, write = [], module.materialize

    def spy(df: DataFrame, tag: str) -> DataFrame:
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(module, "materialize", spy)
    return run(), seen


def test_louvain_joins_are_shuffled(spark, monkeypatch):
    rng = random.Random(1)
    edges = spark.createDataFrame([(i, rng.randrange(i), 1) for i in range(1, 60)], "a long, b long, w long")
    whole = communities.louvain(edges, levels=1, rounds=3)
    dealt, plans = _plans(monkeypatch, communities, lambda: communities.louvain(edges, levels=1, rounds=3, few=0))
    assert not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)
    assert dealt[1] == whole[1] and sorted(dealt[0].collect()) == sorted(whole[0].collect())


def test_arrival_joins_are_shuffled(spark, monkeypatch):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.randrange(40), rng.randrange(40), 1.0, rng.randrange(30)) for _ in range(300)], "from_address long, to_address long, value double, block long")
    sources = spark.createDataFrame([(0,), (7,)], "address long")
    want = sorted(arrival.earliest_arrival(rows, sources).collect(), key=str)
    monkeypatch.setattr(arrival, "FEW", -1)
    got, plans = _plans(monkeypatch, arrival, lambda: arrival.earliest_arrival(rows, sources))
    assert not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)
    assert sorted(got.collect(), key=str) == want

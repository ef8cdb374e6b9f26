"""Edges that one task holds take no rounds: the driver schedules no joins for them."""

import random

import pytest
from pyspark.sql import DataFrame

from provenant.llm import components as components_module
from provenant.llm.components import components


@pytest.mark.parametrize("held", [components_module.HELD, 16])
def test_rounds_follow_only_where_tasks_share_the_edges(spark, monkeypatch, held):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 1)]
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    monkeypatch.setattr(components_module, "HELD", held)
    plans, write = [], components_module.materialize

    def spy(df: DataFrame, tag: str) -> DataFrame:
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(components_module, "materialize", spy)
    found = components(spark.createDataFrame(edges, "u long, v long").repartition(6))
    assert sorted(map(tuple, found.collect())) == sorted(least.items())
    if held > len(edges):
        assert len(plans) == 2 and not any("Join" in p for p in plans)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    else:
        assert len(plans) > 2

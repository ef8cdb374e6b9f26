"""Transactions are counted in tasks of bounded rows."""

import random

import pytest
from compare import spark_rows

from provenant.operators import behaviour


@pytest.mark.parametrize("way", ["out", "in"])
def test_transactions_are_dealt_by_their_number(spark, monkeypatch, way):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.randrange(50), i % 7, i, i % 10) for i in range(600)]
    txs = spark.createDataFrame(rows, "from_address long, to_address long, value long, fee long, block long, ts long")
    own = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "addr long")
    features, key, other = (behaviour.outbound_features, 0, 1) if way == "out" else (behaviour.inbound_features, 1, 0)
    monkeypatch.setattr(behaviour, "TASK_ROWS", 20)
    df = features(txs, own, 8, len(rows))
    plan = df._jdf.queryExecution().executedPlan().toString()
    name = "from_address" if way == "out" else "to_address"
    assert f"{name}#" in plan and ", 30), REPARTITION_BY_NUM" in plan  # 600 rows, 20 a task
    assert "Join" not in plan[plan.index("REPARTITION_BY_NUM") :]  # addresses join what is counted
    kept = [r for r in rows if r[key] is not None and r[key] % 2 == 0 and (r[5] <= 8 if way == "out" else r[5] < 8)]
    got = {r[0]: (r[1], r["out_degree" if way == "out" else "in_degree"]) for r in df.collect()}
    assert got == {a: (sum(r[key] == a for r in kept), len({r[other] for r in kept if r[key] == a} - {None})) for a in {r[key] for r in kept}}
    assert spark_rows(df) == spark_rows(features(txs, own, 8))

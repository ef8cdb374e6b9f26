"""Every registered query against its SQL, and plan checks."""

import math
import sys
from pathlib import Path

import duckdb
import pytest
from compare import oracle, spark_rows

from provenant import plans, session
from provenant.operators.master import FEATURES

plans_queries = sys.modules["provenant.plans.queries"]

SF = "/root/testdata/sf0.001"
SINKS = {"chunks", "overlap", "one", "none", "lines", "table", "pointers"}


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    folder = Path(session.shared_dir(spark).removeprefix("file:"))
    before = {f.name for f in folder.iterdir()}
    df = plans.queries()[name](spark, SF)
    assert spark_rows(df) == oracle(SF, plans.oracle_sql()[name])
    # what is left of the tables it wrote is what the result reads; sources and sinks keep the folders they are about
    left = {f.name for f in folder.iterdir()} - before
    assert {x for x in left if x.rsplit("-", 1)[0] not in SINKS} <= session.read_by(df)


@pytest.mark.parametrize("name", ["first_funding", "provider_star", "msg_features", "behaviour_master", "exchange_pivot", "pr_curve"])
def test_plans_stay_native(spark, name):
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_messages_are_shuffled_once(spark):
    """Both blocks come from one pass: the scan of the messages is there once, and no distinct count multiplies its rows."""
    from provenant.plans import proxies

    p = proxies.Proxies(spark, SF)
    messages = session.materialize(p.messages, "messages")
    plan = plans_queries.behaviour.message_blocks(messages, proxies.HOME_SOURCE, proxies.HOME_DESTINATION)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" not in plan and "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # by address, kind and id, then by address


def test_filters_and_columns_reach_the_scan(spark):
    plan = plans.queries()["scan_filter_zero"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan


def test_training_scores(spark, monkeypatch, tmp_path):
    """The evaluation of written scores equals SQL over the same file."""
    monkeypatch.setattr(plans_queries, "QUERY_ROUNDS", 3)
    scored = session.materialize(plans.queries()["train_gbt"](spark, SF), "scored")
    rows = scored.collect()
    assert rows and all(0 <= r.score <= 1 and r.prediction == int(r.score > 0.5) for r in rows)
    assert {r.split for r in rows} == {"test", "validation"}
    monkeypatch.setattr(plans_queries, "_scored", lambda p: scored)
    got = {(r.split, r.threshold, r["class"]): r for r in plans.queries()["train_evaluation"](spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW s AS SELECT * FROM read_parquet('{scored._materialized_path.removeprefix('file://').removeprefix('file:')}/*.parquet')")
    for split in ("validation", "test"):
        auc, accuracy, n = con.execute(f"""SELECT (SELECT avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)
            FROM s a, s b WHERE a.split = '{split}' AND b.split = '{split}' AND a.label = 1 AND b.label = 0),
            avg((prediction = label)::INT), count(*) FROM s WHERE split = '{split}'""").fetchone()
        assert math.isclose(got[split, "best", "auc"].f1, auc, rel_tol=1e-9)
        assert math.isclose(got[split, "0.5", "accuracy"].f1, accuracy, rel_tol=1e-9) and got[split, "0.5", "accuracy"].support == n
    assert got["validation", "best", "1"].f1 >= got["validation", "0.5", "1"].f1


def test_importance_counts_splits(spark, monkeypatch):
    monkeypatch.setattr(plans_queries, "QUERY_ROUNDS", 12)
    seen = []
    fitted = plans_queries.fitted
    monkeypatch.setattr(plans_queries, "fitted", lambda p: seen.append(fitted(p)) or seen[-1])
    rows = plans.queries()["topk_importance"](spark, SF).collect()
    counts = {}
    for tree in seen[0][1].trees:
        for f in tree.feature:
            if f >= 0:
                counts[FEATURES[f]] = counts.get(FEATURES[f], 0) + 1
    want = sorted(counts.items(), key=lambda x: (-x[1], FEATURES.index(x[0])))[:20]
    assert [(r.feature, r.splits) for r in rows] == want and len(FEATURES) == 63 and len(want) == 20


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())

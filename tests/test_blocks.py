"""Message blocks: both ways to make an address's row, and what is shuffled for it."""

import random

import pytest
from compare import spark_rows

from provenant.operators import behaviour
from provenant.session import materialize

SCHEMA = "sender_wallet string, source_chain string, destination_chain string, project string, source_contract long, destination_contract long, swap_usd decimal(18,2), drop_usd decimal(18,2), tx_hash long, ts timestamp_ntz"


@pytest.fixture(scope="module")
def messages(spark):
    rng, rows = random.Random(5), []
    for i in range(3000):
        who = "hot" if i % 2 else rng.choice([None, *(f"a{j}" for j in range(60))])
        few = lambda n: rng.choice([None, *range(n)])
        chain = lambda: rng.choice([None, "h", "b", "c"])
        rows.append((who, chain(), chain(), rng.choice([None, "p", "q"]), few(9), few(30), few(50), few(5), few(400), None if i % 11 == 0 else i * 1000))
    frame = spark.createDataFrame(rows, SCHEMA.replace("decimal(18,2)", "long").replace("timestamp_ntz", "long")).repartition(5)
    kinds = {"swap_usd": "decimal(18,2)", "drop_usd": "decimal(18,2)"}
    frame = frame.withColumns({c: frame[c].cast(k) for c, k in kinds.items()}).selectExpr("* EXCEPT (ts)", "timestamp_seconds(ts) :: timestamp_ntz AS ts")
    return materialize(frame, "messages")


def test_crowded_addresses_have_the_same_rows(spark, messages):
    blocks = lambda crowded: behaviour.message_blocks(messages, "h", "b", crowded)
    few, many, mixed = (spark_rows(blocks(n)) for n in (10**9, 0, 1000))
    assert few == many == mixed and len(few[1]) == 61
    # 1000: the address with half of the messages alone is dealt by its ids
    plan = lambda n: blocks(n)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan(1000) and "Union" not in plan(10**9)


def test_a_message_is_dealt_once(spark, messages):
    """Two narrow rows of a message, by address, not one for each of its ids with all measures."""
    plan = behaviour.message_blocks(messages, "h", "b")._jdf.queryExecution().executedPlan().toString()
    first = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line][-1]
    assert "half" in first and "kind" not in plan

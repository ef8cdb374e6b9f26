"""First funding in keyed state against the batch operator."""

import datetime as dt
import random
from decimal import Decimal
from pathlib import Path

import pytest

from provenant.operators.funding import first_funding
from provenant.streaming import stateful

SCHEMA = "to_address string, from_address string, value decimal(18,2), ts timestamp, block long, tx long"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def history(seed, n):
    rng = random.Random(seed)
    rows = [(f"a{rng.randrange(25)}", f"p{rng.randrange(6)}", Decimal(rng.choice([0, 1, 2, 5])), at(m := rng.randrange(12)), m + rng.randrange(2) * 100, i) for i in range(n)]
    return [*rows, (None, "p", Decimal(1), at(0), 1, n), ("a1", "p", Decimal(9), None, 1, n + 1), ("late", None, Decimal(3), at(1), 1, n + 2)]


def edges(frame):
    return sorted(tuple(r) for r in frame.select("activated_address", "gas_provider", "amount", "ts", "block", "tx").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_in_any_order_and_after_restarts(spark, tmp_path, monkeypatch, seed):
    """Batches come shuffled, each in a query of its own that starts from the checkpoint; folded folders stay few."""
    monkeypatch.setattr(stateful, "FOLD", 3)
    rows = history(seed, 160)
    random.Random(seed).shuffle(rows)
    folder = f"{tmp_path}/in"
    for i in range(8):
        spark.createDataFrame(rows[i::8], SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/*")
        stateful.write_changes(stateful.first_funding_changes(stream), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        if i in (0, 4, 7):
            so_far = spark.createDataFrame([r for j in range(i + 1) for r in rows[j::8]], SCHEMA).filter("to_address IS NOT NULL AND ts IS NOT NULL")
            assert edges(stateful.current_edges(spark, f"{tmp_path}/out")) == edges(first_funding(so_far))
    assert len([p for p in Path(f"{tmp_path}/out").iterdir() if p.is_dir()]) <= 3


def test_answers_become_final_behind_the_watermark(spark, tmp_path):
    batches = [
        [("a", "x", Decimal(1), at(10), 1, 1), ("b", "x", Decimal(1), at(30), 3, 2)],
        [("a", "y", Decimal(1), at(5), 0, 3), ("c", "z", Decimal(1), at(60), 6, 4)],
        [("c", "z", Decimal(1), at(61), 6, 5)],
        [("a", "w", Decimal(1), at(1), 0, 6), ("b", "w", Decimal(1), at(90), 9, 7)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        changes = stateful.first_funding_changes(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"), late="30 minutes")
        stateful.write_changes(changes, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {(r.to_address, r.final): r.first.from_address for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["a", True] == "y"  # what came within 30 minutes counts, what came after does not
    assert got["b", False] == "x" and got["c", False] == "z" and ("c", True) not in got

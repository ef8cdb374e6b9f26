"""A round of line dedup numbers its ranks in one sort: the driver schedules few stages, however many rounds there are."""

from pyspark.sql import DataFrame

from provenant.llm import line_dedup


def test_ranks_are_ordered_and_numbered_in_one_sort(spark, make, monkeypatch):
    text = "\n".join(f"line {i * i % 7}" for i in range(12))
    rows = line_dedup.keyed(make(text, "other\n" + text, text + "\nlast"))
    plans, write = [], line_dedup.materialize

    def spy(df: DataFrame, tag: str) -> DataFrame:
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(line_dedup, "materialize", spy)
    ids = line_dedup.line_ids(line_dedup.once(rows))
    rounds = line_dedup.rank_rounds(ids, 3)
    assert len(rounds) == 4  # 1, 2, 4 and 8 lines; no 16 are there
    assert not any("SinglePartition" in p for p in plans)
    assert sum(p.count("Exchange ") for p in plans) <= 8 * len(rounds)
    # places in order of the ranks of 4 lines are in order of the ids of these lines
    line = {(r.k, r.p): r.r for r in ids.collect()}
    four = rounds[2].collect()
    assert len(four) > 9
    heads = sorted((r.r, [line[r.k, r.p + i] for i in range(4)]) for r in four)
    assert [h for _, h in heads] == sorted(h for _, h in heads)
    assert len({r for r, _ in heads}) == len({tuple(h) for _, h in heads})

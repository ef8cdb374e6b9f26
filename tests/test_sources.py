"""Readers, sinks, learning helpers and the stream."""

import datetime as dt

import pytest

from provenant import schemas, session, sources
from provenant.operators import cleaning, learning, metrics, numbering, progress
from provenant.streaming.first_funding import current_edges, event_window_counts, first_funding_stream


def test_csv_directory(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TO_ADDRESS,CEX_IN_COUNT,DEX_IN_COUNT\nx,1,2\n")
    (tmp_path / "b.csv").write_text("TO_ADDRESS,CEX_IN_COUNT,DEX_IN_COUNT\ny,3,\n")
    (tmp_path / "readme.txt").write_text("no")
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "c.csv").write_text("TO_ADDRESS,CEX_IN_COUNT,DEX_IN_COUNT\nz,9,9\n")
    df = sources.read_csv_directory(spark, str(tmp_path), schemas.EXCHANGE)
    assert df.columns == ["to_address", "cex_in_count", "dex_in_count"]
    assert sorted(tuple(r) for r in df.collect()) == [("x", 1, 2), ("y", 3, None)]


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dex_in_count,To_Address,cex_in_count\n2,x,1\n")
    (tmp_path / "b.csv").write_text('\ufeffto_address,"own, more",cex_in_count\ny,"a, b",3\n')
    (tmp_path / "c.csv").write_text("to_address\nz\n")
    (tmp_path / "d.csv").write_text("")
    df = sources.read_csv_directory(spark, str(tmp_path), schemas.EXCHANGE)
    assert sorted(tuple(r) for r in df.collect()) == [("x", 1, 2), ("y", 3, None), ("z", None, None)]
    every = sources.read_csv_directory(spark, str(tmp_path))
    assert set(every.columns) == {"to_address", "cex_in_count", "dex_in_count", "own, more"}
    assert {r.to_address: r["own, more"] for r in every.collect()} == {"x": None, "y": "a, b", "z": None}
    ordered = sources.read_csv_directory(spark, str(tmp_path), schemas.EXCHANGE, load_order="at").orderBy("at")
    assert [r.to_address for r in ordered.collect()] == ["x", "y", "z"]
    assert [tuple(r) for r in sources.read_csv_file(spark, str(tmp_path / "a.csv"), schemas.EXCHANGE).collect()] == [("x", 1, 2)]
    assert sources.read_csv_directory(spark, str(tmp_path), schemas.EXCHANGE, glob="*.none").count() == 0
    with pytest.raises(FileNotFoundError):
        sources.read_csv_file(spark, str(tmp_path / "e.csv"))


def test_pointers_are_rejected(spark, tmp_path):
    (tmp_path / "a.csv").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:00\nsize 1\n")
    for read in (lambda: sources.read_csv_directory(spark, str(tmp_path), schemas.EXCHANGE), lambda: sources.read_line_set(spark, str(tmp_path))):
        with pytest.raises(sources.InvalidExtractError):
            read()
    assert [r.is_pointer for r in sources.pointer_files(spark, str(tmp_path)).collect()] == [True]


def test_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "address string")
    sources.write_lines(df, f"{tmp_path}/out")
    again = sources.read_line_set(spark, f"{tmp_path}/out", glob="*.txt")
    assert {r.address for r in again.collect()} == {"a", "b", "c"}
    (tmp_path / "x.csv").write_text(" q \r\nq\nr\n")
    assert {r.address for r in sources.read_line_set(spark, str(tmp_path)).collect()} == {"q", "r"}


def test_csv_and_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 2)], "to_address string, cex_in_count long, dex_in_count long")
    sources.write_csv(df, f"{tmp_path}/out", single_file=True)
    assert sources.read_csv_directory(spark, f"{tmp_path}/out", schemas.EXCHANGE).collect() == df.collect()
    sources.replace_table(df, "kept_for_a_while", days_to_live=14)
    assert spark.table("kept_for_a_while").count() == 1


def test_key_sets_and_literals(spark):
    a = spark.createDataFrame([("x",), ("y",)], "ADDR string")
    b = spark.createDataFrame([("y",), (None,)], "Address string")
    assert {r.address for r in sources.key_sets([(a, "ADDR"), (b, "Address")]).collect()} == {"x", "y", None}
    assert sources.literal_set(spark, ["A", "a"], lower=True).count() == 1


def test_null_is_different_from_a_value(spark):
    df = spark.createDataFrame([(None,), ("0x0",), ("a",)], "addr string")
    assert {r.addr for r in cleaning.exclude_value(df, "addr", "0x0").collect()} == {None, "a"}
    raw = spark.createDataFrame([("a", "1000000000000000000"), ("b", "bad")], "a string, v string")
    assert [r.v for r in cleaning.clean_edges(raw, "a", "v", "0x0").orderBy("a").collect()] == [1.0, None]


def test_numbers_are_global_and_dense(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 1009 AS x")
    rows = numbering.number_rows(df, ["x", "id"], "n").orderBy("x", "id").collect()
    assert [r.n for r in rows] == list(range(1000))


def test_running_sums_equal_a_plain_loop(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 1009 AS x", "id % 7 AS y")
    want = 0
    for r in numbering.running_sums(df, ["x"], ["y"]).orderBy("x").collect():
        want += r.y
        assert r.upto_y == want


def test_curves_of_distinct_scores(spark):
    rows = [(i * 37 % 1000 / 1000, int(i * 7919 % 1009 < 300 + i * 37 % 1000 // 4)) for i in range(1000)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(df).first().auc - want) < 1e-12
    best = metrics.best_f1_threshold(df).first()
    f1 = lambda t: 2 * sum(s >= t for s in pos) / (sum(s >= t for s, _ in rows) + len(pos))
    top = max(map(f1, {s for s, _ in rows}))
    assert abs(best.f1 - top) < 1e-12 and best.threshold == min(s for s, _ in rows if abs(f1(s) - top) < 1e-12)
    plan = metrics.pr_curve(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Subquery")[0] or "_p#" in plan


def test_progress_log(spark, tmp_path):
    log = progress.ProgressLog(spark, f"file://{tmp_path}/log", 10)
    first, last = log.step("a", 4), log.step("b", 6)
    assert first[4] > 0 and last[4] == 0
    assert [(r.step, r.done, r.total) for r in log.rows().collect()] == [("a", 4, 10), ("b", 10, 10)]
    assert progress.time_left(0, 10, 5) is None


def test_intermediate_tables_end_with_their_block(spark):
    with session.scratch() as keep:
        a, b = session.materialize(spark.range(3), "a"), keep(session.materialize(spark.range(4), "b"))
        assert a.count() == 3
    assert b.count() == 4 and a._materialized_path not in session._WRITTEN
    session.release(b)
    assert b._materialized_path not in session._WRITTEN


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "local-cluster[2,1,1024]"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError):
        session.shared_dir(Session)


def test_event_windows_in_a_stream(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(at(0, 5), "a", 1.0), (at(0, 50), "a", 2.0), (at(1, 5), "b", 3.0), (at(3, 0), "a", 0.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    counts = event_window_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    query = counts.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.window.start.hour, r.event_type, r.n, r.total) for r in spark.table("windows").collect()) == [(0, "a", 2, 3.0), (1, "b", 1, 3.0)]


def test_upsampling_needs_two_classes(spark):
    for y in ("id % 3", "CASE WHEN id % 2 = 0 THEN 1 END"):
        with pytest.raises(ValueError):
            learning.upsample_minority(spark.range(10).selectExpr("id AS addr", f"CAST({y} AS INT) AS y"), "addr", "y")


def test_split_and_balance(spark):
    df = spark.range(1000).selectExpr("id AS addr", "CAST(id % 10 = 0 AS INT) AS y")
    rows = learning.stratified_split(df, "addr", "y")
    got = {(r.split, r.y): r["count"] for r in rows.groupBy("split", "y").count().collect()}
    assert got == {("test", 0): 270, ("test", 1): 30, ("validation", 0): 189, ("validation", 1): 21, ("train", 0): 441, ("train", 1): 49}
    train = learning.upsample_minority(rows.filter("split = 'train'"), "addr", "y")
    assert {r.y: r["count"] for r in train.groupBy("y").count().collect()} == {0: 441, 1: 441}


def test_stream_equals_batch(spark, tmp_path):
    schema = "to_address string, from_address string, value double, ts timestamp, block long, tx long"
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [
        [("a", "x", 1.0, at(5), 5, 1), ("b", "x", 1.0, at(5), 5, 2)],
        [("a", "y", 1.0, at(3), 3, 3), ("b", "y", 1.0, at(5), 5, 4), ("c", "z", 0.0, at(1), 1, 5)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        first_funding_stream(stream, f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination()
    assert [(r.activated_address, r.gas_provider) for r in current_edges(spark, f"{tmp_path}/table").collect()] == [("a", "y")]

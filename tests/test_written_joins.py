"""Views over written joins, and how often queries join the lines of orders."""

import sys

from compare import spark_rows

from provenant import plans, session
from provenant.operators import master
from provenant.plans import proxies

plans_queries = sys.modules["provenant.plans.queries"]

SF = "/root/testdata/sf0.001"


def test_written_joins_give_the_same_views(spark, tmp_path):
    """A part key of two brands, one of a null brand and one of no part: a message for each brand, a transaction in any case."""
    for name in ("lineitem", "orders", "customer"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    part = spark.read.parquet(f"{SF}/part.parquet")
    again = part.filter("p_partkey % 7 = 1").withColumn("p_brand", part.p_brand.substr(1, 6))
    odd = part.filter("p_partkey % 7 <> 2").selectExpr("* EXCEPT (p_brand)", "if(p_partkey % 7 = 3, null, p_brand) AS p_brand").unionByName(again)
    odd.write.parquet(f"{tmp_path}/part.parquet")
    plain = proxies.Proxies(spark, str(tmp_path))
    written = plain.written()
    for view in ("messages", "transactions", "sybil"):
        want, got = getattr(plain, view), getattr(written, view)
        assert got.schema.simpleString() == want.schema.simpleString() and spark_rows(got) == spark_rows(want)
    assert written.trades.count() == written.transactions.count() != written.messages.count()


def test_lines_are_joined_once(spark, monkeypatch):
    """Messages, transactions and the truth list read one written join."""
    seen, write = [], session.materialize

    def spy(df, tag):
        seen.append((tag, "l_orderkey" in df._jdf.queryExecution().optimizedPlan().toString() and "lineitem.parquet" in " ".join(df.inputFiles())))
        return write(df, tag)

    for module in (plans_queries, proxies, master):
        monkeypatch.setattr(module, "materialize", spy)
    df = plans.queries()["master_features"](spark, SF)
    assert [tag for tag, lines in seen if lines] == ["trades"] and df.count() > 0


def test_providers_are_looked_up_for_narrow_rows(spark):
    """Wide rows are joined by address alone; a null provider, several providers and no provider keep their rows."""
    wide = spark.createDataFrame([(i, f"w{i}") for i in range(6)], "addr long, wide string")
    providers = spark.createDataFrame([(0, 7), (1, None), (2, 8), (2, None), (3, 9)], "activated_address long, gas_provider long")
    sets = [spark.createDataFrame([(x,) for x in s], "address long") for s in ([7], [8, None], [7, 8])]
    df = master.provider_flags(wide, providers, *sets)
    want = [
        (0, "w0", 7, True, False, True, False), (1, "w1", None, False, False, False, True), (2, "w2", 8, False, True, True, False),
        (2, "w2", None, False, False, False, True), (3, "w3", 9, False, False, False, False), (4, "w4", None, False, False, False, True),
        (5, "w5", None, False, False, False, True),
    ]
    columns = ["addr", "wide", "gas_provider", "provider_is_labeled", "provider_is_cex", "provider_is_interactor", "provider_is_null"]
    assert df.columns == columns and sorted((tuple(r) for r in df.collect()), key=str) == sorted(want, key=str)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[1].strip().startswith("+- Join LeftOuter, (addr#") and plan.count("wide#") <= 3

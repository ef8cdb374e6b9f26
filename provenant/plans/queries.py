"""Named queries: each applies one operator (or an assembly of them) to whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import arrival, behaviour, boosting, cleaning, communities, exchange, forest, funding, labels, learning, master, metrics, tour, walks
from ..operators.progress import progress_rows
from ..session import materialize, shared_dir, tidy
from ..sources import (
    literal_set,
    offset_chunk,
    pointer_files,
    rank_chunk,
    read_csv_directory,
    read_csv_file,
    read_line_set,
    replace_table,
    write_csv,
    write_lines,
)
from ..sources.readers import POINTER_PREFIX
from ..streaming.first_funding import event_window_counts
from .proxies import HOME_DESTINATION, HOME_SOURCE, Proxies

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Callable[[Proxies], DataFrame]) -> Callable[[Proxies], DataFrame]:
    _REGISTRY[fn.__name__] = tidy(lambda spark, sf_dir: fn(Proxies(spark, sf_dir)))
    return fn


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    # large sums of cents are exact to cents only, whatever the order of addition
    doubles = [(c, 2 if c == "total_gas" else digits) for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in doubles}) if doubles else df


# -- cleaning ------------------------------------------------------------------


@query
def scan_filter_zero(p: Proxies) -> DataFrame:
    c = p.table("customer").select(F.nullif(F.col("c_custkey"), F.lit(7)).alias("addr"), "c_name")
    return cleaning.exclude_value(c, "addr", 0)


@query
def dropna_all(p: Proxies) -> DataFrame:
    c = p.table("customer").select(
        F.col("c_custkey").alias("addr"),
        F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("nation"),
        F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal")).alias("balance"),
    )
    return cleaning.drop_all_null(c, "addr")


@query
def dedup_keep_first(p: Proxies) -> DataFrame:
    o = p.table("orders").select(F.col("o_custkey").alias("addr"), F.col("o_orderkey").alias("load_order"), "o_orderstatus")
    return cleaning.keep_first(o, ["addr"], ["load_order"])


@query
def dedup_keep_first_pair(p: Proxies) -> DataFrame:
    x = p.xfer.select("to_address", "from_address", "tx")
    return cleaning.keep_first(x, ["to_address", "from_address"], ["tx"])


@query
def dup_pairs(p: Proxies) -> DataFrame:
    return cleaning.duplicated(p.xfer.select("to_address", "from_address", "tx"), ["to_address", "from_address"])


@query
def shape_report(p: Proxies) -> DataFrame:
    x = p.xfer.select("to_address", "from_address", F.when(F.col("block") > 0, F.col("block")).alias("block"))
    return cleaning.shape_report(x, ["to_address", "from_address"])


@query
def multi_provider(p: Proxies) -> DataFrame:
    return cleaning.with_several(p.xfer, "to_address", "from_address", "n_providers")


@query
def unit_scaling(p: Proxies) -> DataFrame:
    raw = p.table("orders").select(
        F.col("o_orderkey").alias("addr"),
        F.when(F.col("o_orderkey") % 10 == 3, F.lit("n/a"))
        .otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("000000000000")))
        .alias("amount"),
    )
    return _rounded(cleaning.clean_edges(raw, "addr", "amount", 0), 9)


@query
def fill_missing(p: Proxies) -> DataFrame:
    c = p.table("customer").select(
        F.col("c_custkey").alias("addr"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_nationkey") > 3, F.col("c_nationkey") > 10).alias("flag"),
    )
    return master.fill_zero(c)


@query
def provider_map_last_wins(p: Proxies) -> DataFrame:
    x = p.xfer.select("to_address", "from_address", "tx")
    return cleaning.last_wins(x, "to_address", "from_address", "tx")


# -- label sets ----------------------------------------------------------------


@query
def label_union(p: Proxies) -> DataFrame:
    inline = literal_set(p.spark, ["AB1", "ab1", "Cd2"], lower=True)
    text = lambda df: labels.member_set(df.select(F.col("address").cast("string")), "address")
    return labels.union_sets(text(p.labeled), text(p.cex), text(p.dex), text(p.label_dim), inline)


@query
def membership_flags(p: Proxies) -> DataFrame:
    c = p.table("customer").select(F.nullif(F.col("c_custkey"), F.lit(5)).alias("addr"))
    for members, flag in ((p.labeled, "is_labeled"), (p.cex, "is_cex"), (p.interactors, "is_interactor")):
        c = labels.flag_membership(c, "addr", members, flag)
    return c


@query
def provider_flags(p: Proxies) -> DataFrame:
    c = p.table("customer").select(F.col("c_custkey").alias("addr"))
    return master.provider_flags(c, p.first_edge.select("activated_address", "gas_provider"), p.labeled, p.cex, p.interactors)


@query
def is_provider(p: Proxies) -> DataFrame:
    c = p.table("customer").select(F.col("c_custkey").alias("addr"))
    return master.is_provider(labels.flag_membership(c, "addr", p.sybil, "sybil"), p.first_edge)


# -- behaviour -----------------------------------------------------------------


def _interactions(p: Proxies) -> DataFrame:
    return behaviour.home_interactions(p.messages, HOME_SOURCE)


def _outbound(p: Proxies) -> DataFrame:
    return behaviour.outbound_features(p.transactions, _interactions(p), p.cutoff, p.table("lineitem").count())


def _inbound(p: Proxies) -> DataFrame:
    return behaviour.inbound_features(p.transactions, _interactions(p), p.cutoff, p.table("lineitem").count())


def _blocks(p: Proxies) -> DataFrame:
    return behaviour.message_blocks(materialize(p.messages, "messages"), HOME_SOURCE, HOME_DESTINATION)


def _master(p: Proxies) -> DataFrame:
    """Of views whose joins are written: messages and transactions are read by several branches."""
    blocks = materialize(behaviour.message_blocks(p.messages, HOME_SOURCE, HOME_DESTINATION), "blocks")
    own, rows = blocks.select("addr"), p.trades.count()
    return behaviour.behaviour_master(
        blocks, behaviour.outbound_features(p.transactions, own, p.cutoff, rows), behaviour.inbound_features(p.transactions, own, p.cutoff, rows)
    )


@query
def eth_interactions(p: Proxies) -> DataFrame:
    return _interactions(p)


@query
def msg_features(p: Proxies) -> DataFrame:
    return _rounded(behaviour.message_features(_blocks(p)))


@query
def msg_to_home_features(p: Proxies) -> DataFrame:
    return _rounded(behaviour.message_home_features(_blocks(p)))


@query
def tx_out_features(p: Proxies) -> DataFrame:
    return _rounded(_outbound(p))


@query
def tx_in_features(p: Proxies) -> DataFrame:
    return _rounded(_inbound(p))


@query
def behaviour_master(p: Proxies) -> DataFrame:
    return _rounded(_master(p.written()))


@query
def rank_range(p: Proxies) -> DataFrame:
    x = p.xfer.select(F.nullif(F.col("to_address"), F.lit(3)).alias("addr"), "tx")
    return rank_chunk(x, "addr", 101, 1100)


@query
def limit_offset(p: Proxies) -> DataFrame:
    return offset_chunk(p.table("customer").select("c_custkey", "c_name"), ["c_custkey"], 40, 100)


@query
def exchange_counterparties(p: Proxies) -> DataFrame:
    return exchange.labelled_counterparties(p.xfer, p.label_dim, p.cutoff)


def _exchange(p: Proxies) -> DataFrame:
    addresses = p.table("customer").select(F.col("c_custkey").alias("addr"))
    return exchange.exchange_pivot(addresses, exchange.labelled_counterparties(p.xfer, p.label_dim, p.cutoff, exchange.KINDS))


@query
def exchange_pivot(p: Proxies) -> DataFrame:
    return _exchange(p)


# -- funding graph -------------------------------------------------------------


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select(
        "activated_address", "gas_provider", F.col("amount").cast("double"), F.unix_timestamp("ts").alias("ts"), "block", "tx"
    )


@query
def first_funding(p: Proxies) -> DataFrame:
    return _plain(p.first_edge)


@query
def provision_closure(p: Proxies) -> DataFrame:
    seeds = labels.only_members(p.interactors, "address", p.cex)
    return _plain(funding.provision_closure(p.first_edge, seeds))


def _interactor_rows(p: Proxies) -> DataFrame:
    rows = p.first_edge.select("gas_provider", "activated_address", "amount")
    return labels.only_members(rows, "activated_address", p.interactors)


@query
def provider_star(p: Proxies) -> DataFrame:
    return _rounded(funding.provider_star(_interactor_rows(p)))


@query
def star_flag_running(p: Proxies) -> DataFrame:
    rows = p.xfer.select(F.col("from_address").alias("gas_provider"), F.col("to_address").alias("activated_address"), F.col("value").alias("amount"))
    return _rounded(funding.star_features(rows, p.labeled).withColumn("amount", F.col("amount").cast("double")))


@query
def edge_exclusion(p: Proxies) -> DataFrame:
    return forest.tree_edges(p.first_edge, p.labeled)


@query
def roots_depth(p: Proxies) -> DataFrame:
    return forest.roots_and_depths(forest.tree_edges(p.first_edge, p.labeled))


def _metrics(p: Proxies) -> DataFrame:
    return forest.tree_metrics(forest.node_table(p.first_edge, p.labeled))


@query
def tree_metrics_shape(p: Proxies) -> DataFrame:
    return _rounded(
        _metrics(p).select(
            "root", "tree_size", "max_depth", "branching_factor", "balance_factor", "avg_depth", "depth_variance",
            "leaf_to_internal_ratio", "breadth_factor", "breadth_to_depth_ratio", "longest_chain_ratio", "star_like_ratio",
        )
    )


@query
def tree_metrics_gas(p: Proxies) -> DataFrame:
    out = _metrics(p).select(
        "root", "total_gas", "leaf_provision_proportion", "avg_leaf_gas", "depth_weighted_avg_gas", "sparsity", "gini_coefficient"
    )
    return _rounded(out)


@query
def tree_entropy(p: Proxies) -> DataFrame:
    return _rounded(_metrics(p).select("root", "gas_distribution_entropy", "leaf_gas_distribution_entropy"), 5)


@query
def tree_skew(p: Proxies) -> DataFrame:
    return _rounded(_metrics(p).select("root", "gas_distribution_skewness", "leaf_gas_distribution_skewness"), 5)


@query
def gini_true(p: Proxies) -> DataFrame:
    return _rounded(forest.gini(forest.node_table(p.first_edge, p.labeled)))


@query
def pure_chain(p: Proxies) -> DataFrame:
    return _metrics(p).select("root", "pure_chain_length")


@query
def largest_trees(p: Proxies) -> DataFrame:
    return _metrics(p).select("root", "tree_size").orderBy(F.desc("tree_size"), "root").limit(20)


@query
def member_features(p: Proxies) -> DataFrame:
    nodes = forest.node_table(p.first_edge, p.labeled)
    return forest.member_features(nodes, forest.tree_metrics(nodes)).select("addr", "depth", "tree_size", "max_depth")


def _tour(p: Proxies) -> tuple[DataFrame, DataFrame]:
    """(first funding edges, written; the tour of their forest)."""
    edges = materialize(p.first_edge, "edges")
    return edges, tour.euler_tour(forest.tree_edges(edges, p.labeled))


@query
def subtree_totals(p: Proxies) -> DataFrame:
    edges, walked = _tour(p)
    amounts = edges.groupBy(F.col("activated_address").alias("node")).agg(F.sum("amount").alias("amount"))
    return _rounded(tour.subtree_totals(walked, amounts), 2)


@query
def node_centrality(p: Proxies) -> DataFrame:
    return _rounded(tour.path_metrics(_tour(p)[1]), 9)


@query
def tree_paths(p: Proxies) -> DataFrame:
    return _rounded(tour.tree_paths(_tour(p)[1]), 9)


@query
def tree_profile(p: Proxies) -> DataFrame:
    edges, walked = _tour(p)
    own = edges.groupBy(F.col("activated_address").alias("node")).agg(F.sum("amount").alias("amount"), F.min("block").alias("block"))
    return _rounded(tour.tree_profile(walked, own))


@query
def tree_shapes(p: Proxies) -> DataFrame:
    """How many trees have one shape, whatever the order of children."""
    whole = tour.shapes(_tour(p)[1]).filter("depth = 0")
    return whole.groupBy("shape", F.col("size").alias("tree_size")).agg(F.count("*").alias("trees")).select("tree_size", "trees", "shape")


@query
def timed_provision(p: Proxies) -> DataFrame:
    """First day and hops on which funds of the MACHINERY customers can have reached an address."""
    return arrival.earliest_arrival(p.xfer, p.cex).filter("arrival IS NOT NULL")


def _provision_graph(p: Proxies) -> DataFrame:
    return p.first_edge.select(F.col("activated_address").alias("a"), F.col("gas_provider").alias("b"), F.lit(1).alias("w"))


@query
def louvain_communities(p: Proxies) -> DataFrame:
    return communities.louvain(_provision_graph(p))[0]


@query
def louvain_modularity(p: Proxies) -> DataFrame:
    """Number of communities and modularity of each level."""
    graph = materialize(_provision_graph(p), "graph")
    return _rounded(communities.modularity(graph, communities.louvain(graph)[0]), 9)


@query
def chain_walk(p: Proxies) -> DataFrame:
    addresses = p.table("customer").select(F.col("c_custkey").alias("addr"))
    return walks.chain_walk(addresses, p.first_edge, p.interactors, p.labeled)


def _features(p: Proxies, with_gini: bool = False) -> DataFrame:
    p = p.written()  # messages, transactions and the truth list read its joins
    edges = materialize(p.first_edge, "edges")  # six branches read it
    nodes = materialize(forest.node_table(edges, p.labeled), "nodes")
    trees = forest.tree_metrics(nodes)
    if with_gini:  # no feature of the model
        trees = trees.join(forest.gini(nodes), "root", "left")
    rows = labels.only_members(edges.select("gas_provider", "activated_address", "amount"), "activated_address", p.interactors)
    return master.master_features(
        materialize(_master(p).drop("possible_triangles"), "behaviour"),  # the walk and the result read it
        edges.select("activated_address", "gas_provider"),
        funding.star_features(rows, p.labeled),
        forest.member_features(nodes, trees),
        _exchange(p), edges, p.sybil, p.labeled, p.cex,
    )


@query
def master_features(p: Proxies) -> DataFrame:
    df = _features(p, with_gini=True).select("addr", "sybil", "provider_is_cex", *master.FEATURES, "gini_true")
    spread = [c for c in master.FEATURES if "entropy" in c or "skewness" in c]
    return _rounded(df.withColumns({c: F.round(c, 5) for c in spread}))


# -- evaluation ----------------------------------------------------------------


@query
def class_counts(p: Proxies) -> DataFrame:
    return p.scored.groupBy("label").agg(F.count("*").alias("n"))


@query
def confusion_05(p: Proxies) -> DataFrame:
    return metrics.confusion(metrics.classify(p.scored, "score", 0.5, inclusive=False))


@query
def class_report(p: Proxies) -> DataFrame:
    return _rounded(metrics.class_report(metrics.classify(p.scored, "score", 0.5, inclusive=False)))


@query
def pr_curve(p: Proxies) -> DataFrame:
    return _rounded(metrics.pr_curve(p.scored))


@query
def best_f1_threshold(p: Proxies) -> DataFrame:
    return _rounded(metrics.best_f1_threshold(p.scored))


@query
def confusion_best(p: Proxies) -> DataFrame:
    best = metrics.best_f1_threshold(p.scored).select("threshold").scalar()
    return metrics.confusion(metrics.classify(p.scored, "score", best, inclusive=True))


@query
def roc_curve(p: Proxies) -> DataFrame:
    return _rounded(metrics.roc_curve(p.scored))


@query
def roc_auc(p: Proxies) -> DataFrame:
    return _rounded(metrics.roc_auc(p.scored))


def _customers_with_class(p: Proxies) -> DataFrame:
    c = p.table("customer").select(F.col("c_custkey").alias("addr"), "c_acctbal", "c_nationkey")
    return labels.flag_membership(c, "addr", p.sybil, "sybil").withColumn("sybil", F.col("sybil").cast("int"))


@query
def split_rows(p: Proxies) -> DataFrame:
    return learning.stratified_split(_customers_with_class(p), "addr", "sybil").select("addr", "sybil", "split")


@query
def split_balance(p: Proxies) -> DataFrame:
    rows = learning.stratified_split(_customers_with_class(p), "addr", "sybil")
    train = learning.upsample_minority(rows.filter("split = 'train'"), "addr", "sybil")
    out = train.unionByName(rows.filter("split <> 'train'"))
    return out.groupBy("split", "sybil").agg(F.count("*").alias("n"))


#: Rounds of the registered training queries, for their time alone (see the README); the operator's default is the inherited number.
QUERY_ROUNDS = 100


def fitted(p: Proxies, rounds: int | None = None) -> tuple[DataFrame, boosting.Model]:
    """(all rows with their split, the model of the train rows)."""
    rows = _features(p).withColumn("sybil", F.col("sybil").cast("int"))
    rows = materialize(learning.stratified_split(rows, "addr", "sybil"), "split")
    train = learning.upsample_minority(rows.filter("split = 'train'"), "addr", "sybil")
    return rows, boosting.fit(train, master.FEATURES, "sybil", rounds or QUERY_ROUNDS)


def _scored(p: Proxies) -> DataFrame:
    rows, model = fitted(p)
    scored = model.score(rows.filter("split <> 'train'").select("addr", "split", "sybil", *master.FEATURES))
    return scored.select("addr", "split", F.col("sybil").alias("label"), "score", (F.col("score") > 0.5).cast("int").alias("prediction"))


@query
def train_gbt(p: Proxies) -> DataFrame:
    return _scored(p)


@query
def train_evaluation(p: Proxies) -> DataFrame:
    """The report at 0.5 and at the validation split's best threshold, and the area, of both held-out splits."""
    scored, out = materialize(_scored(p), "scored"), None
    best = metrics.best_f1_threshold(scored.filter("split = 'validation'")).select("threshold").scalar()
    for split in ("validation", "test"):
        rows = scored.filter(F.col("split") == split)
        area = metrics.roc_auc(rows).select(F.lit("auc").alias("class"), *[F.col("auc").alias(c) for c in ("precision", "recall", "f1")], F.lit(None).cast("double").alias("support"))
        for name, judged in (("0.5", rows), ("best", metrics.classify(rows, "score", best, inclusive=True))):
            report = metrics.class_report(judged)
            report = report.unionByName(area) if name == "best" else report
            report = report.withColumns({"split": F.lit(split), "threshold": F.lit(name)})
            out = report if out is None else out.unionByName(report)
    return out


@query
def topk_importance(p: Proxies) -> DataFrame:
    _, model = fitted(p)
    rows = [(i + 1, f, n) for i, (f, n) in enumerate(model.split_counts())]
    return p.spark.createDataFrame(rows, "place int, feature string, splits int")


@query
def events_first_seen(p: Proxies) -> DataFrame:
    """The batch form of the streaming operator, over events as transfers."""
    e = p.table("events").select(
        F.col("user_id").alias("to_address"), F.col("event_type").alias("from_address"), "value", "ts",
        F.unix_date(F.to_date("ts")).alias("block"), F.col("event_id").alias("tx"),
    )
    return funding.first_funding(e).select("activated_address", "gas_provider", F.col("amount"), "block", "tx")


@query
def event_windows(p: Proxies) -> DataFrame:
    """The batch form of the streaming counts."""
    e = p.table("events").withColumn("value", F.col("value").cast("decimal(18,4)"))
    out = event_window_counts(e)
    return out.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round(F.col("total").cast("double"), 4).alias("total"))


# -- sources and sinks: each query writes what it reads back -----------------------


def _folder(p: Proxies, name: str) -> str:
    return f"{shared_dir(p.spark)}/{name}-{uuid.uuid4().hex}"


_CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_acctbal", T.DoubleType())])


def _chunks(p: Proxies) -> str:
    """A folder of CSV chunks that order, omit and add columns, beside files and folders that are not to be read."""
    path, c = _folder(p, "chunks"), p.table("customer")
    part = lambda i: c.filter(F.col("c_custkey") % 3 == i)
    write_csv(part(0).select("c_custkey", "c_name", "c_acctbal"), path)
    write_csv(part(1).select("c_acctbal", F.lit("x").alias("other"), F.col("c_custkey").alias("C_CUSTKEY"), "c_name"), path, append=True)
    write_csv(part(2).select("c_name", "c_custkey"), path, append=True)
    write_csv(part(0), f"{path}/archive")
    write_lines(c.select("c_name"), f"{path}/notes", "c_name")
    return path


@query
def csv_union_by_name(p: Proxies) -> DataFrame:
    return read_csv_directory(p.spark, _chunks(p), _CUSTOMER)


@query
def csv_union_all_columns(p: Proxies) -> DataFrame:
    """Without a schema: every column of any chunk, as text; the balance's text form is not compared."""
    df = read_csv_directory(p.spark, _chunks(p))
    return df.select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "other")


@query
def csv_keep_first_loaded(p: Proxies) -> DataFrame:
    """Of chunks that overlap, the row loaded first stays: chunks are files in name order."""
    path, c = _folder(p, "overlap"), p.table("customer").select("c_custkey", "c_name", "c_acctbal")
    write_csv(c.unionByName(c.withColumn("c_name", F.lit("again"))), path, single_file=True)
    df = read_csv_directory(p.spark, path, _CUSTOMER, load_order="_load_order")
    return cleaning.keep_first(df, ["c_custkey"], ["_load_order"]).select("c_custkey", "c_name", "c_acctbal")


@query
def csv_single_file(p: Proxies) -> DataFrame:
    """A file whose columns stand in another order than the schema's."""
    path = _folder(p, "one")
    write_csv(p.table("customer").select("c_acctbal", "c_name", "c_custkey"), path, single_file=True)
    return read_csv_file(p.spark, path, _CUSTOMER)


@query
def csv_empty_folder(p: Proxies) -> DataFrame:
    path = _folder(p, "none")
    write_lines(p.table("region").select("r_name"), path, "r_name")
    return read_csv_directory(p.spark, path, _CUSTOMER)


@query
def line_sets(p: Proxies) -> DataFrame:
    """Sorted lines written, and lines with white space and repeats read as a set."""
    path, c = _folder(p, "lines"), p.table("customer").select(F.concat(F.lit("  "), "c_mktsegment", F.lit("\t")).alias("s"))
    write_lines(c, path, "s")
    return read_line_set(p.spark, path, glob="*.txt", name="segment")


@query
def lines_sorted(p: Proxies) -> DataFrame:
    """Part files of a line sink are in global order: the last line of each is not above the first of the next."""
    path = _folder(p, "lines")
    write_lines(p.table("customer").select("c_name"), path, "c_name")
    lines = p.spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    ends = lines.groupBy("file").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count("*").alias("n"))
    after = F.lead("a").over(Window.orderBy("file"))  # one row per file
    return ends.withColumn("ok", F.coalesce(after >= F.col("b"), F.lit(True))).agg(F.sum("n").alias("lines"), F.bool_and("ok").alias("in_order"))


@query
def replaced_table(p: Proxies) -> DataFrame:
    """The second write replaces the first; the expiry is a property."""
    name, path = f"replaced_{uuid.uuid4().hex}", _folder(p, "table")
    replace_table(p.table("nation"), name, location=path)
    replace_table(p.table("region"), name, days_to_live=14, location=path)
    out = materialize(p.spark.table(name), "replaced")
    expires = p.spark.sql(f"SHOW TBLPROPERTIES {name}").filter("key = 'expires_at'").count() == 1
    p.spark.sql(f"DROP TABLE {name}")
    return out.withColumn("expires", F.lit(expires))


@query
def pointer_detection(p: Proxies) -> DataFrame:
    path = _folder(p, "pointers")
    write_csv(p.table("region"), path, single_file=True)
    pointer = p.spark.range(1).select(F.lit(f"{POINTER_PREFIX}v1\noid sha256:0\nsize 1").alias("value"))
    pointer.coalesce(1).write.mode("append").text(path)
    return pointer_files(p.spark, path, "part-*").groupBy("is_pointer").agg(F.count("*").alias("files"))


@query
def progress_eta(p: Proxies) -> DataFrame:
    """Days of events as steps of a job that takes as long as the events did."""
    day = F.to_date("ts")
    steps = p.table("events").groupBy(F.date_format(day, "yyyy-MM-dd").alias("step")).agg(
        F.count("*").alias("amount"), F.max(F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))).cast("double").alias("elapsed")
    )
    return _rounded(progress_rows(steps, "step", "amount", "elapsed"), 3)


__all__ = ["fitted", "queries"]

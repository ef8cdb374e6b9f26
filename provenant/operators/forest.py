"""Funding forests: edges, roots and depths, tree metrics, pure chains, member features.

One node table ``(node, root, depth, n_children, gas, leaf)`` is derived with
log-depth pointer doubling; every metric is a native aggregate over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import after_fill, double_sum, mean_of, safe_divide
from ..session import materialize
from .labels import without_members
from .numbering import number_rows
from .walks import double_pointers


def tree_edges(edges: DataFrame, labeled: DataFrame) -> DataFrame:
    """Edges with no labeled end and no self-loop, one parent per address (the last loaded wins)."""
    kept = without_members(without_members(edges, "activated_address", labeled), "gas_provider", labeled)
    kept = kept.filter(F.col("activated_address") != F.col("gas_provider"))
    return kept.groupBy("activated_address").agg(F.max_by("gas_provider", F.struct("block", "tx")).alias("gas_provider"))


def roots_and_depths(parents: DataFrame) -> DataFrame:
    """(node, root, depth, in_cycle) of every node of the edge table."""
    edges = parents.select(F.col("activated_address").alias("node"), F.col("gas_provider").alias("ptr"))
    tops = edges.select(F.col("ptr").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    state = edges.unionByName(tops.withColumn("ptr", F.lit(None).cast(dict(edges.dtypes)["ptr"])))
    ended = double_pointers(
        state.select(
            "node",
            "ptr",
            F.col("ptr").isNotNull().cast("long").alias("len"),
            F.lit(0).cast("long").alias("cnt"),
            F.coalesce("ptr", "node").alias("last"),
        ),
        keep_last=True,
    )
    known = lambda c: F.when(~F.col("in_cycle"), F.col(c))
    return ended.select("node", known("last").alias("root"), known("len").alias("depth"), "in_cycle")


def node_table(edges: DataFrame, labeled: DataFrame) -> DataFrame:
    """Nodes of all trees; gas of a node sums over *all* edges into it, labeled ones included."""
    parents = tree_edges(edges, labeled)
    placed = roots_and_depths(parents).filter(~F.col("in_cycle")).drop("in_cycle")
    children = parents.groupBy(F.col("gas_provider").alias("node")).agg(F.count("*").alias("n_children"))
    gas = edges.groupBy(F.col("activated_address").alias("node")).agg(double_sum("amount").alias("gas"))
    return placed.join(children, "node", "left").join(gas, "node", "left").select(
        "node",
        "root",
        "depth",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.coalesce("gas", F.lit(0.0)).alias("gas"),
        F.col("n_children").isNull().alias("leaf"),
    )


def _entropy(a, total):
    """Base-2 entropy of positive amounts, from each one's share of the total (a difference of sums would cancel where one amount dominates)."""
    share = a / total
    return F.coalesce(-F.sum(F.when(share > 0, share * F.log2(share))), F.lit(0.0)) + F.lit(0.0)


def tree_metrics(nodes: DataFrame) -> DataFrame:
    """One row per root.  Trees without positive amounts get zeros for the amount metrics.

    ``gini_coefficient`` follows the inherited formula, of which only rounding
    errors are left, as shares sum to 1; they are rounded away.  :func:`gini`
    is the real coefficient.
    """
    gas, depth, leaf, kids = F.col("gas"), F.col("depth"), F.col("leaf"), F.col("n_children")
    given = F.when((depth > 0) & (gas > 0), gas)  # the root's own funding is outside the tree
    leaf_gas = F.when(leaf, gas)
    share = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    n = F.count("*")
    sums = nodes.groupBy(F.col("root").alias("_root")).agg(F.sum(given).alias("_given"), F.sum(F.when(leaf & (gas > 0), gas)).alias("_leaves"))
    out = nodes.join(sums, F.col("root") == F.col("_root")).groupBy("root").agg(
        n.alias("tree_size"),
        F.coalesce(F.sum(given), F.lit(0.0)).alias("total_gas"),
        F.max("depth").alias("max_depth"),
        safe_divide(F.sum("n_children"), n).alias("branching_factor"),
        (F.max("depth") - F.min(F.when(leaf, depth))).alias("balance_factor"),
        F.sum(leaf_gas).alias("_leaf_gas"),
        F.avg("depth").alias("avg_depth"),
        F.coalesce(F.var_samp("depth"), F.lit(0.0)).alias("depth_variance"),
        safe_divide(share(leaf), share(~leaf)).alias("leaf_to_internal_ratio"),
        mean_of(leaf_gas).alias("avg_leaf_gas"),
        safe_divide(n, F.max("depth") + 1).alias("breadth_factor"),
        safe_divide(F.max("depth"), n).alias("longest_chain_ratio"),
        safe_divide(share(kids > 1), n).alias("star_like_ratio"),
        safe_divide(F.sum(gas * depth), F.sum("depth")).alias("depth_weighted_avg_gas"),
        safe_divide(share(gas > 0), n).alias("sparsity"),
        (F.coalesce(F.round(safe_divide(F.count(given) - 1, F.count(given)) * (1 - F.sum(given / F.col("_given"))), 9), F.lit(0.0)) + F.lit(0.0)).alias("gini_coefficient"),
        _entropy(given, F.col("_given")).alias("gas_distribution_entropy"),
        after_fill(F.skewness(given)).alias("gas_distribution_skewness"),
        _entropy(F.when(leaf & (gas > 0), gas), F.col("_leaves")).alias("leaf_gas_distribution_entropy"),
        after_fill(F.skewness(leaf_gas)).alias("leaf_gas_distribution_skewness"),
        F.when((n >= 3) & (F.count_distinct("depth") == n), n).otherwise(F.lit(0).cast("long")).alias("pure_chain_length"),
    )
    return out.withColumns(
        {
            "leaf_provision_proportion": safe_divide(F.col("_leaf_gas"), F.col("total_gas")),
            "breadth_to_depth_ratio": safe_divide(F.col("breadth_factor"), F.col("max_depth")),
        }
    ).drop("_leaf_gas")


def gini(nodes: DataFrame) -> DataFrame:
    """The Gini coefficient of positive amounts per tree (extension; the inherited formula is 0 for any amounts).

    Places within a tree are global numbers, from range partitions, less the
    tree's first one: a giant tree is no single task.
    """
    a = nodes.filter("depth > 0 AND gas > 0").select("root", "gas", "node")
    numbered = materialize(number_rows(a, ["root", "gas", "node"], "i"), "amounts")
    first = numbered.groupBy("root").agg(F.min("i").alias("_first"))
    ranked = numbered.join(first, "root").withColumn("i", F.col("i") - F.col("_first") + 1)
    n, total = F.count("*"), F.sum("gas")
    return ranked.groupBy("root").agg(
        ((2 * F.sum(F.col("i") * F.col("gas")) - (n + 1) * total) / (n * total)).alias("gini_true")
    )


def member_features(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """The metrics of its tree and the own depth for every node that has a parent; roots have none."""
    return (
        nodes.filter("depth >= 1")
        .select(F.col("node").alias("addr"), "root", "depth")
        .join(metrics, "root")
        .drop("root")
    )

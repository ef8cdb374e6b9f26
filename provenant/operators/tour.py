"""Euler tours of funding forests: totals of every subtree, path lengths and centralities, repeated shapes.

A tour walks down into every node and up out of it again.  Its order comes from
list ranking by pointer doubling, so the number of rounds is the logarithm of
the largest tree, not its depth.  A subtree is then a stretch of the tour, and
what a subtree or the path from the root adds up to is a difference of running
sums, which come from range partitions: no join per level, and neither a giant
tree, a hot provider nor a long chain is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import after_fill, safe_divide
from ..session import materialize, scratch
from .numbering import number_rows, running_sums
from .walks import double_pointers


def _arcs(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered nodes (i, node, parent, pi), successors of arcs (node, ptr)): arc 2i goes down into node i and 2i + 1 up out of it.

    Nodes are numbered by (parent, node), so brothers are neighbours.
    """
    edges = parents.select(F.col("activated_address").alias("node"), F.col("gas_provider").alias("parent")).filter("parent IS NOT NULL AND parent <> node")
    tops = edges.select(F.col("parent").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    nodes = edges.unionByName(tops.withColumn("parent", F.lit(None).cast(dict(edges.dtypes)["parent"])))
    numbered = materialize(number_rows(nodes, ["parent", "node"], "i"), "tour-nodes")
    places = numbered.select(F.col("node").alias("parent"), F.col("i").alias("pi"))
    numbered = materialize(numbered.join(places, "parent", "left").select("i", "node", "parent", "pi"), "tour-nodes")
    first = numbered.filter("pi IS NOT NULL").groupBy(F.col("pi").alias("i")).agg(F.min("i").alias("child"))
    brother = numbered.filter("pi IS NOT NULL").select((F.col("i") - 1).alias("i"), F.col("pi").alias("_bp"))
    joined = numbered.join(first, "i", "left").join(brother, "i", "left")
    after = F.when(F.col("_bp") == F.col("pi"), 2 * F.col("i") + 2).otherwise(2 * F.col("pi") + 1)
    pair = F.array(
        F.struct((2 * F.col("i")).alias("node"), F.coalesce(2 * F.col("child"), 2 * F.col("i") + 1).alias("ptr")),
        F.struct((2 * F.col("i") + 1).alias("node"), after.alias("ptr")),
    )
    return numbered, joined.select(F.inline(pair))


def euler_tour(parents: DataFrame) -> DataFrame:
    """(node, parent, root, depth, first, last, size, tree_size, path) of every node, written.

    ``parents``: (activated_address, gas_provider), one provider per address.
    ``first`` and ``last`` are a node's places in its tree's tour, ``size`` is
    its subtree's number of nodes and ``path`` the sum of the sizes from the
    root down to it.  Own and null providers are no edges; nodes in cycles and
    below them have no root and are left out; no edges give no rows.
    """
    with scratch() as keep:
        numbered, arcs = _arcs(parents)
        state = arcs.select("node", "ptr", F.col("ptr").isNotNull().cast("long").alias("len"), F.lit(0).cast("long").alias("cnt"), F.coalesce("ptr", "node").alias("last"))
        ended = materialize(double_pointers(state, keep_last=True).filter("NOT in_cycle").select("node", "len", F.col("last").alias("end")), "tour")
        ends = ended.groupBy(F.shiftright("node", 1).alias("i")).agg(
            F.max("len").alias("down"), F.min("len").alias("up"), F.first("end").alias("end")
        )  # down comes before up, so more of the tour is left there
        sized = ends.withColumn("size", F.expr("(down - up + 1) DIV 2"))
        whole = sized.filter("up = 0").select("end", (F.col("down") + 1).alias("arcs"))
        placed = materialize(sized.join(whole, "end"), "tour-places")
        steps = placed.select("i", "end", F.inline(F.array(
            F.struct((F.col("arcs") - 1 - F.col("down")).alias("at"), F.lit(1).cast("long").alias("step"), F.col("size").alias("path")),
            F.struct((F.col("arcs") - 1 - F.col("up")).alias("at"), F.lit(-1).cast("long").alias("step"), (-F.col("size")).alias("path")),
        )))
        summed = running_sums(steps, ["end", "at"], ["step", "path"]).filter("step = 1")
        roots = numbered.select((2 * F.col("i") + 1).alias("end"), F.col("node").alias("root"))
        own = summed.select("i", F.col("at").alias("first"), (F.col("upto_step") - 1).alias("depth"), F.col("upto_path").alias("path"))
        sizes = placed.select("i", "end", "size", (F.col("arcs") - 1 - F.col("up")).alias("last"), F.expr("arcs DIV 2").alias("tree_size"))
        out = numbered.select("i", "node", "parent").join(own, "i").join(sizes, "i").join(roots, "end")
        return keep(materialize(out.select("node", "parent", "root", "depth", "first", "last", "size", "tree_size", "path"), "tours"))


def subtree_sums(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(node, <column>...) summed over each node and all below it, of a tour with exact number columns: what lies between a node's two arcs."""
    kinds = dict(rows.dtypes)
    own = [F.col(c) for c in columns]
    none = [F.lit(0).cast(kinds[c]).alias(c) for c in columns]
    arcs = rows.select("node", "root", "last", F.inline(F.array(F.struct(F.col("first").alias("at"), *own), F.struct(F.col("last").alias("at"), *none))))
    summed = running_sums(arcs, ["root", "at"], columns)
    difference = lambda c: F.sum(F.when(F.col("at") == F.col("last"), F.col(f"upto_{c}")).otherwise(F.col(c) - F.col(f"upto_{c}")))
    return summed.groupBy("node").agg(*[difference(c).alias(c) for c in columns])


def subtree_totals(tour: DataFrame, amounts: DataFrame) -> DataFrame:
    """(node, root, depth, subtree_size, subtree_amount, subtree_depth_amount): sums over each node and all below it.

    ``amounts``: (node, amount), one exact decimal per node; a missing one is
    0.  Depths count from the root.
    """
    kind = "decimal(38,2)"
    own = tour.join(amounts, "node", "left").withColumn("a", F.coalesce("amount", F.lit(0)).cast(kind))
    own = own.withColumn("w", (F.col("a") * F.col("depth").cast("decimal(10,0)")).cast(kind))
    sums = subtree_sums(own, ["a", "w"])
    out = tour.join(sums, "node")
    return out.select(
        "node", "root", "depth", F.col("size").alias("subtree_size"), F.col("a").cast("double").alias("subtree_amount"), F.col("w").cast("double").alias("subtree_depth_amount")
    )


def tree_profile(tour: DataFrame, own: DataFrame) -> DataFrame:
    """One row per tree: how it is spread over depth, time, amounts and brothers.

    ``own``: (node, amount, block) of funded nodes; a missing amount is 0.  Of
    the nodes below the root: ``depth_skewness`` (of all nodes), the skewness and
    excess kurtosis of blocks, ``time_to_gas_ratio`` (blocks from first to last
    over the total amount) and its inverse ``provision_rate``, ``leaf_path_length``
    (depth of leaves by amount), ``gas_per_node``.  Over parents, on average:
    ``asymmetry`` (of two children and more, by how much the least subtree falls
    short of the largest), ``evenness`` (their least amount over the largest) and
    ``pruning`` (share of leaves among all below).  What is undefined is 0.
    """
    kind = "decimal(38,2)"
    rows = tour.join(own, "node", "left").withColumns(
        {"a": F.coalesce("amount", F.lit(0)).cast(kind), "leaf": (F.col("size") == 1).cast("long"), "deep": F.col("depth") > 0}
    )
    rows = materialize(rows.drop("amount"), "profile")
    below = subtree_sums(rows, ["leaf"]).withColumnRenamed("leaf", "leaves")
    parents = rows.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("kids"), F.min("size").alias("s0"), F.max("size").alias("s1"), F.min("a").alias("a0"), F.max("a").alias("a1")
    )
    inner = rows.select("node", "root", "size").join(parents, "node").join(below, "node")
    several = lambda c: F.coalesce(F.avg(F.when(F.col("kids") > 1, c)), F.lit(0.0))
    shape = inner.groupBy("root").agg(
        several((F.col("s1") - F.col("s0")) / F.col("s1")).alias("asymmetry"),
        several(safe_divide(F.col("a0"), F.col("a1"))).alias("evenness"),
        F.avg(F.col("leaves") / (F.col("size") - 1)).alias("pruning"),
    )
    deep = lambda c: F.when(F.col("deep"), F.col(c))
    leaf = lambda c: F.when(F.col("deep") & (F.col("leaf") == 1), c)
    total = F.sum(deep("a")).cast("double")
    span = F.max(deep("block")) - F.min(deep("block"))
    spread = rows.groupBy("root").agg(
        F.max("tree_size").alias("tree_size"),
        after_fill(F.skewness("depth")).alias("depth_skewness"),
        after_fill(F.skewness(deep("block"))).alias("activation_skewness"),
        after_fill(F.kurtosis(deep("block"))).alias("activation_kurtosis"),
        safe_divide(span, total).alias("time_to_gas_ratio"),
        safe_divide(total, span).alias("provision_rate"),
        safe_divide(F.sum(leaf((F.col("a") * F.col("depth").cast("decimal(10,0)")).cast(kind))), F.sum(leaf(F.col("a")))).alias("leaf_path_length"),
        safe_divide(total, F.count("*")).alias("gas_per_node"),
    )
    return spread.join(shape, "root")


def path_metrics(tour: DataFrame) -> DataFrame:
    """(node, root, distance_sum, closeness, betweenness) in the tree without directions.

    Moving the root over an edge brings the subtree below it one nearer and all
    others one further, so a node's distances are its root's plus a sum over its
    path.  Betweenness counts the pairs of other nodes whose path goes through
    the node, that is, pairs of different parts that its removal leaves.
    """
    roots = tour.groupBy("root").agg(F.sum("depth").alias("_total"))
    n, s = F.col("tree_size"), F.col("size")
    pairs = lambda x: x * (x - 1) / 2
    below = tour.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum(pairs(s.cast("double"))).alias("_inside"))
    joined = tour.join(roots, "root").join(below, "node", "left")
    distances = F.col("_total") + n * F.col("depth") - 2 * (F.col("path") - n)
    rest = (n - s).cast("double")
    through = pairs((n - 1).cast("double")) - F.coalesce("_inside", F.lit(0.0)) - pairs(rest)
    return joined.select("node", "root", distances.alias("distance_sum"), safe_divide(n - 1, distances).alias("closeness"), through.alias("betweenness"))


def tree_paths(tour: DataFrame) -> DataFrame:
    """(root, tree_size, mean_path_length, max_betweenness, amount of pairs over the busiest edge) of each tree.

    An edge lies on the paths between the size of the subtree below it and the rest.
    """
    n, s = F.col("tree_size").cast("double"), F.col("size").cast("double")
    over = F.when(F.col("parent").isNotNull(), s * (n - s))
    edges = tour.groupBy("root", "tree_size").agg(F.sum(over).alias("_all"), F.max(over).alias("max_edge_betweenness"))
    pairs = n * (n - 1) / 2
    busiest = path_metrics(tour).groupBy("root").agg(F.max("betweenness").alias("max_betweenness"))
    return edges.join(busiest, "root").select("root", "tree_size", (F.col("_all") / pairs).alias("mean_path_length"), "max_betweenness", "max_edge_betweenness")


def shapes(tour: DataFrame) -> DataFrame:
    """(node, root, depth, size, shape): nodes of one shape have equal subtrees, whatever the order of children; written.

    From the deepest level up, a node's name is a digest of its number of
    children and of two sums over digests of theirs: equal for equal sets of
    child shapes, in any order, and added up before they are shuffled, so a
    provider of very many children is no large group.  There are as many rounds
    as levels.  Different shapes share a name with a probability of about n^2 / 2^129.
    """
    deepest = tour.agg(F.max("depth")).first()[0]
    mixed = lambda c, seed: F.conv(F.substring(F.md5(F.concat(c, F.lit(seed))), 1, 15), 16, 10).cast("decimal(38,0)")
    done, below = [], None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        nodes = tour.filter(F.col("depth") == level).select("node", "parent", "root", "depth", "size")
        leaf = F.md5(F.lit("leaf"))
        if below is None:
            named = nodes.withColumn("shape", leaf)
        else:
            kids = below.groupBy(F.col("parent").alias("node")).agg(
                F.count("*").alias("n"), *[F.sum(mixed(F.col("shape"), s)).alias(f"s{s}") for s in ("a", "b", "c")]
            )
            name = F.md5(F.concat_ws(":", "n", "sa", "sb", "sc"))
            named = nodes.join(kids, "node", "left").withColumn("shape", F.when(F.col("n").isNull(), leaf).otherwise(name)).drop("n", "sa", "sb", "sc")
        below = materialize(named, "shapes")
        done.append(below)
    if not done:
        return tour.select("node", "root", "depth", "size", F.lit("").alias("shape")).limit(0)
    return tour.sparkSession.read.schema(done[0].schema).parquet(*[d._materialized_path for d in done]).drop("parent")

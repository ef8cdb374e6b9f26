"""Pointer doubling over functional graphs (each node has one parent at most).

Every round halves the distance left: node state ``(ptr, len, cnt)`` is joined
with the state of ``ptr``.  Only nodes that still have a pointer join, finished
rows pass through, and each round's state is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release


def double_pointers(state: DataFrame, *, keep_last: bool) -> DataFrame:
    """``state``: node, ptr, len, cnt (and, if ``keep_last``, last: the node reached so far).

    Returns the state at the end of every walk, with ``in_cycle`` true for
    nodes whose walk never ends.
    """
    last = ["last"] if keep_last else []
    current = materialize(state.select("node", "ptr", "len", "cnt", *last), "walk")
    bound = max(1, current.count()).bit_length() + 1
    for _ in range(bound):
        if current.filter("ptr IS NOT NULL").isEmpty():
            break
        done, going = current.filter("ptr IS NULL"), current.filter("ptr IS NOT NULL")
        ahead = current.select(F.col("node").alias("ptr"), *[F.col(c).alias(f"_{c}") for c in ("ptr", "len", "cnt", *last)])
        step = going.join(ahead, "ptr", "left").select(
            "node",
            F.col("_ptr").alias("ptr"),
            (F.col("len") + F.coalesce("_len", F.lit(0))).alias("len"),
            (F.col("cnt") + F.coalesce("_cnt", F.lit(0))).alias("cnt"),
            *[F.coalesce("_last", "last").alias("last") for _ in last],
        )
        after = materialize(done.unionByName(step), "walk")
        release(current)
        current = after
    return current.select("node", "len", "cnt", *last, F.col("ptr").isNotNull().alias("in_cycle"))


def chain_walk(addresses: DataFrame, provider_of: DataFrame, interactors: DataFrame, labeled: DataFrame) -> DataFrame:
    """(addr, chain_length, interactors_in_chain, in_cycle): walk up the providers of each address.

    Each step counts an edge; a labeled provider ends the walk after its edge
    and is not itself looked at; a missing or own provider ends it at once.
    Nodes met before that which are interactors are counted.  A walk in a
    cycle never ends: its numbers are null and ``in_cycle`` is true.
    """
    from .labels import flag_membership

    edges = provider_of.select(F.col("activated_address").alias("node"), F.col("gas_provider").alias("provider"))
    nodes = (
        addresses.select(F.col(addresses.columns[0]).alias("node"))
        .unionByName(edges.select("node"))
        .unionByName(edges.select(F.col("provider").alias("node")))
        .filter("node IS NOT NULL")
        .distinct()
    )
    state = flag_membership(nodes.join(edges, "node", "left"), "node", interactors, "_i")
    state = flag_membership(state, "provider", labeled, "_l")
    step = F.col("provider").isNotNull() & (F.col("provider") != F.col("node"))
    ended = double_pointers(
        state.select(
            "node",
            F.when(step & ~F.col("_l"), F.col("provider")).alias("ptr"),
            F.when(step, 1).otherwise(0).cast("long").alias("len"),
            F.col("_i").cast("long").alias("cnt"),
        ),
        keep_last=False,
    )
    wanted = addresses.select(F.col(addresses.columns[0]).alias("node")).distinct()
    known = lambda c: F.when(~F.col("in_cycle"), F.col(c))
    return wanted.join(ended, "node").select(
        F.col("node").alias("addr"),
        known("len").alias("chain_length"),
        known("cnt").alias("interactors_in_chain"),
        "in_cycle",
    )

"""Connected components by alternating star contraction.

Each task first replaces the edges it holds by stars around the least node of
each component among them: the same components with fewer edges, and tasks that
hold edges of one group mostly agree on its star.  What is left is dealt to
tasks of ``HELD`` edges and replaced once more.  Edges are then linked to the
least neighbour, first from larger nodes and then from smaller ones, until each
component is a star around its least node (a round count that grows with the
logarithm of the component).  Fewer than ``HELD`` edges are one task's, whose
stars are the components already: no round follows.  A hub's edges are
never gathered: minima come from partial aggregation and are joined back, where
adaptive execution splits a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from .shared import lean

#: Edges that a task holds before it hands on their stars.
HELD = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all nodes of the edges but the least ones."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _task_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.empty((2, 0), np.int64)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["u", "v"])

    for more in batches:
        held = np.concatenate((held, [more.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]), axis=1)
        if held.shape[1] >= HELD:
            held = np.stack(stars(*held))
            if held.shape[1] >= HELD // 2:
                yield batch()
                held = held[:, :0]
    if held.shape[1]:
        held = np.stack(stars(*held))
        yield batch()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edge table (u, v) of longs; root is the least node reachable.

    Self-loops, repeated and null edges do no harm.  An empty table gives an
    empty result.
    """
    kept = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    first = materialize(kept.mapInArrow(lean(_task_stars), "u long, v long"), "stars")
    n = first.count()
    tasks = max(1, -(-n // HELD))  # a task's share stays the same at every size
    again = first.coalesce(tasks).mapInArrow(lean(_task_stars), "u long, v long")
    now = materialize(again if tasks == 1 else again.distinct(), "edges")
    release(first)
    mark = _mark(now) if n >= HELD else (0,)  # one task has seen every edge of fewer: its stars are the components
    while mark[0]:
        after = materialize(_small_star(_large_star(now)).distinct(), "edges")
        release(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    # all are stars now, so no root is an edge's u
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest: equal marks mean an unchanged edge set."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour (or itself)."""
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    # v < u: a node's smaller neighbours are its v; its larger ones are the u of edges that end in it
    out = edges.join(least, edges["v"] == least["n"], "left")
    return out.select("u", F.coalesce("m", "v").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the least of them."""
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    both = edges.join(least, edges["u"] == least["n"])
    moved = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

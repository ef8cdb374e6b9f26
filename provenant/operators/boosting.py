"""Second-order boosting: trees of Newton steps on the logistic loss, from histograms.

Features are cut into bins once.  A tree grows level by level, and a level is
one aggregation: every task sums gradients and Hessians of its rows by node,
feature and bin, the sums of a feature meet in one task, and that task finds
the feature's best split of every node.  The driver sees one candidate for
each node and feature, whatever the number of rows.  Of two children only the
lighter one is summed and sent: the other is its parent less it.  Sums travel as
whole numbers of the least step, in as many bytes as they need, from as many
tasks as there are cores, so what is moved doesn't grow with the rows beyond that.

Rows are written once as blocks of bins (a byte or two a value), labels and
margins; each new tree is applied to the kept blocks once, and every few rounds
the margins are written anew.  A lost executor costs the blocks it was reading.
Gradients are rounded to a power of two that keeps all sums exact, so a model
does not depend on the number or order of tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import materialize, release

#: Boosting rounds of the inherited model (fixed value).
ROUNDS = 2000
#: Rows of a block, rounds after which margins are written, and blocks that a task holds as one.
BLOCK, REBASE, MERGED = 16_384, 16, 32


@dataclass
class Tree:
    """Nodes by level; a leaf has no feature.  A row goes left if its bin is below ``cut``."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)

    def add(self, weight: float) -> int:
        for column, value in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.weight, weight)):
            column.append(value)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, weights: tuple[float, float]) -> None:
        left = self.add(weights[0])
        self.add(weights[1])
        self.feature[node], self.cut[node], self.left[node] = feature, cut, left

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = feature[at]
            going = f >= 0
            if not going.any():
                return at
            right = bins[rows, np.maximum(f, 0)] >= cut[at]
            at = np.where(going, left[at] + right, at)


@dataclass
class Model:
    """Trees over bins, the cuts of each feature, and the feature names."""

    features: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]

    def margins(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.cuts)
        return sum((np.array(t.weight)[t.nodes(bins)] for t in self.trees), np.zeros(len(values)))

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score``, the probability of class 1.

        The model (at most 2^(depth + 1) nodes a round) goes to each executor once.
        """
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = np.column_stack([_doubles(batch.column(f"_x{i}")) for i in range(len(shared.value.features))]) if batch.num_rows else np.empty((0, len(shared.value.features)))
                chance = 1 / (1 + np.exp(-shared.value.margins(values)))
                own = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(chance)], names=[*names, "score"])

        names = df.columns
        wide = df.select("*", *[F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)])
        return wide.mapInArrow(run, StructType([*df.schema.fields, StructField("score", DoubleType())]))

    def split_counts(self, top: int = 20) -> list[tuple[str, int]]:
        """How often each feature splits a node, largest first, ties in feature order."""
        counts = np.bincount([f for t in self.trees for f in t.feature if f >= 0], minlength=len(self.features))
        order = sorted((i for i in range(len(self.features)) if counts[i]), key=lambda i: (-counts[i], i))
        return [(self.features[i], int(counts[i])) for i in order[:top]]


def _doubles(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def find_cuts(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Ascending cuts of each feature: all distinct values where few, else quantiles; one aggregation for all."""
    shares = [i / bins for i in range(bins)]
    quantiles = [F.percentile_approx(F.col(f"`{f}`").cast("double"), shares, 100 * bins).alias(f"q{i}") for i, f in enumerate(features)]
    got = df.agg(*quantiles).first()
    return [np.unique([x for x in got[i] or [] if x is not None and not np.isnan(x)]) for i in range(len(features))]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of cuts at or below each value; a missing value counts as below all."""
    out = np.empty(values.shape, np.uint16)
    for i, c in enumerate(cuts):
        out[:, i] = np.where(np.isnan(values[:, i]), 0, np.searchsorted(c, values[:, i], "right"))
    return out


def _blocks(df: DataFrame, features: list[str], label: str, cuts: list[np.ndarray]) -> DataFrame:
    wide = df.select(*[F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(features)], F.col(f"`{label}`").cast("double").alias("_y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            table = np.vstack(held)
            bins, y = binned(table[:, :-1], cuts), table[:, -1]
            return pa.RecordBatch.from_arrays(
                [pa.array([len(y)], pa.int64()), pa.array([bins.tobytes()], pa.binary()), pa.array([y.astype(np.int8).tobytes()], pa.binary()), pa.array([np.zeros(len(y)).tobytes()], pa.binary())],
                names=["n", "bins", "y", "margin"],
            )

        for batch in batches:
            if batch.num_rows:
                held.append(np.column_stack([_doubles(c) for c in batch.columns]))
                rows += batch.num_rows
            if rows >= BLOCK:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return wide.mapInArrow(pack, "n long, bins binary, y binary, margin binary")


class _Rows:
    """Blocks of training rows with the margins of all trees so far, and the trees that the written margins lack."""

    def __init__(self, table: DataFrame, n_features: int, n: int) -> None:
        self.n_features, self.n, self.pending, self.stale = n_features, n, [], None
        self.last, self.totals = [], None  # the nodes of the level before and their sums by feature
        self.quantum = 2.0 ** (n.bit_length() - 52)  # sums of n such numbers are exact
        self.load(table)

    def load(self, table: DataFrame) -> None:
        """Few rows are few tasks: a task has a block's rows or more.  Many rows are as many tasks as cores, as each sends its sums."""
        width = self.n_features
        self.table = table

        def merge(rows: Iterator) -> Iterator[tuple]:
            while own := list(islice(rows, MERGED)):
                joined = [b"".join(bytes(r[c]) for r in own) for c in ("bins", "y", "margin")]
                yield np.asfortranarray(np.frombuffer(joined[0], np.uint16).reshape(-1, width)), np.frombuffer(joined[1], np.int8), np.frombuffer(joined[2], np.float64)

        cores = table.sparkSession.sparkContext.defaultParallelism
        self.blocks: RDD = table.coalesce(max(1, min(cores, -(-self.n // BLOCK)))).rdd.mapPartitions(merge).persist()

    def add(self, tree: Tree) -> None:
        """Applies a tree to the kept blocks: its levels and those of later trees find the margins there."""
        self.pending = [*self.pending, tree]
        if len(self.pending) == REBASE:
            self.rebase()
        else:
            self.drop_stale()
            self.stale, self.blocks = self.blocks, self.blocks.map(lambda b: (b[0], b[1], _margin(b[0], b[2], [tree]))).persist()

    def drop_stale(self) -> None:
        """The blocks before the last tree go once those after it are there."""
        if self.stale is not None:
            self.stale.unpersist()
        self.stale = None

    def rebase(self) -> None:
        """Writes the margins after all trees so far."""
        trees, width = self.pending, self.n_features

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = []
                for bins, margin in zip(batch.column("bins"), batch.column("margin"), strict=True):
                    bins = np.frombuffer(bins.as_py(), np.uint16).reshape(-1, width)
                    margins.append(_margin(bins, np.frombuffer(margin.as_py(), np.float64), trees).tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margins, pa.binary())], names=batch.schema.names)

        old, self.pending = self.table, []
        self.drop_stale()
        self.blocks.unpersist()
        self.load(materialize(old.mapInArrow(apply, old.schema), "margins"))
        self.blocks.count()  # read before the old blocks go
        release(old)

    def candidates(self, tree: Tree, active: list[int], light: list[int], sizes: list[int], l2: float, min_child: float) -> dict[int, list[tuple]]:
        """For each active node: (gain, feature, cut, gradients and Hessians left and in all) of every feature's best split.

        Active nodes are the root, or left and right children in turn; ``light`` has the lighter one of every two.
        """
        quantum, n_features = self.quantum, self.n_features
        reducers = min(n_features, self.blocks.getNumPartitions())
        own = light if light and reducers > 1 else active  # without a shuffle all are summed
        slot = np.full(len(tree.feature), -1)
        slot[own] = np.arange(len(own))

        def sums(blocks: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
            total: dict[int, np.ndarray] = {}
            for bins, y, margin in blocks:
                chance = 1 / (1 + np.exp(-margin))
                g, h = np.round((chance - y) / quantum) * quantum, np.round(chance * (1 - chance) / quantum) * quantum
                at = slot[tree.nodes(bins)]
                some = at >= 0
                at, g, h, every = at[some], g[some], h[some], some.all()
                for f in range(n_features):
                    cell = at * sizes[f] + (bins[:, f] if every else bins[some, f])
                    both = [np.bincount(cell, w, len(own) * sizes[f]) for w in (g, h)]
                    total[f] = total[f] + both if f in total else np.array(both)
            yield from _shares(((f, False, *_packed(t, quantum)) for f, t in total.items()), reducers)

        def added(parts: Iterator[tuple[int, list]]) -> Iterator[tuple[int, np.ndarray]]:
            got: dict[tuple[int, bool], np.ndarray] = {}
            for _, found in parts:
                for f, parent, there, values in found:
                    t = got.setdefault((f, parent), np.zeros((2, len(own) * sizes[f])))
                    at, more = _unpacked(there, values, quantum, t.shape[1])
                    t[:, at] += more
            for f in sorted({f for f, _ in got}):
                t = got.get((f, False), np.zeros((2, len(own) * sizes[f]))).reshape(2, len(own), sizes[f])
                if len(own) < len(active):
                    both = np.empty((2, len(active), sizes[f]))
                    both[:, at_light], both[:, at_light ^ 1] = t, got[f, True].reshape(t.shape) - t
                    t = both
                yield f, t

        summed = self.blocks.mapPartitions(sums)
        if len(own) < len(active):
            at_light = np.flatnonzero(np.isin(active, own))
            place = {tree.left[node]: i for i, node in enumerate(self.last)}
            parents = [place[left] for left in active[::2]]
            above = lambda totals: _shares(((f, True, *_packed(t[:, parents].reshape(2, -1), quantum)) for f, t in totals), reducers)
            summed = summed.union(self.totals.mapPartitions(above))
        if reducers > 1:
            summed = summed.partitionBy(reducers)
        before, self.totals, self.last = self.totals, summed.mapPartitions(added).persist(), active
        out: dict[int, list[tuple]] = {}
        best = lambda totals: (found for f, t in totals for found in _best_splits(f, *t, l2, min_child))
        for node, *found in self.totals.mapPartitions(best).collect():
            out.setdefault(active[node], []).append(tuple(found))
        if before is not None:
            before.unpersist()
        self.drop_stale()
        return out


def _shares(sums: Iterable[tuple], reducers: int) -> Iterator[tuple[int, list]]:
    """Sums of features, by the task that adds them up."""
    shares: dict[int, list] = {}
    for one in sums:
        shares.setdefault(one[0] % reducers, []).append(one)
    yield from shares.items()


def _packed(sums: np.ndarray, quantum: float) -> tuple[bytes, bytes]:
    """(bits of the cells that are not zero, the bytes of their sums in quanta: the lowest of all, the next of all...)."""
    there = (sums != 0).any(0)
    quanta = (sums[:, there] / quantum).astype("<i8").ravel()
    quanta = ((quanta << 1) ^ (quanta >> 63)).view("<u8")  # the sign is the lowest bit, so high bytes are zero
    width = -(-int(quanta.max(initial=0)).bit_length() // 8)
    return np.packbits(there).tobytes(), quanta.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(there: bytes, values: bytes, quantum: float, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, their sums (2, n)) of what was packed."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(there, np.uint8), count=cells))
    wide = np.zeros((2 * len(at), 8), np.uint8)
    if len(at):
        width = len(values) // len(wide)
        wide[:, :width] = np.frombuffer(values, np.uint8).reshape(width, -1).T
    quanta = wide.view("<u8").ravel()
    quanta = (quanta >> np.uint64(1)).astype(np.int64) ^ -(quanta & np.uint64(1)).astype(np.int64)
    return at, quanta.reshape(2, -1) * quantum


def _margin(bins: np.ndarray, margin: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for t in trees:
        margin = margin + np.array(t.weight)[t.nodes(bins)]
    return margin


def _best_splits(f: int, g: np.ndarray, h: np.ndarray, l2: float, min_child: float) -> Iterator[tuple]:
    """(node, gain, feature, cut, gradient and Hessian left, in all) of each node, where any split is allowed."""
    all_g, all_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    if not left_g.shape[1]:
        return
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
    gain[(left_h < min_child) | (right_h < min_child)] = -np.inf
    cut = gain.argmax(1)  # the least of equals
    for node, c in enumerate(cut.tolist()):
        if np.isfinite(gain[node, c]):
            yield node, float(gain[node, c]), f, c + 1, float(left_g[node, c]), float(left_h[node, c]), float(all_g[node, 0]), float(all_h[node, 0])


def fit(
    df: DataFrame, features: list[str], label: str, rounds: int = ROUNDS, depth: int = 6, step: float = 0.3,
    l2: float = 1.0, min_child: float = 1.0, min_gain: float = 1e-6, bins: int = 256,
) -> Model:
    """Boosts ``rounds`` trees of ``depth`` levels on rows of class 0 or 1 (the usual defaults of second-order boosting).

    A missing value counts as below all others; a null label is an error; no
    rows and rows of one class give trees of one leaf.  Of splits of one gain
    (to nine digits) the least feature and cut are taken.
    """
    if df.filter(F.col(f"`{label}`").isNull() | ~F.col(f"`{label}`").isin(0, 1)).limit(1).count():
        raise ValueError(f"{label} must be 0 or 1")
    cuts = find_cuts(df, features, bins)
    table = materialize(_blocks(df, features, label, cuts), "blocks")
    n = table.agg(F.sum("n")).first()[0] or 0
    rows = _Rows(table, len(features), int(n))
    sizes, trees = [len(c) + 1 for c in cuts], []
    for _ in range(rounds):
        tree = Tree()
        active, light = [tree.add(0.0)], []
        for level in range(depth):
            found, after, lighter = rows.candidates(tree, active, light, sizes, l2, min_child), [], []
            for node in active:
                options = found.get(node, [])
                if not options:
                    continue
                gain, f, cut, left_g, left_h, all_g, all_h = min(options, key=lambda o: (-float(f"{o[0]:.9e}"), o[1], o[2]))
                if level == 0:
                    tree.weight[0] = -step * all_g / (all_h + l2)
                if gain <= min_gain:
                    continue
                tree.split(node, f, cut, (-step * left_g / (left_h + l2), -step * (all_g - left_g) / (all_h - left_h + l2)))
                after += [tree.left[node], tree.left[node] + 1]
                lighter.append(tree.left[node] + int(2 * left_h > all_h))
            active, light = after, lighter
            if not active:
                break
        trees.append(tree)
        rows.add(tree)
    rows.drop_stale()
    rows.blocks.unpersist()
    if rows.totals is not None:
        rows.totals.unpersist()
    release(rows.table)
    return Model(features, cuts, trees)

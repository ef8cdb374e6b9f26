"""Histograms travel packed, of lighter children only, and their sums are exact."""

import numpy as np

from provenant.operators import boosting


def test_packed_sums_are_exact_and_short():
    rng = np.random.default_rng(1)
    quantum = 2.0 ** (20 - 52)
    sums = np.round(rng.normal(0, 3, (2, 5000)) / quantum) * quantum
    sums[:, rng.random(5000) < 0.3] = 0
    sums[1, 7], sums[0, 7], sums[0, 11] = 0, -1, 2.0**19
    there, values = boosting._packed(sums, quantum)
    at, got = boosting._unpacked(there, values, quantum, 5000)
    back = np.zeros_like(sums)
    back[:, at] = got
    assert (back == sums).all()
    sums[0, 11] = 0  # without the large sum, a cell takes under 12 bytes
    assert sum(map(len, boosting._packed(sums, quantum))) < 12 * (sums != 0).any(0).sum()
    at, got = boosting._unpacked(*boosting._packed(np.zeros((2, 9)), quantum), quantum, 9)
    assert not len(at) and got.shape == (2, 0)


def test_totals_of_levels_equal_plain_sums(spark, monkeypatch):
    """The heavier child's sums, which nothing sends, are its parent's less the lighter one's."""
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(c), int(a + b * (c > 3) > 5 + d)) for a, b, c, d in rng.integers(0, 12, (1500, 4))]
    df = spark.createDataFrame(rows, "x double, z double, w double, y int").repartition(5)
    monkeypatch.setattr(boosting, "BLOCK", 64)
    levels, candidates = [], boosting._Rows.candidates

    def spy(self, tree, active, light, sizes, *more):
        out = candidates(self, tree, active, light, sizes, *more)
        assert 1 < self.blocks.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert 2 * len(light) == (len(active) if light else 0) and set(light) <= set(active)
        totals = dict(self.totals.collect())
        blocks = self.blocks.collect()
        bins, y, margin = (np.concatenate([b[i] for b in blocks]) for i in range(3))
        chance = 1 / (1 + np.exp(-margin))
        both = [np.round(v / self.quantum) * self.quantum for v in (chance - y, chance * (1 - chance))]
        nodes = tree.nodes(bins)
        for f, size in enumerate(sizes):
            want = np.array([[np.bincount(bins[nodes == n, f], v[nodes == n], size) for n in active] for v in both])
            assert (totals[f] == want).all()
        levels.append(len(active))
        return out

    monkeypatch.setattr(boosting._Rows, "candidates", spy)
    boosting.fit(df, ["x", "z", "w"], "y", rounds=2, depth=4)
    assert max(levels) >= 4

"""Blocks keep the margins of all trees, so a level applies none of them again."""

import numpy as np

from provenant.operators import boosting


def test_blocks_hold_all_margins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), int(a + b > 9)) for a, b in rng.integers(0, 10, (400, 2))]
    df = spark.createDataFrame(rows, "x double, z double, y int").repartition(3)
    seen, add = [], boosting._Rows.add

    def spy(self, tree):
        add(self, tree)
        kept = self.blocks.map(lambda b: (b[0], b[2])).collect()
        seen.append((np.vstack([k[0] for k in kept]), np.concatenate([k[1] for k in kept])))

    monkeypatch.setattr(boosting._Rows, "add", spy)
    monkeypatch.setattr(boosting, "REBASE", 3)
    model = boosting.fit(df, ["x", "z"], "y", rounds=5, depth=2)
    assert len(seen) == 5
    for i, (bins, margin) in enumerate(seen):
        want = np.zeros(len(bins))
        for t in model.trees[: i + 1]:
            want = want + np.array(t.weight)[t.nodes(bins)]
        assert (margin == want).all()

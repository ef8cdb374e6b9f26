"""Second-order boosting against a plain version."""

import math
import random

import numpy as np
import pytest

from provenant.operators import boosting


def plain(rows, n_features, rounds, depth, step=0.3, l2=1.0, min_child=1.0, min_gain=1e-6):
    """Margins of the rows by plain loops over all values of all features."""
    margins = [0.0] * len(rows)
    splits = []
    for _ in range(rounds):
        g = [1 / (1 + math.exp(-m)) - r[-1] for m, r in zip(margins, rows, strict=True)]
        h = [1 / (1 + math.exp(-m)) * (1 - 1 / (1 + math.exp(-m))) for m in margins]

        def grow(own, level, g=g, h=h):
            all_g, all_h = math.fsum(g[i] for i in own), math.fsum(h[i] for i in own)
            best = None
            if level < depth:
                for f in range(n_features):
                    for cut in sorted({rows[i][f] for i in own}):
                        left = [i for i in own if rows[i][f] < cut]
                        right = [i for i in own if rows[i][f] >= cut]
                        lg, lh = math.fsum(g[i] for i in left), math.fsum(h[i] for i in left)
                        rg, rh = math.fsum(g[i] for i in right), math.fsum(h[i] for i in right)
                        if lh < min_child or rh < min_child:
                            continue
                        gain = lg**2 / (lh + l2) + rg**2 / (rh + l2) - all_g**2 / (all_h + l2)
                        if gain > min_gain and (best is None or float(f"{gain:.9e}") > best[0]):
                            best = (float(f"{gain:.9e}"), f, left, right)
            if best is None:
                for i in own:
                    margins[i] += -step * all_g / (all_h + l2)
            else:
                splits.append(best[1])
                grow(best[2], level + 1)
                grow(best[3], level + 1)

        grow(range(len(rows)), 0)
    return margins, splits


def data(seed, n, features):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [rng.choice([rng.randint(0, 9), round(rng.gauss(0, 2), 2)]) * 1.0 for _ in range(features)]
        rows.append((*x, int(x[0] + x[1] * rng.random() > 2)))
    return rows


@pytest.mark.parametrize("parts,rounds,depth", [(1, 5, 6), (5, 20, 3), (3, 18, 2)])
def test_model_equals_the_plain_one(spark, parts, rounds, depth):
    rows, names = data(rounds, 160, 4), ["a", "b", "c d", "e"]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["id", *names, "y"]).repartition(parts)
    model = boosting.fit(frame, names, "y", rounds=rounds, depth=depth)
    margins, splits = plain(rows, 4, rounds, depth)
    got = {r.id: r.score for r in model.score(frame).collect()}
    for i, m in enumerate(margins):
        assert math.isclose(got[i], 1 / (1 + math.exp(-m)), rel_tol=0, abs_tol=1e-9)
    assert dict(model.split_counts()) == {names[f]: splits.count(f) for f in set(splits)}


def test_model_does_not_depend_on_tasks(spark):
    rows = data(5, 2000, 6)
    frame = spark.createDataFrame(rows, [f"f{i}" for i in range(6)] + ["y"])
    models = [boosting.fit(frame.repartition(p), [f"f{i}" for i in range(6)], "y", rounds=4, bins=32) for p in (1, 7)]
    assert models[0].trees == models[1].trees


def test_loss_falls_and_odd_rows_are_defined(spark):
    rows = [(None, 1.0, 1), (float("nan"), 0.0, 0), (2.0, None, 1), (3.0, 3.0, 0)] * 20
    frame = spark.createDataFrame(rows, "a double, b double, y int")
    model = boosting.fit(frame, ["a", "b"], "y", rounds=10)
    loss = []
    for k in (1, 5, 10):
        scores = boosting.Model(model.features, model.cuts, model.trees[:k]).score(frame).collect()
        loss.append(-np.mean([math.log(r.score if r.y else 1 - r.score) for r in scores]))
    assert loss[0] > loss[1] > loss[2]
    one = boosting.fit(frame.filter("y = 1"), ["a", "b"], "y", rounds=2)
    assert all(r.score > 0.5 for r in one.score(frame).collect())
    none = boosting.fit(frame.limit(0), ["a", "b"], "y", rounds=2)
    assert {r.score for r in none.score(frame).collect()} == {0.5} and none.score(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="0 or 1"):
        boosting.fit(frame.withColumn("y", frame.y + 1), ["a", "b"], "y")

"""Contributions to single predictions: they add up, and equal a sum over all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackwater.operators import attributions, learning
from brackwater.sources import generators

NAMES = ["dur", "spkts", "rate", "sbytes"]


def walk(tree, x, known):
    """Mean of one tree's output where only the features `known` are."""
    nodes = {r.id: r for r in tree.itertuples()}

    def down(at):
        n = nodes[at]
        if n.left < 0:
            return n.value
        if n.feature in known:
            return down(n.left if x[n.feature] <= n.threshold else n.right)
        a, b = nodes[n.left].cover, nodes[n.right].cover
        return (a * down(n.left) + b * down(n.right)) / (a + b)

    return down(0)


def shapley(value, n):
    out = np.zeros(n)
    for j in range(n):
        rest = [i for i in range(n) if i != j]
        for size in range(n):
            for s in combinations(rest, size):
                out[j] += factorial(size) * factorial(n - 1 - size) / factorial(n) * (value({*s, j}) - value(set(s)))
    return out


@pytest.mark.parametrize(("kind", "params"), [("boosted_trees", {"maxIter": 4, "maxDepth": 4}), ("random_forest", {"numTrees": 5, "maxDepth": 5})])
def test_equal_to_all_subsets(spark, monkeypatch, kind, params):
    df = generators.flows(spark, 600)
    fitted = learning.train_classifier(df, kind, NAMES, **params)
    seen = []
    inner = attributions._leaves
    monkeypatch.setattr(attributions, "_leaves", lambda nodes, scale: seen.append((nodes, scale)) or inner(nodes, scale))
    trees = attributions.explainer(fitted, NAMES)
    some = df.orderBy("id").limit(12)
    got = attributions.explain(fitted, some.withColumn("base", F.lit(1)).drop("base"), trees).orderBy("id").collect()
    for r in got:
        x = np.array([r[c] for c in NAMES], float)
        value = lambda known: sum(scale * walk(nodes, x, known) for nodes, scale in seen)  # noqa: B023, E731
        assert np.allclose(r.contributions, shapley(value, len(NAMES)), atol=1e-10)
        assert abs(r.base - value(set())) < 1e-10
    score = {r.id: r.score for r in learning.probabilities(fitted, some).collect()}
    for r in got:
        total = r.base + sum(r.contributions)
        assert abs((1 / (1 + np.exp(-2 * total)) if kind == "boosted_trees" else total) - score[r.id]) < 1e-9
    monkeypatch.setattr(attributions, "_TABLE", 0)  # patterns as they occur, without tables
    again = attributions.explain(fitted, some, attributions.explainer(fitted)).orderBy("id").collect()
    assert all(np.allclose(a.contributions, b.contributions) for a, b in zip(got, again, strict=True))
    top = attributions.mean_contributions(attributions.explain(fitted, df, trees), NAMES).orderBy(F.desc("mean_abs")).collect()
    assert {r.feature for r in top} == set(NAMES) and top[0].mean_abs > 0.05
    assert attributions.explain(fitted, df.limit(0), trees).count() == 0


def test_missing_values_and_categories(spark):
    df = generators.flows(spark, 500).withColumn("proto", F.when(F.col("id") % 2 == 0, "tcp").otherwise("udp"))
    fitted = learning.train_classifier(df, "boosted_trees", ["spkts", "dur"], ["proto"], maxIter=3, maxDepth=3)
    odd = df.limit(6).withColumn("spkts", F.when(F.col("id") % 2 == 0, F.lit(None).cast("double")).otherwise(F.col("spkts"))).withColumn("proto", F.lit("never seen"))
    score = {r.id: r.score for r in learning.probabilities(fitted, odd).collect()}
    for r in attributions.explain(fitted, odd).collect():
        assert abs(1 / (1 + np.exp(-2 * (r.base + sum(r.contributions)))) - score[r.id]) < 1e-9


def test_each_cell_is_worked_out_once(monkeypatch):
    low = lambda a: np.array([a], float)
    leaves = [attributions.Leaf(v, np.array([j]), low(a), low(b), low(s)) for v, j, a, b, s in ((1.0, 0, -np.inf, 3, 0.4), (2.0, 0, 3, np.inf, 0.6), (5.0, 1, -np.inf, 0.5, 0.3), (7.0, 1, 0.5, np.inf, 0.7))]
    trees = attributions.Explainer(leaves, 0.0, 2, ["a", "b"])
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 7, 5000), rng.choice([0.2, 0.5, 0.9, np.nan], 5000)], 1).astype(float)
    want, seen, plain = trees.contributions(x), [], attributions.Explainer.contributions
    monkeypatch.setattr(attributions.Explainer, "contributions", lambda self, some: seen.append(len(some)) or plain(self, some))
    for most in (1 << 17, 1):
        cells = attributions.Cells(trees, most)
        assert np.array_equal(np.concatenate([cells.contributions(part) for part in np.array_split(x, 5)]), want)
    assert seen[:1] == [4] and sum(seen) <= 4 + 5 * 4

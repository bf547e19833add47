"""Histogram boosting: the same trees as a plain version that tries every split, whatever the layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackwater.operators import boosting, metrics
from brackwater.sources import generators

COLUMNS = ["a", "b", "c"]


def rows_of(n, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n).round(2), rng.integers(0, 5, n).astype(float)
    c = np.where(rng.random(n) < 0.2, np.nan, rng.random(n).round(1))
    y = (a + (b == 2) - np.nan_to_num(c) + rng.normal(scale=0.5, size=n) > 0).astype(int)
    return [(i, *(None if np.isnan(v) else float(v) for v in r), int(t)) for i, (r, t) in enumerate(zip(np.stack([a, b, c], 1), y, strict=True))]


def plain_trees(model, x, y, marks, use_of, depth, rate, reg, least, row_share, seed):
    """Every split of every node by sums over its rows, one round after the other."""
    codes = model.codes(x)
    margin = np.full(len(y), model.base)
    out = []
    for r, use in enumerate(use_of):
        g, h = (v / boosting._UNIT for v in boosting.gradients(margin, y))
        seen = boosting.sampled(marks, r, row_share, seed)

        def grow(rows, level):
            own = rows & seen
            value = -rate * g[own].sum() / (h[own].sum() + reg)
            best = (1e-9, None)
            if level < depth:
                for j in use:
                    for b in range(codes.max() + 1):
                        left, right = own & (codes[:, j] <= b), own & (codes[:, j] > b)
                        gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[right].sum(), h[right].sum()
                        if hl >= least and hr >= least:
                            gain = gl**2 / (hl + reg) + gr**2 / (hr + reg) - (gl + gr) ** 2 / (hl + hr + reg)
                            if gain > best[0] + 1e-12:
                                best = (gain, (j, b))
            if best[1] is None:
                return value
            j, b = best[1]
            return (j, b, grow(rows & (codes[:, j] <= b), level + 1), grow(rows & (codes[:, j] > b), level + 1))

        def apply(node, row):
            while isinstance(node, tuple):
                node = node[2] if codes[row, node[0]] <= node[1] else node[3]
            return node

        tree = grow(np.ones(len(y), bool), 0)
        out.append(tree)
        margin = margin + np.array([apply(tree, i) for i in range(len(y))])
    return out, margin


def nested(tree, at=0):
    if tree.left[at] == at:
        return tree.value[at]
    return (tree.feature[at], tree.cut[at], nested(tree, tree.left[at]), nested(tree, tree.right[at]))


def same(a, b):
    return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3]) if isinstance(a, tuple) and isinstance(b, tuple) else not isinstance(a, tuple) and not isinstance(b, tuple) and abs(a - b) < 1e-6


@pytest.mark.parametrize(("row_share", "column_share"), [(1.0, 1.0), (0.7, 0.67)])
def test_trees_equal_a_plain_version(spark, row_share, column_share):
    data = rows_of(260)
    df = spark.createDataFrame(data, "id long, a double, b double, c double, label int")
    params = {"rounds": 4, "depth": 3, "bins": 12, "keep_every": 2, "row_share": row_share, "column_share": column_share}
    model = boosting.fit(df.repartition(3), COLUMNS, "label", ["id"], **params)
    marks = np.array([r.m for r in df.select("id", F.xxhash64("id").alias("m")).orderBy("id").collect()])
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in data])
    y = np.array([r[4] for r in data], float)
    rng = np.random.default_rng(42)
    use = [sorted(rng.permutation(3)[: max(1, round(3 * column_share))].tolist()) for _ in range(4)]
    want, margin = plain_trees(model, x, y, marks, use, 3, 0.1, 1.0, 1.0, row_share, 42)
    assert all(same(nested(t), w) for t, w in zip(model.trees, want, strict=True))
    score = {r.id: r.score for r in boosting.predict(df, model).collect()}
    assert np.allclose([score[i] for i in range(260)], 1 / (1 + np.exp(-margin)), atol=1e-6)
    again = boosting.fit(df.repartition(11), COLUMNS, "label", ["id"], **params)
    assert [nested(t) for t in again.trees] == [nested(t) for t in model.trees]


def test_it_learns_and_odd_tables(spark):
    df = generators.flows(spark, 800)
    model = boosting.fit(df.filter("id % 2 = 0"), ["dur", "spkts", "rate"], "label", ["id"], rounds=6, depth=3)
    assert metrics.roc_auc(boosting.predict(df.filter("id % 2 = 1"), model), "label", "score").first()[0] > 0.95
    odd = spark.createDataFrame([(1, None, 1.0, 0), (2, float("nan"), float("inf"), 1), (3, 2.0, -1.0, None), (3, 2.0, -1.0, 1)], "id long, a double, b double, label int")
    few = boosting.fit(odd, ["a", "b"], "label", ["id"], rounds=2, depth=2, least=0.0)
    assert boosting.predict(odd, few).filter("score > 0 AND score < 1").count() == 4
    none = boosting.fit(odd.limit(0), ["a", "b"], "label", ["id"], rounds=1)
    assert {r.score for r in boosting.predict(odd, none).collect()} == {0.5}


def test_finder_equals_a_walk():
    rng = np.random.default_rng(3)
    for inner in (0, 1, 7, 15, 40):
        tree = boosting.Tree()
        tree.add()
        ends = [0]
        for _ in range(inner):
            at = ends.pop(int(rng.integers(len(ends))))
            tree.feature[at], tree.cut[at] = int(rng.integers(3)), int(rng.integers(60))
            tree.left[at], tree.right[at] = tree.add(), tree.add()
            ends += [tree.left[at], tree.right[at]]
        codes = rng.integers(0, 66, (500, 3)).astype(np.uint8)
        for depth in (0, 2, 6):
            at = [0] * len(codes)
            for _ in range(depth):
                at = [(tree.left if c[tree.feature[i]] <= tree.cut[i] else tree.right)[i] for c, i in zip(codes, at)]
            assert tree.finder(depth)(codes).tolist() == at


def test_checkpoint_rows_hold_many(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(boosting, "cut_lineage", lambda df: kept.append(df.localCheckpoint()) or kept[-1])
    df = spark.range(0, 5000, numPartitions=2).selectExpr("id", "CAST(id % 97 AS DOUBLE) AS a", "CAST(id % 97 > 40 AS INT) AS label")
    model = boosting.fit(df, ["a"], "label", ["id"], rounds=3, depth=2, keep_every=1)
    assert all(k.count() <= 4 for k in kept) and len(model.trees) == 3

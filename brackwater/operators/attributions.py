"""Explanations of single predictions: path-dependent Shapley values of Spark ML trees.

A fitted forest is flattened into leaves. A leaf of a tree asks of each feature on its path that its value lies in an interval;
a feature that is not known goes both ways, in the shares of the training rows (`cover`). What a leaf adds to a feature depends
only on which of its intervals hold, so contributions come from small tables, one for each leaf, looked up by the bits of
the intervals. Rows stay where they are: one Arrow pass over df, with the leaves in the closure.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.session import remove_folder, shared_dir

_TABLE = 256  # tables of up to so many patterns are made once; beyond, only the patterns that occur


@dataclass
class Leaf:
    value: float
    features: np.ndarray
    low: np.ndarray  # low < x <= high
    high: np.ndarray
    share: np.ndarray  # of the training rows that went this way at the feature's splits
    table: np.ndarray | None = field(default=None, repr=False)

    def parts(self, holds: np.ndarray) -> np.ndarray:
        """Contributions to the features for each row of booleans."""
        m = len(self.features)
        out = np.empty(holds.shape, float)
        for j in range(m):
            poly = np.zeros((len(holds), m))  # coefficients by the number of known features
            poly[:, 0] = 1.0
            for i in range(m):
                if i != j:
                    poly[:, 1:] = poly[:, 1:] * self.share[i] + poly[:, :-1] * holds[:, i, None]
                    poly[:, 0] *= self.share[i]
            weights = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
            out[:, j] = (poly @ weights) * (holds[:, j] - self.share[j]) * self.value
        return out

    def add_to(self, out: np.ndarray, x: np.ndarray) -> None:
        m = len(self.features)
        if not m:
            return
        holds = (x[:, self.features] > self.low) & (x[:, self.features] <= self.high)
        pattern = holds @ (1 << np.arange(m))
        if 1 << m <= _TABLE:
            if self.table is None:
                self.table = self.parts((np.arange(1 << m)[:, None] >> np.arange(m)) & 1)
            out[:, self.features] += self.table[pattern]
        else:
            some, where = np.unique(pattern, return_inverse=True)
            out[:, self.features] += self.parts((some[:, None] >> np.arange(m)) & 1)[where.ravel()]


@dataclass
class Explainer:
    """Leaves of all trees, the mean prediction over the training rows, and the number of features."""

    leaves: list[Leaf]
    base: float
    features: int
    names: list[str]

    def cells(self) -> Cells:
        return Cells(self)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.features))
        x = np.where(np.isnan(x), np.inf, x)  # no value goes right at every split
        for leaf in self.leaves:
            leaf.add_to(out, x)
        return out


class Cells:
    """Contributions looked up by cell. All rows between the same two neighbouring bounds of every feature meet the same leaves, so
    each cell is worked out once, and those of the last `most` cells at least are kept by a task."""

    def __init__(self, trees: Explainer, most: int = 1 << 17):
        self.trees, self.most = trees, most
        ends = [(int(f), b) for leaf in trees.leaves for f, lo, hi in zip(leaf.features, leaf.low, leaf.high, strict=True) for b in (lo, hi) if np.isfinite(b)]
        self.bounds = [np.unique([b for f, b in ends if f == j]) for j in range(trees.features)]
        self.place: dict[bytes, int] = {}
        self.known = np.zeros((0, trees.features))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), np.inf, x)  # as `Explainer.contributions`
        code = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(self.bounds)], 1) if self.bounds else np.zeros((len(x), 0), np.int64)
        sizes = [len(b) + 1 for b in self.bounds]
        if np.prod(np.array(sizes, float)) < 2.0**62:
            key = code @ np.cumprod([1, *sizes[:-1]]).astype(np.int64) if sizes else np.zeros(len(x), np.int64)
        else:
            key = np.ascontiguousarray(code.astype(np.int32)).view(f"V{4 * code.shape[1]}").ravel()
        cells, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        names = cells.tolist()
        new = np.array([i for i, c in enumerate(names) if c not in self.place], np.int64)
        if len(new):
            if len(self.place) + len(new) > self.most:
                self.place, self.known, new = {}, self.known[:0], np.arange(len(names))
            self.place.update(zip((names[i] for i in new), range(len(self.place), len(self.place) + len(new)), strict=True))
            self.known = np.concatenate([self.known, self.trees.contributions(x[first[new]])])
        return self.known[np.array([self.place[c] for c in names], np.int64)][inverse.ravel()]


def _leaves(nodes: pd.DataFrame, scale: float) -> tuple[list[Leaf], float]:
    """Leaves of one tree (columns id, left, right, feature, threshold, value, cover) and its mean, both times `scale`."""
    by = {r.id: r for r in nodes.itertuples()}
    out, mean = [], 0.0
    todo = [(0, {}, 1.0)]
    while todo:
        at, known, reach = todo.pop()
        n = by[at]
        if n.left < 0:
            mean += reach * n.value * scale
            f = sorted(known)
            out.append(Leaf(n.value * scale, np.array(f, int), *(np.array([known[i][c] for i in f], float) for c in range(3))))
            continue
        low, high, share = known.get(n.feature, (-np.inf, np.inf, 1.0))
        for child, a, b in ((n.left, low, min(high, n.threshold)), (n.right, max(low, n.threshold), high)):
            part = by[child].cover / n.cover if n.cover else 0.5
            todo.append((child, known | {n.feature: (a, b, share * part)}, reach * part))
    return out, mean


def explainer(fitted: PipelineModel, names: Sequence[str] = ()) -> Explainer:
    """The flattened trees of a fitted pipeline whose last stage is a forest or boosted trees. A forest's trees give the share of
    the positive label; boosted trees give the margin."""
    model = fitted.stages[-1]
    spark = SparkSession.active()
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    boosted = type(model).__name__.startswith("GBT")
    saved = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    stats = F.col("impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    nodes = saved.select(
        "tree", "id",
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"), F.col("split.numCategories").alias("categories"),
        (F.col("prediction") if boosted else F.get(stats, F.lit(1)) / total).alias("value"),
        (F.get(stats, F.lit(0)) if boosted else total).alias("cover"),
    ).toPandas()  # bounded by the model's size
    remove_folder(spark, path)
    if (nodes["categories"] > 0).any():
        raise ValueError("splits by categories are not explained; encode them as columns")
    weights = list(model.treeWeights)
    if not boosted:
        weights = [w / sum(weights) for w in weights]
    leaves, base = [], 0.0
    for t, part in nodes.groupby("tree"):
        more, mean = _leaves(part, weights[int(t)])
        leaves += more
        base += mean
    return Explainer(leaves, base, model.numFeatures, list(names) or [f"f{i}" for i in range(model.numFeatures)])


def explain(fitted: PipelineModel, df: DataFrame, trees: Explainer | None = None) -> DataFrame:
    """df with `base` and `contributions` (one for each feature of the assembled vector): they add up to the model's margin (boosted
    trees) or probability of 1 (forests)."""
    trees = trees or explainer(fitted)
    assembled = df
    for stage in fitted.stages[:-1]:
        assembled = stage.transform(assembled)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cells = trees.cells()
        for rows in batches:
            x = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, trees.features))
            parts = [cells.contributions(x[i : i + 16384]) for i in range(0, len(x), 16384)]
            yield pd.Series(list(np.concatenate(parts)) if parts else [], dtype=object)

    features = fitted.stages[-1].getFeaturesCol()
    return assembled.withColumn("contributions", run(vector_to_array(features))).select(*df.columns, F.lit(trees.base).alias("base"), "contributions")


def mean_contributions(explained: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, mean absolute and mean contribution over all rows."""
    row = explained.agg(*[x for i in range(len(names)) for x in (F.avg(F.abs(F.col("contributions")[i])).alias(f"a{i}"), F.avg(F.col("contributions")[i]).alias(f"m{i}"))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"a{i}").alias("mean_abs"), F.col(f"m{i}").alias("mean")) for i, n in enumerate(names)])))

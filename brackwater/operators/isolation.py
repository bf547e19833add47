"""Isolation forest: each tree grows from its own seeded sample of all rows; scoring is one Arrow pass with flattened trees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.operators.metrics import threshold_sweep
from brackwater.session import cut_lineage


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Flat node arrays; a leaf points to itself and holds its depth plus the mean path of its rows."""

    columns: tuple[str, ...]
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    sample: int
    depth: int
    offset: float = -0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """-2 ** (-mean length / normaliser): lower is more anomalous."""
        node = np.repeat(self.roots[None, :], len(x), 0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] < self.threshold[node], self.left[node], self.right[node])
        return -(2.0 ** (-self.length[node].mean(1) / max(float(mean_path(self.sample)), 1e-9)))

    def save(self, spark, path: str) -> None:
        """The nodes as a Parquet table, and the rest as one JSON row."""
        nodes = pd.DataFrame({"node": np.arange(len(self.left)), "feature": self.feature, "threshold": self.threshold, "left": self.left, "right": self.right, "length": self.length})
        spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/nodes")
        row = (list(self.columns), self.roots.tolist(), self.sample, self.depth, self.offset)
        spark.createDataFrame([row], _META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


_META = "columns array<string>, roots array<long>, sample int, depth int, offset double"


def load(spark, path: str) -> Forest:
    m = spark.read.schema(_META).json(f"{path}/meta").first()
    t = spark.read.parquet(f"{path}/nodes").toPandas().sort_values("node")
    return Forest(tuple(m.columns), np.array(m.roots), *(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "length")), m.sample, m.depth, m.offset)


def grow(x: np.ndarray, columns: Sequence[str], trees: int, sample: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(sample, 2))))
    feature, threshold, left, right, length, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (threshold, np.inf), (left, len(left)), (right, len(right)), (length, 0.0)):
            a.append(v)
        return len(left) - 1

    dealt = rng.permutation(len(x)) if len(x) >= trees * sample else None
    for t in range(trees):
        roots.append(node())
        own = rng.permutation(len(x))[:sample] if dealt is None else dealt[t * sample : (t + 1) * sample]
        todo = [(roots[-1], x[own], 0)]
        while todo:
            at, rows, level = todo.pop()
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
            free = np.flatnonzero(high > low)
            if level >= limit or len(rows) < 2 or not len(free):
                length[at] = level + float(mean_path(len(rows)))
                continue
            j = int(rng.choice(free))
            cut = rng.uniform(low[j], high[j])
            feature[at], threshold[at], left[at], right[at] = j, cut, node(), node()
            goes = rows[:, j] < cut
            todo += [(left[at], rows[goes], level + 1), (right[at], rows[~goes], level + 1)]
    return Forest(tuple(columns), *(np.array(a) for a in (roots, feature, threshold, left, right, length)), sample, limit)


def draw_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows of df (all, if it has no more), every row with the same chance. Rows beyond a bound on the draw, which is n at
    more than ten deviations, are dropped before they are ordered."""
    bound = (n + 10 * n**0.5 + 100) / max(1, df.count())
    return df.withColumn("_drawn", F.rand(seed)).filter(F.col("_drawn") < bound).orderBy("_drawn").limit(n).drop("_drawn")


def _clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in columns])


def _offset(scores: DataFrame, contamination: float) -> float:
    q = scores.agg(F.percentile_approx("s", contamination, 100_000)).first()[0]
    return float(q) if q is not None else -0.5


def fit(train: DataFrame, columns: Sequence[str], trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42) -> Forest:
    """Each tree samples `sample` of all training rows: `trees * sample` rows are drawn in Spark, each row with the same chance
    whatever its values, and dealt to the trees; where there are fewer, every tree samples them all. The offset is the
    contamination quantile of the scores of all training rows. Nulls count 0."""
    clean = _clean(train, columns)
    forest = grow(draw_rows(clean, trees * sample, seed).toPandas().to_numpy(float), columns, trees, sample, seed)
    forest.offset = _offset(clean.select(score_column(forest).alias("s")), contamination)
    return forest


def fit_predict(df: DataFrame, columns: Sequence[str], trees: int = 100, sample: int = 256, contamination: float = 0.1, threshold: float = 0.0, seed: int = 42) -> tuple[Forest, DataFrame]:
    """The forest of df and its predictions on df: rows are scored once, and the scores checkpointed for both."""
    forest = grow(draw_rows(_clean(df, columns), trees * sample, seed).toPandas().to_numpy(float), columns, trees, sample, seed)
    scored = cut_lineage(df.withColumn("anomaly_score", score_column(forest)))
    forest.offset = _offset(scored.select(F.col("anomaly_score").alias("s")), contamination)
    shifted = scored.withColumn("anomaly_score", F.col("anomaly_score") - F.lit(forest.offset))
    return forest, shifted.withColumn("is_anomaly", (F.col("anomaly_score") < threshold).cast("int"))


def score_column(forest: Forest) -> Column:
    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.fillna(0).to_numpy(float) for c in cols], 1)
        return pd.Series(np.concatenate([forest.score(x[i : i + 4096]) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0))

    return run(*[F.col(c).try_cast("double") for c in forest.columns])


def predict(df: DataFrame, forest: Forest, threshold: float = 0.0) -> DataFrame:
    """Adds anomaly_score (score minus offset) and is_anomaly (score < threshold)."""
    out = df.withColumn("anomaly_score", score_column(forest) - F.lit(forest.offset))
    return out.withColumn("is_anomaly", (F.col("anomaly_score") < threshold).cast("int"))


def tune(df: DataFrame, forest: Forest, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Rates of `anomaly_score < threshold` at each threshold; metrics.best_threshold picks one."""
    return threshold_sweep(predict(df, forest), label, "anomaly_score", thresholds, below=True)


def load_or_fit(train: DataFrame, columns: Sequence[str], path: str, **params) -> Forest:
    """The forest saved under `path`; where there is none, one is trained on `train` and saved there."""
    spark = train.sparkSession
    try:
        return load(spark, path)
    except AnalysisException:
        forest = fit(train, columns, **params)
        forest.save(spark, path)
        return forest


def tune_saved(df: DataFrame, columns: Sequence[str], label: str, thresholds: Sequence[float], path: str, **params) -> DataFrame:
    """The sweep of `tune` for the saved forest, which is trained on df first if there is none."""
    return tune(df, load_or_fit(df, columns, path, **params), label, thresholds)


def noise_attack(df: DataFrame, columns: Sequence[str], sigma: float, scale: dict[str, tuple[float, float]], seed: int = 42) -> DataFrame:
    """Gaussian noise of `sigma` deviations on each column."""
    return df.withColumns({c: F.col(c) + F.randn(seed + i) * F.lit(sigma * scale[c][1]) for i, c in enumerate(columns)})


def scaling_attack(df: DataFrame, columns: Sequence[str], factor: float, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardised values times `factor`: each column moves from or towards its fitted mean."""
    return df.withColumns({c: F.lit(scale[c][0]) + (F.col(c) - F.lit(scale[c][0])) * F.lit(factor) for c in columns})


def evasion_base(scored: DataFrame, label: str, use_labels: bool = True) -> DataFrame:
    """The rows that attacks start from: those found, and of them (with `use_labels`) the true anomalies."""
    found = scored.filter("is_anomaly = 1")
    return (found.filter(F.col(label) == 1) if use_labels else found).drop("anomaly_score", "is_anomaly")

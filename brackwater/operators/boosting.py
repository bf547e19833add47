"""Histogram boosting for binary labels: gradient and hessian histograms added up in Spark, level by level.

Values become bin numbers once (cut points are a bounded list for each column), kept with label and margin in a checkpoint, whose
rows each hold the arrays of some thousand rows, so a pass costs array operations alone. For
each level of a tree a task adds up gradients and hessians of its rows by (node, column, bin); the histograms of all tasks
are added by node, and the driver, which holds one histogram a node, picks the splits. Sums are of whole numbers (2**-26), so
trees do not depend on partitions, batches or the order of tasks. Rows are sampled anew for each tree by a hash of the key,
columns by a seeded draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.session import cut_lineage

_UNIT = float(1 << 26)
_ADDERS = 16


@dataclass
class Tree:
    """Flat nodes: rows whose bin is at most `cut` go left; a leaf leads to itself."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for a, v in ((self.feature, 0), (self.cut, 255), (self.left, len(self.left)), (self.right, len(self.left)), (self.value, 0.0)):
            a.append(v)
        return len(self.left) - 1

    def find(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after `depth` steps."""
        return self.finder(depth)(codes)

    def finder(self, depth: int) -> Callable[[np.ndarray], np.ndarray]:
        """`find` for many batches. A row asks all nodes at once: a table for each column has the answers of a bin as bits, one for each
        node that splits on it, and the bits of all columns are the place of the row's node in a table. Trees of more than
        16 inner nodes are walked."""
        feature, cut, left, right = (np.array(a) for a in (self.feature, self.cut, self.left, self.right))
        inner = np.flatnonzero(left != np.arange(len(left)))
        if len(inner) > 16:

            def walk(codes: np.ndarray) -> np.ndarray:
                at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
                for _ in range(depth):
                    at = np.where(codes[rows, feature[at]] <= cut[at], left[at], right[at])
                return at

            return walk
        bit = np.zeros(len(left), np.int64)
        bit[inner] = np.arange(len(inner))
        pattern = np.arange(1 << len(inner))
        at = np.zeros(len(pattern), np.int64)
        for _ in range(depth):
            at = np.where((pattern >> bit[at]) & 1, left[at], right[at])  # a leaf leads to itself both ways
        answers = {int(j): sum(((np.arange(256) <= cut[i]).astype(np.uint16) << np.uint16(bit[i]) for i in inner[feature[inner] == j]), np.zeros(256, np.uint16)) for j in set(feature[inner].tolist())}

        def look_up(codes: np.ndarray) -> np.ndarray:
            found = np.zeros(len(codes), np.uint16)
            for j, bits in answers.items():
                found |= bits[codes[:, j]]
            return at[found]

        return look_up


@dataclass
class Boosted:
    columns: tuple[str, ...]
    edges: list[np.ndarray]
    base: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bins of values: 0 for a missing one, which is below all others, then one more for each cut point below it."""
        out = np.zeros(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            there = ~np.isnan(x[:, j])
            out[there, j] = 1 + np.searchsorted(e, x[there, j], "left")
        return out

    def margin(self, codes: np.ndarray) -> np.ndarray:
        return self.adder(self.trees)(codes, np.full(len(codes), self.base))

    def adder(self, trees: Sequence[Tree]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Adds the values of `trees` to the margins of rows, for many batches."""
        each = [(np.array(t.value), t.finder(self.depth)) for t in trees]

        def add(codes: np.ndarray, margin: np.ndarray) -> np.ndarray:
            for value, find in each:
                margin += value[find(codes)]
            return margin

        return add


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, in whole units."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) * _UNIT).astype(np.int64), np.rint(p * (1 - p) * _UNIT).astype(np.int64)


def sampled(marks: np.ndarray, round_: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree sees, by their 64-bit marks."""
    h = marks.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) < np.uint64(share * 2.0**53)


def histogram(codes: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, columns: Sequence[int], bins: int) -> np.ndarray:
    """Sums by (node, column, bin) of g and h; rows with a negative node are left out."""
    use = node >= 0
    codes, node, g, h = codes[use], node[use], g[use], h[use]
    out = np.zeros((nodes, len(columns), bins, 2), np.int64)
    for k, j in enumerate(columns):
        cell = node * bins + codes[:, j]
        for i, w in enumerate((g, h)):
            out[:, k, :, i] = np.bincount(cell, w, nodes * bins).astype(np.int64).reshape(nodes, bins)  # exact below 2**53
    return out


def best_split(sums: np.ndarray, columns: Sequence[int], reg: float, least: float) -> tuple[float, int, int, np.ndarray, np.ndarray] | None:
    """Gain, column, bin and the sums of both sides of the best split of one node, the first of equals; None without a gain."""
    left = np.cumsum(sums, 1) / _UNIT
    whole = left[:, -1:, :]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + reg)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), score(left) + score(right) - score(whole), -np.inf)
    k, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[k, b] > 1e-9:
        return None
    return float(gain[k, b]), columns[k], int(b), left[k, b], right[k, b]


_PACKED = "codes binary, y binary, mark binary, margin binary"


def _packed(*arrays: np.ndarray) -> pa.RecordBatch:
    """One row with the arrays of many."""
    return pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in arrays], ["codes", "y", "mark", "margin"])


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Codes, label, mark and margin of the rows in each row of `_PACKED`."""
    for batch in batches:
        for packed in zip(*((v.as_py() for v in c) for c in batch.columns), strict=True):
            codes, y, mark, margin = (np.frombuffer(b, t) for b, t in zip(packed, (np.uint8, np.float64, np.int64, np.float64), strict=True))
            yield codes.reshape(-1, width), y, mark, margin


def fit(df: DataFrame, columns: Sequence[str], label: str, key: Sequence[str], *, rounds: int = 20, depth: int = 4, rate: float = 0.1, bins: int = 64, reg: float = 1.0, least: float = 1.0, row_share: float = 0.8, column_share: float = 0.8, keep_every: int = 10, seed: int = 42) -> Boosted:
    """Trees of `depth` levels at most. `key` names columns that tell rows apart (rows with equal keys are sampled together). Rows
    without a label are left out; without rows the model gives even odds. Margins are checkpointed every `keep_every` trees."""
    if not 2 <= bins <= 254:
        raise ValueError("bins must be 2 to 254")
    number = [F.col(c).try_cast("double") for c in columns]
    clean = df.filter(F.col(label).isNotNull()).select(*[F.when(~F.isnan(x), x).alias(f"x{i}") for i, x in enumerate(number)], F.col(label).cast("double").alias("y"), F.xxhash64(*key).alias("mark"))
    row = clean.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *[F.percentile_approx(f"x{i}", [b / bins for b in range(1, bins)], 10_000).alias(f"x{i}") for i in range(len(columns))]).first()
    share = min(max(((row["ones"] or 0.0) + 0.5) / (row["n"] + 1.0), 1e-6), 1 - 1e-6)
    edges = [np.unique(np.array(row[f"x{i}"] or [], float)) for i in range(len(columns))]
    model = Boosted(tuple(columns), edges, float(np.log(share / (1 - share))) if row["n"] else 0.0, depth)
    width, many = len(columns), max((len(e) for e in edges), default=0) + 2

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)], 1)
            y, mark = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "mark"))
            yield _packed(model.codes(x), y.astype(np.float64), mark.astype(np.int64), np.full(len(x), model.base))

    rows = cut_lineage(clean.mapInArrow(encode, _PACKED))
    rng = np.random.default_rng(seed)
    fresh: list[Tree] = []  # trees that the checkpointed margins do not have

    def level_sums(tree: Tree, open_: list[int], level: int, use: list[int], round_: int) -> np.ndarray:
        place = np.full(len(tree.left), -1)
        place[open_] = np.arange(len(open_))
        trees = list(fresh)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(open_), len(use), many, 2), np.int64)
            add_trees, find = model.adder(trees), tree.finder(level)
            for codes, y, mark, margin in _unpacked(batches, width):
                chosen = np.flatnonzero(sampled(mark, round_, row_share, seed))
                codes = np.asfortranarray(codes[chosen])
                g, h = gradients(add_trees(codes, margin[chosen]), y[chosen])
                node = place[find(codes)]
                total += histogram(codes, node, g, h, len(open_), use, many)
            yield pa.record_batch([pa.array(np.arange(len(open_), dtype=np.int32)), pa.array([t.tobytes() for t in total], pa.binary())], ["node", "sums"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = np.frombuffer(s, np.int64)
                    sums[n] = sums[n] + own if n in sums else own
            if sums:
                yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["node", "sums"])

        parts = rows.mapInArrow(add, "node int, sums binary")
        found = parts.repartition(min(_ADDERS, len(open_)), "node").mapInArrow(merge, "node int, sums binary").collect()
        out = np.zeros((len(open_), len(use), many, 2), np.int64)
        for n, s in found:
            out[n] = np.frombuffer(s, np.int64).reshape(out.shape[1:])
        return out

    for r in range(rounds):
        use = sorted(rng.permutation(width)[: max(1, round(width * column_share))].tolist())
        tree = Tree()
        open_ = [tree.add()]
        for level in range(depth):
            sums = level_sums(tree, open_, level, use, r)
            further = []
            for at, own in zip(open_, sums, strict=True):
                if level == 0:
                    g, h = own[0].sum(0) / _UNIT
                    tree.value[at] = -rate * g / (h + reg)
                found = best_split(own, use, reg, least)
                if found is None:
                    continue
                _, j, b, *sides = found
                tree.feature[at], tree.cut[at] = j, b
                for side, s in zip((tree.left, tree.right), sides, strict=True):
                    child = tree.add()
                    side[at] = child
                    tree.value[child] = float(-rate * s[0] / (s[1] + reg))
                    further.append(child)
            open_ = further
            if not open_:
                break
        model.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == keep_every and r + 1 < rounds:
            trees = list(fresh)

            def keep(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
                add_trees = model.adder(trees)
                for codes, y, mark, margin in _unpacked(batches, width):
                    yield _packed(codes, y, mark, add_trees(codes, margin.copy()))

            rows = cut_lineage(rows.mapInArrow(keep, _PACKED))
            fresh = []
    return model


def score_column(model: Boosted) -> Column:
    """Probability of 1."""

    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float, na_value=np.nan) for c in cols], 1)
        return pd.Series(1 / (1 + np.exp(-model.margin(model.codes(x)))))

    return run(*[F.col(c).try_cast("double") for c in model.columns])


def predict(df: DataFrame, model: Boosted) -> DataFrame:
    """df with `score` and `predicted` (score >= 0.5)."""
    return df.withColumn("score", score_column(model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

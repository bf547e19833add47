"""Quality rules (operator 5): gradient-boosted trees over document statistics.

Statistics of whole texts are computed on their bytes in Arrow batches. The trees are grown in numpy on a bounded sample
of labelled rows (`train_rows`), with monotonic constraints on the features that can only count against a document,
then flattened into node arrays and applied to all rows at once, level by level.

Defined cases: a null text has no words and fails the base rules; without labels of both kinds the verdict is that of
the base rules; a null label is no label; several labels of one key count once, with the least; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.tokens import _key_type
from brackwater.llm.words import best_of, bounded_batches, find_words, hash_spans, mix, rolling, slices, text_bytes, whole

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
FEATURES = ("log_words", "mean_chars", "symbols", "dup_lines", "repeats", "upper", "digits", "shouts", "distinct", "line_words")
#: -1: more of it can only lower the score.
MONOTONE = np.array([0, 0, -1, -1, -1, -1, 0, -1, 0, 0])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _marks(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _LETTER, _DIGIT, _SHOUT = _marks(SYMBOLS), _marks(bytes(range(65, 91))), _marks(bytes([*range(65, 91), *range(97, 123), *range(0xC0, 256)])), _marks(b"0123456789"), _marks(b"!")


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The five counts, and the features, of each text."""
    buf, offs = text_bytes(texts)
    words = find_words(buf, offs)
    n = len(offs) - 1
    doc = words.doc
    h = words.hashes()

    def count(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[at])

    def in_text(marks: np.ndarray) -> np.ndarray:
        return count(marks[buf], offs)

    n_words = np.diff(words.ptr)
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    word_chars = np.bincount(doc, points[words.end] - points[words.start], n).astype(np.int64)

    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    begin = np.flatnonzero(edge[:-1] | np.concatenate([[False], buf[:-1] == 10])) if len(buf) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(buf)) if len(begin) else begin
    end = end - (buf[end - 1] == 10) if len(begin) else end
    holds = np.diff(np.searchsorted(words.start, np.append(begin, len(buf)))) > 0 if len(begin) else np.zeros(0, bool)
    begin, end = begin[holds], end[holds]
    line_doc = np.searchsorted(offs, begin, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    keys = mix(hash_spans(buf, begin, end) + mix(line_doc.astype(np.uint64)))
    fresh = np.bincount(line_doc[np.unique(keys, return_index=True)[1]], minlength=n)

    tri = rolling(h, 3)
    at = np.flatnonzero(whole(words, 3))
    covered = np.zeros(len(h), bool)
    if len(at):
        _, inverse, times = np.unique(mix(tri[at] + mix(doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
        twice = at[times[inverse.ravel()] > 1]
        for k in range(3):
            covered[twice + k] = True
    distinct = np.bincount(doc[np.unique(mix(h + mix(doc.astype(np.uint64))), return_index=True)[1]], minlength=n)

    counts = np.stack([n_words, word_chars, in_text(_SYMBOL), lines - fresh, count(covered, words.ptr)], 1)
    w = np.maximum(n_words, 1)
    features = np.stack([np.log1p(n_words), word_chars / w, counts[:, 2] / w, counts[:, 3] / np.maximum(lines, 1), counts[:, 4] / w, in_text(_UPPER) / np.maximum(in_text(_LETTER), 1), in_text(_DIGIT) / w, in_text(_SHOUT) / w, distinct / w, w / np.maximum(lines, 1)], 1)
    return counts, features.astype(np.float32)


@dataclass
class Trees:
    """All trees in flat arrays: node i sends x[feature] <= threshold to left, else to right; leaves point to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int
    cut: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), 0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Trees:
    """Logistic boosting on binned features. A constrained split is taken only if its two values are in order, and
    the midpoint bounds both subtrees, so that the whole model is monotone in the feature."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
    rate_of_good = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of_good / (1 - rate_of_good)))
    f = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (threshold, np.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(left) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        roots.append(node())
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            own = float(np.clip(gs / (hs + ridge), low, high))
            best = (1e-6, -1, -1, 0.0, 0.0)
            if level < depth and len(rows) >= 2 * least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    lg, lh = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1], np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    ln = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    lv, rv = np.clip(lg / (lh + ridge), low, high), np.clip((gs - lg) / (hs - lh + ridge), low, high)
                    gain = lg**2 / (lh + ridge) + (gs - lg) ** 2 / (hs - lh + ridge) - gs**2 / (hs + ridge)
                    gain[(ln < least) | (len(rows) - ln < least) | (monotone[j] * (rv - lv) < 0)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, k, lv[k], rv[k])
            if best[1] < 0:
                value[at] = rate * own
                f[rows] += rate * own
                continue
            _, j, k, lv, rv = best
            feature[at], threshold[at] = j, edges[j][k]
            left[at], right[at] = node(), node()
            goes, middle = binned[rows, j] <= k, (lv + rv) / 2
            bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[int(monotone[j])]
            todo += [(left[at], rows[goes], level + 1, *bounds[0]), (right[at], rows[~goes], level + 1, *bounds[1])]
    return Trees(*(np.array(a) for a in (roots, feature, np.array(threshold, np.float32), left, right, value)), base, depth)


def _fit(features: np.ndarray, y: np.ndarray, passed: np.ndarray, keep: float) -> Trees | None:
    """Trees, and the cut that keeps the share `keep` of the good rows set aside (a fifth) that pass the base rules."""
    if len(np.unique(y)) < 2:
        return None
    aside = np.arange(len(y)) % 5 == 0
    good = aside & (y == 1) & passed
    use = ~aside if good.sum() >= 50 and len(np.unique(y[~aside])) == 2 else np.ones(len(y), bool)
    model = grow(features[use], y[use], MONOTONE)
    good = good if good.sum() >= 50 else (y == 1) & passed
    model.cut = min(0.5, float(np.quantile(model.score(features[good]), 1 - keep)) - 1e-9) if good.any() else 0.5
    return model


def measure(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the five counts and `features array<float>` of each whole text."""
    kind, arrow = _key_type(docs, key)
    schema = pa.schema([(key, arrow), *((c, pa.int64()) for c in COUNTS), ("features", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                counts, x = statistics(part.column(text))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c) for c in counts.T), rows], schema=schema)

    return bounded_batches(docs).select(key, text).mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{c} long' for c in COUNTS)}, features array<float>")


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_trees(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = 20_000, keep: float = 0.998) -> Trees | None:
    """Trees from at most `train_rows` labelled keys, the first in the order of a hash of the key: the same ones in every run. A key of
    several rows teaches one of them, that with the least features, so a key on a third of all rows is one row of the driver's."""
    spark = docs.sparkSession
    labels = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("label"))
    picked = best_of(labels, train_rows, F.xxhash64(F.col(key), F.lit(29)), key).collect()
    if not picked:
        return None
    some = spark.createDataFrame(picked, labels.schema)  # bounded by `train_rows`
    rows = measure(docs.select(key, text).join(F.broadcast(some), key, "left_semi"), key=key, text=text)
    one = rows.groupBy(key).agg(F.min(F.struct("features", (~base_failed()).alias("passed"))).alias("x"))
    found = one.join(F.broadcast(some), key).select(key, "x.features", "label", "x.passed").toPandas().sort_values(key)
    if not len(found):
        return None
    return _fit(np.stack(found["features"].to_numpy()).astype(np.float32), (found["label"].to_numpy() > 0).astype(float), found["passed"].to_numpy(), keep)


def judge(docs: DataFrame, model: Trees | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the five counts, base_failed, score (null without a model) and kept, of each whole text."""
    kind, arrow = _key_type(docs, key)
    schema = pa.schema([(key, arrow), *((c, pa.int64()) for c in COUNTS), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for part in slices(batch, text):
                counts, x = statistics(part.column(text))
                score = pa.nulls(len(x), pa.float64()) if trees is None else pa.array(trees.score(x))
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c) for c in counts.T), score], schema=schema)

    cut = model.cut if model else 0.0
    scored = bounded_batches(docs).select(key, text).mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{c} long' for c in COUNTS)}, score double")
    scored = scored.withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= cut, F.lit(True)))


def keep_good(docs: DataFrame, model: Trees | None, *, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that `judge` keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for part in slices(batch, text):
                counts, x = statistics(part.column(text))
                good = (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0])
                if trees is not None:
                    good &= trees.score(x) >= trees.cut
                yield part.filter(pa.array(good))

    return bounded_batches(docs).mapInArrow(run, docs.schema)

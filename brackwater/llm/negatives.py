"""Hard-negative mining (operator 12): exact integer inner products by bit-planes of the rows.

Components become whole numbers, floor(scale * x). A block of rows is held as bit-planes of its two's complement. A score is
summed up plane by plane, most significant first; after each, the planes still to come leave an interval (they add between
-negative * slack and positive * slack, where these are the sums of the anchor's components of either sign). Candidates
whose interval lies outside what an anchor asks for, or below as many sure candidates as it keeps, are dropped; planes are
whole matrix products while most candidates are left, and sums over the remaining pairs after that. What is left after
the last plane has its exact score.

The anchors are a stated query set, met with all rows in blocks: rows are packed where they are read, anchors into blocks of
`anchor_block`, and each pair of blocks is one row of a join, whose task holds one block of each at a time and keeps the best
rows of each anchor so far. Two passes: the positives of each anchor, then, within the scores that they set, its negatives.
Only the best rows of a task travel, and are ranked by anchor; nothing is collected or broadcast by the operator.

Defined cases: rows with a null key, label or vector, or a component that is null or not finite, take no part; a shorter
vector counts as if it ended in zeros; an anchor key of several rows stands for the one with the least label, then the least
vector, and rows with its key are neither its positives nor its negatives; otherwise repeated rows each count; equal scores go
by the smaller key; an empty table, or one without anchors, gives an empty table; columns not asked for are not read. A
component beyond 2**26 after scaling is an error: its products might not fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST, MOST = np.int64(-(2**62)), np.int64(2**62)
_PAIRS = 1 << 19  # pairs worked on at once
_DENSE = 8  # whole matrix products until one pair in so many is left


class Planes:
    """Rows as bit-planes, most significant first, each with its weight; the first is the sign."""

    def __init__(self, values: np.ndarray):
        wide = int(np.abs(values).max(initial=0))
        self.bits = max(1, wide.bit_length() + 1)
        self.planes = [((values >> b) & 1).astype(np.uint8) for b in range(self.bits - 1, -1, -1)]
        self.weights = [-(1 << (self.bits - 1)), *(1 << b for b in range(self.bits - 2, -1, -1))]


def _kth(group: np.ndarray, score: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The k-th largest score of each group, LEAST where there are fewer."""
    out = np.full(groups, LEAST)
    order = np.lexsort((-score, group))
    group = group[order]
    rank = np.arange(len(group)) - np.searchsorted(group, group)
    at = rank == k - 1
    out[group[at]] = score[order][at]
    return out


def sliced_products(anchors: np.ndarray, rows: Planes, allowed: np.ndarray, floor: np.ndarray, ceil: np.ndarray, bar: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and exact score of every allowed pair that may be one of the `keep` best of its anchor, floor <= score <= ceil,
    for one of the bands: floor, ceil and bar (a score below which nothing is wanted) have a column for each band."""
    plus, minus = np.maximum(anchors, 0).sum(1), np.maximum(-anchors, 0).sum(1)
    kind = np.float32 if int((plus + minus).max(initial=0)) < 1 << 24 else np.float64  # sums of parts stay exact
    left = anchors.astype(kind)
    alive, dense = allowed, True
    score = np.zeros(alive.shape, np.int64)
    i = j = np.zeros(0, np.int64)
    for done, (plane, weight) in enumerate(zip(rows.planes, rows.weights, strict=True)):
        slack = (1 << (rows.bits - 1 - done)) - 1
        if dense:
            score += weight * (left @ plane.T.astype(kind)).astype(np.int64)
            low, high = score - slack * minus[:, None], score + slack * plus[:, None]
            may = np.zeros(alive.shape, bool)
            for f, c, b in zip(floor.T, ceil.T, bar.T, strict=True):
                sure = alive & (low >= f[:, None]) & (high <= c[:, None])
                if alive.shape[1] > keep and (sure.sum(1) >= keep).any():
                    b = np.maximum(b, np.partition(np.where(sure, low, LEAST), -keep, axis=1)[:, -keep])
                may |= (high >= np.maximum(f, b)[:, None]) & (low <= c[:, None])
            alive = alive & may
            if alive.sum() * _DENSE <= alive.size:
                dense = False
                i, j = np.nonzero(alive)
                score = score[i, j]
        else:
            score = score + weight * np.einsum("pd,pd->p", anchors[i], plane[j].astype(np.int64))
            low, high = score - slack * minus[i], score + slack * plus[i]
            may = np.zeros(len(i), bool)
            for f, c, b in zip(floor.T, ceil.T, bar.T, strict=True):
                sure = (low >= f[i]) & (high <= c[i])
                b = np.maximum(b, _kth(i[sure], low[sure], keep, len(anchors)))
                may |= (high >= np.maximum(f, b)[i]) & (low <= c[i])
            i, j, score = i[may], j[may], score[may]
    if dense:
        i, j = np.nonzero(alive)
        score = score[i, j]
    return i, j, score


def _first(group: np.ndarray, score: np.ndarray, key: np.ndarray, keep: int) -> np.ndarray:
    """Which rows are the `keep` first of their group, by score down, then key."""
    order = np.lexsort((key, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < keep]


def _whole(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of a list array, shorter ones filled with 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.floor(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
    if len(flat) and np.abs(flat).max() > 1 << 26:
        raise ValueError("a component is beyond 2**26 after scaling")
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat.astype(np.int64)
    return out


def _values(row: dict, prefix: str) -> np.ndarray:
    n = row[f"{prefix}n"]
    raw = row[f"{prefix}values"]
    dims = row[f"{prefix}dims"]
    return np.frombuffer(raw, np.int16 if len(raw) == 2 * n * dims else np.int32).reshape(n, dims).astype(np.int64)


def _wider(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def _packed(rows: DataFrame, scale: int, block: int, prefix: str, slots: int = 0) -> DataFrame:
    """Blocks of rows k, l, v (and found: place, other, score) of one partition each, as bytes; names begin with `prefix`."""
    names = [f"{prefix}{c}" for c in ("n", "dims", "keys", "labels", "values", "others", "scores")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            while len(batch):
                held.append(batch.slice(0, block - count))
                batch = batch.slice(block - count)
                count += len(held[-1])
                if count == block:
                    yield one(held)
                    held, count = [], 0
        if count:
            yield one(held)

    def one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        values = _whole(table.column("v"), scale)
        small = np.abs(values).max(initial=0) < 1 << 15
        others, scores = np.zeros((len(table), slots), np.int64), np.full((len(table), slots), LEAST)
        if slots:
            for r, found in enumerate(table.column("found").to_pylist()):
                for s, x in enumerate(found):
                    others[r, s], scores[r, s] = x["other"], x["score"]
        raw = [table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("k", "l")]
        cells = [len(table), values.shape[1], *raw, values.astype(np.int16 if small else np.int32).tobytes(), others.tobytes(), scores.tobytes()]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.record_batch([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names)

    return rows.mapInArrow(pack, ", ".join(f"{n} {t}" for n, t in zip(names, ["int", "int", *["binary"] * 5], strict=True)))


def _search(pairs: DataFrame, keep: int, slots: int, low: int, high: int) -> DataFrame:
    """anchor, slot, other, score: the best rows that a task has found. Without slots rows of the anchor's label, at any score;
    with them rows of other labels, between `low` and `high` hundredths of the score of each slot, and the positive of the slot."""
    schema = "anchor long, slot int, other long, score long, positive long, positive_score long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list[np.ndarray]] = {}  # by the keys of an anchor block: group, score, key
        asked: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # the positives and their scores
        for batch in batches:
            for at in range(len(batch)):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                a, x = _values(row, "a_"), _values(row, "r_")
                dims = max(a.shape[1], x.shape[1])
                a, planes = _wider(a, dims), Planes(_wider(x, dims))
                own, other, a_label, r_label = (np.frombuffer(row[c], np.int64) for c in ("a_keys", "r_keys", "a_labels", "r_labels"))
                bands = max(1, slots)
                if slots:
                    goal = np.frombuffer(row["a_scores"], np.int64).reshape(-1, slots)
                    none = goal == LEAST
                    floor = np.where(none, MOST, -((-low * np.where(none, 0, goal)) // high))
                    ceil = goal
                else:
                    floor, ceil = np.full((len(own), 1), LEAST), np.full((len(own), 1), MOST)
                held = best.setdefault(row["a_keys"], [np.zeros(0, np.int64)] * 3)
                asked[row["a_keys"]] = (np.frombuffer(row["a_others"], np.int64), goal.ravel()) if slots else (np.zeros(len(own), np.int64),) * 2
                bar = _kth(held[0], held[1], keep, len(own) * bands).reshape(-1, bands)
                step = max(1, _PAIRS // max(1, len(other)))
                new = [held]
                for s in range(0, len(own), step):
                    part = slice(s, s + step)
                    allowed = ((a_label[part, None] != r_label) if slots else (a_label[part, None] == r_label)) & (own[part, None] != other)
                    i, j, score = sliced_products(a[part], planes, allowed, floor[part], ceil[part], bar[part], keep)
                    for b in range(bands):
                        ok = (score >= floor[part][i, b]) & (score <= ceil[part][i, b])
                        new.append([(i[ok] + s) * bands + b, score[ok], other[j[ok]]])
                group, score, key = (np.concatenate(z) for z in zip(*new, strict=True))
                use = _first(group, score, key, keep)
                best[row["a_keys"]] = [group[use], score[use], key[use]]
        for keys, (group, score, key) in best.items():
            own, bands = np.frombuffer(keys, np.int64), max(1, slots)
            if len(group):
                positive, goal = asked[keys]
                columns = (own[group // bands], (group % bands).astype(np.int32), key, score, positive[group], goal[group])
                yield pa.record_batch([pa.array(c) for c in columns], ["anchor", "slot", "other", "score", "positive", "positive_score"])

    return pairs.mapInArrow(work, schema)


def mine(rows: DataFrame, is_anchor: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, anchor_block: int = 4096, row_block: int = 16384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `is_anchor` is a condition on the key."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    chosen = rows.select(F.col(key).cast("long").alias("k"), F.col(label).cast("long").alias("l"), F.col(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("q"), good.alias("good"))
    clean = chosen.filter("k IS NOT NULL AND l IS NOT NULL AND good")
    queries = clean.filter("q").groupBy("k").agg(F.min(F.struct("l", "v")).alias("x")).select("k", "x.l", "x.v")
    blocks = max(1, -(-queries.count() // anchor_block))
    all_rows = _packed(clean.select("k", "l", "v"), scale, row_block, "r_")

    def best(parts: DataFrame, keep: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "other")
        return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)

    first = _packed(queries.repartition(blocks, "k"), scale, anchor_block, "a_")
    near = best(_search(all_rows.crossJoin(first), positives, 0, low, high), positives, "anchor")
    found = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("found"))
    asked = queries.join(found, queries["k"] == found["anchor"]).select("k", "l", "v", "found")
    second = _packed(asked.repartition(blocks, "k"), scale, anchor_block, "a_", positives)
    mined = best(_search(all_rows.crossJoin(second), negatives, positives, low, high), negatives, "anchor", "slot")
    return mined.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same by all products, for small tables.
ORACLE = """WITH c AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other, b.label AS label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM c a JOIN c b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND label <> own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""

"""Mutual information between numeric columns and a label by nearest neighbours, over range partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackwater.operators.ranks import ranged
from brackwater.session import cut_lineage

# Coefficients of 1/x**2, 1/x**4, ... in the asymptotic series of the digamma function (fixed values).
_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -5 / 660)
_SHIFT = 10


def digamma(x: Column) -> Column:
    """Digamma of positive numbers, to about 1e-14: the recurrence up to x + 10, then the asymptotic series."""
    x = x.cast("double")
    y = x + _SHIFT
    out = F.log(y) - 0.5 / y
    for i, c in enumerate(_SERIES):
        out = out + F.lit(c) / F.pow(y, F.lit(2.0 * i + 2))
    for i in range(_SHIFT):
        out = out - 1.0 / (x + i)
    return out


def _digamma(x: np.ndarray) -> np.ndarray:
    """The same of an array."""
    x = x.astype(np.float64)
    y = x + _SHIFT
    out = np.log(y) - 0.5 / y
    for i, c in enumerate(_SERIES):
        out += c / y ** (2 * i + 2)
    for i in range(_SHIFT):
        out -= 1.0 / (x + i)
    return out


def digamma_sql(x: str) -> str:
    """The same in SQL."""
    series = " ".join(f"+ ({c!r}) / pow({x} + {_SHIFT}.0, {2 * i + 2})" for i, c in enumerate(_SERIES))
    return f"(ln({x} + {_SHIFT}.0) - 0.5 / ({x} + {_SHIFT}.0) {series} {' '.join(f'- 1.0 / ({x} + {i}.0)' for i in range(_SHIFT))})"


PART_ROWS = 2_000_000  # values of rows, equal ones counted each time, for every range partition


def _codes(labels: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A whole number for each label, equal for equal ones."""
    found = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
    return found.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin; at the end, the number of rows."""
    new = np.ones(len(keys[0]) + 1, bool)
    if len(keys[0]):
        new[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _ends(k: int):
    """Of each column and label in a part: its rows, and its first and last k values with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        c, u, n = (t.column(name).to_numpy() for name in ("c", "u", "n"))
        y = _codes(t.column("y"))
        order = np.lexsort((u, y, c))
        cut = _starts(c[order], y[order])
        u, n, groups = u[order], n[order], [*zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        first = pa.array(order[cut[:-1]])
        values = pa.list_(pa.int64())
        sides = {"head": [slice(a, min(a + k, z)) for a, z in groups], "tail": [slice(max(a, z - k), z) for a, z in groups]}
        out = {"_part": t.column("_part").take(first), "c": t.column("c").take(first), "y": t.column("y").take(first), "rows": pa.array(np.add.reduceat(n, cut[:-1]))}
        for side, cuts in sides.items():
            out |= {f"{side}_{name}": pa.array([a[x].tolist() for x in cuts], values) for name, a in (("u", u), ("n", n))}
        yield from pa.table(out).to_batches()

    return run


def _radius(g: np.ndarray, u: np.ndarray, n: np.ndarray, want: np.ndarray, mine: np.ndarray, k: int) -> np.ndarray:
    """Distance to the neighbour of rank `want` of `mine` among rows sorted by group and value, a value standing for `n` rows: the
    nearer of the next values before and after is taken until enough rows are seen."""
    size = len(g)
    at = np.arange(size)
    seen, radius, back, ahead = n - 1, np.zeros(size, np.int64), at - 1, at + 1
    far = np.iinfo(np.int64).max
    for _ in range(k):
        some = np.flatnonzero(mine & (seen < want))
        if not len(some):
            break
        b, a = back[some], ahead[some]
        down = np.where((b >= 0) & (g[b] == g[some]), u[some] - u[b], far)
        a_in = np.minimum(a, size - 1)
        up = np.where((a < size) & (g[a_in] == g[some]), u[a_in] - u[some], far)
        low = down <= up
        radius[some] = np.minimum(down, up)
        seen[some] += n[np.where(low, b, a_in)]
        back[some] -= low
        ahead[some] += ~low
    return radius


_NAMES = ("c", "part", "nth", "ask", "at", "n", "want", "ny", "near", "terms")
_FOUND = ", ".join(f"{x} {'double' if x == 'terms' else 'long'}" for x in _NAMES)


def _rows(size: int, **given) -> pa.Table:
    """Rows of `_NAMES`: -1 stands for what is not given, 0 for terms."""
    return pa.table({x: pa.array(np.broadcast_to(np.asarray(given.get(x, 0.0 if x == "terms" else -1), np.float64 if x == "terms" else np.int64), size)) for x in _NAMES})


def _counted(k: int, bounds: dict[int, tuple[np.ndarray, ...]]):
    """Per column the terms of a part's rows, added up, where all nearer rows lie in the part. Of the others, at most 2k values a
    label, each is a row with those found so far, and a row for each end that lies in another part (`ask`), where rows up to `at`
    are to be counted. Labels with one row are told to the part itself, `near` 0."""

    def run(group: tuple, rows: pa.Table, edges: pa.Table) -> pa.Table:
        part, own = group[0].as_py(), len(rows)
        lists = [edges.column(x).combine_chunks() for x in ("before_u", "after_u", "before_n", "after_n")]
        of = np.concatenate([np.repeat(np.arange(len(edges)), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in lists[:2]])
        values = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
        y = _codes(pa.chunked_array([*rows.column("y").chunks, *edges.column("y").chunks], rows.schema.field("y").type))
        c_edges, y_edges = edges.column("c").to_numpy(), y[own:]
        c = np.concatenate([rows.column("c").to_numpy(), c_edges[of]])
        y = np.concatenate([y[:own], y_edges[of]])
        u, n = np.concatenate([rows.column("u").to_numpy(), *values[:2]]), np.concatenate([rows.column("n").to_numpy(), *values[2:]])
        order = np.lexsort((u, y, c))
        c, y, u, n, mine = c[order], y[order], u[order], n[order], order < own
        cut = _starts(c, y)
        g = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        ny = edges.column("ny").to_numpy()[np.lexsort((y_edges, c_edges))][g]  # edges have a row for each of these groups
        want = np.minimum(k, ny - 1)
        width = np.maximum(_radius(g, u, n, want, mine, k), 1)  # at a distance of 0 only equal values count
        lone = mine & (ny == 1)
        out, nth = [_rows(int(lone.sum()), c=c[lone], part=part, ask=part, at=u[lone], near=0)], 0
        for column in np.unique(c).tolist():
            here = mine & (ny > 1) & (c == column)
            v, m, w, s = u[here], n[here], want[here], ny[here]
            order = np.argsort(v, kind="stable")
            upto = _upto(v[order], m[order])
            parts, first, before = bounds[column]
            j = int(np.searchsorted(parts, part))
            low, high = v - width[here], v + width[here] - 1
            of_low, of_high = (np.searchsorted(first, x, "right") - 1 for x in (low, high))  # the part an end lies in; -1: before all
            near = upto(high) - upto(low)
            near += np.where(of_low < j, before[j] - before[np.maximum(of_low, 0)], 0) + np.where(of_high > j, before[of_high] - before[j + 1], 0)
            ask_low, ask_high = (of_low < j) & (of_low >= 0), of_high > j
            rest = ask_low | ask_high
            done = ~rest
            terms = m[done] * (_digamma(w[done]) - _digamma(s[done]) - _digamma(near[done]))
            out.append(_rows(1, c=column, n=m[done].sum(), terms=terms.sum()))
            numbers = nth + np.cumsum(rest) - 1
            nth += int(rest.sum())
            out.append(_rows(int(rest.sum()), c=column, part=part, nth=numbers[rest], n=m[rest], want=w[rest], ny=s[rest], near=near[rest]))
            for ask, ends, of, sign in ((ask_low, low, of_low, -1), (ask_high, high, of_high, 1)):
                out.append(_rows(int(ask.sum()), c=column, part=part, nth=numbers[ask], ask=parts[of[ask]], at=ends[ask], near=sign))
        return pa.concat_tables(out)

    return run


def _upto(u: np.ndarray, n: np.ndarray):
    """How many rows of ascending values `u`, `n` of each, lie at or below x."""
    sums = np.concatenate([[0], np.cumsum(n)])
    return lambda x: sums[np.searchsorted(u, x, "right")]


def _last(values: Column, k: int) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - k + 1), F.lit(k))


def _answers(group: tuple, rows: pa.Table, asks: pa.Table) -> pa.Table:
    """The rows of `asks` with an end, `near` times the rows of this part up to it; labels with one row do not count."""
    c, u, n = (rows.column(x).to_numpy() for x in ("c", "u", "n"))
    a = {x: asks.column(x).to_numpy() for x in _NAMES}
    out = [_rows(0)]
    for column in np.unique(a["c"]).tolist():
        here, lone, ask = c == column, (a["c"] == column) & (a["near"] == 0), (a["c"] == column) & (a["near"] != 0)
        order = np.argsort(u[here], kind="stable")
        lone = np.sort(a["at"][lone])
        at = a["at"][ask]
        found = _upto(u[here][order], n[here][order])(at) - np.searchsorted(lone, at, "right")
        out.append(_rows(len(at), c=column, part=a["part"][ask], nth=a["nth"][ask], near=a["near"][ask] * found))
    return pa.concat_tables(out)


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, k: int = 3, digits: int = 6, parts: int | None = None) -> DataFrame:
    """column and mi (nats, 0 at least) by the estimator of Ross (2014) for a discrete label: the distance to the k-th neighbour of
    the same label, and how many rows of any label lie nearer.

    Values are compared to `digits` decimals, as whole numbers, so equal distances are equal. Rows without a label or a finite
    value, and labels with one row, are left out; a label with k rows or fewer takes as many neighbours as it has. A column
    without rows has no result.

    Equal values of a label are counted once and ranged by column and value, all labels together. To each part come, of its
    labels, the k values before and after it, so it knows every distance, and nearly all rows nearer lie in the part itself. Only
    ends that lie in another part, at most 2k values a label and part, are asked for there.
    """
    wide = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])))
    size = F.abs("v") * float(10**digits)
    whole = F.floor(size)
    rounded = whole + F.when(size - whole >= 0.5, 1).otherwise(0)  # halves away from zero; F.round takes a decimal number a value
    good = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    steps = wide.filter(good).groupBy("c", "y", F.when(F.col("v") < 0, -rounded).otherwise(rounded).alias("u")).agg(F.count("*").alias("n"))
    if parts is None:
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() * len(columns) // PART_ROWS))
    rows = ranged(steps, "c", "u", parts=parts)
    kind = rows.schema["y"].dataType.simpleString()
    lists = [f"{side}_{x}" for side in ("head", "tail") for x in ("u", "n")]
    ends = rows.mapInArrow(_ends(k), f"_part int, c int, y {kind}, rows long, {', '.join(f'{x} array<long>' for x in lists)}")
    own = Window.partitionBy("c", "y")
    beside = lambda x, a, b: F.flatten(F.collect_list(x).over(own.orderBy("_part").rowsBetween(a, b)))
    edges = cut_lineage(ends.select(
        "_part", "c", "y", "rows", F.col("head_u")[0].alias("first"), F.sum("rows").over(own).alias("ny"),
        *[_last(beside(f"tail_{x}", -k, -1), k).alias(f"before_{x}") for x in "un"],
        *[F.slice(beside(f"head_{x}", 1, k), 1, k).alias(f"after_{x}") for x in "un"],
    ))
    bounds = {}
    held = edges.groupBy("c", "_part").agg(F.min("first").alias("first"), F.sum(F.when(F.col("ny") > 1, F.col("rows")).otherwise(0)).alias("rows")).toPandas().sort_values(["c", "_part"])
    for c, own_parts in held.groupby("c"):
        bounds[int(c)] = (own_parts["_part"].to_numpy(np.int64), own_parts["first"].to_numpy(np.int64), np.concatenate([[0], np.cumsum(own_parts["rows"].to_numpy(np.int64))]))
    found = cut_lineage(rows.groupBy("_part").cogroup(edges.drop("rows", "first").groupBy("_part")).applyInArrow(_counted(k, bounds), _FOUND))
    asks = found.filter("ask >= 0").withColumn("_part", F.col("ask").cast("int"))
    answers = rows.groupBy("_part").cogroup(asks.groupBy("_part")).applyInArrow(_answers, _FOUND)
    spread = found.filter("ask < 0 AND part >= 0").unionByName(answers)
    spread = spread.groupBy("c", "part", "nth").agg(F.max("n").alias("n"), F.max("want").alias("want"), F.max("ny").alias("ny"), F.sum("near").alias("near"))
    terms = F.col("n") * (digamma(F.col("want")) - digamma(F.col("ny")) - digamma(F.col("near")))
    sums = found.filter("part < 0").select("c", "n", "terms").unionByName(spread.select("c", "n", terms.alias("terms")))
    out = sums.groupBy("c").agg(F.sum("n").alias("all"), F.sum("terms").alias("terms")).filter("all > 0")
    name = F.array(*[F.lit(c) for c in columns])[F.col("c").cast("int")]
    return out.select(name.alias("column"), F.greatest(F.lit(0.0), digamma(F.col("all")) + F.col("terms") / F.col("all")).alias("mi"))

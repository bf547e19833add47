"""Exploratory aggregates: counts, profiles, correlations, outliers, splits and samples."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackwater.operators.ranks import group_percentiles
from brackwater.session import cut_lineage


def percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row, `q`: the exact percentiles of a column at `shares`, between two values in proportion; nulls without values."""
    found = group_percentiles(df.select(F.lit(0).alias("_g"), F.col(column).alias("_c")), ["_g"], "_c", shares).agg(F.first("q").alias("q"))
    return found.select(F.coalesce("q", F.array(*[F.lit(None).cast("double") for _ in shares])).alias("q"))


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    out = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return out if n is None else out.orderBy(F.desc("n"), column).limit(n)


def hour_by_type(df: DataFrame, ts: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Hours against the kinds, 0 where there is none. The kinds are given, so that one pass is enough."""
    return df.groupBy(F.hour(ts).alias("hour")).pivot(kind, list(kinds)).agg(F.count(F.lit(1))).na.fill(0)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles and largest of each column, nulls left out. All columns' values are
    counted in one pass as (column, value)."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    stats = [("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)]
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in stats])
    each = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name, _ in stats]) for i, c in enumerate(columns)])))
    q = group_percentiles(long, ["column"], "v", (0.25, 0.5, 0.75))
    return each.join(q, "column", "left").select("column", "n", "mean", "std", "min", *[F.get("q", F.lit(i)).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "max")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values, least and largest (as text) and completeness in percent."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[x for c in columns for x in (F.count_distinct(c).alias(f"{c}_d"), F.min(c).cast("string").alias(f"{c}_a"), F.max(c).cast("string").alias(f"{c}_b"), F.count(c).alias(f"{c}_c"))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}_d").alias("n_unique"), F.col(f"{c}_a").alias("min"), F.col(f"{c}_b").alias("max"), (F.col(f"{c}_c") * 100.0 / F.nullif(F.col("_n"), F.lit(0))).alias("completeness")) for c in columns]
    return row.select(F.inline(F.array(*rows)))


def moments(df: DataFrame, columns: Sequence[str], first_rows: int = 1000) -> DataFrame:
    """a, b and the sums over rows that have both values: n, sa, sb, qa, qb (squares) and p (product), of values less a column's mean
    over some first rows, which keeps sums of large values exact.

    Each task adds up whole matrices of its rows and hands on one row a column; the matrices of all tasks are added by column.
    """
    m = len(columns)
    number = [F.col(c).cast("double") for c in columns]
    finite = [F.when(F.abs(x) < float("inf"), x) for x in number]  # NaN is above all numbers
    row = df.select(*columns).limit(first_rows).agg(*[F.avg(x).alias(f"c{i}") for i, x in enumerate(finite)]).first()
    shift = np.array([row[i] or 0.0 for i in range(m)])
    kinds = ("n", "s", "q", "p")
    schema = "i int, " + ", ".join(f"{k} array<double>" for k in kinds)

    def rows_of(sums: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        lists = [pa.array(list(x), pa.list_(pa.float64())) for x in sums]
        return pa.record_batch([pa.array(which, pa.int32()), *lists], ["i", *kinds])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, m, m))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(float) - shift
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        yield rows_of(total, np.arange(m))

    def merge(table: pa.Table) -> pa.Table:
        sums = np.stack([np.stack(table.column(k).to_numpy(zero_copy_only=False)).sum(0)[None] for k in kinds])
        return pa.Table.from_batches([rows_of(sums, table.column("i").to_numpy()[:1])])

    parts = df.select(*[x.alias(f"c{i}") for i, x in enumerate(number)]).mapInArrow(add_up, schema)
    whole = parts.groupBy("i").applyInArrow(merge, schema)
    names = F.array(*[F.lit(c) for c in columns])
    cells = whole.select("i", F.posexplode(F.arrays_zip(*kinds)).alias("j", "x")).select("i", "j", "x.*")
    other = cells.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("sb"), F.col("q").alias("qb"))
    both = cells.withColumnsRenamed({"s": "sa", "q": "qa"}).filter("i <= j").join(other, ["i", "j"])
    return both.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "n", "sa", "sb", "qa", "qb", "p")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of each pair over the rows that have both values; null where one is constant or there are none. NaN counts as missing."""
    va, vb = F.col("n") * F.col("qa") - F.col("sa") ** 2, F.col("n") * F.col("qb") - F.col("sb") ** 2
    spread = (va > 1e-12 * F.col("n") * F.col("qa")) & (vb > 1e-12 * F.col("n") * F.col("qb"))
    r = (F.col("n") * F.col("p") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb)
    return moments(df, columns).filter("a <> b").select("a", "b", F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """One row: quartiles, bounds, rows outside and their share in percent."""
    v = F.col(column).cast("double")
    q = percentiles(df, column, (0.25, 0.75)).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    q = q.withColumn("lower", F.col("q1") - k * (F.col("q3") - F.col("q1"))).withColumn("upper", F.col("q3") + k * (F.col("q3") - F.col("q1")))
    outside = F.count_if((v < F.col("lower")) | (v > F.col("upper")))
    return df.join(F.broadcast(q)).groupBy("q1", "q3", "lower", "upper").agg(outside.alias("outliers"), (outside * 100.0 / F.count("*")).alias("pct"))


def clip_by_label(df: DataFrame, column: str, label: str, share: float = 0.99, most_broadcast: int = 100_000) -> DataFrame:
    """Rows at or below their label's exact percentile; rows without a label or a value are left out. The labels' bounds are
    broadcast up to `most_broadcast` labels, so a label with most rows is not one task."""
    tops = cut_lineage(group_percentiles(df, [label], column, [share]).select(label, F.col("q")[0].alias("_top")))
    small = tops.limit(most_broadcast + 1).count() <= most_broadcast
    return df.join(F.broadcast(tops) if small else tops, label).filter(F.col(column) <= F.col("_top")).drop("_top")


def alerts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule and the number of rows it fires on, in one pass."""
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("n")) for i, n in enumerate(rules)])))


def stratified_split(df: DataFrame, label: str, key: Column, shares: Sequence[float] = (0.7, 0.15, 0.15), part_rows: int = 1 << 20, most_broadcast: int = 100_000) -> DataFrame:
    """Adds `split` (0, 1, ...): exact shares of each label, in the order of `key` (a unique hash).

    Rank within the label comes from ranks within parts of the key's range, as many as leave about `part_rows` of all rows to
    each, so a label with most rows is not one task. The table of the parts' sizes is broadcast up to `most_broadcast` rows.
    """
    salts = max(1, -(-df.count() // part_rows))
    part = F.floor((key.cast("double") / 2.0**64 + 0.5) * salts).cast("int")
    df = df.withColumn("_key", key).withColumn("_salt", part)
    sizes = df.groupBy(label, "_salt").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(label, "_salt", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    same = F.row_number().over(Window.partitionBy(label, "_salt").orderBy("_key"))
    small = sizes.limit(most_broadcast + 1).count() <= most_broadcast
    ranked = df.withColumn("_in", same).join(F.broadcast(sizes) if small else sizes, [label, "_salt"])
    place = (F.col("_before") + F.col("_in") - 0.5) / F.col("_all")
    split, edge = F.lit(len(shares) - 1), 0.0
    for i, s in enumerate(shares[:-1]):
        edge += s
        split = F.when((place < edge) & (split == len(shares) - 1), i).otherwise(split)
    return ranked.withColumn("split", split).drop("_key", "_salt", "_in", "_before", "_all")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded digest of the key, then of the key: the same ones whatever the partitions."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(n)

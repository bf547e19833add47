"""Prefix sums and rank selection over range partitions: no task has all rows, and no expression grows with the partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackwater.session import cut_lineage


def ranged(df: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """df with `_part`, the number of the range partition that a row lies in, ascending in `order`.

    Cut points are sampled anew whenever a plan with range partitions is planned, so the rows are checkpointed with their
    numbers: sums by part and the rows themselves then always speak of the same parts. Without `parts` their number follows
    the size of the data.
    """
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))


def _before(held: DataFrame, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Adds `_b_<c>`, the totals of the parts before within a group, and `_t_<c>`, those of the group. A group has as many rows here
    as it has parts."""
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return held.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_b_{c}") for c in counts], *[F.sum(c).over(whole).alias(f"_t_{c}") for c in counts])


def running_totals(df: DataFrame, value: str, counts: Sequence[str], by: Sequence[str] = (), descending: bool = False, parts: int | None = None) -> DataFrame:
    """Adds `cum_<c>`: totals of each count over all rows of the group `by` up to this value (one row per group and value; groups
    are not null). Each part sums its own rows, and the sums of the parts before it come from a table with a row for each
    part and group."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    rows = ranged(df, *by, order, parts=parts)
    inside = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = _before(rows.groupBy(*by, "_part").agg(*[F.sum(c).alias(c) for c in counts]), by, counts).select(*by, "_part", *[f"_b_{c}" for c in counts])
    out = rows.select("*", *[F.sum(c).over(inside).alias(f"_i_{c}") for c in counts]).join(held if by else F.broadcast(held), [*by, "_part"])
    return out.withColumns({f"cum_{c}": F.col(f"_i_{c}") + F.col(f"_b_{c}") for c in counts}).drop("_part", *[f"_{k}_{c}" for k in "ib" for c in counts])


def row_numbers(df: DataFrame, *order: Column | str, name: str = "nth", parts: int | None = None) -> DataFrame:
    """Adds the number of each row (from 1) in an order without ties: rows are numbered inside their range partition, and the rows of
    the partitions before are added from a table with one row a partition."""
    rows = ranged(df, *order, parts=parts)
    held = _before(rows.groupBy("_part").agg(F.count("*").alias("_n")), [], ["_n"]).select("_part", "_b__n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn(name, inside).join(F.broadcast(held), "_part").withColumn(name, F.col(name) + F.col("_b__n")).select(*df.columns, name)


def group_percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], parts: int | None = None) -> DataFrame:
    """by and `q`: the exact percentiles of each group at `shares`, between two values in proportion. Rows without a value or a group
    are left out.

    Equal values are counted once, the rest are ranged by group and value. Counts by part say in which parts the wanted ranks
    lie, and only their rows are put in order.
    """
    present = F.col(value).isNotNull()
    for c in by:
        present = present & F.col(c).isNotNull()
    steps = df.filter(present).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    rows = ranged(steps, *by, "_v", parts=parts)
    held = _before(rows.groupBy(*by, "_part").agg(F.sum("_n").alias("_n")), by, ["_n"])
    place = lambda s, n: F.lit(s) * (n - 1)
    ranks = [f(place(s, F.col("_t__n"))) for s in shares for f in (F.floor, F.ceil)]
    inside = F.lit(False)
    for r in ranks:
        inside = inside | ((r >= F.col("_b__n")) & (r < F.col("_b__n") + F.col("_n")))
    wanted = held.filter(inside).select(*by, "_part", "_b__n", "_t__n")
    order = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    few = rows.join(wanted, [*by, "_part"]).withColumn("_cum", F.sum("_n").over(order) + F.col("_b__n"))
    at = lambda rank: F.min(F.when(F.col("_cum") > rank, F.col("_v")))
    ends = [x for i, s in enumerate(shares) for x in (at(F.floor(place(s, F.col("_t__n")))).alias(f"_a{i}"), at(F.ceil(place(s, F.col("_t__n")))).alias(f"_z{i}"))]
    found = few.groupBy(*by).agg(F.max("_t__n").alias("_all"), *ends)

    def between(i: int, s: float) -> Column:
        a, b, spot = F.col(f"_a{i}"), F.col(f"_z{i}"), place(s, F.col("_all"))
        part = spot - F.floor(spot)
        return F.when(a == b, a).otherwise((1 - part) * a + part * b)

    return found.select(*by, F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("q"))

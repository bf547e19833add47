"""Dataset-level checks and drift: schema, completeness, ranges, duplicates, PSI and the two-sample KS statistic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from brackwater.operators.ranks import running_totals

# The range each feature must lie in.
RANGES = {
    "failed_login_ratio": (0.0, 1.0),
    "login_frequency": (0.0, 100.0),
    "geo_velocity": (0.0, 200000.0),
    "session_duration_anomaly": (-10.0, 10.0),
    "port_scan_index": (0.0, 1.0),
    "dns_query_entropy": (0.0, 8.0),
    "data_exfil_ratio": (0.0, 1000000.0),
    "privilege_escalation_score": (0.0, 10.0),
    "off_hours_ratio": (0.0, 1.0),
    "connection_burstiness": (0.0, 1000.0),
}


def _long(df: DataFrame, names: Sequence[str], *per: tuple[str, Mapping[str, Column]]) -> DataFrame:
    """One row per name from aggregates computed in one pass."""
    row = df.agg(*[f(n).alias(f"{label}_{i}") for label, f in per for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"{label}_{i}").alias(label) for label, _ in per]) for i, n in enumerate(names)])
    return row.select(F.inline(rows))


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[name] in ("double", "float") else c.isNull()


def check_schema(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    gone, more = sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))
    rows = [("missing_columns", "FAIL" if gone else "PASS", ",".join(gone), len(gone)), ("extra_columns", "WARN" if more else "PASS", ",".join(more), len(more))]
    return df.sparkSession.createDataFrame(rows, "check_name string, status string, details string, affected long")


def check_missing(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """column, affected, total, pct and status: more than 20 % missing FAIL, more than 5 % WARN. An empty table passes."""
    out = _long(df, names or df.columns, ("affected", lambda n: F.count_if(_missing(df, n))), ("total", lambda n: F.count(F.lit(1))))
    pct = F.when(F.col("total") > 0, F.col("affected") * 100.0 / F.col("total")).otherwise(0.0)
    return out.withColumn("pct", pct).withColumn("status", F.when(pct > 20, "FAIL").when(pct > 5, "WARN").otherwise("PASS"))


def check_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Rows outside each column's range; null and NaN pass."""
    names = [n for n in ranges if n in df.columns]
    outside = lambda n: F.count_if(~F.isnan(F.col(n).cast("double")) & ((F.col(n) < ranges[n][0]) | (F.col(n) > ranges[n][1])))
    out = _long(df, names, ("affected", outside), ("total", lambda n: F.count(F.lit(1))))
    return out.withColumn("status", F.when(F.col("affected") > 0, "FAIL").otherwise("PASS"))


def check_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first of equal rows, and of equal keys."""
    spare = lambda by, name: df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("affected")).select(F.lit(name).alias("check_name"), "affected")
    out = spare(df.columns, "duplicate_rows").unionByName(spare(key, "duplicate_keys"))
    return out.withColumn("status", F.when(F.col("affected") > 0, "FAIL").otherwise("PASS"))


# What to do about a check that did not pass.
REMEDIES = {"missing": "Find out why values are missing upstream.", "range": "Look at the unit and the source of values out of range.", "duplicate": "Remove repeated rows before they are counted.", "columns": "Bring the table to the declared columns."}


def all_checks(df: DataFrame, expected: Sequence[str], key: Sequence[str], ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    """check_name, status, details, affected, total and recommendation of all dataset checks: columns, missing values of each expected
    column, ranges, duplicates. Checks that cannot be made for want of a column are left out; the column check names it."""
    here = [c for c in expected if c in df.columns]
    total = df.agg(F.count("*").alias("total"))
    told = lambda d, name, details, kind: d.select(name.alias("check_name"), "status", details.alias("details"), F.col("affected").cast("long").alias("affected"), F.when(F.col("status") == "PASS", "").otherwise(REMEDIES[kind]).alias("recommendation"))
    out = told(check_schema(df, expected), F.col("check_name"), F.col("details"), "columns")
    if here:
        out = out.unionByName(told(check_missing(df, here), F.concat(F.lit("missing: "), "column"), F.format_string("%.2f %%", "pct"), "missing"))
    if [c for c in ranges if c in df.columns]:
        out = out.unionByName(told(check_ranges(df, ranges), F.concat(F.lit("range: "), "column"), F.lit(""), "range"))
    if all(c in df.columns for c in key):
        out = out.unionByName(told(check_duplicates(df, key), F.col("check_name"), F.lit(""), "duplicate"))
    return out.crossJoin(F.broadcast(total)).select("check_name", "status", "details", "affected", "total", "recommendation")


def psi(expected: DataFrame, actual: DataFrame, column: str, buckets: int = 10, shared_bins: bool = False) -> DataFrame:
    """One row: psi and status. Each side is cut into equal widths of its own range (or of both with `shared_bins`), the
    last bin closed; a constant side is all in the middle bin; an empty bin counts 1e-4. Nulls and NaN are left out."""
    good = lambda d, s: d.select(F.col(column).cast("double").alias("v"), F.lit(s).alias("side")).filter("v IS NOT NULL AND NOT isnan(v)")
    both = good(expected, "e").unionByName(good(actual, "a"))
    ends = both.groupBy(*([] if shared_bins else ["side"])).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = both.join(F.broadcast(ends)) if shared_bins else both.join(F.broadcast(ends), "side")
    width = (F.col("hi") - F.col("lo")) / buckets
    bin_of = F.when(F.col("hi") == F.col("lo"), F.lit(buckets // 2)).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0)))))
    counts = placed.groupBy("side", bin_of.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    wide = counts.groupBy("bin").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s) for s in "ea"])
    every = both.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(wide), "bin", "left").na.fill(0)
    totals = both.agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in "ea"])
    share = lambda s: F.when(F.col(s) == 0, 1e-4).otherwise(F.col(s) / F.col(f"n_{s}"))
    term = (share("a") - share("e")) * F.log(share("a") / share("e"))
    out = every.join(F.broadcast(totals)).agg(F.coalesce(F.sum(F.when((F.col("n_a") > 0) & (F.col("n_e") > 0), term)), F.lit(0.0)).alias("psi"))
    return out.select(F.lit(column).alias("feature"), "psi", drift_status(F.col("psi")).alias("status"))


def drift_status(value: Column) -> Column:
    return F.when(value >= 0.25, "Significant").when(value >= 0.1, "Moderate").otherwise("No Drift")


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: n_a, n_b and D, the largest distance of the two cumulative shares. Equal values are one step."""
    both = a.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(column).cast("double").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    steps = both.filter("v IS NOT NULL AND NOT isnan(v)").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = steps.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    run = running_totals(steps, "v", ["a", "b"]).join(F.broadcast(totals))
    return run.agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max(F.abs(F.col("cum_a") / F.col("n_a") - F.col("cum_b") / F.col("n_b"))).alias("ks_stat"))


def ks_p_column(d: Column, n: Column, m: Column) -> Column:
    """`ks_p_value` as an expression."""
    en = F.sqrt(n.cast("double") * m / (n + m))
    x = (en + 0.12 + 0.11 / en) * d
    sign = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + sign(k) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total)))


def drift_table(current: DataFrame, reference: DataFrame) -> DataFrame:
    """feature, psi, ks_stat, ks_pvalue and status of each numeric column of `current` that `reference` has as well. A column
    without values on one side has no row."""
    numeric = [f.name for f in current.schema.fields if isinstance(f.dataType, NumericType) and f.name in reference.columns]
    if not numeric:
        return current.sparkSession.createDataFrame([], "feature string, psi double, ks_stat double, ks_pvalue double, status string")
    out = None
    for c in numeric:
        ks = ks_statistic(reference, current, c).filter("n_a > 0 AND n_b > 0")
        row = psi(reference, current, c).join(F.broadcast(ks)).select("feature", "psi", "ks_stat", ks_p_column(F.col("ks_stat"), F.col("n_a"), F.col("n_b")).alias("ks_pvalue"), "status")
        out = row if out is None else out.unionByName(row)
    return out


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    import math

    en = math.sqrt(n * m / (n + m))
    x = (en + 0.12 + 0.11 / en) * d
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))

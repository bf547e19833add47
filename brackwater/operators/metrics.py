"""Binary classification metrics as aggregates. Curves are built over distinct scores, so ties are one step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.operators.ranks import running_totals


def confusion(df: DataFrame, label: Column, predicted: Column, *by: str) -> DataFrame:
    n = lambda a, b: F.count_if((label == a) & (predicted == b))
    return df.groupBy(*by).agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))


def rates(counts: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1, fpr, fnr; 0 where the denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counts.withColumns({
        "accuracy": over(tp + tn, tp + tn + fp + fn),
        "precision": over(tp, tp + fp),
        "recall": over(tp, tp + fn),
        "f1": over(2 * tp, 2 * tp + fp + fn),
        "fpr": over(fp, fp + tn),
        "fnr": over(fn, fn + tp),
    })


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float], below: bool = False) -> DataFrame:
    """Rates at each threshold (score >= t, or < t with `below`), all in one pass without multiplying the rows."""
    fires = lambda t: (F.col(score) < t) if below else (F.col(score) >= t)
    aggs = [F.count_if((F.col(label) == y) & (fires(t) == bool(p))).alias(f"{n}_{i}") for i, t in enumerate(thresholds) for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in ("tn", "fp", "fn", "tp")]) for i, t in enumerate(thresholds)])
    return rates(df.agg(*aggs).select(F.inline(rows)))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the best F1, the first threshold among equals."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, pos, neg, cum_pos, cum_neg from the highest score down, one row per distinct score."""
    steps = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return running_totals(steps, "score", ["pos", "neg"], descending=True)


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, precision and recall from the highest score down; recall is null without positives."""
    c = curve(df, label, score)
    total = c.agg(F.sum("pos").alias("all_pos"))
    share = F.when(F.col("all_pos") > 0, F.col("cum_pos") / F.col("all_pos"))
    return c.join(F.broadcast(total)).select("score", (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"), share.alias("recall"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the ROC curve; null without both labels."""
    c = curve(df, label, score)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    both = F.sum("pos").cast("double") * F.sum("neg")
    return c.agg(F.when(both > 0, area / both).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: sum of (recall step x precision); null without positives."""
    c = curve(df, label, score)
    total = F.sum("pos").cast("double")
    steps = F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))))
    return c.agg(F.when(total > 0, steps / total).alias("average_precision"))


def detection_by_category(df: DataFrame, category: str, detected: Column) -> DataFrame:
    """category (trimmed after grouping), total, detected and rate in percent; null categories are left out."""
    out = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("total"), F.count_if(detected).alias("detected"))
    return out.select(F.trim(category).alias("category"), "total", "detected", (F.col("detected") * 100.0 / F.col("total")).alias("rate"))


def alert_load(df: DataFrame, fires: Column, per: int = 10_000, capacity: int = 50) -> DataFrame:
    """One row: alert rate, alerts in `per` events (cut to a whole number) and whether analysts can take them."""
    rate = F.count_if(fires) / F.count("*")
    return df.agg(rate.alias("rate")).withColumn("alerts", (F.col("rate") * per).cast("long")).withColumn("overload", F.col("alerts") > capacity)


def retention(before: Column, after: Column) -> list[Column]:
    """Columns total, still, retained (percent) and tier for rows that were detected before an attack."""
    total, still = F.count_if(before), F.count_if(before & after)
    pct = F.when(total > 0, still * 100.0 / total).otherwise(0.0)
    return [total.alias("total"), still.alias("still"), pct.alias("retained"), F.when(pct >= 80, "ROBUST").when(pct >= 50, "MODERATE").otherwise("VULNERABLE").alias("tier")]

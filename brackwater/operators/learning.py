"""Preparation and models for tabular flows: imputing, scaling, mutual information, SMOTE, Spark ML classifiers and search."""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from brackwater.operators.exploration import percentiles
from brackwater.operators.metrics import confusion, rates, roc_auc
from brackwater.session import cut_lineage, remove_folder, shared_dir


def finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinities become null."""
    bad = lambda c: F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in columns})


def to_number(value: Column) -> Column:
    """A number, or null where the value is none."""
    return value.try_cast("double")


def fit_impute(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> dict[str, object]:
    """Exact median of each numeric column and commonest value (least of equals) of each categorical one, of the training rows."""
    found: dict[str, object] = {c: percentiles(train, c, (0.5,)).first()["q"][0] for c in numeric}
    for c in categorical:
        top = train.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).first()
        found[c] = top[0] if top else None
    return found


def impute(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill({k: v for k, v in values.items() if v is not None})


def fit_scale(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 where it is 0) of each column."""
    row = train.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]).first()
    return {c: (row[f"{c}_m"] or 0.0, row[f"{c}_s"] or 1.0) for c in columns}


def scale(df: DataFrame, fitted: Mapping[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.withColumns({c + suffix: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def near_rows(x: np.ndarray, k: int, leaf: int = 64) -> np.ndarray:
    """The k nearest other rows (fewer, if there are no more) of each row among those of its leaf: rows are halved along their
    widest column until about `leaf` are left. A distance from or to a row with a missing value is the largest of all."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    todo = [np.arange(len(x))] if k > 0 else []
    while todo:
        rows = todo.pop()
        y = x[rows]
        if len(rows) > max(leaf, 2 * k + 2):
            spread = np.nan_to_num(np.nanmax(y, 0, initial=-np.inf) - np.nanmin(y, 0, initial=np.inf), nan=0.0, neginf=0.0)
            order = np.argpartition(y[:, int(spread.argmax())], len(rows) // 2)
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
            continue
        d = ((y[:, None, :] - y[None, :, :]) ** 2).sum(2)
        d[np.isnan(d)] = np.finfo(float).max
        np.fill_diagonal(d, np.inf)
        out[rows] = rows[np.argpartition(d, k - 1, axis=1)[:, :k]]
    return out


def smote(train: DataFrame, columns: Sequence[str], label: str, minority: int = 1, k: int = 5, tables: int = 4, block_rows: int = 4096, seed: int = 42) -> DataFrame:
    """Synthetic minority rows (columns and label), as many as bring the minority level with the rest.

    Neighbours come from the minority alone, by distances of standardised columns: rows are ranged by a random projection,
    `tables` times, and in each partition worked through in that order, `block_rows` at once; a block is halved on until
    leaves of near rows are left (`near_rows`), and each row draws its synthetic rows towards one of the nearest of its leaf.
    Ties of the projection are ranged by a random number, so copies of one row fill no single partition, and nothing but
    two counts and the columns' scales reaches the driver.
    """
    few = train.filter(F.col(label) == minority).select(*[F.col(c).cast("double").alias(c) for c in columns])
    n = train.groupBy().agg(F.count_if(F.col(label) == minority).alias("a"), F.count_if(F.col(label) != minority).alias("b")).first()
    need = max(0, (n["b"] or 0) - (n["a"] or 0))
    per = need / n["a"] / tables if n["a"] else 0.0
    fitted = fit_scale(few, columns)
    mean, deviation = (np.array([fitted[c][i] for c in columns]) for i in (0, 1))
    rng = np.random.default_rng(seed)
    out = None
    for t in range(tables):
        line = sum(((F.col(c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1])) * F.lit(float(w)) for c, w in zip(columns, rng.normal(size=len(columns)), strict=True))
        dealt = few.withColumns({"_line": F.coalesce(line, F.lit(float("nan"))), "_tie": F.rand(seed + t)})

        def drawn(x: np.ndarray, t: int) -> pd.DataFrame:
            own = np.random.default_rng([seed, t, zlib.crc32(np.ascontiguousarray(x).tobytes())])
            near = near_rows((x - mean) / deviation, k)
            times = int(np.floor(per)) + (own.random(len(x)) < per - np.floor(per))
            base = np.repeat(np.arange(len(x)), times)
            other = near[base, own.integers(near.shape[1], size=len(base))] if near.shape[1] else base
            return pd.DataFrame(x[base] + own.random(len(base))[:, None] * (x[other] - x[base]), columns=list(columns))

        def draw(batches: Iterator[pd.DataFrame], t: int = t) -> Iterator[pd.DataFrame]:
            held, count = [], 0
            for pdf in batches:
                held.append(pdf.to_numpy(float))
                count += len(pdf)
                while count >= 2 * block_rows:  # so that the last block is no small rest
                    rows = np.concatenate(held)
                    yield drawn(rows[:block_rows], t)
                    held, count = [rows[block_rows:]], count - block_rows
            if count:
                yield drawn(np.concatenate(held), t)

        sorted_ = dealt.repartitionByRange("_line", "_tie").sortWithinPartitions("_line", "_tie").select(*columns)
        made = sorted_.mapInPandas(draw, ", ".join(f"`{c}` double" for c in columns))
        out = made if out is None else out.unionByName(made)
    return out.withColumn(label, F.lit(minority))


MODELS = {
    "random_forest": (RandomForestClassifier, {"numTrees": [100, 200], "maxDepth": [10, 15], "minInstancesPerNode": [1, 5]}),
    "boosted_trees": (GBTClassifier, {"maxIter": [50, 100], "maxDepth": [5, 8], "stepSize": [0.1]}),
    "logistic": (LogisticRegression, {"regParam": [0.0, 0.001, 0.01]}),
}


def pipeline(model, numeric: Sequence[str], categorical: Sequence[str] = ()) -> Pipeline:
    """Index and encode categories (unknown ones get zeros), assemble, classify."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categorical]
    stages += [OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v", dropLast=True) for c in categorical]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*numeric, *[f"{c}_v" for c in categorical]], outputCol="features", handleInvalid="keep"), model])


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds `weight`: rows / (classes x rows of the class)."""
    n = cut_lineage(df.groupBy(label).agg(F.count("*").alias("_n")))  # counted once, however often the result is read
    total = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return df.join(F.broadcast(n), label).join(F.broadcast(total)).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def train_classifier(df: DataFrame, kind: str, numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "label", seed: int = 42, part_rows: int = 500_000, **params):
    """A fitted PipelineModel of `kind` (random_forest, boosted_trees, logistic), classes weighted level. More than `part_rows` rows
    are dealt into partitions of so many at most, as Spark ML keeps the rows of a partition in an inflated form (about 330 bytes
    a row for trees) and reads them whole in each pass."""
    cls, _ = MODELS[kind]
    known = {p.name for p in cls().params}
    own = {"seed": seed} if "seed" in known else {}
    model = cls(featuresCol="features", labelCol=label, weightCol="weight", **(own | params))
    rows = balanced(df.select(*numeric, *categorical, label), label)
    parts = -(-df.count() // part_rows)
    if parts > 1:
        rows = rows.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism))
    return pipeline(model, numeric, categorical).fit(rows)


def stratified_folds(df: DataFrame, label: str, folds: int, seed: int = 42, part_rows: int = 100_000) -> DataFrame:
    """Adds `fold`, 0 to folds - 1: each row draws a number, and the rows of a label are cut in its order into folds that differ by
    one row at most, the first ones being the larger. Rows are neither moved nor put in order: counts of parts of about
    `part_rows` rows of a label say in which part each cut lies, and only those parts are ranked to find the number that a fold
    begins with. Draws and folds are checkpointed: every model sees the same ones."""
    df = df.filter(F.col(label).isNotNull())
    if folds < 2:
        return df.withColumn("fold", F.lit(0))
    sizes = cut_lineage(df.groupBy(label).agg(F.count("*").alias("_n")))
    drawn = cut_lineage(df.withColumn("_draw", F.struct(F.rand(seed).alias("u"), F.rand(seed + 1).alias("v"))))
    spread = drawn.select(label, "_draw").join(F.broadcast(sizes), label).withColumn("_part", F.floor(F.col("_draw.u") * F.ceil(F.col("_n") / F.lit(part_rows))))
    earlier = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.groupBy(label, "_part", "_n").agg(F.count("*").alias("_own")).withColumn("_before", F.coalesce(F.sum("_own").over(earlier), F.lit(0)))
    # the rank (from 0) that each fold but the first begins with
    ranks = F.array(*[F.expr(f"{i} * (_n div {folds}) + least({i}, _n % {folds})") for i in range(1, folds)])
    cuts = parts.select(label, "_part", "_before", "_own", F.explode(ranks).alias("_rank"))
    cuts = cuts.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_own"))).groupBy(label, "_part", "_before").agg(F.collect_list("_rank").alias("_ranks"))
    place = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_draw")) - 1 + F.col("_before")
    begins = spread.join(F.broadcast(cuts), [label, "_part"]).withColumn("_place", place).filter(F.array_contains("_ranks", F.col("_place").cast("long")))
    # a label of fewer rows than folds has fewer cuts: its rows are the first folds
    begins = cut_lineage(begins.groupBy(label).agg(F.sort_array(F.collect_list("_draw")).alias("_begins")))
    fold = sum((F.coalesce((F.col("_draw") >= F.get("_begins", F.lit(i))).cast("int"), F.lit(0)) for i in range(folds - 1)), F.lit(0))
    return cut_lineage(drawn.join(F.broadcast(begins), label, "left").withColumn("fold", fold).select(*df.columns, "fold"))


CV_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def cross_validate(df: DataFrame, kind: str, numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "label", folds: int = 5, seed: int = 42, **params) -> DataFrame:
    """metric, mean and deviation over stratified folds of each of CV_METRICS; a model learns from the other folds alone."""
    data = stratified_folds(df.select(*numeric, *categorical, label), label, folds, seed)
    rows = []
    for i in range(folds):
        fitted = train_classifier(data.filter(F.col("fold") != i), kind, numeric, categorical, label, seed, **params)
        scored = probabilities(fitted, data.filter(F.col("fold") == i))
        row = rates(confusion(scored, F.col(label), F.col("predicted"))).first()
        rows.append([row[m] for m in CV_METRICS[:4]] + [roc_auc(scored, label, "score").first()[0]])
    table = np.array(rows, float)
    found = [(m, float(a), float(s)) for m, a, s in zip(CV_METRICS, table.mean(0), table.std(0), strict=True)]
    return df.sparkSession.createDataFrame(found, "metric string, mean double, deviation double")


def production_check(fitted, df: DataFrame, label: str = "label", rows: int = 1000, seed: int = 42) -> DataFrame:
    """One row: milliseconds a row to score `rows` rows, the model's size in MB as saved, F1 on a random half of df."""
    spark = df.sparkSession
    few = cut_lineage(df.limit(rows))
    n = max(1, few.count())
    began = time.perf_counter()
    probabilities(fitted, few).write.format("noop").mode("overwrite").save()
    each = (time.perf_counter() - began) * 1000 / n
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    fitted.write().save(path)
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] or 0
    remove_folder(spark, path)
    half = probabilities(fitted, df.filter(F.rand(seed) < 0.5))
    f1 = rates(confusion(half, F.col(label), F.col("predicted"))).first()["f1"]
    return spark.createDataFrame([(each, size / 2**20, float(f1))], "inference_time_ms double, model_size_mb double, robustness_f1 double")


def search(df: DataFrame, kind: str, numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "label", n_iter: int = 3, folds: int = 5, parallelism: int = 4, seed: int = 42):
    """Randomised search by stratified cross-validation on F1 of the positive class; the best PipelineModel and its scores."""
    cls, grid = MODELS[kind]
    options = [dict(zip(grid, v, strict=True)) for v in product(*grid.values())]
    rng = np.random.default_rng(seed)
    picked = [options[i] for i in rng.permutation(len(options))[:n_iter]]
    model = cls(featuresCol="features", labelCol=label, weightCol="weight")
    maps = [{model.getParam(k): v for k, v in o.items()} for o in picked]
    data = stratified_folds(balanced(df.select(*numeric, *categorical, label), label), label, folds, seed)
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    found = CrossValidator(estimator=pipeline(model, numeric, categorical), estimatorParamMaps=maps, evaluator=judge, numFolds=folds, foldCol="fold", parallelism=parallelism).fit(data)
    return found.bestModel, list(zip(picked, found.avgMetrics, strict=True))


def save_classifier(fitted: PipelineModel, path: str, features: Sequence[str], log: DataFrame | None = None, **about: object) -> None:
    """The model, the list of features in order, what is known of the training (`about`) and its log (one row a model) under `path`."""
    spark = SparkSession.active()
    fitted.write().overwrite().save(f"{path}/model")
    meta = json.dumps({"features": list(features), "kind": type(fitted.stages[-1]).__name__, "about": about}, default=str)
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    if log is not None:
        log.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/training_log")


def load_classifier(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """The saved model and what was saved with it (features, kind, about). An incomplete folder is an error of Spark's readers."""
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def train_best(train: DataFrame, numeric: Sequence[str], path: str, categorical: Sequence[str] = (), label: str = "label", kinds: Sequence[str] = ("random_forest", "boosted_trees", "logistic"), n_iter: int = 3, folds: int = 5, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """Searches each kind, saves the model with the best cross-validated F1 (the first of equals) under `path` with features and log;
    returns it and the log: kind, parameters, f1, seconds, best."""
    spark = train.sparkSession
    rows, models = [], {}
    for kind in kinds:
        began = time.perf_counter()
        models[kind], scores = search(train, kind, numeric, categorical, label, n_iter, folds, seed=seed)
        params, f1 = max(scores, key=lambda x: x[1])
        rows.append((kind, json.dumps(params, sort_keys=True), float(f1), time.perf_counter() - began))
    best = max(rows, key=lambda r: r[2])[0]
    log = spark.createDataFrame([(*r, r[0] == best) for r in rows], "kind string, parameters string, f1 double, seconds double, best boolean")
    save_classifier(models[best], path, [*numeric, *categorical], log, label=label, folds=folds, seed=seed)
    return models[best], log


def probabilities(fitted, df: DataFrame) -> DataFrame:
    """df with `score` (probability of 1) and `predicted` (score >= 0.5)."""
    out = fitted.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*df.columns, "score", "predicted")


def _exchanged(columns: Sequence[str], key: Sequence[str]):
    """The rows of a part in the order of `_m`, and beside them, as `_given<i>`, the values of each column in the order of `_m<i>`."""

    def order(t: pa.Table, mark: str) -> np.ndarray:
        marks = t.column(mark).to_numpy()
        by_mark = np.argsort(marks, kind="stable")
        if (np.diff(marks[by_mark]) == 0).any():  # equal hashes: by key, as rows come in any order
            return pc.sort_indices(t, sort_keys=[(c, "ascending") for c in (mark, *key)], null_placement="at_start").to_numpy()
        return by_mark

    def run(t: pa.Table) -> pa.Table:
        out = t.take(order(t, "_m")).drop_columns(["_p", "_m", *[f"_m{i}" for i in range(len(columns))]])
        for i, c in enumerate(columns):
            out = out.append_column(f"_given{i}", t.column(c).take(order(t, f"_m{i}")))
        return out

    return run


def permutation_importance(fitted, df: DataFrame, columns: Sequence[str], key: Sequence[str], label: str = "label", seed: int = 42) -> DataFrame:
    """Loss of accuracy when one column's values move to other rows. Rows are put in two orders by hashes of the unique `key`, within
    parts of a hash of it, and each takes the value of the row at its place in the other order: whatever the layout, the same
    rows exchange values. Parts hold about a million rows. Each is dealt once, and all columns change places in it; the rows as
    they are and with each column changed are scored in one pass."""
    parts = max(1, -(-df.count() // 1_000_000))
    mark = lambda n: F.xxhash64(*key, F.lit(n))
    marks = {"_p": F.pmod(mark(seed), F.lit(parts)), "_m": mark(seed + 1)} | {f"_m{i}": mark(seed + 2 + i) for i in range(len(columns))}
    schema = StructType([*df.schema.fields, *[StructField(f"_given{i}", df.schema[c].dataType) for i, c in enumerate(columns)]])
    given = df.withColumns(marks).groupBy("_p").applyInArrow(_exchanged(columns, key), schema)
    one = lambda i: F.struct(F.lit(i).alias("_which"), *[F.col(f"_given{j}" if j == i else c).alias(c) for j, c in enumerate(columns)])
    each = given.select(*[c for c in df.columns if c not in columns], F.inline(F.array(*[one(i) for i in range(-1, len(columns))])))
    right = probabilities(fitted, each).groupBy("_which").agg(F.avg((F.col("predicted") == F.col(label)).cast("double")))
    found = dict(map(tuple, right.collect()))
    return df.sparkSession.createDataFrame([(c, float(found[-1] - found[i])) for i, c in enumerate(columns)], "column string, importance double")

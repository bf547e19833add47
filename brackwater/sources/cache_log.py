"""A cache of entries by key as a log in a shared folder: append-only deltas, the latest entry wins on reading, compaction.

A delta is a Parquet folder; it counts once a line of the log names it, and that line is written last. A writer that dies
leaves a folder that no line names, or an unfinished file that Spark does not read: the log opens as it was before. One
writer at a time; readers at any time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINES = "version long, path string, whole boolean"


def _lines(spark: SparkSession, root: str) -> list:
    """Lines of the log from the last compaction on, in order."""
    try:
        lines = spark.read.schema(_LINES).json(f"{root}/log")
    except AnalysisException:
        return []
    last = lines.agg(F.max(F.when(F.col("whole"), F.col("version")))).first()[0]
    return lines.filter(F.col("version") >= (last or 0)).orderBy("version").collect()


def _write(entries: DataFrame, root: str, version: int, whole: bool) -> DataFrame:
    spark = entries.sparkSession
    path = f"{root}/entries/{version}-{uuid.uuid4().hex}"
    entries.write.parquet(path)
    spark.createDataFrame([(version, path, whole)], _LINES).coalesce(1).write.mode("append").json(f"{root}/log")
    return spark.read.schema(entries.schema).parquet(path)


def append(entries: DataFrame, root: str) -> DataFrame:
    """Adds entries (with `cached_at`) to the log; returns them as they were written."""
    lines = _lines(entries.sparkSession, root)
    return _write(entries, root, lines[-1]["version"] + 1 if lines else 1, False)


def read(spark: SparkSession, root: str, schema: str, key: str = "indicator") -> DataFrame:
    """The latest entry of each key (of equal times, that of the later delta); an empty table where there is no log."""
    lines = _lines(spark, root)
    if not lines:
        return spark.createDataFrame([], schema)
    order = F.create_map(*[F.lit(x) for line in lines for x in (line["path"].rsplit("/", 1)[-1], line["version"])])
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = spark.read.schema(schema).parquet(*[line["path"] for line in lines])
    found = rows.withColumn("_version", F.try_element_at(order, folder))
    best = found.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct("cached_at", "_version")).alias("best"))
    return best.select("best.*")


def compact(spark: SparkSession, root: str, schema: str, key: str = "indicator") -> int:
    """Writes the latest entries as one delta that stands for all before it; returns its version (0: nothing to do). Folders of older
    deltas stay, so readers that have begun can end; they can be removed by `path` of older lines."""
    lines = _lines(spark, root)
    if len(lines) < 2:
        return 0
    version = lines[-1]["version"] + 1
    _write(read(spark, root, schema, key), root, version, True)
    return version

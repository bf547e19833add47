"""CSV tables with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cells that count as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `schema` of a CSV file with a header, in whatever order it has them, and others left out.

    Cells of MISSING and cells that are no value of their type are null; a declared column that the file has not is null, or
    an error if it is `required`.
    """
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=False)
    gone = sorted(set(required) - set(raw.columns))
    if gone:
        raise ValueError(f"{path} lacks {', '.join(gone)}")
    cell = lambda f: F.when(~F.trim(f"`{f.name}`").isin(*MISSING), F.col(f"`{f.name}`")) if f.name in raw.columns else F.lit(None)
    return raw.select(*[cell(f).try_cast(f.dataType).alias(f.name) for f in schema.fields])

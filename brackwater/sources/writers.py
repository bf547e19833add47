"""Sinks: JSON lines, CSV, single text files in order, store snapshots, and reports from small aggregates."""

from __future__ import annotations

import html
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, also when there is no row."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_enrichment(enriched: DataFrame, path: str) -> None:
    """Scored indicators with their feeds' answers, nested, one JSON object a row; nulls are written out."""
    write_jsonl(enriched.select("indicator", "type", "risk_score", "risk_tier", "tags", "sources", "enrichment"), path)


def write_lines(df: DataFrame, path: str, order: list, header: list[str] = ()) -> None:
    """The column `line`, in order, as one text file behind the header. For exports that a device loads whole: blocklists
    are bounded by what it can hold."""
    spark = df.sparkSession
    rows = df.orderBy(*order).select("line").coalesce(1)
    if header:
        top = spark.createDataFrame([(h,) for h in header], "line string").coalesce(1)
        rows = top.unionByName(rows).coalesce(1)
    rows.write.mode("overwrite").text(path)


def write_store(store: DataFrame, root: str, version: str) -> str:
    """A new snapshot of the indicator store, then the pointer to it; readers see the old one until the pointer is written."""
    path = f"{root}/snapshots/{version}"
    store.write.mode("errorifexists").parquet(path)
    spark = store.sparkSession
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_records")
    figures = [F.count("*").alias("total_records"), *map(count, STATUSES)] if "status" in store.columns else [F.count("*").alias("total_records")]
    about = spark.read.parquet(path).agg(*figures).select(F.lit(version).alias("version"), F.current_timestamp().alias("last_updated"), "*")
    about.coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return path


# States of an indicator.
STATUSES = ("active", "expired", "revoked")
_ABOUT = "version string, last_updated timestamp, total_records long, active_records long, expired_records long, revoked_records long"


def store_metadata(spark: SparkSession, root: str) -> Row | None:
    """Version, time and counts of the current snapshot; None if there is none that can be read."""
    try:
        return spark.read.schema(_ABOUT).json(f"{root}/current").first()
    except AnalysisException:
        return None


def read_store(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The current snapshot. Where there is none, or its pointer leads nowhere, an empty table of `schema`, or an error without."""
    about = store_metadata(spark, root)
    if about and about["version"]:
        try:
            return spark.read.parquet(f"{root}/snapshots/{about['version']}")
        except AnalysisException:
            if schema is None:
                raise
    if schema is None:
        raise FileNotFoundError(f"no store at {root}")
    return spark.createDataFrame([], schema)


def summary_json(summary: DataFrame) -> str:
    """The one-row summary of record quality as a JSON document."""
    return json.dumps(json.loads(summary.toJSON().first()), indent=2)


def console_report(summary: DataFrame, recommendations: DataFrame) -> str:
    row = summary.first()
    lines = [f"records {row['total_records']}, valid {row['valid_records']}, errors {row['error_count']}, warnings {row['warning_count']}"]
    lines += [f"  {name}: {v['status']} ({v['issues_count']})" for name, v in sorted(row["by_check"].items())]
    return "\n".join(lines + [f"- {r['recommended_action']}" for r in recommendations.collect()])


def html_report(title: str, tables: dict[str, DataFrame], most_rows: int = 200) -> str:
    """A page of small result tables (at most `most_rows` rows each are shown; checks and figures have fewer)."""
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most_rows).collect()
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>")
        out += [f"<tr>{''.join(f'<td>{html.escape(str(v))}</td>' for v in r)}</tr>" for r in rows]
        out.append("</table>")
    return "".join([*out, "</body></html>"])


ADVICE = {"Significant": "Retrain, or find what changed upstream.", "Moderate": "Watch this feature.", "No Drift": "Nothing to do."}


def drift_markdown(drift: DataFrame) -> str:
    rows = [f"| {r['feature']} | {r['psi']:.4f} | {r['status']} | {ADVICE[r['status']]} |" for r in drift.orderBy("feature").collect()]
    return "\n".join(["| feature | PSI | status | advice |", "|-|-|-|-|", *rows])


DICTIONARY = {
    "failed_login_ratio": "failed logins over all logins",
    "login_frequency": "successful logins an hour",
    "geo_velocity": "greatest speed between successive logins, km/h",
    "session_duration_anomaly": "constant 0",
    "port_scan_index": "distinct target ports a second",
    "dns_query_entropy": "mean entropy of DNS names, bits a character",
    "data_exfil_ratio": "bytes sent over bytes received",
    "privilege_escalation_score": "changes from user to administrator",
    "off_hours_ratio": "share of events before 9 or from 17 o'clock",
    "connection_burstiness": "variance of counts in non-empty five-minute bins",
}


def data_dictionary() -> str:
    return "\n".join(["| feature | meaning |", "|-|-|", *(f"| {k} | {v} |" for k, v in DICTIONARY.items())])


def prediction_table(scored: DataFrame, stamp: str) -> DataFrame:
    """Predictions with one constant timestamp first."""
    return scored.select(F.lit(stamp).alias("timestamp"), *scored.columns)

"""Structured Streaming forms of parsing, quality rules and hopping-window features."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.operators.record_quality import stateless_issues
from brackwater.sources.logs import parse_lines


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """New text files of a folder as a stream of lines."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.col("value").alias("line")).filter(F.trim("line") != "")


def parsed_stream(lines: DataFrame) -> DataFrame:
    """Parsing is a projection, so the batch function is the streaming one; adds event_time for watermarks."""
    return parse_lines(lines).withColumn("event_time", F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def issue_stream(events: DataFrame, now: dt.datetime) -> DataFrame:
    """Checks that need one record only."""
    return events.select("original_line", F.inline(stateless_issues(now)))


def without_duplicates(events: DataFrame, delay: str = "1 hour", key: str = "event_id") -> DataFrame:
    """The first event of each id within the watermark."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, delay: str = "15 minutes") -> DataFrame:
    """Event, failure and off-hours counts of each source in hopping windows (an hour, every 15 minutes). Windows lie on the clock,
    and late events within `delay` are counted: the anchor at the first event and the cut at the last are batch matters."""
    hour = F.hour("event_time")
    return (
        events.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 hour", "15 minutes"), "source_ip")
        .agg(F.count("*").alias("n"), F.count_if((F.col("log_type") == "auth") & (F.col("status") == "failure")).alias("failures"), F.count_if((hour < 9) | (hour >= 17)).alias("off_hours"))
    )


def _rapid(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = []
    for pdf in batches:
        for us, line in sorted(zip(pdf["us"], pdf["original_line"], strict=True)):
            if last is not None and 0 <= us - last < 1_000_000:
                rows.append((key[0], us, line))
            last = us
    if last is not None:
        state.update((int(last),))
    yield pd.DataFrame(rows, columns=["source_ip", "us", "original_line"])


def rapid_stream(events: DataFrame) -> DataFrame:
    """Events less than a second after the one before of the same source; the state is one time for each source."""
    timed = events.filter("source_ip IS NOT NULL AND event_time IS NOT NULL").select("source_ip", F.unix_micros("event_time").alias("us"), "original_line")
    return timed.groupBy("source_ip").applyInPandasWithState(_rapid, "source_ip string, us long, original_line string", "last long", "append", "NoTimeout")

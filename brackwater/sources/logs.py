"""Raw log lines: scan with line numbers, detect the format, parse, and set bad lines aside.

Everything is a projection over built-in functions, so it works on streams as well.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.functions.network import is_valid_ip
from brackwater.functions.scalars import let, normalize_timestamp

EVENT_COLUMNS = ("line_number", "event_id", "timestamp", "source_ip", "target_ip", "user", "action", "status", "log_type", "bytes", "dns_query", "original_line")


MOST_SPLITS = 100_000


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The files of one path or several, in one scan, as `file_path`, `line_number` (1-based within a file, blank lines counted) and `line`.

    Spark gives rows of a text file no numbers, but rows of one split keep their order, and a split knows where in its file it
    begins. So lines are numbered inside their splits, and the lines of the splits before are added from a table with one row
    a split (broadcast while that is small). No row passes through Python.
    """
    split = ("file_path", "begin")
    place = (F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("id"))
    rows = spark.read.text(path).select(F.col("value").alias("line"), *place)
    splits = rows.groupBy(*split).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file_path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(*split, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    few = rows.rdd.getNumPartitions() <= MOST_SPLITS
    return rows.join(F.broadcast(splits) if few else splits, list(split)).select("file_path", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line_number"), "line")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file_number (in the order of paths), line_number (1-based within its file, blank lines counted) and line, without
    blank lines. All files are one scan; a file that two paths name counts for both. A path that is not there is an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    named = [(unquote(f), n) for n, p in enumerate(paths) for f in sorted(set(spark.read.text(p).inputFiles()))]
    rows = numbered_lines(spark, sorted({f for f, _ in named})).filter(F.trim("line") != "")
    if len(paths) == 1:
        return rows.select(F.lit(0).alias("file_number"), "line_number", "line")
    # local files are named with one slash or three, and with or without escapes
    numbers = spark.createDataFrame([(re.sub("^file:/+", "file:/", f), n) for f, n in named], "file_path string, file_number int")
    plain = F.regexp_replace(F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    return rows.withColumn("file_path", plain).join(numbers, "file_path").select("file_number", "line_number", "line")


def _part(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def parse_lines(lines: DataFrame, line: str = "line", v6: bool = True) -> DataFrame:
    """All columns of lines, the parsed event's fields, and error_code (null where the line parsed).

    First fit decides the format: DNS (`query_time=` and a bar), firewall (comma and ALLOW or DENY), auth (SUCCESS or
    FAILURE and six tokens). The first failed check of a format names the error. A null line is unknown_format.
    Each step is bound once (`let`), so that a filter on error_code does not take a line apart for every check.
    """
    s = F.trim(F.coalesce(F.col(line), F.lit("")))

    def taken_apart(x: Column) -> dict[str, Column]:
        s, upper = x["s"], F.upper(x["s"])
        kind = (
            F.when(s.contains("query_time=") & s.contains("|"), "dns")
            .when(s.contains(",") & (upper.contains("ALLOW") | upper.contains("DENY")), "firewall")
            .when((upper.contains("SUCCESS") | upper.contains("FAILURE")) & (F.size(F.split(s, "\\s+")) >= 6), "auth")
        )
        pairs = F.filter(F.transform(F.split(s, "\\|"), lambda p: F.trim(p)), lambda p: p.contains("="))
        return {"k": kind, "f": F.transform(F.split(s, ","), lambda p: F.trim(p)), "t": F.split(s, "\\s+"), "pairs": pairs}

    def named(x: Column) -> dict[str, Column]:
        k, f, t = x["k"], x["f"], x["t"]
        fire, auth, query = k == "firewall", k == "auth", k == "dns"
        keys = F.transform(x["pairs"], lambda p: F.trim(F.substring_index(p, "=", 1)))
        values = F.transform(x["pairs"], lambda p: F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))))
        pairs = F.when(query, F.reverse(F.arrays_zip(keys.alias("key"), values.alias("value"))))

        def dns(name: str) -> Column:  # the last of equal keys counts
            return F.get(F.filter(pairs, lambda p: p["key"] == name), F.lit(0))["value"]

        raw_ts = F.when(fire, _part(f, 0)).when(auth, F.concat_ws(" ", _part(t, 0), _part(t, 1))).when(query, dns("query_time"))
        return {
            "ts": normalize_timestamp(raw_ts),
            "source": F.when(fire, _part(f, 1)).when(auth, _part(t, 5)).when(query, dns("client")),
            "target": F.when(fire, _part(f, 2)),
            "verb": F.when(fire, F.upper(_part(f, 4))).when(auth, F.upper(_part(t, 4))),
            "port": F.when(fire, _part(f, 3).try_cast("int")),
            "bytes": F.when(fire, _part(f, 5).try_cast("long")),
            "reply": dns("response"),
            "domain": dns("domain"),
            "type": dns("type"),
            "needed": dns("query_time").isNotNull() & dns("client").isNotNull() & dns("domain").isNotNull() & dns("type").isNotNull(),
        }

    def checked(x: Column, y: Column) -> dict[str, Column]:
        k = x["k"]
        fire, auth, query = k == "firewall", k == "auth", k == "dns"
        code = (
            F.when(k.isNull(), "unknown_format")
            .when(fire & (F.size(x["f"]) != 6), "field_count")
            .when(query & ~y["needed"], "missing_fields")
            .when(y["ts"].isNull(), "timestamp")
            .when(~is_valid_ip(y["source"], v6), "source_ip")
            .when(fire & ~is_valid_ip(y["target"], v6), "target_ip")
            .when(fire & ~F.coalesce(y["port"].between(0, 65535), F.lit(False)), "port")
            .when(fire & y["bytes"].isNull(), "bytes")
            .when(fire & ~y["verb"].isin("ALLOW", "DENY"), "action")
            .when(auth & ~y["verb"].isin("SUCCESS", "FAILURE"), "status")
        )
        return {"code": code}

    def event(x: Column, y: Column, code: Column) -> Column:
        k, good = x["k"], code.isNull()
        fire, auth, query = k == "firewall", k == "auth", k == "dns"
        answered = F.coalesce(y["reply"], F.lit("")) != ""
        status = F.when(query, F.when(~answered, "unknown").when(y["reply"].isin("NXDOMAIN", "SERVFAIL"), "failure").otherwise("success")).when(y["verb"].isin("ALLOW", "SUCCESS"), "success").otherwise("failure")
        fields = {
            "error_code": code,
            "timestamp": F.when(good, y["ts"]),
            "source_ip": F.when(good, y["source"]),
            "target_ip": F.when(good, y["target"]),
            "user": F.when(good & auth, _part(x["t"], 2)),
            "action": F.when(good, F.when(query, F.when(answered, "RESPONSE").otherwise("QUERY")).otherwise(y["verb"])),
            "status": F.when(good, status),
            "log_type": F.when(good, k),
            "bytes": F.when(good & fire, y["bytes"]),
            "dns_query": F.when(good & query, F.struct(y["domain"].alias("domain"), y["type"].alias("type"), y["reply"].alias("response"))),
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    parsed = let({"s": s}, lambda w: let(taken_apart(w), lambda x: let(named(x), lambda y: let(checked(x, y), lambda z: event(x, y, z["code"])))))
    return lines.withColumn("_parsed", parsed).select(*lines.columns, "_parsed.*", s.alias("original_line"))


def events_of(parsed: DataFrame) -> DataFrame:
    """The normalised events: lines that parsed, each with an id made of its place (stable when a task runs again)."""
    place = F.concat_ws(":", *[F.col(c).cast("string") for c in ("file_number", "line_number") if c in parsed.columns], "original_line")
    return parsed.filter("error_code IS NULL").withColumn("event_id", F.sha2(place, 256)).select(*EVENT_COLUMNS)


def quarantine_of(parsed: DataFrame) -> DataFrame:
    keep = [c for c in ("file_number", "line_number") if c in parsed.columns]
    return parsed.filter("error_code IS NOT NULL").select(*keep, "original_line", "error_code")


GEO = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
DETAILS = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("action", "status", "method")),
    T.StructField("geo_location", GEO),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("bytes_sent", T.LongType()),
    T.StructField("bytes_received", T.LongType()),
    *(T.StructField(n, T.StringType()) for n in ("protocol", "flags", "query", "query_type", "response_code", "response_ip", "process", "parent_process", "command_line", "privilege_change")),
])
SECURITY_EVENT = T.StructType([*(T.StructField(n, T.StringType()) for n in ("event_id", "timestamp", "event_type", "source_ip", "user_id")), T.StructField("details", DETAILS)])
NORMALIZED_EVENT = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("event_id", "timestamp", "source_ip", "target_ip", "user", "action", "status", "log_type", "original_line", "parsed_at")),
    T.StructField("bytes", T.LongType()),
    T.StructField("dns_query", T.StructType([T.StructField(n, T.StringType()) for n in ("domain", "type", "response")])),
])


def read_normalized(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of normalised events; one bad line ends the read."""
    return spark.read.schema(NORMALIZED_EVENT).json(path, mode="FAILFAST")


def read_security_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good events (event_time parsed from `yyyy-MM-ddTHH:mm:ssZ`) and the raw text of bad ones."""
    schema = T.StructType([*SECURITY_EVENT.fields, T.StructField("_bad", T.StringType())])
    # the raw text is parsed as a column, so that both outputs can be asked for alone
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    when = F.try_to_timestamp("e.timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    parsed = parsed.withColumn("event_time", when)
    fine = F.col("e._bad").isNull() & F.col("event_time").isNotNull()
    fields = [F.coalesce(F.col(f"e.{n}"), F.lit("")).alias(n) for n in ("event_id", "event_type", "source_ip", "user_id")]
    return parsed.filter(fine).select(*fields, "event_time", F.col("e.details").alias("details")), parsed.filter(~fine).select("value")

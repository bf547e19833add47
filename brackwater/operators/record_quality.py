"""Record-level quality rules over normalised events: one row per issue, and the summary.

Besides the final counts there are two shuffles: by event_id (duplicates) and by source_ip (rapid sequences), both inside
blocks of lines, so that no id or address is one task; `now` is always given by the caller.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackwater.functions.network import is_external_facing, is_private_ip, is_valid_ip
from brackwater.functions.scalars import floor_div, let, to_instant

# Names of the checks as they stand in reports.
CHECKS = ("Check 1: Missing Fields", "Check 2: IP Validation", "Check 3: Timestamp Anomalies", "Check 4: Duplicate Detection", "Check 5: Suspicious Patterns")
CRITICAL = ("event_id", "timestamp", "source_ip", "action", "log_type")
TERABYTE = 1 << 40
BLOCK_LINES = 1 << 20  # lines in which one address or id is one group
ADVICE = {
    "missing": "Check the upstream parser and schema so that every core field is filled.",
    "source_ip": "Clean the source address; only IPv4 or IPv6 is accepted.",
    "private_ip": "Look for address translation faults or spoofing where a private address meets an outward-facing log.",
    "target_ip": "Clean the target address field.",
    "future": "Synchronise clocks and check time zone handling.",
    "archived": "Check whether a backlog is being replayed.",
    "bad_time": "Send timestamps in ISO 8601, UTC.",
    "duplicate": "Check the source for repeated ids or retries.",
    "deny_success": "Check how the firewall parser maps actions to statuses.",
    "failure_success": "Check how the auth parser maps actions to statuses.",
    "negative_bytes": "Look for overflow in the export of byte counts.",
    "huge_bytes": "Check whether the transfer is legitimate.",
    "rapid": "Look for brute force, scanning or flooding from this address.",
}


def _issue(when: Column, check: int, severity: str, rule: str, description: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(CHECKS[check - 1]).alias("check_type"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), description.alias("description"), F.lit(ADVICE[rule]).alias("recommended_action")))


def _facts(v6: bool) -> dict[str, Column]:
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    missing = F.concat_ws(", ", *[F.when(blank(c), F.lit(c)) for c in CRITICAL])
    return {"missing": missing, "valid": is_valid_ip(F.col("source_ip"), v6), "target_valid": is_valid_ip(F.col("target_ip"), v6), "at": to_instant(F.col("timestamp"))}


def _with_facts(events: DataFrame, v6: bool) -> tuple[DataFrame, dict[str, Column]]:
    """The facts as columns of a projection of their own: compiled, while what `let` binds is interpreted."""
    facts = _facts(v6)
    return events.withColumns({f"_{n}": c for n, c in facts.items()}), {n: F.col(f"_{n}") for n in facts}


def _rules(x: Column | dict[str, Column], now: dt.datetime, v6: bool) -> list[tuple[Column, int, str, str, Column]]:
    """Condition, check, severity, rule and description of every rule that one record can break by itself."""
    src, dst, ts = F.col("source_ip"), F.col("target_ip"), F.col("timestamp")
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    missing, at = x["missing"], x["at"]
    clock = F.lit(now.astimezone(dt.timezone.utc) if now.tzinfo else now.replace(tzinfo=dt.timezone.utc))
    age = (F.unix_micros(clock) - F.unix_micros(at)) / 1e6
    size = F.col("bytes").try_cast("long")
    outward = is_external_facing(F.lit(None).cast("string"), F.col("original_line"), F.col("log_type"))
    say = F.concat
    return [
        (missing != "", 1, "ERROR", "missing", say(F.lit("Missing critical field(s): "), missing)),
        (there(src) & ~x["valid"], 2, "ERROR", "source_ip", say(F.lit("Invalid source address: "), src)),
        (there(src) & x["valid"] & outward & is_private_ip(src, v6), 2, "WARNING", "private_ip", say(F.lit("Private address in an outward-facing log: "), src)),
        (there(dst) & ~x["target_valid"], 2, "ERROR", "target_ip", say(F.lit("Invalid target address: "), dst)),
        (there(ts) & (age < -5), 3, "ERROR", "future", say(F.lit("Timestamp in the future: "), ts)),
        (there(ts) & (F.floor(age / 86400) > 365), 3, "WARNING", "archived", say(F.lit("Timestamp older than a year: "), ts)),
        (there(ts) & at.isNull(), 3, "ERROR", "bad_time", say(F.lit("Timestamp is not ISO 8601: "), ts)),
        ((F.col("action") == "DENY") & (F.col("status") == "success"), 5, "WARNING", "deny_success", F.lit("DENY marked as success")),
        ((F.col("action") == "FAILURE") & (F.col("status") == "success"), 5, "WARNING", "failure_success", F.lit("FAILURE marked as success")),
        (size < 0, 5, "ERROR", "negative_bytes", say(F.lit("Negative byte count: "), size.cast("string"))),
        (size > TERABYTE, 5, "WARNING", "huge_bytes", say(F.lit("More than 1 TB: "), size.cast("string"))),
    ]


def stateless_issues(now: dt.datetime, v6: bool = True) -> Column:
    """Array of the issues that one record shows by itself (checks 1 to 3 and most of 5); works on streams as well."""
    return let(_facts(v6), lambda x: F.filter(F.array(*[_issue(*r) for r in _rules(x, now, v6)]), lambda i: i.isNotNull()))


def _blocks(events: DataFrame, lines: int) -> DataFrame:
    return events.withColumn("block", floor_div(F.col("line_number"), lines))


def duplicate_issues(events: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Every occurrence of an event id after its first, with the first line that has it and how many came before.

    An id is ranked inside blocks of `lines` lines; what its earlier blocks hold is added from a table with one row an id and
    block, from which ids that occur once are left out. So an id that every line has is as many groups as there are blocks.
    """
    e = _blocks(events.filter("coalesce(event_id, '') <> ''").select("line_number", "event_id"), lines)
    by_id = Window.partitionBy("event_id")
    earlier = by_id.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = e.groupBy("event_id", "block").agg(F.count("*").alias("n"), F.min("line_number").alias("least"))
    held = held.select("event_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("held"), F.min("least").over(by_id).alias("first"), F.sum("n").over(by_id).alias("all")).filter("all > 1")
    place = F.row_number().over(Window.partitionBy("event_id", "block").orderBy("line_number"))
    rows = e.join(held, ["event_id", "block"]).withColumn("before", F.col("held") + place - 1).filter("before > 0")
    text = F.concat(F.lit("Duplicate event_id "), F.col("event_id"), F.lit(", first on line "), F.col("first").cast("string"), F.lit(", occurrences before: "), F.col("before").cast("string"))
    return rows.select("line_number", _issue(F.lit(True), 4, "ERROR", "duplicate", text).alias("i")).select("line_number", "i.*")


def _timed(events: DataFrame, lines: int) -> DataFrame:
    timed = events.filter("coalesce(source_ip, '') <> ''").select("line_number", "source_ip", F.unix_micros(to_instant(F.col("timestamp"))).alias("us"))
    return _blocks(timed.filter("us IS NOT NULL"), lines)


def _in_block(c: str) -> Column:
    return F.lag(c).over(Window.partitionBy("source_ip", "block").orderBy("line_number"))


def _block_before() -> Column:
    return F.lag("last").over(Window.partitionBy("source_ip").orderBy("block"))


def _ends() -> list[Column]:
    return [f(F.struct("line_number", "us")).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]


def _soon(us: Column, before: Column) -> Column:
    return (us - before >= 0) & (us - before < 1_000_000)


def rapid_issues(events: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Events less than a second after the previous line of the same source address (lines without a good time are passed over).

    Lines meet the one before inside blocks of `lines` lines, and the first line of an address in a block meets the last one
    of its block before: a flooding address is one row a block there.
    """
    timed = _timed(events, lines)
    inside = timed.select("line_number", "source_ip", "us", _in_block("line_number").alias("prev"), _in_block("us").alias("then"))
    ends = timed.groupBy("source_ip", "block").agg(*_ends()).select("source_ip", "first", _block_before().alias("before"))
    across = ends.select("first.line_number", "source_ip", "first.us", F.col("before.line_number").alias("prev"), F.col("before.us").alias("then"))
    text = F.concat(F.lit("Less than 1 s after line "), F.col("prev").cast("string"), F.lit(" from "), F.col("source_ip"))
    found = inside.unionByName(across).filter(_soon(F.col("us"), F.col("then")))
    return found.select("line_number", _issue(F.lit(True), 5, "WARNING", "rapid", text).alias("i")).select("line_number", "i.*")


def issues(events: DataFrame, now: dt.datetime, v6: bool = True) -> DataFrame:
    """line_number, check_type, severity, rule, description, recommended_action: all issues of all checks."""
    known, x = _with_facts(events, v6)
    alone = known.select("line_number", F.explode(F.array(*[_issue(*r) for r in _rules(x, now, v6)])).alias("i")).filter("i IS NOT NULL").select("line_number", "i.*")
    return alone.unionByName(duplicate_issues(events)).unionByName(rapid_issues(events))


def summary(events: DataFrame, found: DataFrame) -> DataFrame:
    """One row: total and valid records, errors, warnings, and by_check (check -> status, issues_count)."""
    lines = found.groupBy("line_number").agg(F.max((F.col("severity") == "ERROR").cast("int")).alias("bad"))
    n = events.agg(F.count("*").alias("total_records"))
    bad = lines.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    worst = F.when(F.count_if(F.col("severity") == "ERROR") > 0, "ERROR").otherwise("WARNING")
    per = found.groupBy("check_type").agg(worst.alias("status"), F.count("*").alias("issues_count"), F.count_if(F.col("severity") == "ERROR").alias("errors"))
    every = found.sparkSession.createDataFrame([(c,) for c in CHECKS], "check_type string").join(F.broadcast(per), "check_type", "left")
    by_check = every.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("check_type", F.struct(F.coalesce("status", F.lit("PASS")).alias("status"), F.coalesce("issues_count", F.lit(0)).alias("issues_count")))))).alias("by_check"), F.coalesce(F.sum("errors"), F.lit(0)).alias("error_count"), F.coalesce(F.sum("issues_count") - F.sum("errors"), F.lit(0)).alias("warning_count"))
    return n.join(bad).join(by_check).select("total_records", (F.col("total_records") - F.col("bad")).alias("valid_records"), "error_count", "warning_count", "by_check")


def quick_summary(events: DataFrame, now: dt.datetime, v6: bool = True, lines: int = BLOCK_LINES) -> DataFrame:
    """The row of `summary(events, issues(events, now, v6))` without its issues: line numbers must differ.

    Rules on single records and duplicates come from one pass and one shuffle by event_id, which counts before it shuffles;
    rapid sequences from a pass over address, time and line.
    """
    kinds = [(c, s) for c in (1, 2, 3, 5) for s in ("ERROR", "WARNING")]
    name = lambda c, s: f"{s.lower()}_{c}"

    known, x = _with_facts(events, v6)
    hits = [(F.coalesce(when, F.lit(False)).cast("int"), c, s) for when, c, s, _, _ in _rules(x, now, v6)]
    e = known.select("line_number", F.nullif("event_id", F.lit("")).alias("event_id"), *[sum((h for h, c, s in hits if (c, s) == k), F.lit(0)).alias(name(*k)) for k in kinds])
    e = e.withColumn("bad", (sum(F.col(name(*k)) for k in kinds if k[1] == "ERROR") > 0).cast("int"))
    ids = e.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.min(F.struct("line_number", "bad")).alias("first"), *[F.sum(name(*k)).alias(name(*k)) for k in kinds])
    known = F.col("event_id").isNotNull()
    more_bad = F.when(known, F.col("n") - F.col("bad") - 1 + F.col("first.bad")).otherwise(0)  # good ones but for their id
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    main = ids.agg(total("n").alias("total_records"), total(F.col("bad") + more_bad).alias("bad"), total(F.when(known, F.col("n") - 1)).alias("error_4"), F.lit(0).cast("long").alias("warning_4"), *[total(name(*k)).alias(name(*k)) for k in kinds])
    steps = _timed(events, lines).select("line_number", "source_ip", "block", "us", _in_block("us").alias("then"))
    per_block = steps.groupBy("source_ip", "block").agg(F.count_if(_soon(F.col("us"), F.col("then"))).alias("rapid"), *_ends())
    edge = _soon(F.col("first.us"), _block_before()["us"])
    rapid = per_block.select("rapid", edge.alias("edge")).agg((total("rapid") + F.count_if("edge")).alias("rapid"))
    both = main.join(rapid).withColumn("warning_5", F.col("warning_5") + F.col("rapid"))
    err, warn = [F.col(f"error_{i}") for i in range(1, 6)], [F.col(f"warning_{i}") for i in range(1, 6)]
    state = lambda a, b: F.when(a > 0, "ERROR").when(b > 0, "WARNING").otherwise("PASS")
    by_check = F.create_map(*[c for n, a, b in zip(CHECKS, err, warn, strict=True) for c in (F.lit(n), F.struct(state(a, b).alias("status"), (a + b).alias("issues_count")))])
    return both.select("total_records", (F.col("total_records") - F.col("bad")).alias("valid_records"), sum(err[1:], err[0]).alias("error_count"), sum(warn[1:], warn[0]).alias("warning_count"), by_check.alias("by_check"))


def top_recommendations(found: DataFrame, n: int = 5) -> DataFrame:
    """The first n different recommendations in order of appearance."""
    return found.groupBy("recommended_action").agg(F.min("line_number").alias("first_line")).orderBy("first_line", "recommended_action").limit(n)

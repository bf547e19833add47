"""Queries over log lines, normalised events and behavioural features."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackwater.functions import network, scalars
from brackwater.operators import dataset_quality, exploration, features, record_quality
from brackwater.plans import adapters as ad
from brackwater.plans.registry import query
from brackwater.session import shared_dir, table
from brackwater.sources import logs, tables, writers

NOW = dt.datetime.fromisoformat(ad.NOW)
SALT = "pepper"


def parsed(spark, d) -> DataFrame:
    return logs.parse_lines(ad.log_lines(spark, d))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("line_number", "timestamp", "source_ip", "target_ip", "user", "action", "status", "bytes", F.col("dns_query.domain").alias("dns_domain"), F.col("dns_query.type").alias("dns_type"), F.col("dns_query.response").alias("dns_response"))


for _kind in ("firewall", "auth", "dns"):
    query(f"parse_{_kind}", f"""WITH {ad.PARSED} SELECT line_number, "timestamp", source_ip, target_ip, "user", action, status, bytes, dns_domain, dns_type, dns_response
FROM parsed WHERE error_code IS NULL AND log_type = '{_kind}'""")(lambda spark, d, k=_kind: _flat(parsed(spark, d).filter((F.col("log_type") == k) & F.col("error_code").isNull())))

query("parse_detect_counts", f"WITH {ad.PARSED} SELECT coalesce(CASE WHEN error_code IS NULL THEN log_type END, 'rejected') AS kind, count(*) AS n FROM parsed GROUP BY 1")(
    lambda spark, d: parsed(spark, d).groupBy(F.coalesce("log_type", F.lit("rejected")).alias("kind")).agg(F.count("*").alias("n")))
query("quarantine_reasons", f"WITH {ad.PARSED} SELECT error_code, count(*) AS n FROM parsed WHERE error_code IS NOT NULL GROUP BY 1")(
    lambda spark, d: logs.quarantine_of(parsed(spark, d)).groupBy("error_code").agg(F.count("*").alias("n")))
query("quarantine_lines", f"WITH {ad.PARSED} SELECT line_number, original_line, error_code FROM parsed WHERE error_code IS NOT NULL")(lambda spark, d: logs.quarantine_of(parsed(spark, d)))

def _written(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("lines_scan", f"""WITH {ad.PARSED} SELECT coalesce(error_code, log_type) AS kind, count(*) AS n, min(line_number) AS first_line, max(line_number) AS last_line FROM parsed GROUP BY 1""")
def lines_scan(spark, d):
    """The log lines written as many text files, in order, and read again in one scan; a line's number is that within its file and
    the lines of the files before."""
    path = _written(spark, "lines")
    lines = ad.log_lines(spark, d)
    lines.repartitionByRange(16, "line_number").sortWithinPartitions("line_number").select("line").write.text(path)
    rows = logs.numbered_lines(spark, path)
    before = Window.partitionBy(F.lit(1)).orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = rows.groupBy("file_path").agg(F.max("line_number").alias("n")).select("file_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    first = lines.agg((F.min("line_number") - 1).alias("first"))
    numbered = rows.join(F.broadcast(files), "file_path").crossJoin(F.broadcast(first)).select((F.col("line_number") + F.col("before") + F.col("first")).alias("line_number"), "line")
    return logs.parse_lines(numbered).groupBy(F.coalesce("error_code", "log_type").alias("kind")).agg(F.count("*").alias("n"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"))


@query("jsonl_scan", f"""WITH {ad.PARSED} SELECT line_number, source_ip, "user", action, bytes, dns_domain FROM parsed WHERE error_code IS NULL""")
def jsonl_scan(spark, d):
    """Normalised events written as JSON lines and read again."""
    path = _written(spark, "events")
    writers.write_jsonl(logs.events_of(parsed(spark, d)).withColumn("parsed_at", F.col("line_number").cast("string")), path)
    return logs.read_normalized(spark, path).select(F.col("parsed_at").cast("long").alias("line_number"), "source_ip", "user", "action", "bytes", F.col("dns_query.domain").alias("dns_domain"))


@query("csv_scan", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN NULL ELSE c_acctbal END AS balance, 'a, \"b\" ' || c_name AS note, NULL::VARCHAR AS more FROM customer")
def csv_scan(spark, d):
    """A CSV file with missing and bad cells, quotes and commas, columns in another order and one that is not declared."""
    path = _written(spark, "customers")
    k = F.col("c_custkey")
    balance = F.when(k % 7 == 0, "N/A").when(k % 7 == 1, "none at all").otherwise(F.col("c_acctbal").cast("string"))
    out = table(spark, d, "customer").select(F.lit(1).alias("unknown"), balance.alias("balance"), F.concat(F.lit('a, "b" '), F.col("c_name")).alias("note"), "c_custkey")
    out.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_table(spark, path, "c_custkey long, balance double, note string, more string")


_FORMS = (  # Spark's pattern and DuckDB's, what stands behind, hours to take off, and the unit that is left
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "", 0, "second"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "Z", 0, "second"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", ".250+02:00", 2, "second"),
    ("yyyy-MM-dd", "%Y-%m-%d", "", 0, "day"),
    ("yyyy-MM-dd'T'HH:mm", "%Y-%m-%dT%H:%M", "", 0, "minute"),
    ("yyyyMMdd'T'HHmmss", "%Y%m%dT%H%M%S", "", 0, "second"),
    ("yyyyMMdd", "%Y%m%d", "", 0, "day"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", ".12345678-0330", -3.5, "second"),
    ("yyyy-MM-dd HH", "%Y-%m-%d %H", "+01", 1, "hour"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", ",5", 0, "second"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", ".", None, ""),
    ("yyyy-MM", "%Y-%m", "", None, ""),
    ("yyyy-13-dd", "%Y-13-%d", "", None, ""),
    ("dd.MM.yyyy", "%d.%m.%Y", "", None, ""),
)


def _by_form(of) -> str:
    return f"CASE event_id % {len(_FORMS)} {' '.join(f'WHEN {i} THEN {of(*f)}' for i, f in enumerate(_FORMS))} END"


@query("normalize_ts", f"""SELECT event_id, {_by_form(lambda _, form, tail, off, unit: f"strftime(ts, '{form}') || '{tail}'")} AS raw,
  {_by_form(lambda _, form, tail, off, unit: "NULL" if off is None else f"strftime(date_trunc('{unit}', ts) - INTERVAL ({int(off * 60)}) MINUTE, '%Y-%m-%dT%H:%M:%SZ')")} AS normalized FROM events""")
def normalize_ts(spark, d):
    n = F.col("event_id") % len(_FORMS)
    raw = F.coalesce(*[F.when(n == i, F.concat(F.date_format("ts", form), F.lit(tail))) for i, (form, _, tail, _, _) in enumerate(_FORMS)])
    df = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return df.select("event_id", "raw", scalars.normalize_timestamp(F.col("raw")).alias("normalized"))


@query("entity_key", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'u' || CAST(user_id AS VARCHAR) END, ''), nullif(CASE WHEN event_id % 5 > 0 THEN '10.0.0.' || CAST(user_id % 250 AS VARCHAR) ELSE '' END, '')) AS entity FROM events")
def entity_key(spark, d):
    n, user = F.col("event_id"), F.col("user_id")
    name = F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("u"), user.cast("string")))
    ip = F.when(n % 5 > 0, F.concat(F.lit("10.0.0."), (user % 250).cast("string"))).otherwise("")
    return table(spark, d, "events").select("event_id", features.entity_of(name, ip).alias("entity"))


_IP = "CAST(event_id % 260 AS VARCHAR) || '.' || CAST((event_id * 7) % 200 AS VARCHAR) || CASE WHEN event_id % 11 = 0 THEN '.01' ELSE '.1' END || CASE WHEN event_id % 13 = 0 THEN '' ELSE '.' || CAST(event_id % 256 AS VARCHAR) END"


def _ips(spark, d):
    n, s = F.col("event_id"), lambda c: c.cast("string")
    return table(spark, d, "events").select("event_id", F.concat(s(n % 260), F.lit("."), s(n * 7 % 200), F.when(n % 11 == 0, ".01").otherwise(".1"), F.when(n % 13 == 0, "").otherwise(F.concat(F.lit("."), s(n % 256)))).alias("ip"))


query("ip_validity_v4", f"SELECT event_id, {_IP} AS ip, regexp_matches({_IP}, '{ad.V4}') AS valid FROM events")(lambda spark, d: _ips(spark, d).withColumn("valid", network.is_valid_ip(F.col("ip"))))
_RANGES = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in network.private_ranges())
query("ip_private_v4", f"""WITH ips AS (SELECT event_id, {_IP} AS ip FROM events), nums AS (SELECT event_id, ip, CASE WHEN regexp_matches(ip, '{ad.V4}') THEN
  CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) END AS n FROM ips)
SELECT event_id, ip, coalesce({_RANGES}, false) AS private FROM nums""")(lambda spark, d: _ips(spark, d).withColumn("private", network.is_private_ip(F.col("ip"))))
query("generalize_ip", f"SELECT event_id, CASE WHEN len(string_split({_IP}, '.')) = 4 THEN regexp_replace({_IP}, '[^.]*$', '0') ELSE {_IP} END AS ip FROM events")(lambda spark, d: _ips(spark, d).select("event_id", network.generalize_ip(F.col("ip")).alias("ip")))
query("pseudonymize", f"SELECT c_custkey, sha256(c_name || '{SALT}') AS name_hash FROM customer")(lambda spark, d: table(spark, d, "customer").select("c_custkey", scalars.pseudonymize(F.col("c_name"), SALT).alias("name_hash")))
query("round_ts", "SELECT event_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS quarter, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS whole FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", *[F.date_format(scalars.round_timestamp(F.col("ts").cast("timestamp"), m), "yyyy-MM-dd HH:mm:ss").alias(n) for m, n in ((15, "quarter"), (60, "whole"))]))
query("url_ids", "SELECT page_id, rtrim(translate(to_base64(encode(url)), '+/', '-_'), '=') AS url_id FROM pages")(lambda spark, d: table(spark, d, "pages").select("page_id", scalars.url_id(F.col("url")).alias("url_id")))
query("haversine", "SELECT n_nationkey, round(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM (SELECT n_nationkey, pow(sin(radians(n_nationkey * 2) / 2), 2) + cos(radians(10.0)) * cos(radians(10.0 + n_nationkey * 2)) * pow(sin(radians(n_nationkey * 5) / 2), 2) AS a FROM nation)")(
    lambda spark, d: table(spark, d, "nation").select("n_nationkey", F.round(scalars.haversine_km(F.lit(10.0), F.lit(0.0), 10.0 + F.col("n_nationkey") * 2, F.col("n_nationkey") * 5.0), 6).alias("km")))
query("text_entropy", "SELECT p_partkey, round(entropy(c), 6) AS bits FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part) GROUP BY 1")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", F.round(scalars.entropy_bits(F.col("p_name")), 6).alias("bits")))


@query("laplace")
def laplace(spark, d):
    """Seeded noise on event values: a check of rows only."""
    return table(spark, d, "events").select("event_id", scalars.laplace_noise(F.col("value"), 0.01, 0.5, seed=3).alias("noisy"))


# record quality ------------------------------------------------------------------------------------------------------
_SQL_ISSUES = f"""{ad.NORM_EVENTS},
timed AS (SELECT *, CASE WHEN regexp_matches("timestamp", '{ad._GOOD_TS}') THEN CAST(replace(replace("timestamp", 'T', ' '), 'Z', '') AS TIMESTAMP) END AS tstamp FROM norm_events),
private AS (SELECT line_number FROM norm_events WHERE source_ip LIKE '10.0.0.%' AND (log_type = 'dns' OR regexp_matches(original_line, 'web|gateway|mail|external|vpn'))),
dup AS (SELECT line_number, event_id, row_number() OVER (PARTITION BY event_id ORDER BY line_number) - 1 AS before, min(line_number) OVER (PARTITION BY event_id) AS first FROM norm_events WHERE coalesce(event_id, '') <> ''),
near AS (SELECT line_number, source_ip, tstamp - lag(tstamp) OVER (PARTITION BY source_ip ORDER BY line_number) AS gap FROM timed WHERE tstamp IS NOT NULL AND coalesce(source_ip, '') <> ''),
found AS (
  SELECT line_number, 1 AS c, 'ERROR' AS severity, 'missing' AS rule FROM norm_events WHERE event_id IS NULL OR trim("timestamp") = '' OR trim(source_ip) = ''
  UNION ALL SELECT line_number, 2, 'ERROR', 'source_ip' FROM norm_events WHERE source_ip <> '' AND NOT regexp_matches(source_ip, '{ad.V4}')
  UNION ALL SELECT line_number, 2, 'WARNING', 'private_ip' FROM private
  UNION ALL SELECT line_number, 2, 'ERROR', 'target_ip' FROM norm_events WHERE target_ip <> '' AND NOT regexp_matches(target_ip, '{ad.V4}')
  UNION ALL SELECT line_number, 3, 'ERROR', 'future' FROM timed WHERE tstamp > TIMESTAMP '{ad.NOW}' + INTERVAL 5 SECOND
  UNION ALL SELECT line_number, 3, 'WARNING', 'archived' FROM timed WHERE floor((epoch(TIMESTAMP '{ad.NOW}') - epoch(tstamp)) / 86400) > 365
  UNION ALL SELECT line_number, 3, 'ERROR', 'bad_time' FROM timed WHERE "timestamp" <> '' AND tstamp IS NULL
  UNION ALL SELECT line_number, 4, 'ERROR', 'duplicate' FROM dup WHERE before > 0
  UNION ALL SELECT line_number, 5, 'WARNING', 'deny_success' FROM norm_events WHERE action = 'DENY' AND status = 'success'
  UNION ALL SELECT line_number, 5, 'WARNING', 'failure_success' FROM norm_events WHERE action = 'FAILURE' AND status = 'success'
  UNION ALL SELECT line_number, 5, 'ERROR', 'negative_bytes' FROM norm_events WHERE bytes < 0
  UNION ALL SELECT line_number, 5, 'WARNING', 'huge_bytes' FROM norm_events WHERE bytes > 1099511627776
  UNION ALL SELECT line_number, 5, 'WARNING', 'rapid' FROM near WHERE gap >= INTERVAL 0 SECOND AND gap < INTERVAL 1 SECOND)"""


def found(spark, d) -> DataFrame:
    return record_quality.issues(ad.norm_events(spark, d), NOW)


for _name, _check in (("q_missing", 1), ("q_ip", 2), ("q_timestamp", 3), ("q_suspicious", 5)):
    query(_name, f"WITH {_SQL_ISSUES} SELECT line_number, severity, rule FROM found WHERE c = {_check} AND rule <> 'rapid'")(
        lambda spark, d, c=_check: ad.norm_events(spark, d).select("line_number", F.inline(record_quality.stateless_issues(NOW))).filter(F.col("check_type") == record_quality.CHECKS[c - 1]).select("line_number", "severity", "rule"))
query("q_duplicates", f"WITH {_SQL_ISSUES} SELECT line_number, 'Duplicate event_id ' || event_id || ', first on line ' || CAST(first AS VARCHAR) || ', occurrences before: ' || CAST(before AS VARCHAR) AS description FROM dup WHERE before > 0")(
    lambda spark, d: record_quality.duplicate_issues(ad.norm_events(spark, d)).select("line_number", "description"))
query("q_rapid", f"WITH {_SQL_ISSUES} SELECT line_number, severity FROM found WHERE rule = 'rapid'")(lambda spark, d: record_quality.rapid_issues(ad.norm_events(spark, d)).select("line_number", "severity"))


@query("q_summary", f"""WITH {_SQL_ISSUES}, names(c, name) AS (VALUES {', '.join(f"({i + 1}, '{n}')" for i, n in enumerate(record_quality.CHECKS))}),
per AS (SELECT c, count(*) AS n, CASE WHEN count_if(severity = 'ERROR') > 0 THEN 'ERROR' ELSE 'WARNING' END AS status FROM found GROUP BY c)
SELECT name AS check_type, coalesce(status, 'PASS') AS status, CAST(coalesce(n, 0) AS BIGINT) AS issues_count, (SELECT count(*) FROM norm_events) AS total_records,
  (SELECT count(*) FROM norm_events) - (SELECT count(DISTINCT line_number) FROM found WHERE severity = 'ERROR') AS valid_records,
  (SELECT count(*) FROM found WHERE severity = 'ERROR') AS error_count, (SELECT count(*) FROM found WHERE severity = 'WARNING') AS warning_count
FROM names LEFT JOIN per USING (c)""")
def q_summary(spark, d):
    s = record_quality.quick_summary(ad.norm_events(spark, d), NOW)
    return s.select(F.explode("by_check").alias("check_type", "v"), "total_records", "valid_records", "error_count", "warning_count").select("check_type", "v.status", "v.issues_count", "total_records", "valid_records", "error_count", "warning_count")


query("q_recommendations", f"""WITH {_SQL_ISSUES}, advice(rule, recommended_action) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in record_quality.ADVICE.items())})
SELECT recommended_action, min(line_number) AS first_line FROM found JOIN advice USING (rule) GROUP BY 1 ORDER BY first_line, recommended_action LIMIT 5""")(lambda spark, d: record_quality.top_recommendations(found(spark, d)))

# features ------------------------------------------------------------------------------------------------------------
_KM = "2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h))"
SQL_FEATURES = f"""{ad.SEC_EVENTS},
ends AS (SELECT min(us) AS lo, max(us) AS hi FROM sec_events),
wins AS (SELECT k, lo + k * 900000000 AS win_start FROM (SELECT lo, hi, unnest(range(0, CAST((hi - lo - 3600000000) // 900000000 AS BIGINT) + 1)) AS k FROM ends WHERE hi - lo >= 3600000000)),
e AS (SELECT s.*, k AS win, win_start FROM sec_events s JOIN wins ON s.us >= win_start AND s.us < win_start + 3600000000),
base AS (SELECT entity, win, win_start, count(*) AS event_count,
    count_if(action = 'login' AND status = 'failure') / nullif(count_if(action = 'login'), 0) AS flr, CAST(count(*) FILTER (WHERE action = 'login' AND status = 'success') AS DOUBLE) AS login_frequency,
    count(DISTINCT CASE WHEN event_type = 'network' THEN dest_port END) / 3600.0 AS port_scan_index,
    coalesce(sum(bytes_sent), 0) AS sent, coalesce(sum(bytes_received), 0) AS received,
    CAST(count(*) FILTER (WHERE privilege_change = 'user_to_admin') AS DOUBLE) AS privilege_escalation_score,
    count_if(hour(make_timestamp(us)) < 9 OR hour(make_timestamp(us)) >= 17) / count(*) AS off_hours_ratio
  FROM e GROUP BY 1, 2, 3),
steps AS (SELECT entity, win, (us - lag(us) OVER w) / 3.6e9 AS gap, pow(sin((radians(lat) - radians(lag(lat) OVER w)) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) OVER w) / 2), 2) AS h
  FROM e WHERE event_type = 'auth' AND lat IS NOT NULL WINDOW w AS (PARTITION BY entity, win ORDER BY us, seq)),
speeds AS (SELECT entity, win, max({_KM} / gap) AS geo FROM steps WHERE gap > 0 GROUP BY 1, 2),
chars AS (SELECT seq, unnest(string_split(query, '')) AS c FROM sec_events WHERE query IS NOT NULL),
bits AS (SELECT seq, entropy(c) AS b FROM chars GROUP BY seq),
ent AS (SELECT entity, win, avg(b) AS bits FROM e JOIN bits USING (seq) GROUP BY 1, 2),
binned AS (SELECT entity, win, us, (us - min(us) OVER (PARTITION BY entity, win)) // 300000000 AS bin FROM e),
bins AS (SELECT entity, win, bin, count(*) AS n, min(us) AS a, max(us) AS b FROM binned GROUP BY 1, 2, 3),
burst AS (SELECT entity, win, CASE WHEN max(b) - min(a) < 300000000 THEN 0.0 ELSE var_pop(n) END AS burst FROM bins GROUP BY 1, 2),
feats AS (SELECT entity, win, win_start, event_count, round(coalesce(flr, 0.0), 6) AS failed_login_ratio, login_frequency, round(coalesce(geo, 0.0), 4) AS geo_velocity, 0.0::DOUBLE AS session_duration_anomaly,
    round(port_scan_index, 9) AS port_scan_index, round(coalesce(bits, 0.0), 6) AS dns_query_entropy,
    round(CASE WHEN received = 0 THEN CAST(sent AS DOUBLE) ELSE sent / received END, 6) AS data_exfil_ratio, privilege_escalation_score, round(off_hours_ratio, 6) AS off_hours_ratio, round(burst, 6) AS connection_burstiness
  FROM base LEFT JOIN speeds USING (entity, win) LEFT JOIN ent USING (entity, win) JOIN burst USING (entity, win))"""
_DIGITS = {"geo_velocity": 4, "port_scan_index": 9, "login_frequency": None, "session_duration_anomaly": None, "privilege_escalation_score": None}


def feature_table(spark, d, which=features.FEATURES) -> DataFrame:
    df = features.window_features(ad.sec_events(spark, d), which)
    return df.withColumns({f: F.round(f, _DIGITS.get(f, 6)) for f in which if _DIGITS.get(f, 6) is not None})


for _name, _feature in (("feat_failed_login", "failed_login_ratio"), ("feat_login_freq", "login_frequency"), ("feat_geo_velocity", "geo_velocity"), ("feat_port_scan", "port_scan_index"), ("feat_dns_entropy", "dns_query_entropy"), ("feat_exfil", "data_exfil_ratio"), ("feat_priv_esc", "privilege_escalation_score"), ("feat_off_hours", "off_hours_ratio"), ("feat_burstiness", "connection_burstiness"), ("feat_session_anomaly", "session_duration_anomaly")):
    query(_name, f"WITH {SQL_FEATURES} SELECT entity, win, {_feature} FROM feats")(lambda spark, d, f=_feature: feature_table(spark, d, (f,)).select("entity", "win", f))
query("feat_hop_counts", f"WITH {SQL_FEATURES} SELECT entity, win, win_start, event_count FROM feats")(lambda spark, d: feature_table(spark, d, ()).select("entity", "win", "win_start", "event_count"))
query("feat_all", f"WITH {SQL_FEATURES} SELECT * FROM feats")(lambda spark, d: feature_table(spark, d))
query("feat_release", f"""WITH {SQL_FEATURES} SELECT sha256(entity || '{SALT}') AS entity_id, strftime(date_trunc('hour', make_timestamp(win_start)), '%Y-%m-%dT%H:%M:%S') AS window_start, event_count, failed_login_ratio, dns_query_entropy, NULL::VARCHAR AS generalized_ip FROM feats""")(
    lambda spark, d: features.private_features(feature_table(spark, d), SALT, epsilon=0.0).select("entity_id", "window_start", "event_count", "failed_login_ratio", "dns_query_entropy", "generalized_ip"))
query("feat_private")(lambda spark, d: features.private_features(features.window_features(ad.sec_events(spark, d)), SALT))

# dataset quality, drift ----------------------------------------------------------------------------------------------
_HOLES = ("failed_login_ratio", "geo_velocity", "dns_query_entropy")
_SQL_HOLES = f"{SQL_FEATURES}, holes AS (SELECT entity, win, event_count, " + ", ".join(f"CASE WHEN (win + {i}) % {m} <> 0 THEN {c} END AS {c}" for i, (c, m) in enumerate(zip(_HOLES, (4, 15, 100), strict=True))) + ", off_hours_ratio * 2 AS off_hours_ratio FROM feats)"


def holes(spark, d) -> DataFrame:
    df = feature_table(spark, d)
    return df.select("entity", "win", "event_count", *[F.when((F.col("win") + i) % m != 0, F.col(c)).alias(c) for i, (c, m) in enumerate(zip(_HOLES, (4, 15, 100), strict=True))], (F.col("off_hours_ratio") * 2).alias("off_hours_ratio"))


def _union(rows: str, names) -> str:
    return " UNION ALL ".join(rows.format(c=c) for c in names)


query("ds_missing", f"""WITH {_SQL_HOLES}, m AS ({_union("SELECT '{c}' AS \"column\", count(*) - count({c}) AS affected, count(*) AS total FROM holes", _HOLES)})
SELECT *, round(affected * 100.0 / total, 6) AS pct, CASE WHEN affected * 100.0 / total > 20 THEN 'FAIL' WHEN affected * 100.0 / total > 5 THEN 'WARN' ELSE 'PASS' END AS status FROM m""")(
    lambda spark, d: dataset_quality.check_missing(holes(spark, d), _HOLES).withColumn("pct", F.round("pct", 6)))
_RANGED = (*_HOLES, "off_hours_ratio")
query("ds_range", f"WITH {_SQL_HOLES} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count_if({c} < {dataset_quality.RANGES[c][0]} OR {c} > {dataset_quality.RANGES[c][1]}) AS affected, count(*) AS total, CASE WHEN count_if({c} < {dataset_quality.RANGES[c][0]} OR {c} > {dataset_quality.RANGES[c][1]}) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM holes" for c in dataset_quality.RANGES if c in _RANGED))(
    lambda spark, d: dataset_quality.check_ranges(holes(spark, d)))
query("ds_duplicates", f"""WITH {SQL_FEATURES}, h AS (SELECT entity, win_start // 3600000000 AS hour_no FROM feats),
x AS (SELECT 'duplicate_rows' AS check_name, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM h)) AS BIGINT) AS affected FROM h UNION ALL SELECT 'duplicate_keys', CAST(count(*) - count(DISTINCT entity) AS BIGINT) FROM h)
SELECT *, CASE WHEN affected > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM x""")(
    lambda spark, d: dataset_quality.check_duplicates(feature_table(spark, d, ()).select("entity", scalars.floor_div(F.col("win_start"), 3_600_000_000).alias("hour_no")), ["entity"]))
query("ds_schema", "SELECT * FROM (VALUES ('missing_columns', 'FAIL', 'generalized_ip', 1::BIGINT), ('extra_columns', 'WARN', 'win_start', 1::BIGINT)) AS t(check_name, status, details, affected)")(lambda spark, d: dataset_quality.check_schema(feature_table(spark, d), ["entity", "win", "event_count", *features.FEATURES, "generalized_ip"]))

_HALVES = "halves AS (SELECT value AS v, CASE WHEN event_id * 2 < (SELECT max(event_id) FROM events) THEN 'e' ELSE 'a' END AS side FROM events)"


def _halves(spark, d):
    e = table(spark, d, "events")
    top = e.agg(F.max("event_id").alias("top"))
    e = e.join(F.broadcast(top)).withColumn("old", F.col("event_id") * 2 < F.col("top")).select("value", "old")
    return e.filter("old").select("value"), e.filter("NOT old").select("value")


@query("drift_psi", f"""WITH {_HALVES}, b AS (SELECT side, min(v) AS lo, max(v) AS hi, count(*) AS n FROM halves GROUP BY side),
c AS (SELECT h.side, least(9, CAST(floor((v - lo) / ((hi - lo) / 10)) AS INTEGER)) AS bin, count(*) / any_value(n) AS p FROM halves h JOIN b USING (side) GROUP BY 1, 2),
g AS (SELECT bin, coalesce(max(CASE WHEN side = 'e' THEN p END), 1e-4) AS e, coalesce(max(CASE WHEN side = 'a' THEN p END), 1e-4) AS a FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN c USING (bin) GROUP BY bin),
s AS (SELECT sum((a - e) * ln(a / e)) AS psi FROM g)
SELECT 'value' AS feature, round(psi, 9) AS psi, CASE WHEN psi >= 0.25 THEN 'Significant' WHEN psi >= 0.1 THEN 'Moderate' ELSE 'No Drift' END AS status FROM s""")
def drift_psi(spark, d):
    return dataset_quality.psi(*_halves(spark, d), "value").withColumn("psi", F.round("psi", 9))


@query("drift_ks_stat", f"""WITH {_HALVES}, s AS (SELECT v, count_if(side = 'e') AS e, count_if(side = 'a') AS a FROM halves GROUP BY v),
r AS (SELECT sum(e) OVER (ORDER BY v) AS ce, sum(a) OVER (ORDER BY v) AS ca, sum(e) OVER () AS ne, sum(a) OVER () AS na FROM s)
SELECT CAST(max(ne) AS BIGINT) AS n_a, CAST(max(na) AS BIGINT) AS n_b, round(max(abs(ce / ne - ca / na)), 9) AS ks_stat FROM r""")
def drift_ks_stat(spark, d):
    return dataset_quality.ks_statistic(*_halves(spark, d), "value").withColumn("ks_stat", F.round("ks_stat", 9))


_DRIFT = ("value", "hour", "flat")
_KS_P = "CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * x * x))))) END"


@query("drift_table", f"""WITH sides AS (SELECT value, CAST(hour(ts) AS DOUBLE) AS hour, 1.0 AS flat, CASE WHEN event_id * 2 < (SELECT max(event_id) FROM events) THEN 'e' ELSE 'a' END AS side FROM events),
long AS ({_union("SELECT '{c}' AS feature, side, CAST({c} AS DOUBLE) AS v FROM sides WHERE {c} IS NOT NULL", _DRIFT)}),
b AS (SELECT feature, side, min(v) AS lo, max(v) AS hi, count(*) AS n FROM long GROUP BY ALL),
c AS (SELECT feature, side, CASE WHEN lo = hi THEN 5 ELSE least(9, CAST(floor((v - lo) / ((hi - lo) / 10)) AS INTEGER)) END AS bin, count(*) / any_value(n) AS p FROM long JOIN b USING (feature, side) GROUP BY 1, 2, 3),
g AS (SELECT f.feature, bin, coalesce(max(CASE WHEN side = 'e' THEN p END), 1e-4) AS e, coalesce(max(CASE WHEN side = 'a' THEN p END), 1e-4) AS a FROM (SELECT DISTINCT feature, unnest(range(10)) AS bin FROM b) f LEFT JOIN c USING (feature, bin) GROUP BY 1, 2),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM g GROUP BY 1),
s AS (SELECT feature, v, count_if(side = 'e') AS e, count_if(side = 'a') AS a FROM long GROUP BY 1, 2),
r AS (SELECT feature, sum(e) OVER w AS ce, sum(a) OVER w AS ca, sum(e) OVER (PARTITION BY feature) AS ne, sum(a) OVER (PARTITION BY feature) AS na FROM s WINDOW w AS (PARTITION BY feature ORDER BY v)),
k AS (SELECT feature, max(abs(ce / ne - ca / na)) AS d, sqrt(CAST(max(ne) AS DOUBLE) * max(na) / (max(ne) + max(na))) AS en FROM r GROUP BY 1),
x AS (SELECT feature, d, (en + 0.12 + 0.11 / en) * d AS x FROM k)
SELECT feature, round(psi, 9) AS psi, round(d, 9) AS ks_stat, round({_KS_P}, 9) AS ks_pvalue, CASE WHEN psi >= 0.25 THEN 'Significant' WHEN psi >= 0.1 THEN 'Moderate' ELSE 'No Drift' END AS status FROM psi JOIN x USING (feature)""")
def drift_table(spark, d):
    e = table(spark, d, "events")
    e = e.join(F.broadcast(e.agg(F.max("event_id").alias("top")))).select("value", F.hour("ts").cast("double").alias("hour"), F.lit(1.0).alias("flat"), "event_type", (F.col("event_id") * 2 < F.col("top")).alias("old"))
    out = dataset_quality.drift_table(e.filter("NOT old").drop("old"), e.filter("old").drop("old").withColumn("only_there", F.lit(1)))
    return out.withColumns({c: F.round(c, 9) for c in ("psi", "ks_stat", "ks_pvalue")})


# exploration ---------------------------------------------------------------------------------------------------------
KINDS = ("click", "error", "purchase", "signup", "view")
query("eda_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")(lambda spark, d: exploration.value_counts(table(spark, d, "events"), "event_type"))
query("eda_hourly", "SELECT CAST(hour(ts) AS INTEGER) AS hour, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda spark, d: table(spark, d, "events").groupBy(F.hour("ts").alias("hour"), F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n")))
query("eda_pivot", "SELECT CAST(hour(ts) AS INTEGER) AS hour, " + ", ".join(f"count_if(event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1")(lambda spark, d: exploration.hour_by_type(table(spark, d, "events"), "ts", "event_type", KINDS))
_NUM = ("quantity", "price", "discount", "tax")
query("eda_describe", f"WITH {ad.FLOWS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, min({c}) AS \"min\", round(quantile_cont({c}, 0.25), 3) AS p25, round(quantile_cont({c}, 0.5), 3) AS p50, round(quantile_cont({c}, 0.75), 3) AS p75, max({c}) AS \"max\" FROM flows" for c in _NUM))(
    lambda spark, d: exploration.describe(ad.flows(spark, d), _NUM).withColumns({c: F.round(c, 3) for c in ("mean", "std", "p25", "p50", "p75")}))
query("eda_profile", "SELECT 'event_type' AS \"column\", count(DISTINCT event_type) AS n_unique, min(event_type) AS \"min\", max(event_type) AS \"max\", count(event_type) * 100.0 / count(*) AS completeness FROM events UNION ALL SELECT 'user_id', count(DISTINCT user_id), CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR), count(user_id) * 100.0 / count(*) FROM events")(
    lambda spark, d: exploration.profile(table(spark, d, "events"), ("event_type", "user_id")).withColumn("completeness", F.col("completeness").cast("double")))
_PAIRS = [(a, b) for i, a in enumerate((*_NUM, "label")) for b in (*_NUM, "label")[i + 1 :]]
query("eda_corr", f"WITH {ad.FLOWS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM flows" for a, b in _PAIRS))(
    lambda spark, d: exploration.correlations(ad.flows(spark, d), (*_NUM, "label")).withColumn("r", F.round("r", 6)))
query("eda_corr_strong", f"WITH {ad.FLOWS}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM flows" for a, b in _PAIRS) + ") SELECT * FROM c WHERE abs(r) > 0.002")(
    lambda spark, d: exploration.correlations(ad.flows(spark, d), (*_NUM, "label")).withColumn("r", F.round("r", 6)).filter("abs(r) > 0.002"))
query("eda_iqr", f"WITH {ad.FLOWS}, q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM flows), b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q) SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(lower, 4) AS lower, round(upper, 4) AS upper, count_if(price < lower OR price > upper) AS outliers, round(count_if(price < lower OR price > upper) * 100.0 / count(*), 6) AS pct FROM flows, b GROUP BY q1, q3, lower, upper")(
    lambda spark, d: exploration.iqr_outliers(ad.flows(spark, d), "price").withColumns({c: F.round(c, 4) for c in ("q1", "q3", "lower", "upper")} | {"pct": F.round(F.col("pct").cast("double"), 6)}))
query("eda_topk", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 15")(lambda spark, d: exploration.value_counts(table(spark, d, "events"), "user_id", 15))
_RULES = {"geo": "geo_velocity > 800", "logins": "failed_login_ratio > 0.5", "entropy": "dns_query_entropy > 3.5", "exfil": "data_exfil_ratio > 10", "off_hours": "off_hours_ratio > 0.8", "privilege": "privilege_escalation_score > 0"}
query("threshold_alerts", f"WITH {SQL_FEATURES} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count_if({v}) AS n FROM feats" for k, v in _RULES.items()))(
    lambda spark, d: exploration.alerts(feature_table(spark, d), {k: F.expr(v) for k, v in _RULES.items()}))
query("eda_top_alerts", f"WITH {SQL_FEATURES} SELECT entity, win, geo_velocity FROM feats WHERE geo_velocity > 800 ORDER BY geo_velocity DESC, entity, win LIMIT 10")(
    lambda spark, d: feature_table(spark, d, ("geo_velocity",)).filter("geo_velocity > 800").orderBy(F.desc("geo_velocity"), "entity", "win").limit(10).select("entity", "win", "geo_velocity"))
query("union_by_name", "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")(
    lambda spark, d: table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True))

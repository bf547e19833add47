"""The driver's tables in the shapes of security telemetry; for each, the same in DuckDB SQL (a WITH item).

Only whole-number arithmetic, so both engines give the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.session import table

NOW = "2025-01-05 00:00:00"

SEC_EVENTS = """sec_events AS (
  SELECT event_id AS seq, 'u' || CAST(user_id % 4 AS VARCHAR) AS entity, epoch_us(ts) AS us,
    CASE WHEN event_type IN ('signup', 'error') THEN 'auth' WHEN event_type = 'click' THEN 'network' WHEN event_type = 'view' THEN 'dns' ELSE 'endpoint' END AS event_type,
    CASE WHEN event_type IN ('signup', 'error') THEN 'login' END AS action,
    CASE WHEN event_type = 'signup' THEN 'success' WHEN event_type = 'error' THEN 'failure' END AS status,
    CASE WHEN event_type IN ('signup', 'error') AND event_id % 3 <> 0 THEN CAST((event_id * 37) % 120 - 60 AS DOUBLE) END AS lat,
    CASE WHEN event_type IN ('signup', 'error') AND event_id % 3 <> 0 THEN CAST((event_id * 53) % 300 - 150 AS DOUBLE) END AS lon,
    CASE WHEN event_type = 'click' THEN (event_id * 7919) % 1024 END AS dest_port,
    CASE WHEN event_type = 'click' THEN CAST(floor(value * 100) AS BIGINT) END AS bytes_sent,
    CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 END AS bytes_received,
    CASE WHEN event_type = 'view' THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 12) || '.com' END AS query,
    CASE WHEN event_type = 'purchase' AND value > 100 THEN 'user_to_admin' END AS privilege_change
  FROM events)"""


def sec_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.col("event_type")
    auth = kind.isin("signup", "error")
    placed = auth & (F.col("event_id") % 3 != 0)
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("entity"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.when(auth, "auth").when(kind == "click", "network").when(kind == "view", "dns").otherwise("endpoint").alias("event_type"),
        F.when(auth, "login").alias("action"),
        F.when(kind == "signup", "success").when(kind == "error", "failure").alias("status"),
        F.when(placed, ((F.col("event_id") * 37) % 120 - 60).cast("double")).alias("lat"),
        F.when(placed, ((F.col("event_id") * 53) % 300 - 150).cast("double")).alias("lon"),
        F.when(kind == "click", (F.col("event_id") * 7919) % 1024).alias("dest_port"),
        F.when(kind == "click", F.floor(F.col("value") * 100)).alias("bytes_sent"),
        F.when(kind == "click", F.get_json_object("props", "$.k").cast("long") * 100).alias("bytes_received"),
        F.when(kind == "view", F.concat(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 12), F.lit(".com"))).alias("query"),
        F.when((kind == "purchase") & (F.col("value") > 100), "user_to_admin").alias("privilege_change"),
    )


_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
LOG_LINES = f"""log_lines AS (
  SELECT event_id + 1 AS line_number, CASE
    WHEN event_id % 200 = 0 THEN 'noise ' || CAST(event_id AS VARCHAR)
    WHEN event_id % 200 = 101 THEN {_STAMP} || ',10.0.0.1,ALLOW'
    WHEN event_id % 200 = 103 THEN 'query_time=' || {_STAMP} || '|client=10.0.0.1'
    WHEN event_id % 200 = 105 THEN 'never user host SUCCESS x y'
    WHEN event_id % 3 = 0 THEN replace({_STAMP}, ' ', 'T') || 'Z,192.168.' || CAST(event_id % 7 AS VARCHAR) || '.' || CAST(event_id % 300 AS VARCHAR) || ', 8.8.' || CAST(event_id % 5 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) || ',' || CAST((event_id * 13) % 70000 AS VARCHAR) || ',' || CASE WHEN event_id % 2 = 0 THEN 'ALLOW' ELSE 'deny' END || ',' || CAST(CAST(floor(value * 100) AS BIGINT) - 500 AS VARCHAR)
    WHEN event_id % 3 = 1 THEN {_STAMP} || ' user' || CAST(user_id AS VARCHAR) || ' host' || CAST(event_id % 5 AS VARCHAR) || ' ' || CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'FAILURE' END || ' 203.0.113.' || CAST(event_id % 300 AS VARCHAR)
    ELSE 'query_time=' || replace({_STAMP}, ' ', 'T') || 'Z | client = 172.16.' || CAST(event_id % 4 AS VARCHAR) || '.' || CAST(event_id % 280 AS VARCHAR) || '|domain=d' || CAST(event_id % 11 AS VARCHAR) || '.example.com|type=A' || CASE event_id % 4 WHEN 0 THEN '|response=NXDOMAIN' WHEN 1 THEN '|response=a=b' WHEN 2 THEN '|response=' ELSE '' END
  END AS line FROM events)"""


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines of all three formats, with malformed ones of each kind."""
    n, s, v = F.col("event_id"), lambda c: c.cast("string"), F.col("value")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    iso = F.concat(F.replace(stamp, F.lit(" "), F.lit("T")), F.lit("Z"))
    cat = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    line = (
        F.when(n % 200 == 0, cat("noise ", s(n)))
        .when(n % 200 == 101, cat(stamp, ",10.0.0.1,ALLOW"))
        .when(n % 200 == 103, cat("query_time=", stamp, "|client=10.0.0.1"))
        .when(n % 200 == 105, F.lit("never user host SUCCESS x y"))
        .when(n % 3 == 0, cat(iso, ",192.168.", s(n % 7), ".", s(n % 300), ", 8.8.", s(n % 5), ".", s(n % 256), ",", s((n * 13) % 70000), ",", F.when(n % 2 == 0, "ALLOW").otherwise("deny"), ",", s(F.floor(v * 100) - 500)))
        .when(n % 3 == 1, cat(stamp, " user", s(F.col("user_id")), " host", s(n % 5), " ", F.when(n % 2 == 0, "success").otherwise("FAILURE"), " 203.0.113.", s(n % 300)))
        .otherwise(cat("query_time=", iso, " | client = 172.16.", s(n % 4), ".", s(n % 280), "|domain=d", s(n % 11), ".example.com|type=A", F.when(n % 4 == 0, "|response=NXDOMAIN").when(n % 4 == 1, "|response=a=b").when(n % 4 == 2, "|response=").otherwise("")))
    )
    return table(spark, d, "events").select((n + 1).alias("line_number"), line.alias("line"))


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = f"^{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}$"
_GOOD_TS = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}Z?$"
#: parsed: the log lines taken apart in SQL.
PARSED = f"""{LOG_LINES},
kinds AS (SELECT line_number, trim(line) AS s, CASE WHEN contains(line, 'query_time=') AND contains(line, '|') THEN 'dns'
    WHEN contains(line, ',') AND (contains(upper(line), 'ALLOW') OR contains(upper(line), 'DENY')) THEN 'firewall'
    WHEN (contains(upper(line), 'SUCCESS') OR contains(upper(line), 'FAILURE')) AND len(string_split(trim(line), ' ')) >= 6 THEN 'auth' END AS k FROM log_lines),
cut AS (SELECT *, list_transform(string_split(s, ','), lambda x: trim(x)) AS f, string_split(s, ' ') AS t,
    nullif(regexp_extract(s, 'query_time *= *([^|]*)', 1), '') AS q_time, nullif(trim(regexp_extract(s, 'client *= *([^|]*)', 1)), '') AS q_client,
    nullif(trim(regexp_extract(s, 'domain *= *([^|]*)', 1)), '') AS q_domain, nullif(trim(regexp_extract(s, 'type *= *([^|]*)', 1)), '') AS q_type,
    CASE WHEN contains(s, '|response=') THEN trim(regexp_extract(s, 'response *= *([^|]*)', 1)) END AS q_reply FROM kinds),
raw AS (SELECT *, CASE k WHEN 'firewall' THEN f[1] WHEN 'auth' THEN t[1] || ' ' || t[2] WHEN 'dns' THEN trim(q_time) END AS r_ts,
    CASE k WHEN 'firewall' THEN f[2] WHEN 'auth' THEN t[6] WHEN 'dns' THEN q_client END AS src, CASE WHEN k = 'firewall' THEN f[3] END AS dst,
    upper(CASE k WHEN 'firewall' THEN f[5] WHEN 'auth' THEN t[5] END) AS verb FROM cut),
coded AS (SELECT *, CASE WHEN k IS NULL THEN 'unknown_format' WHEN k = 'firewall' AND len(f) <> 6 THEN 'field_count'
    WHEN k = 'dns' AND (q_time IS NULL OR q_client IS NULL OR q_domain IS NULL OR q_type IS NULL) THEN 'missing_fields'
    WHEN NOT coalesce(regexp_matches(r_ts, '{_GOOD_TS}'), false) THEN 'timestamp'
    WHEN NOT coalesce(regexp_matches(src, '{V4}'), false) THEN 'source_ip'
    WHEN k = 'firewall' AND NOT coalesce(regexp_matches(dst, '{V4}'), false) THEN 'target_ip'
    WHEN k = 'firewall' AND NOT coalesce(TRY_CAST(f[4] AS INT) BETWEEN 0 AND 65535, false) THEN 'port'
    WHEN k = 'firewall' AND TRY_CAST(f[6] AS BIGINT) IS NULL THEN 'bytes'
    WHEN k = 'firewall' AND verb NOT IN ('ALLOW', 'DENY') THEN 'action'
    WHEN k = 'auth' AND verb NOT IN ('SUCCESS', 'FAILURE') THEN 'status' END AS error_code FROM raw),
parsed AS (SELECT line_number, s AS original_line, error_code, k AS log_type, replace(replace(r_ts, ' ', 'T'), 'Z', '') || 'Z' AS "timestamp", src AS source_ip, dst AS target_ip,
    CASE WHEN k = 'auth' THEN t[3] END AS "user",
    CASE WHEN k = 'dns' THEN CASE WHEN coalesce(q_reply, '') <> '' THEN 'RESPONSE' ELSE 'QUERY' END ELSE verb END AS action,
    CASE WHEN k = 'dns' THEN CASE WHEN coalesce(q_reply, '') = '' THEN 'unknown' WHEN q_reply IN ('NXDOMAIN', 'SERVFAIL') THEN 'failure' ELSE 'success' END
      WHEN verb IN ('ALLOW', 'SUCCESS') THEN 'success' ELSE 'failure' END AS status,
    CASE WHEN k = 'firewall' THEN CAST(f[6] AS BIGINT) END AS bytes, CASE WHEN k = 'dns' THEN q_domain END AS dns_domain, CASE WHEN k = 'dns' THEN q_type END AS dns_type, CASE WHEN k = 'dns' THEN q_reply END AS dns_response
  FROM coded)"""

NORM_EVENTS = f"""norm_events AS (
  SELECT event_id + 1 AS line_number,
    CASE WHEN event_id % 97 = 5 THEN NULL WHEN event_id % 50 = 7 THEN 'e' || CAST(event_id - 7 AS VARCHAR) ELSE 'e' || CAST(event_id AS VARCHAR) END AS event_id,
    CASE WHEN event_id % 89 = 3 THEN '' WHEN event_id % 83 = 4 THEN 'yesterday' WHEN event_id % 79 = 6 THEN '2099-01-01T00:00:00Z' ELSE replace({_STAMP}, ' ', 'T') || 'Z' END AS "timestamp",
    CASE WHEN event_id % 61 = 2 THEN '999.1.2.3' WHEN event_id % 3 = 0 THEN '10.0.0.' || CAST(user_id % 4 AS VARCHAR) ELSE '8.8.8.' || CAST(user_id % 4 AS VARCHAR) END AS source_ip,
    CASE WHEN event_id % 71 = 1 THEN 'host' WHEN event_id % 2 = 0 THEN '1.1.1.1' END AS target_ip,
    CASE WHEN event_id % 3 = 0 THEN 'DENY' WHEN event_id % 3 = 1 THEN 'FAILURE' ELSE 'QUERY' END AS action,
    CASE WHEN event_id % 5 = 0 THEN 'success' ELSE 'failure' END AS status,
    CASE WHEN event_id % 3 = 0 THEN 'firewall' WHEN event_id % 3 = 1 THEN 'auth' ELSE 'dns' END AS log_type,
    CASE WHEN event_id % 40 = 1 THEN -5 WHEN event_id % 43 = 1 THEN 1099511627777 WHEN event_id % 3 = 0 THEN CAST(floor(value * 100) AS BIGINT) END AS bytes,
    CASE WHEN event_id % 4 = 0 THEN 'host corporate-vpn' ELSE 'host plain' END AS original_line
  FROM events)"""


def norm_events(spark: SparkSession, d: str) -> DataFrame:
    """Normalised events with faults of every rule."""
    n, s = F.col("event_id"), lambda c: c.cast("string")
    return table(spark, d, "events").select(
        (n + 1).alias("line_number"),
        F.when(n % 97 == 5, None).when(n % 50 == 7, F.concat(F.lit("e"), s(n - 7))).otherwise(F.concat(F.lit("e"), s(n))).alias("event_id"),
        F.when(n % 89 == 3, "").when(n % 83 == 4, "yesterday").when(n % 79 == 6, "2099-01-01T00:00:00Z").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.when(n % 61 == 2, "999.1.2.3").when(n % 3 == 0, F.concat(F.lit("10.0.0."), s(F.col("user_id") % 4))).otherwise(F.concat(F.lit("8.8.8."), s(F.col("user_id") % 4))).alias("source_ip"),
        F.when(n % 71 == 1, "host").when(n % 2 == 0, "1.1.1.1").alias("target_ip"),
        F.when(n % 3 == 0, "DENY").when(n % 3 == 1, "FAILURE").otherwise("QUERY").alias("action"),
        F.when(n % 5 == 0, "success").otherwise("failure").alias("status"),
        F.when(n % 3 == 0, "firewall").when(n % 3 == 1, "auth").otherwise("dns").alias("log_type"),
        F.when(n % 40 == 1, F.lit(-5).cast("long")).when(n % 43 == 1, F.lit(1099511627777)).when(n % 3 == 0, F.floor(F.col("value") * 100)).alias("bytes"),
        F.when(n % 4 == 0, "host corporate-vpn").otherwise("host plain").alias("original_line"),
    )


INDICATORS = """indicators AS (
  SELECT page_id * 4 AS seq, url AS indicator FROM pages
  UNION ALL SELECT page_id * 4 + 1, regexp_extract(url, '^https?://([^/:?#]*)', 1) FROM pages
  UNION ALL SELECT doc_id * 4 + 2, CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE sha256(text) END FROM documents
  UNION ALL SELECT event_id * 4 + 3, CASE WHEN event_id % 5 = 0 THEN '300.1.1.' ELSE '45.' || CAST(user_id % 200 AS VARCHAR) || '.7.' END || CAST(user_id % 90 AS VARCHAR) FROM events)"""


def indicators(spark: SparkSession, d: str) -> DataFrame:
    pages, docs, e = (table(spark, d, t) for t in ("pages", "documents", "events"))
    n, s = F.col("event_id"), lambda c: c.cast("string")
    host = F.regexp_extract("url", "^https?://([^/:?#]*)", 1)
    digest = F.when(F.col("doc_id") % 2 == 0, F.md5(F.col("text").cast("binary"))).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    ip = F.concat(F.when(n % 5 == 0, "300.1.1.").otherwise(F.concat(F.lit("45."), s(F.col("user_id") % 200), F.lit(".7."))), s(F.col("user_id") % 90))
    parts = [pages.select((F.col("page_id") * 4).alias("seq"), F.col("url").alias("indicator")), pages.select(F.col("page_id") * 4 + 1, host), docs.select(F.col("doc_id") * 4 + 2, digest), e.select(n * 4 + 3, ip)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


FEEDS = """feeds AS (
  SELECT 'ip' || CAST(p_partkey AS VARCHAR) AS indicator, CASE p_partkey % 5 WHEN 0 THEN 'ipv4' WHEN 1 THEN 'domain' WHEN 2 THEN 'hash' WHEN 3 THEN 'url' ELSE 'unknown' END AS type,
    p_partkey % 7 <> 3 AS vt_ok, (p_partkey * 11) % 9 AS m, (p_partkey * 5) % 6 AS s, p_partkey % 8 <> 5 AS ab_ok, (p_partkey * 17) % 101 AS score, p_partkey % 6 = 0 AS white,
    p_partkey % 9 <> 4 AS otx_ok, (p_partkey * 3) % 10 AS pulses, (p_partkey * 7) % 4 AS crit, p_partkey % 4 AS n_sources, (p_partkey * 29) % 45 AS age_days FROM part)"""


def feeds(spark: SparkSession, d: str) -> DataFrame:
    """indicator, type, the three payload structs, the number of sources and days since the last sight."""
    p = F.col("p_partkey")
    ok = lambda c: F.when(c, "success").otherwise("error").alias("status")
    n = lambda c, name: c.cast("long").alias(name)
    tags = F.slice(F.array(F.lit("Botnet-x"), F.lit("c2"), F.lit("PHISHING kit"), F.lit("benign")), 1, (p * 7 % 4).cast("int"))
    kind = F.when(p % 5 == 0, "ipv4").when(p % 5 == 1, "domain").when(p % 5 == 2, "hash").when(p % 5 == 3, "url").otherwise("unknown")
    return table(spark, d, "part").select(
        F.concat(F.lit("ip"), p.cast("string")).alias("indicator"),
        kind.alias("type"),
        F.struct(ok(p % 7 != 3), n(p * 11 % 9, "malicious"), n(p * 5 % 6, "suspicious")).alias("vt"),
        F.struct(ok(p % 8 != 5), n(p * 17 % 101, "score"), (p % 6 == 0).alias("is_whitelisted")).alias("abuse"),
        F.struct(ok(p % 9 != 4), n(p * 3 % 10, "pulse_count"), tags.alias("tags")).alias("otx"),
        F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (p % 4).cast("int")).alias("sources"),
        (p * 29 % 45).alias("age_days"),
    )


IOCS = """iocs AS (
  SELECT o_orderkey AS seq, 'i' || CAST(o_orderkey AS VARCHAR) AS indicator, CASE o_orderkey % 5 WHEN 0 THEN 'ipv4' WHEN 1 THEN 'domain' WHEN 2 THEN 'url' WHEN 3 THEN 'hash' ELSE 'other' END AS type,
    o_orderdate AS first_seen, o_orderdate + INTERVAL 10 DAY AS last_seen,
    o_orderdate + CAST(CASE o_orderkey % 5 WHEN 0 THEN 40 WHEN 1 THEN 70 WHEN 3 THEN 190 ELSE 40 END AS INTEGER) * INTERVAL 1 DAY AS expiration,
    CAST((o_orderkey * 13) % 101 AS INTEGER) AS risk_score, CAST((o_orderkey * 7) % 101 AS INTEGER) AS confidence,
    CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'expired' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'revoked' ELSE 'active' END END AS status FROM orders)"""


def iocs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, "ipv4").when(k % 5 == 1, "domain").when(k % 5 == 2, "url").when(k % 5 == 3, "hash").otherwise("other")
    at = F.col("o_orderdate").cast("timestamp")
    days = F.when(k % 5 == 1, 70).when(k % 5 == 3, 190).otherwise(40)
    risk = (k * 13 % 101).cast("int")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "expired").when(k % 2 == 0, "revoked").otherwise("active")
    tier = F.when(risk >= 75, "CRITICAL").when(risk >= 50, "HIGH").when(risk >= 20, "SUSPICIOUS").otherwise("CLEAN")
    return table(spark, d, "orders").select(k.alias("seq"), F.concat(F.lit("i"), k.cast("string")).alias("indicator"), kind.alias("type"), at.alias("first_seen"), F.timestamp_add("DAY", F.lit(10), at).alias("last_seen"), F.timestamp_add("DAY", days, at).alias("expiration"), risk.alias("risk_score"), (k * 7 % 101).cast("int").alias("confidence"), status.alias("status"), tier.alias("risk_tier"), F.array(F.lit("t1"), F.concat(F.lit("t"), (k % 9).cast("string"))).alias("tags"))


FLOWS = """flows AS (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS price, l_discount + 0.0 AS discount, l_tax + 0.0 AS tax, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"""


def flows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), (F.col("l_discount") + 0.0).alias("discount"), (F.col("l_tax") + 0.0).alias("tax"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


SCORED = """scored AS (SELECT d.doc_id, l.toxic AS y, d.n_chars % 97 / 97.0 AS score, d.source AS category FROM labels l JOIN documents d USING (doc_id))"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a score that has ties. The column `score` is a double on both sides."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.col("source").alias("category"))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("toxic").alias("y"), (F.col("n_chars") % 97 / 97.0).alias("score"), "category")
